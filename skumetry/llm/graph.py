"""Connected components by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skumetry.llm.shared import discard, stored


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) for every node of the links ``a``, ``b``.

    Each round maps every node to the smallest node next to it, follows these steps twice more,
    and replaces the links by the links between what they lead to, until none is left. Only
    grouped minima and joins are used; nothing is gathered in one place.
    """
    edges = stored(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stored(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
    while not edges.isEmpty():
        steps = stored(edges.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("to")))
        for _ in range(2):
            further = steps.select(F.col("a").alias("to"), F.col("to").alias("next"))
            former, steps = steps, stored(steps.join(further, "to").select("a", F.col("next").alias("to")))
            discard(former)
        former_labels, former_edges = labels, edges
        labels = stored(
            labels.join(steps.withColumnRenamed("a", "component"), "component", "left")
            .select("node", F.coalesce("to", "component").alias("component"))
        )
        edges = stored(
            edges.join(steps, "a").select(F.col("to").alias("a"), "b")
            .join(steps.select(F.col("a").alias("b"), F.col("to").alias("c")), "b")
            .select("a", F.col("c").alias("b")).where("a <> b").distinct()
        )
        discard(former_labels, former_edges, steps)
    discard(edges)
    return labels
