"""Stock on hand from movements, and its comparison with the reorder point.

An extension: the analysis this follows only names the comparison. Every line moves stock:
shipped units leave it, returned units come back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skumetry.policy import Policy


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], at: str, columns: Sequence[str], period: str = "month") -> DataFrame:
    """``left`` with ``columns`` of the last row of ``right`` with the same key at or before its own time.

    Rows without such a row, without a key or without a time get nulls. Of several rows of
    ``right`` with one key and time the greatest ``columns`` count. Both tables have the columns
    ``by`` and ``at``; ``columns`` must have other names.

    Rows are gathered by key and ``period``, so a key with a long history is spread over tasks; what
    a period inherits is the last row of the periods before it, one row for each key and period.
    """
    by = list(by)
    bucket = F.date_trunc(period, F.col(at)).alias("_period")
    facts = right.groupBy(*by, at).agg(F.max(F.struct(*columns)).alias("_fact"))
    asked = left.select(*by, at, F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_row"))
    events = facts.select(*by, at, bucket, F.lit(0).alias("_kind"), "_fact").unionByName(
        asked.select(*by, at, bucket, F.lit(1).alias("_kind"), "_row"), allowMissingColumns=True
    )
    so_far = Window.partitionBy(*by, "_period").orderBy(at, "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = events.withColumn("_seen", F.last("_fact", ignorenulls=True).over(so_far)).where(F.col("_row").isNotNull())
    earlier = Window.partitionBy(*by).orderBy("_period").rowsBetween(Window.unboundedPreceding, -1)
    last_of_period = F.max(F.when(F.col("_fact").isNotNull(), F.struct(at, "_fact")))["_fact"]
    periods = events.groupBy(*by, "_period").agg(last_of_period.alias("_last"))
    inherited = periods.select(*by, "_period", F.last("_last", ignorenulls=True).over(earlier).alias("_inherited"))
    found = F.coalesce("_seen", "_inherited")
    joined = seen.join(inherited, [*by, "_period"], "left")
    return joined.select("_row.*", *[found[c].alias(c) for c in columns])


def stock_movements(lines: DataFrame) -> DataFrame:
    """Units received and issued by each SKU on each day; returned lines have negative quantities."""
    quantity = F.col("quantity").cast("long")
    return lines.where("quantity <> 0").groupBy("stock_code", F.to_date("invoice_date").alias("day")).agg(
        F.coalesce(F.sum(F.when(quantity < 0, -quantity)), F.lit(0).cast("long")).alias("received"),
        F.coalesce(F.sum(F.when(quantity > 0, quantity)), F.lit(0).cast("long")).alias("issued"),
    )


def ledger(movements: DataFrame) -> DataFrame:
    """Units received and issued up to the end of each day with a movement.

    A SKU has one row a day, so the days of the calendar bound a window.
    """
    so_far = Window.partitionBy("stock_code").orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return movements.select(
        "stock_code", "day", F.sum("received").over(so_far).alias("received_to_date"), F.sum("issued").over(so_far).alias("issued_to_date")
    )


def month_ends(movements: DataFrame) -> DataFrame:
    """``stock_code`` and ``day``: the last day of every month from a SKU's first to its last movement."""
    span = movements.groupBy("stock_code").agg(F.trunc(F.min("day"), "month").alias("first"), F.trunc(F.max("day"), "month").alias("last"))
    months = F.sequence("first", "last", F.expr("INTERVAL 1 MONTH"))
    return span.select("stock_code", F.explode(F.transform(months, F.last_day)).alias("day"))


def stock_gap(rop: DataFrame, movements: DataFrame, reviews: DataFrame, policy: Policy) -> DataFrame:
    """Stock on hand of each SKU of ``rop`` at each review day against its reorder point.

    Stock begins with ``policy.opening_stock_weeks`` weeks of mean demand, rounded up, and follows
    the movements up to the end of the review day; before the first movement it is the opening
    stock. It may fall below zero: units are then owed.
    """
    opening = F.ceil(F.col("weekly_demand_mean") * policy.opening_stock_weeks).cast("long")
    skus = rop.select("stock_code", "abc_class", "abc_xyz", opening.alias("opening_stock"), F.col("reorder_point").cast("long").alias("reorder_point"))
    balance = asof_join(reviews, ledger(movements), ["stock_code"], "day", ["received_to_date", "issued_to_date"])
    received, issued = (F.coalesce(c, F.lit(0).cast("long")) for c in ("received_to_date", "issued_to_date"))
    on_hand = F.col("opening_stock") + received - issued
    return balance.join(skus, "stock_code").select(
        "stock_code", "abc_class", "abc_xyz", F.col("day").alias("review_day"), "opening_stock", received.alias("received_to_date"),
        issued.alias("issued_to_date"), on_hand.alias("stock_on_hand"), "reorder_point", (on_hand - F.col("reorder_point")).alias("stock_gap"),
        (on_hand < F.col("reorder_point")).alias("below_reorder_point"),
    )
