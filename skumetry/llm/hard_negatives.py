"""Hard negatives within score windows by slot-decomposed selection (operator 13).

An anchor's positives are its best rows of the same label. The negatives of a positive are the
best rows of another label whose score lies in a window below the positive's. The windows of
one anchor overlap. Their upper limits split the scores into disjoint slots; every task keeps
the best rows of each slot, and merging the slots from a window's upper limit downwards gives
its best rows: those of the slots below a limit are the best below it, and cutting them at the
lower limit leaves the window's best.

Anchors are taken in blocks of bounded size; each block is sent to the tasks, which read every
row once in tiles, so rows are never shuffled. Tasks hand on a bounded number of rows for each
anchor and slot.

Defined results. Rows with a null id, label or vector, an empty vector, or a null or non-finite
component take no part. An anchor is compared with rows of its own length and of another id.
Repeated rows are ranked one after the other; repeated equal anchors count once. Scores beyond
64 bits count as the nearest long. A positive with a score below 0 has an empty window.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skumetry.llm.shared import stored
from skumetry.llm.tiles import HIGHEST, LOWEST, Best, Vectors, by_length

#: Anchors of a block (about), anchors of a tile.
BLOCK, TILE = 4096, 256


def usable_rows(vectors: DataFrame, label: Column) -> DataFrame:
    """``vec_id``, ``label`` and ``x``, an array of double, of every row that takes part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    wanted = F.col("vec_id").isNotNull() & label.isNotNull() & F.col("embedding").isNotNull()
    return vectors.where(wanted).where(finite & (F.size("embedding") > 0)).select(
        F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"),
        F.transform("embedding", lambda x: x.cast("double")).alias("x"),
    )


class _Block:
    """A block of anchors on a task: numbers, ids, labels and vectors by length."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: list[list[float]]):
        self.ids, self.labels = ids, labels
        self.tiles: dict[int, list[tuple[np.ndarray, Vectors]]] = {}
        lengths = np.array([len(v) for v in vectors])
        for length in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths == length)
            cuts = [rows[i: i + TILE] for i in range(0, len(rows), TILE)]
            self.tiles[length] = [(cut, Vectors(np.array([vectors[i] for i in cut], np.float64))) for cut in cuts]

    def scored(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each tile: anchors, ids of rows, scores, whether labels are equal, whether ids differ."""
        for batch in batches:
            ids, labels = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
            for rows, x in by_length(batch.column("x")):
                tiles = self.tiles.get(x.shape[1], ())
                held = Vectors(x) if tiles else None
                for anchors, tile in tiles:
                    same = self.labels[anchors][:, None] == labels[rows][None, :]
                    other = self.ids[anchors][:, None] != ids[rows][None, :]
                    yield anchors, ids[rows], tile.scores(held), same, other


def _batch(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns.values()], list(columns))


def _first(found: DataFrame, groups: list[str], k: int) -> DataFrame:
    """The ``k`` best rows of each group, with ``place`` from 1."""
    place = F.row_number().over(W.partitionBy(*groups).orderBy(F.desc("score"), "id"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def slot_limits(positive_scores: np.ndarray, low: int, high: int) -> tuple[np.ndarray, int]:
    """The falling upper limits of an anchor's slots, and the least score that any window reaches."""
    wanted = [int(s) for s in positive_scores if s >= 0]
    limits = sorted({high * s // 100 for s in wanted}, reverse=True)
    return np.array(limits, np.int64), min((-(-low * s // 100) for s in wanted), default=HIGHEST)


def hard_negatives(
    vectors: DataFrame, label: Column, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    A negative's score is ``low`` to ``high`` hundredths of the positive's. ``vectors`` has
    ``vec_id`` and ``embedding``; ``label`` and ``is_anchor`` are expressions over it.
    """
    rows = stored(usable_rows(vectors, label))
    chosen = rows.where(is_anchor).dropDuplicates(["vec_id", "label", "x"])
    blocks = chosen.count() // BLOCK + 1
    chosen = stored(chosen.withColumn("block", F.pmod(F.xxhash64("vec_id", "label", "x"), F.lit(blocks))))
    return reduce(DataFrame.unionByName, [
        _of_block(rows, chosen.where(F.col("block") == b), positives, negatives, low, high) for b in range(blocks)
    ])


def _of_block(rows: DataFrame, chosen: DataFrame, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    anchors = chosen.orderBy("vec_id", "label", "x").collect()  # about BLOCK rows
    ids = np.array([a.vec_id for a in anchors], np.int64)
    labels = np.array([a.label for a in anchors], np.int64)
    given = [a.x for a in anchors]

    def best_positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(ids), positives)
        for at, others, scores, same, other in _Block(ids, labels, given).scored(batches):
            best.add(at, scores, others, same & other)
        number, found, scores = best.rows()
        yield _batch({"anchor": number, "id": found, "score": scores})

    found = rows.mapInArrow(best_positives, "anchor long, id long, score long")
    near = stored(_first(found, ["anchor"], positives))
    scores_of = {}
    for row in near.collect():  # at most BLOCK * positives rows
        scores_of.setdefault(row.anchor, []).append(row.score)
    # A line for each anchor: falling upper limits, then what no score is below.
    limits = np.full((len(ids), positives + 1), LOWEST, np.int64)
    floors = np.full(len(ids), HIGHEST, np.int64)
    for anchor, scores in scores_of.items():
        own, floors[anchor] = slot_limits(np.array(scores), low, high)
        limits[anchor, : len(own)] = own

    def best_of_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(ids) * positives, negatives)
        for at, others, scores, same, other in _Block(ids, labels, given).scored(batches):
            allowed = ~same & other & (scores >= floors[at][:, None])
            for slot in range(positives):
                upper, below = limits[at, slot][:, None], limits[at, slot + 1][:, None]
                best.add(at * positives + slot, scores, others, allowed & (scores <= upper) & (scores > below))
        number, found, scores = best.rows()
        yield _batch({"anchor": number // positives, "slot": number % positives, "id": found, "score": scores})

    found = rows.mapInArrow(best_of_slots, "anchor long, slot long, id long, score long")
    kept = _first(found, ["anchor", "slot"], negatives)
    # At most positives * negatives rows for each anchor; best first is slot after slot downwards.
    merged = kept.groupBy("anchor").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("order"), "id"))).alias("falling")
    )
    lowest = F.call_function("div", F.lit(low) * F.col("score") + F.lit(99), F.lit(100).cast("long"))
    highest = F.call_function("div", F.lit(high) * F.col("score"), F.lit(100).cast("long"))
    # Scores of at most 2^63 times 100 need wider numbers.
    wide = near.where("score >= 0").select("anchor", F.col("id").alias("positive_id"), F.col("place"), F.col("score").cast("decimal(19,0)").alias("score"))
    windows = wide.select(
        "anchor", "positive_id", F.col("score").cast("long").alias("positive_score"), lowest.alias("lowest"), highest.alias("highest"), "place",
    )
    within = F.filter("falling", lambda n: (-n["order"] <= F.col("highest")) & (-n["order"] >= F.col("lowest")))
    names = rows.sparkSession.createDataFrame(pa.table({"anchor": pa.array(range(len(ids)), pa.int64()), "anchor_id": pa.array(ids, pa.int64())}))
    listed = windows.join(merged, "anchor").join(names, "anchor").select(
        "anchor_id", "positive_id", "positive_score", F.posexplode(F.slice(within, 1, negatives)).alias("at", "negative")
    )
    return listed.select(
        "anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), F.col("negative.id").alias("negative_id"),
        "positive_score", (-F.col("negative.order")).alias("negative_score"),
    )


#: The same in DuckDB's SQL, for ``label`` and anchors as the registered query has them.
ORACLE_SQL = """
WITH usable AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
    SELECT a.vec_id AS anchor_id, o.vec_id AS other_id, a.label = o.label AS same,
           list_inner_product(a.v, o.v)::BIGINT AS score
    FROM usable a JOIN usable o ON a.vec_id % 100 = 0 AND a.vec_id <> o.vec_id
), positives AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pairs WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id,
       row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
