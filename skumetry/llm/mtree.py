"""Exact top-k by inner product with M-trees and best-first search (operator 9).

Vectors are whole numbers, ``floor(256 x)``. Inner products are no metric, but with one more
coordinate, the root of the largest squared length less the vector's own, the Euclidean distance
to a query (whose added coordinate is 0) falls as the inner product grows. In this space the
vectors are kept in M-trees.

Every vector goes to the nearest of a bounded sample of pivots; a cell is split at random into
trees of bounded size, so equal or crowded vectors only make more trees. A tree has paged nodes
with a routing vector, a covering radius and the distance to the parent's routing vector. The
search opens the node with the least possible distance first, whichever tree it is in. Nodes and vectors are passed over,
without computing their distance, where the distances to the parent differ by too much.

Trees are dealt to groups, and each block of queries is sent to every group. A task holds one
group's trees and hands on the best five for each query. Bounds are compared with some slack for
rounding, scores are exact integers, so results are exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skumetry.llm.shared import stored
from skumetry.llm.tiles import PLAIN, Best, Vectors, by_length

#: The bound on the sample of pivots.
PIVOTS = 64
#: Vectors of a tree, about; entries of a page; trees of a group; queries of a block.
TREE, PAGE, GROUP, BLOCK = 4096, 256, 8, 256
SLACK = 1e-6
#: Queries of a block that is multiplied in tiles.
TILE_BLOCK = 1024


def usable_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id`` and ``x``, an array of double, of every row that has an id and only finite components."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    x = F.transform("embedding", lambda x: x.cast("double"))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(finite).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def is_ordinary() -> Column:
    """Whether 64 bits hold every inner product of a vector with others of its kind."""
    return F.forall("x", lambda x: F.abs(x * 256) <= PLAIN)


def _whole(vectors: DataFrame) -> DataFrame:
    """``vec_id`` and ``v``, the whole numbers of ordinary vectors."""
    return vectors.select("vec_id", F.transform("x", lambda x: F.floor(x * 256).cast("long")).alias("v"))


def _by_tiles(rows: DataFrame, asked: DataFrame, k: int) -> list[DataFrame]:
    """``query_id``, ``vec_id``, ``score`` of pairs that trees cannot hold, a table for each block of queries.

    A block has a bounded number of queries; every task reads its rows once and hands on the best
    ``k`` for each query. Scores beyond 64 bits count as the nearest long.
    """
    blocks = asked.count() // TILE_BLOCK + 1
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", "x"), F.lit(blocks)))
    return [_of_block(rows, asked.where(F.col("block") == b).orderBy("vec_id", "x").collect(), k) for b in range(blocks)]


def _of_block(rows: DataFrame, chosen: list, k: int) -> DataFrame:
    ids = np.array([q.vec_id for q in chosen], np.int64)
    lengths = np.array([len(q.x) for q in chosen], np.int64)
    given = [q.x for q in chosen]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(ids), k)
        tiles = {n: Vectors(np.array([given[i] for i in np.flatnonzero(lengths == n)], np.float64)) for n in set(lengths.tolist()) if n}
        for batch in batches:
            others = batch.column("vec_id").to_numpy()
            for at, x in by_length(batch.column("x")):
                if x.shape[1] in tiles:
                    own = np.flatnonzero(lengths == x.shape[1])
                    scores = tiles[x.shape[1]].scores(Vectors(x))
                    best.add(own, scores, others[at], ids[own][:, None] != others[at][None, :])
        number, found, scores = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (ids[number], found, scores)], ["query_id", "vec_id", "score"])

    return rows.mapInArrow(best, "query_id long, vec_id long, score long")


def _matrix(column: pa.Array) -> np.ndarray:
    """Arrays of one length as the rows of a matrix."""
    return np.array(column.to_pylist(), np.int64).reshape(len(column), -1)


def _lift(v: np.ndarray, longest: int) -> np.ndarray:
    """Vectors with the added coordinate."""
    own = (v.astype(np.float64) ** 2).sum(axis=1)
    return np.c_[v, np.sqrt(np.maximum(longest - own, 0))]


class MTree:
    """Pages of vectors under routing vectors; built once, then searched."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, longest: int):
        self.ids, self.v, self.at = ids, v, _lift(v, longest)
        self.nodes: list[dict] = []
        self.distances = 0
        self.root = self._node(np.arange(len(ids)), None)

    def _node(self, rows: np.ndarray, parent: np.ndarray | None) -> int:
        center = self.at[rows[0]] if parent is None else self.at[rows].mean(axis=0)
        center = self.at[rows[np.argmin(((self.at[rows] - center) ** 2).sum(axis=1))]]
        away = np.sqrt(((self.at[rows] - center) ** 2).sum(axis=1))
        number = len(self.nodes)
        node = {"center": center, "radius": away.max(), "to_parent": 0.0 if parent is None else float(np.sqrt(((center - parent) ** 2).sum()))}
        self.nodes.append(node)
        if len(rows) <= PAGE:
            node["rows"], node["away"] = rows, away
            return number
        seeds = self.at[rows[np.linspace(0, len(rows) - 1, min(PAGE, len(rows) // PAGE + 1)).astype(int)]]
        near = (seeds**2).sum(axis=1) - 2 * self.at[rows] @ seeds.T
        side = near.argmin(axis=1)
        parts = [rows[side == s] for s in range(len(seeds)) if (side == s).any()]
        if len(parts) == 1:
            parts = np.array_split(rows, 2)
        children = [self._node(p, center) for p in parts]
        node["children"] = np.array(children)
        node["centers"] = np.array([self.nodes[c]["center"] for c in children])
        node["radii"] = np.array([self.nodes[c]["radius"] for c in children])
        node["apart"] = np.array([self.nodes[c]["to_parent"] for c in children])
        return number


class Forest:
    """The trees of one group over vectors of one length, searched together, nearest node first."""

    def __init__(self, trees: list[MTree]):
        self.trees = trees
        self.centers = np.array([t.nodes[t.root]["center"] for t in trees])
        self.radii = np.array([t.nodes[t.root]["radius"] for t in trees])

    def search(self, query_id: int, q: np.ndarray, k: int, longest: int) -> list[tuple[int, int]]:
        """The best ``k`` vectors with another id, as a heap of ``(score, -id)``."""
        lifted = np.r_[q, 0.0]
        level = float((q.astype(np.float64) ** 2).sum()) + longest
        # The distance within which a vector may still enter.
        best, limit = [], np.inf
        there = np.sqrt(((self.centers - lifted) ** 2).sum(axis=1))
        least = np.maximum(there - self.radii, 0.0)
        queue = [(bound, i, self.trees[i].root, away) for i, (bound, away) in enumerate(zip(least.tolist(), there.tolist()))]
        heapq.heapify(queue)
        while queue:
            bound, i, number, away = heapq.heappop(queue)
            if bound > limit * (1 + SLACK) + SLACK * bound:
                break
            tree = self.trees[i]
            node = tree.nodes[number]
            reach = limit * (1 + SLACK) + SLACK * away
            if "rows" in node:
                near = node["rows"][np.abs(away - node["away"]) <= reach]
                tree.distances += len(near)
                scores = tree.v[near] @ q
                if len(best) == k:
                    enough = scores >= best[0][0]
                    near, scores = near[enough], scores[enough]
                for score, other in zip(scores.tolist(), tree.ids[near].tolist()):
                    if other == query_id:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, (score, -other))
                    elif (score, -other) > best[0]:
                        heapq.heapreplace(best, (score, -other))
                if len(best) == k:
                    limit = np.sqrt(max(level - 2 * best[0][0], 0.0)) + SLACK
                continue
            open_ = np.flatnonzero(np.abs(away - node["apart"]) - node["radii"] <= reach)
            tree.distances += len(open_)
            there = np.sqrt(((node["centers"][open_] - lifted) ** 2).sum(axis=1))
            least = np.maximum(there - node["radii"][open_], 0.0)
            for j in np.flatnonzero(least <= limit * (1 + SLACK)).tolist():
                heapq.heappush(queue, (float(least[j]), i, int(node["children"][open_[j]]), float(there[j])))
        return best


def _cells(vectors: DataFrame) -> DataFrame:
    """``vectors`` with ``tree``: nearest pivot and a random part of its cell, within one length."""
    pivots = {}
    sample = vectors.select("v", F.size("v").alias("dim"), F.xxhash64("vec_id").alias("h")).orderBy("h").limit(PIVOTS).collect()
    for row in sample:
        pivots.setdefault(row.dim, []).append(row.v)
    pivots = {dim: np.array(rows, np.float64) for dim, rows in pivots.items() if dim}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = []
            for v in batch.column("v").to_pylist():
                own = pivots.get(len(v))
                cells.append(0 if own is None else int(((own - np.array(v, np.float64)) ** 2).sum(axis=1).argmin()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(cells, pa.int32())], ["vec_id", "v", "cell"])

    celled = stored(vectors.mapInArrow(assign, "vec_id long, v array<long>, cell int").withColumn("dim", F.size("v")))
    parts = celled.groupBy("dim", "cell").agg((F.floor(F.count(F.lit(1)) / TREE) + 1).alias("parts"))
    # At most PIVOTS cells for each length: the pivots bound this table, not the vectors.
    parts = celled.join(parts, ["dim", "cell"])
    return parts.withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), F.col("parts"))).select("dim", "cell", "part", "vec_id", "v")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` best rows of ``vectors`` for each query.

    Both tables have ``vec_id`` and ``embedding``; other columns are ignored. Rows without an
    id, and vectors that are null or hold null or non-finite components, take no part. A query's
    candidates are the rows of its own length with another ``vec_id``. Ties go to the smaller
    id; repeated rows are ranked one after the other. Few candidates give few rows.

    Trees hold vectors whose whole numbers have at most 21 bits; pairs with a longer one are
    multiplied as whole numbers of any size, and scores beyond 64 bits count as the nearest long.
    """
    every = stored(usable_vectors(vectors))
    wanted = usable_vectors(queries).dropDuplicates(["vec_id", "x"])
    rows, asked = stored(_whole(every.where(is_ordinary()))), stored(_whole(wanted.where(is_ordinary())))
    wide, wide_asked = stored(every.where(~is_ordinary())), stored(wanted.where(~is_ordinary()))
    tiled = [] if wide.isEmpty() else _by_tiles(wide, wanted.where(is_ordinary()), k)
    tiled += [] if wide_asked.isEmpty() else _by_tiles(every, wide_asked, k)
    square = F.aggregate("v", F.lit(0).cast("long"), lambda acc, x: acc + x * x)
    longest, count = rows.agg(F.max(square), F.count(F.lit(1))).first()
    longest = longest or 0
    groups = count // (TREE * GROUP // 2) + 1
    trees = _cells(rows).select(
        F.pmod(F.xxhash64("dim", "cell", "part"), F.lit(groups)).alias("g"), F.lit(0).alias("kind"), "dim", "cell", "part", "vec_id", "v"
    )
    blocks = asked.select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g"), F.lit(1).alias("kind"),
        F.size("v").alias("dim"), F.lit(0).alias("cell"), F.pmod(F.xxhash64("vec_id"), F.lit(asked.count() // BLOCK + 1)).alias("part"), "vec_id", "v",
    )
    order = ["g", "kind", "dim", "cell", "part"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, trees, forests, of, held = None, [], None, None, []

        def finish():
            """What the rows of one tree, or of one block of queries, come to."""
            nonlocal forests
            ids = np.concatenate([b.column("vec_id").to_numpy() for b in held])
            v = np.concatenate([_matrix(b.column("v")) for b in held])
            if of[1] == 0:
                trees.append((of[2], MTree(ids, v, longest)))
                return None
            if forests is None:  # all trees of a group come before its queries
                forests = {dim: Forest([t for d, t in trees if d == dim]) for dim in {d for d, _ in trees}}
            out = [[], [], []]
            for query_id, q in zip(ids.tolist(), v):
                for score, minus_id in forests[of[2]].search(query_id, q, k, longest) if of[2] in forests else ():
                    for column, value in zip(out, (query_id, -minus_id, score)):
                        column.append(value)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["query_id", "vec_id", "score"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in order])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for start, stop in zip(cuts, cuts[1:]):
                key = tuple(keys[:, start].tolist())
                if key != of and held:
                    done = finish()
                    held = []
                    if done is not None:
                        yield done
                if key[0] != group:
                    group, trees, forests = key[0], [], None
                of = key
                held.append(batch.slice(start, stop - start))
        if held:
            done = finish()
            if done is not None:
                yield done

    # One group a task: group numbers name partitions, they are not hashed into them.
    dealt = trees.unionByName(blocks).repartitionById(groups, F.col("g").cast("int")).sortWithinPartitions(*order)
    found = reduce(DataFrame.unionByName, tiled, dealt.mapInArrow(search, "query_id long, vec_id long, score long"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The same in DuckDB's SQL, for the queries that the registered query has.
ORACLE_SQL = """
WITH usable AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)
SELECT q.vec_id AS query_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.v, c.v) DESC, c.vec_id)::INTEGER AS rank,
       c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
FROM usable q JOIN usable c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
QUALIFY rank <= 5
"""
