"""Ranked lexical search by dense blocked multiplication (operator 12).

Every item is a question over all documents. A term counts in a document by its impact, a whole
number that grows with its occurrences and falls with the document's length; an item's score is
the sum of its terms' weights times impacts.

Tasks read the documents' terms once and keep those of any item, as a sparse row for each
document. Statistics (documents, terms, documents of each term) come from these rows. The
items are cut into tiles with a compact vocabulary of their own; a tile of documents becomes a
dense matrix of impacts over it and is multiplied with the tile's weights in float64. Strips of
the vocabulary are as narrow as keeps every partial sum below 2^53, so scores are exact. A task keeps
the best documents of each item over all its tiles, ties included, and hands on no more.

Items are taken in blocks with a bounded number of terms; a block is sent to the tasks, and
documents are not shuffled. Terms are compared by 64-bit hashes.

Defined results. A null or empty text has no term. A document without an id counts in the
statistics but is not ranked; repeated documents are ranked one after the other. Rows of one
item id are one item with the terms of all; items without id or terms have no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skumetry.llm.shared import stored
from skumetry.llm.textbytes import flatten, range_hashes, slices, words
from skumetry.llm.tiles import EXACT, Best

#: Terms of a block's items (about); items, terms and documents of a tile.
BLOCK_TERMS, TILE_ITEMS, TILE_TERMS, TILE_DOCS = 200_000, 64, 4096, 1024
#: Columns of a strip of the vocabulary; the most that an impact can be.
STRIP, MOST_IMPACT = 1024, 1_000_000
#: Documents for each part of the last ranking but one.
PART_DOCS = 20_000

_TERM = np.zeros(256, bool)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _hashed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every term of a column of texts, and for each text the number of terms before it."""
    data, offsets = flatten(column, lower=True)
    starts, ends, before = words(data, offsets, _TERM)
    return range_hashes(data, starts, ends).view(np.int64), before


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id`` and ``terms``, the sorted distinct hashes of each item that has any."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices([batch]):
                hashes, before = _hashed(piece.column("text"))
                owner = np.repeat(np.arange(piece.num_rows), np.diff(before))
                ids = piece.column("item_id").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(ids[owner], pa.int64()), pa.array(hashes, pa.int64())], ["item_id", "term"])

    rows = items.where("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    return rows.mapInArrow(read, "item_id long, term long").groupBy("item_id").agg(F.sort_array(F.collect_set("term")).alias("terms"))


def matched_terms(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """``doc_id``, ``n`` terms, and ``terms`` (places in ``vocabulary``) with their occurrences ``tfs``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            hashes, before = _hashed(piece.column("text"))
            owner = np.repeat(np.arange(piece.num_rows), np.diff(before))
            at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
            known = vocabulary[at] == hashes
            pairs, tfs = np.unique(owner[known] * len(vocabulary) + at[known], return_counts=True)
            ends = np.searchsorted(pairs, np.arange(piece.num_rows + 1) * len(vocabulary)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                piece.column("doc_id"), pa.array(np.diff(before), pa.int64()),
                pa.ListArray.from_arrays(ends, pa.array(pairs % len(vocabulary), pa.int32())),
                pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int64())),
            ], ["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(read, "doc_id long, n long, terms array<int>, tfs array<long>")


def item_tiles(terms: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Consecutive items with few items and few distinct terms: their numbers and their vocabulary."""
    tiles, held, vocabulary = [], [], np.zeros(0, np.int64)
    for number, own in enumerate(terms):
        joined = np.union1d(vocabulary, own)
        if held and (len(held) == TILE_ITEMS or len(joined) > TILE_TERMS):
            tiles.append((np.array(held), vocabulary))
            held, joined = [], own
        held.append(number)
        vocabulary = joined
    return tiles + ([(np.array(held), vocabulary)] if held else [])


def impacts(tfs: np.ndarray, n: np.ndarray, documents: int, all_terms: int) -> np.ndarray:
    """What each term counts in its document, whole numbers up to ``MOST_IMPACT``."""
    m = 50 + (50 * n * documents) // all_terms
    return (1_000_000_000 * tfs) // (1000 * tfs + 20 * m)


class Scorer:
    """The weights of a block's items over compact tiles, and their scores in a tile of documents."""

    def __init__(self, terms: list[np.ndarray], weights: np.ndarray):
        self.size, self.tiles = len(weights), []
        strip = max(1, min(STRIP, (EXACT - 1) // (MOST_IMPACT * max(1, int(weights.max(initial=1))))))
        for items, vocabulary in item_tiles(terms):
            tile = np.zeros((len(vocabulary), len(items)))
            for column, item in enumerate(items):
                tile[np.searchsorted(vocabulary, terms[item]), column] = weights[terms[item]]
            strips = [(vocabulary[i: i + strip], tile[i: i + strip]) for i in range(0, len(vocabulary), strip)]
            self.tiles.append((items, strips))

    def scores(self, owner: np.ndarray, places: np.ndarray, impact: np.ndarray, docs: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Items and their scores, a row for each item, a column for each of the ``docs`` documents."""
        column = np.empty(self.size, np.int64)
        for items, strips in self.tiles:
            total = np.zeros((docs, len(items)), np.int64)
            for vocabulary, weights in strips:
                column.fill(-1)
                column[vocabulary] = np.arange(len(vocabulary))
                at = column[places]
                dense = np.zeros((docs, len(vocabulary)))
                dense[owner[at >= 0], at[at >= 0]] = impact[at >= 0]
                total += (dense @ weights).astype(np.int64)
            yield items, total.T


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score``: the ``k`` best documents of each item.

    ``docs`` has ``doc_id`` and ``text``, ``items`` has ``item_id`` and ``text``; other columns are
    ignored. Only scores above 0 are ranked; equal scores go by smaller ``doc_id``.
    """
    asked = stored(item_terms(items))
    blocks = (asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // BLOCK_TERMS + 1
    found = [_block_best(docs, asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b), k) for b in range(blocks)]
    best = reduce(DataFrame.unionByName, found)
    rank = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _block_best(docs: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The best documents of a block's items: ``k`` of each item for each part of the documents."""
    block = asked.orderBy("item_id").collect()  # about BLOCK_TERMS terms
    ids = np.array([b.item_id for b in block], np.int64)
    hashes = [np.array(b.terms, np.int64) for b in block]
    vocabulary = np.unique(np.concatenate(hashes)) if hashes else np.zeros(1, np.int64)
    terms = [np.searchsorted(vocabulary, h) for h in hashes]
    matched = stored(matched_terms(docs, vocabulary))
    documents, all_terms, rows = matched.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    # A row for each term of the block.
    holding = dict(matched.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * holding.get(t, 0) + 1))) for t in range(len(vocabulary))], np.int64)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, best = Scorer(terms, weights), Best(len(ids), k)
        for batch in batches:
            for start in range(0, batch.num_rows, TILE_DOCS):
                tile = batch.slice(start, TILE_DOCS)
                sizes = tile.column("terms").value_lengths().to_numpy()
                owner = np.repeat(np.arange(tile.num_rows), sizes)
                places, tfs = (tile.column(c).flatten().to_numpy() for c in ("terms", "tfs"))
                impact = impacts(tfs, tile.column("n").to_numpy()[owner], documents, all_terms)
                doc_ids = tile.column("doc_id").to_numpy()
                for items, scores in scorer.scores(owner, places, impact, tile.num_rows):
                    best.add(items, scores, doc_ids, scores > 0)
        item, doc_id, scores = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (ids[item], doc_id, scores)], ["item_id", "doc_id", "score"])

    found = matched.where("doc_id IS NOT NULL AND size(terms) > 0").mapInArrow(score, "item_id long, doc_id long, score long")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(math.isqrt(rows // PART_DOCS) + 1))
    place = F.row_number().over(W.partitionBy("item_id", "part").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("part", part).withColumn("place", place).where(F.col("place") <= k).select("item_id", "doc_id", "score")


#: The same in DuckDB's SQL.
ORACLE_SQL = r"""
WITH words AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM documents
), counted AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM counted GROUP BY ALL),
corpus AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes),
weights AS (
    SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
    FROM counted, corpus GROUP BY term
), asked AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark
), scored AS (
    SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))))::BIGINT AS score
    FROM asked JOIN weights USING (term) JOIN counted USING (term) JOIN sizes USING (doc_id), corpus
    GROUP BY item_id, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 50
"""
