"""Exact substring deduplication with suffix arrays (operator 8).

Every byte that a 50-byte string covers is removed if that string also starts in a document of
smaller id. The work on 50-byte strings is cut into independent parts by minimizers: each string
belongs to the smallest hash of the 16-byte strings in it, so equal strings meet wherever they
stand. Neighbouring strings with one minimizer are kept as one stretch of text.

1. Texts are packed into blocks, which are written once.
2. Each block sends the minimizers it holds, five bytes each, to the buckets they belong to, and
   hears which of them more than one document has. The others can share nothing.
3. For the shared ones the block sends its different stretches with the smallest document id of
   each. A bucket deals them to its parts. A part puts its different stretches into one text, builds suffix array and
   Burrows-Wheeler transform, and finds the stretches' common strings: intervals of suffixes are
   extended backward, breadth first, all by as many symbols as they have, so common prefixes come
   out by lengths that double, up to 50 and no further. Each interval that is left holds the places of one 50-byte string; the
   smallest id among them owns it.
4. Blocks hear the owners and cut what others own.

A stretch is sent once by each block that has it, however many of its documents repeat it, so a
passage that a third of all documents share costs a part a few rows for each block. Every block
has something for nearly every bucket. Blocks and buckets therefore both grow with the square root
of the input, up to ``MOST_BYTES``: there is one message for every ``MESSAGE_BYTES`` of input.
Parts are of bounded size; their number grows with the input.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skumetry.llm import textbytes
from skumetry.llm.shared import stored

#: Bytes of the strings that count, and of the strings that minimizers are taken from.
LENGTH, GRAM = 50, 16
#: Strings in one stretch at most.
MOST_STARTS = 64
#: Bytes of text for each part, about.
PART_BYTES = 512 << 10
#: Bytes of text for each message between a block and a bucket, about, and of a block or bucket at
#: most. Messages of inputs beyond 32 GB, where both reach that size, get smaller.
MESSAGE_BYTES, MOST_BYTES = 8 << 10, 16 << 20

_LAST_ID = (1 << 63) - 1
_KEY_BYTES = 5


def suffix_array(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` symbols (of 9 bits) at least, by doubling."""
    size = len(symbols)
    padded = np.r_[symbols.astype(np.uint64), np.zeros(8, np.uint64)]
    key = np.zeros(size, np.uint64)
    for k in range(7):
        key = (key << np.uint64(9)) | padded[k: k + size]
    reach = 7
    order = np.argsort(key)
    rank, rows, own = np.empty(size + 1, np.uint64), np.arange(size), key[order]
    rank[size:] = 0
    while True:
        # A suffix's rank is one more than the first row of those not told apart from it; only
        # rows that share theirs are sorted on.
        new = np.r_[True, own[1:] != own[:-1]][: len(rows)]
        rank[order[rows]] = np.maximum.accumulate(np.where(new, rows + 1, 0))
        rows = rows[~(new & np.r_[new[1:], True][: len(rows)])]
        if reach >= depth or not len(rows):
            return order
        among = order[rows]
        key = (rank[among] << np.uint64(32)) | rank[np.minimum(among + reach, size)]
        by = np.argsort(key)
        order[rows], own = among[by], key[by]
        reach *= 2


def intervals(symbols: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array and, for each of its rows, the interval of suffixes that share ``length`` symbols.

    Row k of the sorted suffixes is the backward extension of row ``psi[k]`` by its first
    symbol; ``psi`` is the inverse of the last-to-first mapping of the Burrows-Wheeler
    transform. Taken n times it leads to the row that row k extends by its first n symbols. Two
    neighbouring rows share n + m symbols if they share n and the rows that they extend by those
    share m. So the intervals of all strings of one length follow from those of strings half as
    long: every step extends all intervals by up to their own length, settles the common
    prefixes of the lengths between, and goes on with the rows not yet settled.
    """
    size = len(symbols)
    order = suffix_array(symbols, length)
    place = np.empty(size + 1, np.int32)
    place[order] = np.arange(size, dtype=np.int32)
    place[size] = 0
    first = symbols[order]
    settled = np.ones(size, bool)
    settled[1:] = first[1:] != first[:-1]
    interval = np.cumsum(settled, dtype=np.int32)
    # A settled row stays so, as intervals only get smaller.
    rows, reach = np.flatnonzero(~settled), 1
    while reach < length and len(rows):
        more = min(reach, length - reach)
        below, above = (place[np.minimum(order[r] + more, size)] for r in (rows, rows - 1))  # ``psi`` taken ``more`` times
        new = interval[below] != interval[above]
        settled[rows[new]] = True
        rows = rows[~new]
        interval = np.cumsum(settled, dtype=np.int32)
        reach += more
    return order, interval


def _minimizers(running: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of string starts with one minimizer: its hash, the first start, and the end of the run.

    ``running`` is the running sum over the texts, which begin and end at ``offsets``.
    """
    size = len(running) - 1
    none = np.zeros(0, np.int64)
    if size < LENGTH:
        return none.astype(np.uint64), none, none
    least = textbytes.gram_hashes(running, GRAM)
    width, window = 1, LENGTH - GRAM + 1
    while 2 * width <= window:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if window > width:
        least = np.minimum(least[: len(least) - (window - width)], least[window - width:])
    # One value for each start of a string; strings must not leave their document.
    inside = np.zeros(size + 1, np.int8)
    full = np.diff(offsets) >= LENGTH
    np.add.at(inside, offsets[:-1][full], 1)
    np.add.at(inside, offsets[1:][full] - LENGTH + 1, -1)
    valid = np.cumsum(inside[: len(least)], dtype=np.int8) > 0
    begins_doc = np.zeros(size + 1, bool)
    begins_doc[offsets[:-1]] = True
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (least[1:] != least[:-1]) | begins_doc[1: len(least)]
    starts = np.flatnonzero(new)
    stop = valid.copy()
    stop[:-1] &= ~valid[1:] | new[1:]
    stops = np.flatnonzero(stop) + 1
    # Texts of a short period have one minimizer from end to end. Cut into pieces, all of them
    # come down to a few different stretches.
    pieces = -(-(stops - starts) // MOST_STARTS)
    number = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begins = np.repeat(starts, pieces) + MOST_STARTS * number
    return np.repeat(least[starts], pieces), begins, np.minimum(begins + MOST_STARTS, np.repeat(stops, pieces))


class _Deal(NamedTuple):
    """Bits that name a bucket, and further bits that name a part of a bucket."""

    bits: int
    more: int

    @classmethod
    def of(cls, total: int) -> _Deal:
        """For so many bytes of text."""
        balanced = round(np.log2(max(1, total / MESSAGE_BYTES)) / 2)
        bits = max(balanced, (total // MOST_BYTES).bit_length())
        return cls(bits, max(0, (total // PART_BYTES).bit_length() - bits))

    def block_bytes(self) -> int:
        return min(MESSAGE_BYTES << self.bits, MOST_BYTES)

    def buckets(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(8 * _KEY_BYTES)).astype(np.int64)

    def parts(self, keys: np.ndarray) -> np.ndarray:
        """The parts of all buckets in one order, the parts of a bucket together."""
        return (keys >> np.uint64(8 * _KEY_BYTES - self.more)).astype(np.int64)


class _Block:
    """The strings of one block: runs, their minimizers and the bucket of each."""

    def __init__(self, packed: list[bytes], counts: np.ndarray, docs: np.ndarray, sizes: np.ndarray, deal: _Deal, hashed: bool = True):
        self.deal, self.docs, self.offsets = deal, docs, np.r_[0, np.cumsum(sizes)]
        self.slices = self.offsets[np.r_[0, np.cumsum(counts)]]
        datas, keys, starts, ends, hashes = [], [], [], [], []
        # Slice by slice: what is needed for each byte is held for one slice only.
        rows = np.r_[0, np.cumsum(counts)].tolist()
        for piece, a, b in zip(packed, rows, rows[1:]):
            data, begin = np.frombuffer(textbytes.unpack(piece), np.uint8), self.offsets[a]
            running = textbytes.running_sum(data)
            found = _minimizers(running, self.offsets[a: b + 1] - begin)
            datas.append(data)
            for held, more in ((keys, found[0]), (starts, found[1] + begin), (ends, found[2] + begin)):
                held.append(more)
            if hashed:
                hashes.append(textbytes.range_hashes(data, found[1], found[2] + LENGTH - 1, running))
        self.data, keys, self.starts, self.ends = (np.concatenate(x) for x in (datas, keys, starts, ends))
        self.hashes = np.concatenate(hashes) if hashed else None
        self.doc = docs[np.searchsorted(self.offsets, self.starts, "right") - 1] if len(keys) else np.zeros(0, np.int64)
        # The first bits name the bucket, the next 40 the minimizer, and the first of these the part;
        # equal strings agree in both. A minimizer is the least of many hashes, so its own first bits
        # are crowded near 0; mixing is one to one and spreads them over all buckets.
        self.keys = textbytes.mix(keys) >> np.uint64(64 - deal.bits - 8 * _KEY_BYTES)
        self.unique, self.which = np.unique(self.keys, return_inverse=True)
        bucket = deal.buckets(self.unique)
        self.buckets = np.unique(bucket)
        self.cuts = np.searchsorted(bucket, np.r_[self.buckets, 1 << 62])

    def several(self) -> np.ndarray:
        """For each different minimizer whether two documents of the block have it."""
        low, high = np.full(len(self.unique), _LAST_ID), np.full(len(self.unique), -_LAST_ID - 1)
        np.minimum.at(low, self.which, self.doc)
        np.maximum.at(high, self.which, self.doc)
        return low != high

    def stretches(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the runs with shared minimizers: their numbers, which different stretch each is, and
        of each different stretch one run and the smallest document id."""
        runs = np.flatnonzero(shared[self.which])
        hashes = self.hashes[runs]
        # Sorted by part first, so that a part's stretches stand together, and those of a bucket.
        part = self.deal.parts(self.keys[runs])
        order = np.lexsort((hashes, part))
        new = np.r_[True, (hashes[order][1:] != hashes[order][:-1]) | (part[order][1:] != part[order][:-1])][: len(order)]
        which = np.empty(len(runs), np.int64)
        which[order] = np.cumsum(new) - 1
        one = runs[order[np.flatnonzero(new)]]
        least = np.full(len(one), _LAST_ID)
        np.minimum.at(least, which, self.doc[runs])
        return runs, which, one, least

    def shared(self, buckets: list[int], bitmaps: list[bytes]) -> np.ndarray:
        out = np.zeros(len(self.unique), bool)
        where = {p: i for i, p in enumerate(self.buckets.tolist())}
        for bucket, bitmap in zip(buckets, bitmaps):
            a, b = self.cuts[where[bucket]], self.cuts[where[bucket] + 1]
            out[a:b] = np.unpackbits(np.frombuffer(bitmap, np.uint8), count=b - a).astype(bool)
        return out


BLOCK = ("block", "counts", "docs", "sizes", "packed")


def _blocks(batches: Iterator[pa.RecordBatch], deal: _Deal, hashed: bool = True) -> Iterator[tuple[pa.RecordBatch, int, _Block]]:
    """Every block of the batches, with the batch and its row."""
    for batch in batches:
        columns = [batch.column(c) for c in ("packed", "counts", "docs", "sizes")]
        for row in range(batch.num_rows):
            packed, *numbers = (c[row] for c in columns)
            yield batch, row, _Block(packed.as_py(), *(n.values.to_numpy(zero_copy_only=False) for n in numbers), deal, hashed)


def _gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The bytes of all ranges, one after the other."""
    sizes = ends - starts
    begins = np.cumsum(sizes) - sizes
    return data[np.arange(sizes.sum()) - np.repeat(begins - starts, sizes)]


def _in_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[pa.RecordBatch]]:
    """The rows of each value of a sorted column, as slices of the batches."""
    held, of = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), batch.num_rows]
        for start, stop in zip(cuts, cuts[1:]):
            if held and values[start] != of:
                yield held
                held = []
            of = values[start]
            held.append(batch.slice(start, stop - start))
    if held:
        yield held


def _pack(docs: DataFrame, block_bytes: int) -> DataFrame:
    """Blocks of texts: for each its number, its documents' rows, ids and sizes, and slices of compressed bytes."""
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("rows", T.ArrayType(docs.schema["row"].dataType)), T.StructField("docs", T.ArrayType(T.LongType())),
        T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("counts", T.ArrayType(T.LongType())), T.StructField("packed", T.ArrayType(T.BinaryType())),
    ])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=1)
        rows, docs, sizes, packed, held = [], [], [], [], 0

        def out():
            whole = pa.array([0, sum(map(len, docs))], pa.int32())
            return pa.RecordBatch.from_arrays(
                [pa.array([uuid.uuid4().int >> 65], pa.int64()), *(pa.ListArray.from_arrays(whole, pa.concat_arrays(x)) for x in (rows, docs)),
                 pa.array([np.concatenate(sizes)], pa.list_(pa.int64())), pa.array([[len(x) for x in docs]], pa.list_(pa.int64())),
                 pa.array([packed], pa.list_(pa.binary()))], schema.names,
            )

        for batch in textbytes.slices(batches):
            data, offsets = textbytes.flatten(batch.column("text"))
            if held and held + len(data) > block_bytes:
                yield out()
                rows, docs, sizes, packed, held = [], [], [], [], 0
            rows.append(batch.column("row"))
            docs.append(batch.column("doc"))
            sizes.append(np.diff(offsets))
            packed.append(compressor.compress(data.tobytes()) if len(data) else b"")
            held += len(data)
        if docs:
            yield out()

    return docs.mapInArrow(pack, schema)


def _shared_minimizers(blocks: DataFrame, deal: _Deal) -> DataFrame:
    """For each block and bucket a bitmap of the block's minimizers that two documents have."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, row, block in _blocks(batches, deal, hashed=False):
            several = block.several()
            low = block.unique.view(np.uint8).reshape(-1, 8)[:, :_KEY_BYTES]  # little-endian
            cuts = list(zip(block.cuts.tolist(), block.cuts.tolist()[1:]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(block.buckets), pa.array([batch.column("block")[row].as_py()] * len(cuts), pa.int64()),
                 pa.array([low[a:b].tobytes() for a, b in cuts], pa.binary()), pa.array([np.packbits(several[a:b]).tobytes() for a, b in cuts], pa.binary())],
                ["bucket", "block", "keys", "several"],
            )

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _in_groups(batches, "bucket"):
            rows = pa.Table.from_batches(held)
            keys = [np.frombuffer(k, np.uint8).reshape(-1, _KEY_BYTES) for k in rows.column("keys").to_pylist()]
            wide = np.zeros((sum(map(len, keys)), 8), np.uint8)
            wide[:, :_KEY_BYTES] = np.concatenate(keys)
            several = np.concatenate([np.unpackbits(np.frombuffer(s, np.uint8), count=len(k)) for s, k in zip(rows.column("several").to_pylist(), keys)])
            _, which, counts = np.unique(wide.view(np.uint64).ravel(), return_inverse=True, return_counts=True)
            flagged = counts > 1
            flagged[which[several > 0]] = True
            cuts = np.cumsum([0, *map(len, keys)])
            hit = flagged[which]
            bitmaps = [np.packbits(hit[a:b]).tobytes() if hit[a:b].any() else None for a, b in zip(cuts, cuts[1:])]
            out = pa.RecordBatch.from_arrays([rows.column("bucket").combine_chunks(), rows.column("block").combine_chunks(), pa.array(bitmaps, pa.binary())], ["bucket", "block", "bitmap"])
            yield out.filter(out.column("bitmap").is_valid())

    sent = blocks.select(*BLOCK).mapInArrow(send, "bucket long, block long, keys binary, several binary")
    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(answer, "bucket long, block long, bitmap binary")


def _of_block(answers: DataFrame, value: str) -> DataFrame:
    """One row for each block with the buckets and values it was sent; a block's size bounds it."""
    return answers.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", value))).alias("answers")).select(
        "block", F.col("answers.bucket").alias("buckets"), F.col(f"answers.{value}").alias("values")
    )


def _owners(blocks: DataFrame, shared: DataFrame, deal: _Deal) -> DataFrame:
    """For each block and bucket the owners of the strings in the stretches that the block sent.

    ``owners`` is a compressed array of 64-bit numbers: run lengths, then ids.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=1)
        for batch, row, block in _blocks(batches, deal):
            flags = block.shared(batch.column("buckets")[row].as_py(), batch.column("values")[row].as_py())
            _, _, one, least = block.stretches(flags)
            bucket = deal.buckets(block.keys[one])
            buckets = np.unique(bucket)
            cuts = np.searchsorted(bucket, np.r_[buckets, 1 << 62]).tolist()
            part = deal.parts(block.keys[one]) & ((1 << deal.more) - 1)
            texts, sizes, ids, parts = [], [], [], []
            for a, b in zip(cuts, cuts[1:]):
                starts, ends = block.starts[one[a:b]], block.ends[one[a:b]] + LENGTH - 1
                texts.append(compressor.compress(_gather(block.data, starts, ends).tobytes()))
                sizes.append((ends - starts).astype(np.uint8).tobytes())
                ids.append(compressor.compress(least[a:b].tobytes()))
                parts.append(np.bincount(part[a:b], minlength=1 << deal.more).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(buckets), pa.array([batch.column("block")[row].as_py()] * len(buckets), pa.int64()), *(pa.array(c, pa.binary()) for c in (texts, sizes, ids, parts))],
                ["bucket", "block", "texts", "sizes", "ids", "parts"],
            )

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=1)
        for held in _in_groups(batches, "bucket"):
            rows = pa.Table.from_batches(held)
            sizes = [np.frombuffer(s, np.uint8) for s in rows.column("sizes").to_pylist()]
            data = np.frombuffer(b"".join(map(zstandard.decompress, rows.column("texts").to_pylist())), np.uint8)
            ids = np.frombuffer(b"".join(map(zstandard.decompress, rows.column("ids").to_pylist())), np.int64)
            counts = np.concatenate([np.frombuffer(p, np.int32) for p in rows.column("parts").to_pylist()])
            part = np.repeat(np.tile(np.arange(1 << deal.more, dtype=np.int32), len(sizes)), counts)
            own = np.concatenate(sizes).astype(np.int64)
            ends = np.cumsum(own)
            starts = ends - own
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange((1 << deal.more) + 1)).tolist()
            found = [_runs_of_owners(data, starts[order[a:b]], ends[order[a:b]], ids[order[a:b]]) for a, b in zip(cuts, cuts[1:]) if a < b]
            lengths, values, several = (np.concatenate(x) for x in zip(*found))
            # Back from the order of parts to the order in which blocks sent their stretches.
            first, last = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
            last[order] = np.cumsum(several)
            first[order] = np.cumsum(several) - several
            out, row = [], 0
            for number in map(len, sizes):
                at = _gather(np.arange(len(values)), first[row: row + number], last[row: row + number])
                row += number
                change = np.flatnonzero(np.r_[True, values[at][1:] != values[at][:-1]])
                out.append(compressor.compress(np.r_[np.add.reduceat(lengths[at], change), values[at][change]].astype(np.int64).tobytes()))
            yield pa.RecordBatch.from_arrays([rows.column("bucket").combine_chunks(), rows.column("block").combine_chunks(), pa.array(out, pa.binary())], ["bucket", "block", "owners"])

    sent = blocks.select(*BLOCK).join(_of_block(shared, "bitmap"), "block").mapInArrow(
        send, "bucket long, block long, texts binary, sizes binary, ids binary, parts binary"
    )
    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(answer, "bucket long, block long, owners binary")


def _string_owners(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id that has the string at each place of the stretches, and where each stretch begins.

    The stretches are put one after the other, each closed by a symbol that no text has.
    """
    sizes = ends - starts
    begins = np.cumsum(sizes + 1) - (sizes + 1)
    symbols = np.zeros(int((sizes + 1).sum()), np.uint16)
    symbols[np.arange(sizes.sum()) + np.repeat(np.arange(len(sizes)), sizes)] = _gather(data, starts, ends).astype(np.uint16) + 1
    order, interval = intervals(symbols, LENGTH)
    ids = np.repeat(least, sizes + 1)[order]
    heads = np.flatnonzero(np.r_[True, interval[1:] != interval[:-1]])
    smallest = np.minimum.reduceat(ids, heads)
    owner = np.empty(len(symbols), np.int64)
    owner[order] = np.repeat(smallest, np.diff(np.r_[heads, len(symbols)]))
    return owner, begins


def _runs_of_owners(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one part's stretches, in which texts of these ids are: runs of places with one owner, their
    lengths and owners, and how many runs each stretch has."""
    sizes = ends - starts
    own = _gather(data, starts, ends)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    _, one, which = np.unique(textbytes.range_hashes(own, starts, ends), return_index=True, return_inverse=True)
    least = np.full(len(one), _LAST_ID)
    np.minimum.at(least, which, ids)
    owner, begins = _string_owners(own, starts[one], ends[one], least)
    places = sizes - LENGTH + 1
    values = _gather(owner, begins[which], begins[which] + places)
    new = np.r_[True, values[1:] != values[:-1]]
    heads = np.cumsum(places) - places
    new[heads] = True
    at = np.flatnonzero(new)
    return np.diff(np.r_[at, len(values)]), values[at], np.diff(np.searchsorted(at, np.r_[heads, len(values)]))


def remove_repeats(docs: DataFrame, keep_bytes: bool = True) -> DataFrame:
    """``docs`` without its text, with what stays of it and what was removed.

    Added are ``kept`` (binary; what stays need not be whole code points; left out unless
    ``keep_bytes``), ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256``. Null texts
    count as empty. Rows of one ``doc_id``, or all rows without one (which come last), count as
    one document and remove nothing from each other. Columns of ``docs`` that bear the name of
    a result are replaced.
    """
    added = {"kept": T.BinaryType(), "n_bytes": T.LongType(), "n_removed": T.LongType(), "n_spans": T.LongType(), "kept_sha256": T.StringType()}
    keep = [c for c in docs.columns if c not in ("text", *added)]
    if not keep_bytes:
        del added["kept"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.coalesce("doc_id", F.lit(_LAST_ID)).cast("long").alias("doc"), "text")
    deal = _Deal.of(rows.select(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0)
    blocks = stored(_pack(rows, deal.block_bytes()))
    shared = stored(_shared_minimizers(blocks, deal))
    owners = stored(_owners(blocks, shared, deal))
    heard = _of_block(shared, "bitmap").join(_of_block(owners, "owners").select("block", F.col("values").alias("owners")), "block", "left")
    schema = T.StructType([rows.schema["row"], *(T.StructField(k, v) for k, v in added.items())])

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, row, block in _blocks(batches, deal):
            owned = batch.column("owners")[row].is_valid
            if owned:
                flags = block.shared(batch.column("buckets")[row].as_py(), batch.column("values")[row].as_py())
                runs, which, one, _ = block.stretches(flags)
                pairs = [np.frombuffer(zstandard.decompress(o), np.int64).reshape(2, -1) for o in batch.column("owners")[row].as_py()]
                lengths, values = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), np.int64)
                owner = np.repeat(np.arange(len(values), dtype=np.int32), lengths)
                sizes = block.ends[one] - block.starts[one]
                begins = np.cumsum(sizes) - sizes
            removed = np.zeros(len(block.data), bool)
            for base, stop in zip(block.slices.tolist(), block.slices.tolist()[1:]):
                if not owned or base == stop:
                    continue
                a, b = np.searchsorted(block.starts[runs], (base, stop))
                starts, ends = block.starts[runs[a:b]], block.ends[runs[a:b]]
                own = values[_gather(owner, begins[which[a:b]], begins[which[a:b]] + ends - starts)]
                hit = _gather(np.arange(stop - base), starts - base, ends - base)[own < np.repeat(block.doc[runs[a:b]], ends - starts)]
                gone = np.zeros(stop - base + 1, np.int32)
                np.add.at(gone, hit, 1)
                np.add.at(gone, hit + LENGTH, -1)
                removed[base:stop] = np.cumsum(gone[:-1]) > 0
            out = {k: [] for k in added}
            for a, b in zip(block.offsets.tolist(), block.offsets.tolist()[1:]):
                mask = removed[a:b]
                left = block.data[a:b][~mask].tobytes()
                spans = int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum())
                for k, v in {"kept": left, "n_bytes": b - a, "n_removed": int(mask.sum()), "n_spans": spans, "kept_sha256": hashlib.sha256(left).hexdigest()}.items():
                    if k in out:
                        out[k].append(v)
            kinds = {"kept": pa.binary(), "kept_sha256": pa.string()}
            yield pa.RecordBatch.from_arrays([batch.column("rows")[row].values, *(pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items())], schema.names)

    return blocks.join(heard, "block", "left").mapInArrow(clean, schema).select("row.*", *added)
