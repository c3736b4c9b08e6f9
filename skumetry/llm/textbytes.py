"""Whole Arrow columns of texts as flat byte arrays: words, word hashes, three-word hashes.

Everything here is per Arrow batch inside a Spark task. Hashes are 64 bits wide and depend on
the bytes alone, so every task computes the same ones.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Texts are handled in slices of about so many bytes, which bounds a task's memory by the
#: longest text or this, whichever is larger.
SLICE_BYTES = 1 << 19

#: The six characters that part words: space and 0x09 to 0x0D.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Lower case for A-Z only.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BYTE_CODES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def slices(batches: Iterable[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``SLICE_BYTES`` of text; one longer text stands alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends, start, held = [], 0, 0
        for row, size in enumerate(sizes.tolist()):
            if held and held + size > SLICE_BYTES:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


def flatten(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of texts (null: none), and where each text begins and ends."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0]: offsets[-1]] if held and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return (_LOWER[data] if lower else data), offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, parts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word, and for each text the number of words before it (one more at the end).

    Words are runs of the bytes that ``parts`` marks, by default of all but white space.
    """
    inside = ~_SPACE[data] if parts is None else parts[data]
    full = offsets[1:] > offsets[:-1]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    begins, ends = offsets[:-1][full], offsets[1:][full] - 1
    first[begins] = inside[begins]
    last[ends] = inside[ends]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the 64 output bits."""
    for bits, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = x ^ (x >> np.uint64(bits))
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


def _bounded_powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(size - 1, SLICE_BYTES - 1).bit_length())


def running_sum(data: np.ndarray) -> np.ndarray:
    """The sum from which the hashes of all ranges follow."""
    out = np.zeros(len(data) + 1, np.uint64)
    if len(data):
        np.cumsum(_BYTE_CODES[data] * _bounded_powers(len(data))[0][: len(data)], out=out[1:])
    return out


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, running: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each byte range, from one running sum over the whole array."""
    if not len(data):
        return np.zeros(len(starts), np.uint64)
    if running is None:
        running = running_sum(data)
    at = np.minimum(starts, len(data) - 1)
    return mix((running[ends] - running[starts]) * _bounded_powers(len(data))[1][at] + (ends - starts).astype(np.uint64))


def gram_hashes(running: np.ndarray, size: int) -> np.ndarray:
    """``range_hashes`` of all ranges of ``size`` bytes, in the order in which they begin."""
    count = max(0, len(running) - size)
    out = running[len(running) - count:] - running[:count]
    out *= _bounded_powers(len(running) - 1)[1][:count]
    out += np.uint64(size)
    return mix(out)


def join_hashes(*columns: np.ndarray) -> np.ndarray:
    """One hash of an ordered tuple of hashes."""
    out = np.full(len(columns[0]), len(columns), np.uint64)
    for column in columns:
        out = mix(out * np.uint64(0x2545F4914F6CDD1D) + column)
    return out


def packed(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with its last column ``text`` compressed as ``packed``, for a shuffle of texts.

    Null texts are packed as empty ones.
    """
    others = [f for f in docs.schema.fields if f.name != text]
    schema = T.StructType([*others, T.StructField("packed", T.BinaryType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=1)
        for batch in slices(batches, text):
            out = [compressor.compress(t.encode()) if t else b"" for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in others), pa.array(out, pa.binary())], schema.names)

    return docs.mapInArrow(pack, schema)


def unpack(data: bytes) -> bytes:
    return zstandard.decompress(data) if data else b""
