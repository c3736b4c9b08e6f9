"""Substring deduplication by content-defined chunks (operator 1).

A rolling gear hash over the last 32 bytes decides where a text is cut, so that the cuts follow
the content: after an insertion the old cuts are found again. Chunks are told apart by a 128-bit
digest. Of all chunks with one digest the first in the document of smallest id stays; every
other is removed. Cuts never split a code point, so what stays is text.

Owners come from a grouped minimum, which combines before the shuffle, so a chunk that stands in
a third of all documents leaves each task once. Digests that only one document has go no
further.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skumetry.llm import textbytes
from skumetry.llm.shared import stored

#: Bytes of a chunk: at least, at most (but for the rest of a code point), and by which bits of
#: the hash it is cut: one position in 32 after the least.
LEAST, MOST, CUT_BITS = 32, 1024, 5

_GEAR = np.random.default_rng(31).integers(0, 1 << 32, 256, dtype=np.uint32)
_LAST_ID = (1 << 63) - 1


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash at each byte, ``h = 2 h + G[byte]`` in 32 bits, by doubling the window."""
    h = _GEAR[data]
    for width in (1, 2, 4, 8, 16):
        longer = h.copy()
        longer[width:] += h[:-width] << np.uint32(width)
        h = longer
    return h


def cut(data: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """For each text where its chunks begin, and where the last one ends."""
    whole = np.r_[(data[1:] & 0xC0) != 0x80, True] if len(data) else np.zeros(0, bool)
    ends = (np.flatnonzero(((gear(data) >> np.uint32(32 - CUT_BITS)) == 0) & whole) + 1).tolist() if len(data) else []
    out = []
    for start, stop in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        cuts = [start]
        while start < stop:
            at = bisect_left(ends, start + LEAST)
            end = ends[at] if at < len(ends) else stop
            if end > start + MOST:
                end = start + MOST
                while end < stop and not whole[end - 1]:
                    end += 1
            start = min(end, stop)
            cuts.append(start)
        out.append(cuts)
    return out


def _digests(data: np.ndarray, cuts: list[int]) -> list[bytes]:
    view, digest = memoryview(data), xxhash.xxh3_128_digest
    return [digest(view[a:b]) for a, b in zip(cuts, cuts[1:])]


def chunk_digests(docs: DataFrame) -> DataFrame:
    """``doc`` and the 128-bit ``digest`` of each different chunk of each document."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textbytes.slices(batches):
            data, offsets = textbytes.flatten(batch.column("text"))
            ids, out = [], []
            for doc, cuts in zip(batch.column("doc").to_pylist(), cut(data, offsets)):
                own = set(_digests(data, cuts))
                ids += [doc] * len(own)
                out += own
            pairs = np.frombuffer(b"".join(out), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["doc", "high", "low"])

    return docs.select("doc", "text").mapInArrow(chunks, "doc long, high long, low long")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated chunks cut out of ``text``, and what was cut.

    Added are ``n_bytes``, ``n_chunks``, ``n_removed`` (bytes), ``n_spans`` (runs of removed
    bytes) and ``kept_sha256``. Null texts become empty. Rows of one ``doc_id``, or all rows
    without one, count as one document, which comes last if the id is null; so repeated rows
    keep the same chunks. Columns of ``docs`` that bear the name of a result are replaced.
    """
    added = {"n_bytes": "long", "n_chunks": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string"}
    keep = [c for c in docs.columns if c not in ("text", *added)]
    row = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")
    docs = docs.select(row, F.coalesce("doc_id", F.lit(_LAST_ID)).cast("long").alias("doc"), "text")
    found = chunk_digests(docs)
    owners = stored(
        found.groupBy("high", "low").agg(F.min("doc").alias("owner"), F.max("doc").alias("last")).where("owner <> last").select("high", "low", "owner")
    )
    repeats = found.join(owners, ["high", "low"]).where("doc <> owner").select("doc", "high", "low")
    lists = stored(repeats.groupBy("doc").agg(F.collect_set(F.struct("high", "low")).alias("repeats")))
    rows = textbytes.packed(docs).join(lists, "doc", "left").select("row", "packed", F.col("repeats.high").alias("high"), F.col("repeats.low").alias("low"))
    schema = T.StructType([docs.schema["row"], T.StructField("text", T.StringType()), *(T.StructField(k, T.LongType() if v == "long" else T.StringType()) for k, v in added.items())])

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out = [], {k: [] for k in added}
            for packed, high, low in zip(*(batch.column(c) for c in ("packed", "high", "low"))):
                text = textbytes.unpack(packed.as_py())
                data = np.frombuffer(text, np.uint8)
                cuts = cut(data, np.array([0, len(data)]))[0]
                gone = set()
                if high.is_valid:
                    pairs = np.stack([high.values.to_numpy(), low.values.to_numpy()], axis=1).tobytes()
                    gone = {pairs[i: i + 16] for i in range(0, len(pairs), 16)}
                kept, spans, removed, before = [], 0, 0, False
                for a, b, digest in zip(cuts, cuts[1:], _digests(data, cuts)):
                    if digest in gone:
                        removed += b - a
                        spans += not before
                        before = True
                    else:
                        kept.append(text[a:b])
                        gone.add(digest)
                        before = False
                left = b"".join(kept)
                texts.append(left.decode())
                for k, v in zip(added, (len(data), len(cuts) - 1, removed, spans, hashlib.sha256(left).hexdigest())):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(texts, pa.string()), *(pa.array(out[k], pa.int64() if v == "long" else pa.string()) for k, v in added.items())], schema.names
            )

    return rows.mapInArrow(clean, schema).select("row.*", "text", *added)
