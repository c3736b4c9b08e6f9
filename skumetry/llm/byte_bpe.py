"""Byte-level BPE by prefix dynamic programming (operator 10).

For every prefix of a piece exactly one vocabulary entry can be the last token of that
prefix's encoding. A table of these last tokens is built from left to right: a token that
ends at a position is the right one if it may follow the last token of the prefix before it,
that is, if the two tokens' bytes together encode to just these two. An automaton names the
tokens that end at a position; whether two tokens may stand together is told by undoing their
merges, last one first, and looking for an earlier merge across the border. Reading the table
backwards gives the encoding; appending extends the table; an edit only recomputes the entries
from the edit on until they agree with the old ones over the length of the longest token.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import sys
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skumetry.llm.textbytes import slices

#: Bound on the remembered pieces, token pairs and steps, each, of a Python worker.
REMEMBERED = 300_000

#: Unicode White_Space, which ``\s`` means in a tokenizer's pattern.
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def read_ranks(lines: bytes) -> dict[bytes, int]:
    """The vocabulary of a rank file: one base64 token and its rank a line."""
    return {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines.splitlines()) if t}


def _ranges(letter: str, top: int) -> str:
    """The characters up to ``top`` of a general category (L or N) as ranges for a class."""
    points = [c for c in range(top + 1) if unicodedata.category(chr(c))[0] == letter]
    cuts = [i for i in range(1, len(points)) if points[i] != points[i - 1] + 1]
    runs = zip([0, *cuts], [*cuts, len(points)])
    return "".join(f"\\U{points[a]:08x}-\\U{points[b - 1]:08x}" for a, b in runs)


def compile_pattern(pattern: str, top: int = sys.maxunicode) -> re.Pattern:
    r"""The splitting pattern, for texts of characters up to ``top``, with ``\p{L}``, ``\p{N}`` and ``\s`` spelt out as ranges.

    The standard library matches explicit ranges about twice as fast as properties are matched,
    and engines differ on whether 0x1C to 0x1F are white space.
    """
    for name, members in ((r"\p{L}", _ranges("L", top)), (r"\p{N}", _ranges("N", top)), (r"\s", _WHITE)):
        inside = re.compile(r"(\[[^\]]*)" + re.escape(name))
        while inside.search(pattern):
            pattern = inside.sub(lambda m: m[1] + members, pattern, count=1)
        pattern = pattern.replace(name, f"[{members}]")
    return re.compile(pattern.replace(r"\S", f"[^{_WHITE}]"))


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """A function from a text to its pieces.

    Texts without characters above 0xFFFF take a pattern whose classes fit a lookup table.
    """
    basic, whole = compile_pattern(pattern, 0xFFFF).findall, compile_pattern(pattern).findall
    beyond = re.compile("[\U00010000-\U0010ffff]").search
    return lambda text: whole(text) if beyond(text) else basic(text)


class PrefixTable:
    """The last token of every prefix of a byte string, under one ``PrefixEncoder``."""

    def __init__(self, encoder: PrefixEncoder, text: bytes = b""):
        self.encoder, self.text, self.last = encoder, b"", [-1]
        self.append(text)

    def append(self, more: bytes) -> None:
        """Extends the text; no earlier entry changes."""
        begin = len(self.text)
        self.text += more
        self.last += [-1] * len(more)
        self.encoder.fill(self.text, self.last, begin + 1, len(self.text) + 1)

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Puts ``new`` for the bytes from ``start`` to ``stop``; returns the entries recomputed."""
        old, tail = self.last, self.text[stop:]
        self.text = self.text[:start] + new + tail
        self.last = old[: start + 1] + [-1] * (len(new) + len(tail))
        shift, same = len(new) - (stop - start), 0
        for end in range(start + 1, len(self.text) + 1):
            self.encoder.fill(self.text, self.last, end, end + 1)
            if end > start + len(new):
                same = same + 1 if self.last[end] == old[end - shift] else 0
                if same >= self.encoder.longest:
                    self.last[end + 1:] = old[end - shift + 1:]
                    return end - start
        return len(self.text) - start

    def tokens(self) -> list[int]:
        out, end = [], len(self.text)
        while end:
            token = self.last[end]
            out.append(token)
            end -= len(self.encoder.bytes_of[token])
        return out[::-1]


class PrefixEncoder:
    """Encodes and decodes under a rank vocabulary that holds every single byte."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self._follows: dict[int, bool] = {}
        self._splits: dict[int, tuple[int, int] | tuple[()] | None] = {}
        # States of an automaton over bytes: the prefixes of all tokens. Text is read to the state of
        # its longest ending that begins some token; the tokens that end there are the state's own.
        self._names = [b"", *{token[:i] for token in ranks for i in range(1, len(token) + 1)}]
        self._states = {name: i for i, name in enumerate(self._names)}
        self._ending: list[tuple[tuple[int, int], ...] | None] = [None] * len(self._names)
        self._steps: dict[int, int] = {}

    def merge(self, text: bytes) -> list[int]:
        """The definition: merge the pair of lowest rank, leftmost first. For tokens and token pairs only."""
        parts = [text[i: i + 1] for i in range(len(text))]
        self._merge(parts)
        return [self.ranks[p] for p in parts]

    def _merge(self, parts: list[bytes], left: int = 1) -> None:
        """Merges parts until none can be merged or ``left`` are left."""
        while len(parts) > left:
            pairs = [self.ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
            best = min(pairs)
            if best == 1 << 60:
                break
            at = pairs.index(best)
            parts[at: at + 2] = [parts[at] + parts[at + 1]]

    def _split(self, token: int) -> tuple[int, int] | tuple[()] | None:
        """The two tokens that ``token`` is merged from last, none for a byte.

        None if it does not come about by merges of rising rank, its own the last.
        """
        if token not in self._splits:
            parts, found = [bytes((b,)) for b in self.bytes_of[token]], ()
            if len(parts) > 1:
                self._merge(parts, 2)
                pair = tuple(self.ranks[p] for p in parts)
                regular = len(pair) == 2 and all(self._split(p) is not None and (p < token or len(self.bytes_of[p]) == 1) for p in pair)
                found = pair if regular else None
            self._splits[token] = found
        return self._splits[token]

    def _may_follow(self, before: int, token: int) -> bool:
        split = self._split(token)
        if before < 0:
            return split is not None or self.merge(self.bytes_of[token]) == [token]
        own = self._split(before)
        if split is None or own is None:
            return self.merge(self.bytes_of[before] + self.bytes_of[token]) == [before, token]
        # Undoes the merges on both sides, the last one first. A merge across the border comes before
        # the one just undone if its rank is lower, or the same and it stands to the left.
        limit = 1 << 60
        while True:
            if self.ranks.get(self.bytes_of[before] + self.bytes_of[token], limit) < limit:
                return False
            if own and (not split or before > token):
                limit, before = before, own[1]
                own = self._splits[before]
            elif split:
                limit, token = token + 1, split[0]
                split = self._splits[token]
            else:
                return True

    def follows(self, before: int, token: int) -> bool:
        """Whether ``token`` may stand after ``before`` (-1: at the start)."""
        key = (before + 1) << 32 | token
        known = self._follows.get(key)
        if known is None:
            if len(self._follows) >= REMEMBERED:
                self._follows.clear()
            known = self._follows[key] = self._may_follow(before, token)
        return known

    def _step(self, state: int, byte: int) -> int:
        """The state after one more byte."""
        name = self._names[state] + bytes((byte,))
        while name not in self._states:
            name = name[1:]
        if len(self._steps) >= REMEMBERED:
            self._steps.clear()
        to = self._steps[state << 8 | byte] = self._states[name]
        if self._ending[to] is None:
            # Longest first.
            self._ending[to] = tuple((len(name) - i, self.ranks[name[i:]]) for i in range(len(name)) if name[i:] in self.ranks)
        return to

    def fill(self, text: bytes, last: list[int], begin: int, stop: int) -> None:
        """Sets the last tokens of the prefixes that end from ``begin`` on, up to ``stop``."""
        steps, known, ending, state = self._steps.get, self._follows.get, self._ending, 0
        for byte in text[max(0, begin - 1 - self.longest): begin - 1]:
            state = steps(state << 8 | byte) or self._step(state, byte)
        for end, byte in enumerate(text[begin - 1: stop - 1], begin):
            state = steps(state << 8 | byte) or self._step(state, byte)
            for length, token in ending[state]:
                before = last[end - length]
                may = known((before + 1) << 32 | token)
                if may or may is None and self.follows(before, token):
                    last[end] = token
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one match of the pattern; a piece that is itself a token stays whole."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        end, out, last = len(piece), [], [-1] * (len(piece) + 1)
        self.fill(piece, last, 1, end + 1)
        while end:
            out.append(last[end])
            end -= len(self.bytes_of[last[end]])
        return out[::-1]


class _Pieces(dict):
    """Remembers the packed ids of pieces; the older half is forgotten when it is full."""

    def __init__(self, encoder: PrefixEncoder):
        super().__init__()
        self.encoder, self.old = encoder, {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.old.get(piece)
        if packed is None:
            ids = self.encoder.encode_piece(piece.encode())
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 64:
            if len(self) >= REMEMBERED // 2:
                self.old = dict(self)
                self.clear()
            self[piece] = packed
        return packed


_STATE: dict[tuple[int, str], tuple] = {}


def _codec(rank_lines: bytes, pattern: str):
    """The encoder of this Python worker, kept from task to task."""
    key = (hash(rank_lines), pattern)
    if key not in _STATE:
        encoder = PrefixEncoder(read_ranks(rank_lines))
        _STATE.clear()
        _STATE[key] = (splitter(pattern), _Pieces(encoder), encoder.bytes_of)
    return _STATE[key]


def _drop_codec() -> None:
    _STATE.clear()


def encode_texts(docs: DataFrame, rank_lines: bytes, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with ``token_ids`` (array of int) of every whole text.

    A null or empty text has no tokens. Other columns are kept; a column that is already named
    ``token_ids`` is replaced. The vocabulary travels with the task: its size does not depend on
    the data.
    """
    docs = docs.drop("token_ids")
    schema = T.StructType([*docs.schema.fields, T.StructField("token_ids", T.ArrayType(T.IntegerType()))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, pieces, _ = _codec(rank_lines, pattern)
        for batch in slices(batches, text):
            packed = [b"".join(map(pieces.__getitem__, split(t))) if t else b"" for t in batch.column(text).to_pylist()]
            offsets = np.zeros(len(packed) + 1, np.int32)
            np.cumsum([len(p) // 4 for p in packed], out=offsets[1:])
            ids = pa.array(np.frombuffer(b"".join(packed), "<i4"))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), ids)], [*batch.schema.names, "token_ids"]
            )

    return docs.mapInArrow(encode, schema)


def decode_ids(docs: DataFrame, rank_lines: bytes, pattern: str, ids: str = "token_ids") -> DataFrame:
    """``docs`` with ``decoded`` (binary): the bytes of the ids, empty for null."""
    docs = docs.drop("decoded")
    schema = T.StructType([*docs.schema.fields, T.StructField("decoded", T.BinaryType())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = _codec(rank_lines, pattern)[2]
        for batch in batches:
            column = batch.column(ids)
            out = [b"".join(map(bytes_of.__getitem__, row.values.to_numpy(zero_copy_only=False).tolist())) if row.is_valid else b"" for row in column]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "decoded"])

    return docs.mapInArrow(decode, schema)


def token_digests(docs: DataFrame, rank_lines: bytes, pattern: str, text: str = "text", forget: bool = False) -> DataFrame:
    """``docs`` without its text, with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``.

    The same encoding and decoding as above in one pass, so that neither ids nor decoded texts
    leave the Python worker. Null and empty texts have 0 tokens and the digests of no bytes.
    With ``forget`` a worker drops its encoder after each task, so that tasks of other steps that it
    runs later have the room.
    """
    keep = [c for c in docs.columns if c not in (text, "n_tokens", "ids_sha256", "decoded_sha256")]
    docs = docs.select(*[F.col(f"`{c}`") for c in keep], text)
    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema
    for name, kind in (("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")):
        schema = schema.add(name, kind)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, pieces, bytes_of = _codec(rank_lines, pattern)
        sha = hashlib.sha256
        for batch in slices(batches, text):
            counts, ids_sha, decoded_sha = [], [], []
            for t in batch.column(text).to_pylist():
                packed = b"".join(map(pieces.__getitem__, split(t))) if t else b""
                decoded = b"".join(map(bytes_of.__getitem__, np.frombuffer(packed, "<u4").tolist()))
                counts.append(len(packed) // 4)
                ids_sha.append(sha(packed).hexdigest())
                decoded_sha.append(sha(decoded).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())],
                [*keep, "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        if forget:
            _drop_codec()

    return docs.mapInArrow(digest, schema)
