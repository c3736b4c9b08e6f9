"""Exact scores of tiles of whole-number vectors, and the best rows of each question over many tiles.

A product of two tiles is one dense matrix multiplication in float64. It is exact while every
partial sum stays below 2^53, so wide tiles are cut into column strips that keep to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Whole numbers up to here are exact in float64.
EXACT = 1 << 53
#: Vectors with a larger component are multiplied as Python integers.
PLAIN = 1 << 21
#: Scores beyond 64 bits count as the nearest of these.
LOWEST, HIGHEST = -(2**63) + 1, 2**63 - 1


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` of float64 matrices of whole numbers of at most ``PLAIN`` each, as int64."""
    out = np.zeros((len(a), len(b)), np.int64)
    if not a.size or not b.size:
        return out
    largest = max(1, int(np.abs(a).max()) * int(np.abs(b).max()))
    strip = max(1, (EXACT - 1) // largest)
    for start in range(0, a.shape[1], strip):
        out += (a[:, start: start + strip] @ b[:, start: start + strip].T).astype(np.int64)
    return out


def integer_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` of matrices of Python integers, cut to 64 bits."""
    return np.clip(a.dot(b.T), LOWEST, HIGHEST).astype(np.int64) if a.size and b.size else np.zeros((len(a), len(b)), np.int64)


def _integers(x: np.ndarray) -> np.ndarray:
    """``floor(256 x)`` as Python integers, whatever the size of ``x``."""
    out = np.empty(x.shape, object)
    for at, value in np.ndenumerate(x):
        out[at] = int(value) * 256 if abs(value) >= EXACT else int(np.floor(256 * value))
    return out


class Vectors:
    """Vectors of one length, ``floor(256 x)``; the few with large components stand apart."""

    def __init__(self, x: np.ndarray):
        with np.errstate(over="ignore"):
            whole = np.floor(256 * x)
        large = (np.abs(whole) > PLAIN).any(axis=1)
        self.size = len(x)
        self.plain, self.large = np.flatnonzero(~large), np.flatnonzero(large)
        self._plain, self._x = whole[self.plain], x
        self._large = _integers(x[self.large])

    def scores(self, other: Vectors) -> np.ndarray:
        """Inner products with every vector of ``other``, as int64."""
        out = np.empty((self.size, other.size), np.int64)
        out[np.ix_(self.plain, other.plain)] = exact_products(self._plain, other._plain)
        if len(self.large):
            out[self.large] = integer_products(self._large, _integers(other._x))
        if len(other.large) and len(self.plain):
            out[np.ix_(self.plain, other.large)] = integer_products(_integers(self._x[self.plain]), other._large)
        return out


def by_length(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and the matrix of their vectors, one pair for each length above 0."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    ends = np.cumsum(lengths)
    for length in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == length)
        yield rows, values[(ends[rows] - length)[:, None] + np.arange(length)]


class Best:
    """The best ``k`` rows of each question; higher scores first, equal ones by smaller id.

    Ties are safe: a row that equals a question's least kept score still enters if its id is smaller.
    """

    def __init__(self, questions: int, k: int):
        self.k = k
        self.ids = [np.zeros(0, np.int64)] * questions
        self.scores = [np.zeros(0, np.int64)] * questions
        self.least = np.full(questions, LOWEST, np.int64)

    def add(self, questions: np.ndarray, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        """Offers a tile of ``scores``, a row for each of ``questions``, a column for each of ``ids``."""
        open_ = allowed & (scores >= self.least[questions][:, None])
        for row in np.flatnonzero(open_.any(axis=1)).tolist():
            question, columns = questions[row], np.flatnonzero(open_[row])
            found = scores[row, columns]
            if len(found) > 4 * self.k:
                columns = columns[found >= np.partition(found, -self.k)[-self.k]]
                found = scores[row, columns]
            s = np.concatenate([self.scores[question], found])
            i = np.concatenate([self.ids[question], ids[columns]])
            order = np.lexsort((i, -s))[: self.k]
            self.scores[question], self.ids[question] = s[order], i[order]
            if len(order) == self.k:
                self.least[question] = s[order[-1]]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Question, id and score of all that is kept."""
        sizes = [len(i) for i in self.ids]
        if not sum(sizes):
            return (np.zeros(0, np.int64),) * 3
        return np.repeat(np.arange(len(sizes)), sizes), np.concatenate(self.ids), np.concatenate(self.scores)
