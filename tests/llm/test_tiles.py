from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from skumetry.llm.tiles import EXACT, HIGHEST, LOWEST, PLAIN, Best, Vectors, by_length, exact_products


@pytest.mark.parametrize("largest", [3, 1000, PLAIN])
def test_products_are_exact(largest):
    rng = np.random.default_rng(largest)
    a, b = (rng.integers(-largest, largest + 1, (n, 5000)) for n in (3, 4))
    a[0], b[0] = largest, largest  # sums beyond what one strip may hold
    assert (exact_products(a.astype(float), b.astype(float)) == a.astype(object).dot(b.T.astype(object))).all()


def test_large_components_are_multiplied_as_integers():
    x = np.array([[1.0, -0.001], [1e300, 1.0], [-1e300, 2.0], [2.0**40, 3.0], [1e308, 1e308]])
    whole = [[int(v) * 256 if abs(v) >= EXACT else int(np.floor(256 * v)) for v in row] for row in x.tolist()]
    exact = [[sum(p * q for p, q in zip(a, b)) for b in whole] for a in whole]
    got = Vectors(x).scores(Vectors(x))
    assert got.tolist() == [[min(max(e, LOWEST), HIGHEST) for e in row] for row in exact]


def test_vectors_by_length():
    column = pa.array([[1.0], [2.0, 3.0], [], [4.0], None, [5.0, 6.0]], pa.list_(pa.float64()))[1:]
    column = column.filter(pa.array([True, True, True, False, True]))
    assert {x.shape[1]: (rows.tolist(), x.tolist()) for rows, x in by_length(column)} == {1: ([2], [[4.0]]), 2: ([0, 3], [[2.0, 3.0], [5.0, 6.0]])}


@pytest.mark.parametrize("tile", [1, 7, 500])
def test_best_keeps_ties_by_id_whatever_the_tiles(tile):
    rng = np.random.default_rng(tile)
    scores, ids = rng.integers(0, 6, (3, 500)), rng.permutation(500)
    allowed = rng.random((3, 500)) < 0.7
    best = Best(5, 10)
    for i in range(0, 500, tile):
        best.add(np.array([0, 2, 4]), scores[:, i: i + tile], ids[i: i + tile], allowed[:, i: i + tile])
    expected = [(q, i, s) for row, q in enumerate((0, 2, 4)) for s, i in [(-a, b) for a, b in sorted((-s, i) for s, i, ok in zip(scores[row].tolist(), ids.tolist(), allowed[row]) if ok)[:10]]]
    assert list(zip(*[c.tolist() for c in best.rows()])) == expected
