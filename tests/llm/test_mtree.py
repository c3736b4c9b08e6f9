from __future__ import annotations

import math

import numpy as np
import pytest

from skumetry.llm import mtree


def brute(rows, queries, k=5):
    ok = [(i, np.floor(256 * np.array(v, np.float64)).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in ok:
        if i in queries:
            scored = sorted((-int(q @ v), j) for j, v in ok if j != i and len(v) == len(q))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    return sorted(set(out))


def vectors():
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(6, 16))
    rows = [(i, (centers[i % 6] + rng.normal(size=16) * 0.3).astype(np.float32).tolist()) for i in range(500)]
    rows += [(i, rows[3][1]) for i in range(500, 740)]
    rows += [(800, None), (801, []), (802, [math.nan] + [0.0] * 15), (803, [None] + [0.0] * 15), (804, [math.inf] + [1.0] * 15), (None, rows[0][1]),
             (850, [0.0] * 16), (900, [1.0, 2.0, 3.0]), (901, [1.0, -2.0, 3.5])]
    return rows


@pytest.mark.parametrize("tree, page", [(4096, 64), (40, 5)])
def test_equals_brute_force(spark, monkeypatch, tree, page):
    monkeypatch.setattr(mtree, "TREE", tree)
    monkeypatch.setattr(mtree, "PAGE", page)
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in vectors()], "vec_id long, embedding array<float>, v string, rank int")
    got = mtree.top_k(df, df.where("vec_id % 50 = 0"))
    assert sorted(map(tuple, got.collect())) == brute(vectors(), set(range(0, 1000, 50)))


def whole(x):
    return int(x) * 256 if abs(x) >= 2**53 else math.floor(256 * x)


@pytest.mark.parametrize("block", [1024, 2])
def test_finite_vectors_of_any_size(spark, monkeypatch, block):
    """Products are exact, whatever their size; scores beyond 64 bits count as the nearest long."""
    monkeypatch.setattr(mtree, "TILE_BLOCK", block)
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(1, 40)]
    rows += [(50, [1e300, 1.0, 0.5]), (51, [-1e300, 1.0, 2.0]), (52, [1e300, -1e300, 3.0]), (100, [2.0**40, 1.0, -3.0]), (101, [1.5e13, 0.25, 0.0]), (101, [1.5e13, 0.25, 0.0]),
             (150, [0.0, 0.5, 1.0]), (151, [8192.0, -8192.0, 8191.99]), (200, [1e300]), (201, [2.0]), (202, [-1e-300])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = mtree.top_k(df, df.where("vec_id % 50 = 0"))
    expected = []
    for i, q in rows:
        if i % 50 == 0:
            pairs = [(max(min(sum(whole(a) * whole(b) for a, b in zip(q, v)), 2**63 - 1), -(2**63) + 1), j) for j, v in rows if j != i and len(v) == len(q)]
            expected += [(i, r + 1, j, s) for r, (s, j) in enumerate(sorted(pairs, key=lambda p: (-p[0], p[1]))[:5])]
    assert sorted(map(tuple, got.collect())) == sorted(expected)


def test_each_group_has_a_task_of_its_own(spark, monkeypatch):
    monkeypatch.setattr(mtree, "TREE", 20)
    monkeypatch.setattr(mtree, "GROUP", 2)
    df = spark.createDataFrame(vectors(), "vec_id long, embedding array<float>")
    plan = mtree.top_k(df, df.where("vec_id % 50 = 0"))._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_ID" in plan.upper() or "passthrough" in plan.lower() or "direct" in plan.lower(), plan


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [2.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, mtree.top_k(df, df.where("vec_id = 0")).collect())) == [(0, 1, 1, 256 * 512), (0, 2, 2, 256 * 512)]
    assert mtree.top_k(df.limit(0), df.limit(0)).count() == 0


def test_bounds_save_distances():
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(size=(400, 8)) * 5 + c for c in rng.normal(size=(8, 8)) * 400]).astype(np.int64)
    longest = int((v**2).sum(axis=1).max())
    tree = mtree.MTree(np.arange(len(v)), v, longest)
    best = mtree.Forest([tree]).search(-1, v[7], 5, longest)
    exact = sorted(((int(s), -i) for i, s in enumerate(v @ v[7])), reverse=True)[:5]
    assert sorted(best, reverse=True) == exact and tree.distances < len(v) / 2
