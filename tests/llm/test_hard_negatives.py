from __future__ import annotations

import math

import compare
import numpy as np
import pytest
from pyspark.sql import functions as F

from skumetry.llm import hard_negatives, queries

SCHEMA = "vec_id long, embedding array<double>, label int, anchor string, score int"
LOW, HIGH = -(2**63) + 1, 2**63 - 1


def brute(rows, every=100, positives=5, negatives=10, low=30, high=90):
    whole = lambda x: int(x) * 256 if abs(x) >= 2**53 else math.floor(256 * x)
    ok = [(i, lab, [whole(x) for x in v]) for i, v, lab in rows if None not in (i, v, lab) and v and all(x is not None and math.isfinite(x) for x in v)]
    product = lambda a, b: min(max(sum(x * y for x, y in zip(a, b)), LOW), HIGH)
    out = []
    for i, lab, v in {(i, lab, tuple(v)) for i, lab, v in ok if i % every == 0}:
        scored = sorted((-product(v, w), j, other == lab) for j, other, w in ok if j != i and len(w) == len(v))
        for s, j, _ in [x for x in scored if x[2]][:positives]:
            fit = [(n, k) for n, k, same in scored if not same and low * -s <= 100 * -n <= high * -s][:negatives]
            out += [(i, j, r + 1, k, -s, -n) for r, (n, k) in enumerate(fit)]
    return sorted(out)


def vectors():
    rng = np.random.default_rng(9)
    centers = rng.normal(size=(4, 12))
    rows = [(i, (centers[i % 4] + rng.normal(size=12) * 0.6).tolist(), int(rng.integers(0, 4))) for i in range(900)]
    rows += [(i, rows[3][1], i % 2) for i in range(900, 1100)]  # one vector many times, two labels
    rows += [(300, rows[300][1], rows[300][2]), (301, rows[301][1], rows[301][2]), (500, rows[7][1], 3)]
    rows += [(2000, None, 1), (2100, [], 1), (2200, [math.nan] * 12, 1), (2300, [None] * 12, 1), (2400, [math.inf] * 12, 1), (None, rows[0][1], 1), (2500, rows[5][1], None)]
    rows += [(3000, [1.0, 2.0], 1), (3001, [1.0, 1.5], 1), (3002, [0.5, 0.9], 2), (3100, [-1.0, 0.0], 1), (3200, [0.0, 0.0], 2)]
    rows += [(4000, [1e300, 1.0, 0.0], 1), (4001, [1e300, 2.0, 0.0], 1), (4002, [1.0, 2.0, 0.0], 2), (4003, [0.0, 2.0, 1e9], 1), (4100, [0.0, 2.0, 1e9], 2), (4004, [0.0, 0.0, 0.5e9], 1)]
    return rows


def mined(spark, rows):
    df = spark.createDataFrame([(i, v, lab, "x", 1) for i, v, lab in rows], SCHEMA)
    return sorted(map(tuple, hard_negatives.hard_negatives(df, F.col("label"), F.col("vec_id") % 100 == 0).collect()))


@pytest.mark.parametrize("block, tile", [(4096, 256), (4, 2)])
def test_equals_brute_force(spark, monkeypatch, block, tile):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "TILE", tile)
    expected = brute(vectors())
    assert len(expected) > 300 and mined(spark, vectors()) == expected


@pytest.mark.parametrize("rows", [
    [], [(0, [1.0], 1)], [(0, [1.0], 1), (1, [1.0], 1)], [(0, [1.0], 1), (1, [1.0], 2)],
    [(0, [1.0], 1), (1, [1.0], 1), (2, [0.5], 2), (3, [0.5], 2), (4, [0.2], 2), (5, [0.3], 2), (6, [0.9], 2)],
    [(0, [0.0], 1), (1, [1.0], 1), (2, [-1.0], 2)],
])
def test_few_rows(spark, rows):
    assert mined(spark, rows) == brute(rows)


def test_slots_part_the_scores():
    limits, least = hard_negatives.slot_limits(np.array([1000, 1000, 501, 0, -7]), 30, 90)
    assert limits.tolist() == [900, 450, 0] and least == 0
    limits, least = hard_negatives.slot_limits(np.array([-5]), 30, 90)
    assert len(limits) == 0 and least == HIGH


def test_query_matches_sql(spark):
    import duckdb

    folder = "/root/testdata/sf0.01"
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{folder}/embeddings.parquet')")
    assert compare.differences(queries.queries()["op13_hard_negatives"](spark, folder), duck, hard_negatives.ORACLE_SQL) == []
