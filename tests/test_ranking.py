import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import Row, Window
from pyspark.sql import functions as F

from skumetry.operators import ranking

random.seed(7)
REVENUES = {
    "skewed": [round(random.paretovariate(0.7), 2) for _ in range(3000)],
    "seven values": [float(random.randint(1, 7)) for _ in range(3000)],
    "all equal": [5.0] * 3000,
    "one row": [3.0],
    "no rows": [],
    "fewer rows than ranges": [3.0, 1.0, 2.0],
}


def table(spark, values):
    rows = [(f"S{i:05d}", Decimal(str(v))) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "stock_code string, total_revenue decimal(18,2)")


KEYS = [ranking.SortKey("total_revenue", falling=True), ranking.SortKey("stock_code")]


@pytest.mark.parametrize("name", REVENUES)
@pytest.mark.parametrize("ranges", [None, 1, 6])
def test_running_totals_equal_the_single_task_window(spark, name, ranges):
    data = table(spark, REVENUES[name])
    ours = ranking.running_totals(
        data, KEYS, {"rev": F.col("total_revenue"), "n": F.lit(1).cast("long")}, ranges
    )
    window = Window.orderBy(*[k.order for k in KEYS]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy()
    naive = data.select(
        "*", F.sum("total_revenue").over(window).alias("rev_running"), F.row_number().over(window).cast("long").alias("n_running"),
        F.sum("total_revenue").over(whole).alias("rev_total"), F.count(F.lit(1)).over(whole).alias("n_total"),
    )
    columns = naive.columns
    assert sorted(map(tuple, ours.select(columns).collect())) == sorted(map(tuple, naive.collect()))


def range_sizes(data, keys, ranges):
    borders = ranking._borders(data, keys, ranges, data.count())
    number = ranking._range_number(keys, borders, {f.name: f.dataType for f in data.schema.fields})
    return {r["n"]: r["count"] for r in data.groupBy(number.alias("n")).count().collect()}


def test_equal_values_are_spread_over_ranges(spark):
    sizes = range_sizes(table(spark, [5.0] * 6000), KEYS, 6)
    assert len(sizes) == 6 and max(sizes.values()) < 2000


@pytest.mark.parametrize("borders", [0, 1, 2, 3, 7, 8, 4000])
def test_binary_search_counts_the_borders_passed(spark, borders):
    rows = sorted({(random.randint(0, 600), f"S{random.randint(0, 99):02d}") for _ in range(30_000)}, key=lambda r: (-r[0], r[1]))
    chosen = sorted(random.sample(range(len(rows)), borders))
    limits = [Row(total_revenue=Decimal(rows[i][0]), stock_code=rows[i][1]) for i in chosen]
    data = spark.createDataFrame([(c, Decimal(v), p) for p, (v, c) in enumerate(rows)], "stock_code string, total_revenue decimal(18,2), place int")
    number = ranking._range_number(KEYS, limits, {f.name: f.dataType for f in data.schema.fields})
    found = {r.place: r.n for r in data.select("place", number.alias("n")).collect()}
    assert found == {p: sum(i <= p for i in chosen) for p in range(len(rows))}


def test_more_ranges_than_a_deep_expression_could_hold(spark):
    values = [round(random.paretovariate(0.9), 2) for _ in range(20_000)]
    data = ranking.written(table(spark, values).repartition(4))
    ours = ranking.running_totals(data, KEYS, {"rev": F.col("total_revenue"), "n": F.lit(1).cast("long")}, 400)
    running, total = Decimal(0), sum(Decimal(str(v)) for v in values)
    expected = {}
    for place, (value, code) in enumerate(sorted(((Decimal(str(v)), f"S{i:05d}") for i, v in enumerate(values)), key=lambda r: (-r[0], r[1]))):
        running += value
        expected[code] = (running, place + 1, total, len(values))
    found = {r.stock_code: (r.rev_running, r.n_running, r.rev_total, r.n_total) for r in ours.collect()}
    assert found == expected


def test_small_tables_get_few_ranges_and_the_plan_stays_flat(spark):
    data = ranking.written(table(spark, REVENUES["skewed"]))
    session_ranges = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3000")
    try:
        plan = ranking.running_totals(data, KEYS, {"n": F.lit(1).cast("long")})._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", session_ranges)
    assert "REPARTITION_BY_NUM" in plan and ", 3000), REPARTITION" not in plan


@pytest.mark.parametrize("values", [
    [1.0], [1.0, 2.0], [3.0, 1.0, 2.0], [1.0, 1.0, 1.0, 9.0], [float(i * i % 97) for i in range(500)],
])
def test_quantiles_interpolate_linearly(spark, values):
    data = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    row = ranking.quantiles(data, "v", {"q10": 0.1, "median": 0.5, "p98": 0.98, "top": 1.0}).first()
    expected = [float(np.quantile(values, q)) for q in (0.1, 0.5, 0.98, 1.0)]
    assert list(row) == pytest.approx(expected)


def test_grouped_quantiles(spark):
    groups = {"a": [1.0, 2.0, 3.0, 10.0], "b": [5.0], "c": [7.0] * 300 + [8.0] * 301}
    data = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    found = {r.g: r.m for r in ranking.quantiles(data, "v", {"m": 0.5}, by=["g"]).collect()}
    assert found == {g: float(np.median(vs)) for g, vs in groups.items()}


def test_top_by_breaks_ties_by_key(spark):
    data = table(spark, [1.0, 9.0, 9.0, 9.0])
    top = ranking.add_rank(ranking.top_by(data, "total_revenue", 2), "total_revenue", "rank")
    assert [(r["rank"], r.stock_code) for r in top.orderBy("rank").collect()] == [(1, "S00001"), (2, "S00002")]


@pytest.mark.parametrize("k", [200, 3200])
def test_sketched_quantiles_stay_within_their_rank_error(spark, k):
    rng = np.random.default_rng(8)
    groups = {"even": rng.uniform(0, 1, 20_000), "skewed": rng.pareto(0.8, 20_000), "few": rng.integers(0, 5, 20_000).astype(float), "one": np.array([7.0])}
    data = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs] + [("none", None)], "g string, v double").repartition(6)
    wanted = {"q10": 0.1, "median": 0.5, "p98": 0.98}
    found = {r.g: r for r in ranking.quantiles(data, "v", wanted, by=["g"], sketch_k=k).collect()}
    assert set(found) == set(groups)
    for g, values in groups.items():
        values = np.sort(values)
        for name, fraction in wanted.items():
            value = found[g][name]
            below, upto = np.searchsorted(values, value, "left") / len(values), np.searchsorted(values, value, "right") / len(values)
            assert value in values and below - ranking.rank_error(k) <= fraction <= upto + ranking.rank_error(k)


def test_sketches_of_periods_merge(spark):
    data = spark.createDataFrame([(i % 4, i % 2, float(i)) for i in range(4000)], "period int, g int, v double")
    kept = ranking.written(ranking.quantile_sketches(data, "v", ["period", "g"]))
    assert kept.count() == 4
    merged = {r.g: r.m for r in ranking.sketch_quantiles(ranking.merged_sketches(kept, ["g"]), {"m": 0.5}, ["g"]).collect()}
    assert all(abs(merged[g] - (2000 + g)) <= 4000 * ranking.rank_error(3200) + 2 for g in (0, 1))
    assert ranking.sketched_quantiles(data.limit(0), "v", {"m": 0.5}).count() == 0


def test_a_sketch_takes_one_pass_without_a_written_table(spark):
    data = spark.createDataFrame([(1, 2.0)], "g int, v double")
    plan = ranking.quantiles(data, "v", {"m": 0.5}, by=["g"], sketch_k=200)._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan and "Window" not in plan
