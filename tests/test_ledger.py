import bisect
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from skumetry import Policy
from skumetry.operators import ledger

DAY = dt.date(2011, 1, 1)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("period", ["month", "week", "year"])
def test_asof_join_equals_a_search(spark, period):
    rng = random.Random(3)
    facts = {("hot" if i % 3 else f"k{rng.randint(0, 5)}", DAY + dt.timedelta(days=rng.randint(0, 400))): i for i in range(500)}
    asked = [(rng.choice(["hot", "k0", "k1", "none", None]), rng.choice([None, *[DAY + dt.timedelta(days=d) for d in range(-40, 480, 7)]]), i) for i in range(300)]
    asked += [asked[0], asked[1]]
    right = spark.createDataFrame([(k, t, v, str(v)) for (k, t), v in facts.items()], "key string, at date, value int, name string")
    left = spark.createDataFrame(asked, "key string, at date, id int")
    got = ledger.asof_join(left, right, ["key"], "at", ["value", "name"], period)
    times = {}
    for k, t in sorted(facts):
        times.setdefault(k, []).append(t)
    expected = []
    for k, t, i in asked:
        place = bisect.bisect_right(times.get(k, []), t) if t and k else 0
        value = facts[k, times[k][place - 1]] if place else None
        expected.append((k, t, i, value, str(value) if place else None))
    assert got.columns == ["key", "at", "id", "value", "name"]
    assert rows(got) == sorted(expected, key=str)


def test_asof_join_of_ties_and_empty_tables(spark):
    right = spark.createDataFrame([("a", DAY, 1, None), ("a", DAY, 3, 0), ("a", DAY, 2, 9)], "key string, at date, value int, other int")
    left = spark.createDataFrame([("a", DAY)], "key string, at date")
    assert rows(ledger.asof_join(left, right, ["key"], "at", ["value", "other"])) == [("a", DAY, 3, 0)]
    assert rows(ledger.asof_join(left, right.limit(0), ["key"], "at", ["value"])) == [("a", DAY, None)]
    assert rows(ledger.asof_join(left.limit(0), right, ["key"], "at", ["value"])) == []


def movement(lines, *changes):
    return ledger.stock_movements(lines(*[
        {"stock_code": code, "quantity": quantity, "invoice_date": dt.datetime.combine(DAY + dt.timedelta(days=day), dt.time(hour))}
        for code, day, hour, quantity in changes
    ]))


def rop(spark, **mean_and_point):
    return spark.createDataFrame([(c, "A", "AZ", float(m), float(p)) for c, (m, p) in mean_and_point.items()],
                                 "stock_code string, abc_class string, abc_xyz string, weekly_demand_mean double, reorder_point double")


def test_returns_come_back_and_a_day_counts_as_a_whole(lines):
    moves = movement(lines, ("S", 0, 9, 5), ("S", 0, 17, -2), ("S", 0, 18, 4), ("S", 3, 9, -6), ("T", 1, 9, 1), ("S", 4, 9, 0))
    assert rows(moves) == [("S", DAY, 2, 9), ("S", DAY + dt.timedelta(days=3), 6, 0), ("T", DAY + dt.timedelta(days=1), 0, 1)]
    assert rows(ledger.ledger(moves))[1] == ("S", DAY + dt.timedelta(days=3), 8, 9)


def test_stock_before_between_and_after_movements(spark, lines):
    moves = movement(lines, ("S", 10, 9, 7), ("S", 20, 9, 6), ("S", 20, 12, -1), ("T", 5, 9, 1))
    days = [0, 9, 10, 15, 20, 40]
    reviews = spark.createDataFrame([(c, DAY + dt.timedelta(days=d)) for c in ("S", "QUIET", "UNKNOWN") for d in days], "stock_code string, day date")
    got = ledger.stock_gap(rop(spark, S=(2.6, 4), QUIET=(1, 0)), moves, reviews, Policy())
    found = {(r.stock_code, (r.review_day - DAY).days): (r.stock_on_hand, r.stock_gap, r.below_reorder_point) for r in got.collect()}
    opening = 11  # 4 weeks of 2.6, rounded up
    assert [found["S", d][0] for d in days] == [opening, opening, opening - 7, opening - 7, opening - 12, opening - 12]
    assert found["S", 10] == (4, 0, False) and found["S", 20] == (-1, -5, True)
    assert {found["QUIET", d] for d in days} == {(4, 4, False)} and not any(c == "UNKNOWN" for c, _ in found)


def test_a_review_at_every_month_end(lines):
    moves = movement(lines, ("S", 0, 9, 1), ("S", 70, 9, 1), ("T", 27, 9, 1))
    assert rows(ledger.month_ends(moves)) == [("S", dt.date(2011, m, d)) for m, d in ((1, 31), (2, 28), (3, 31))] + [("T", dt.date(2011, 1, 31))]


def test_a_hot_key_is_spread_over_periods(spark):
    right = spark.range(1000).select(F.lit("k").alias("key"), F.date_add(F.lit(DAY), F.col("id").cast("int")).alias("at"), F.col("id").alias("value"))
    plan = ledger.asof_join(right.select("key", "at"), right, ["key"], "at", ["value"])._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(key" in plan and "_period" in plan.split("Window")[1].split("hashpartitioning(")[1].split("ENSURE")[0]
