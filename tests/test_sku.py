import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from skumetry import Policy, StockPlan
from skumetry.functions.exact import clip, iso_week_label, rounded_mean, rounded_share
from skumetry.operators import classes, sku

SQL, SCRIPT = Policy(), Policy(semantics="script")


def test_sku_revenue(lines):
    data = lines(
        {"invoice_no": "1", "quantity": 2, "unit_price": "1.50", "customer_id": "a"},
        {"invoice_no": "1", "quantity": 1, "unit_price": "1.00", "customer_id": "a",
         "invoice_date": dt.datetime(2011, 5, 1, 23, 59)},
        {"invoice_no": "2", "quantity": 4, "unit_price": "1.00", "customer_id": None},
        {"invoice_no": "C3", "quantity": -4},
    )
    row = StockPlan(data, SQL).sku_revenue.first().asDict()
    assert row == {
        "stock_code": "85123A", "description": "LANTERN", "total_qty_sold": 7,
        "total_revenue": Decimal("8.00"), "n_invoices": 2, "n_customers": 1,
        "avg_unit_price": Decimal("1.1667"), "first_sale_date": dt.date(2011, 3, 1),
        "last_sale_date": dt.date(2011, 5, 1),
    }
    script = StockPlan(data, SCRIPT).sku_revenue.first()
    assert script.avg_unit_price == 3.5 / 3
    assert script.last_sale_date == dt.datetime(2011, 5, 1, 23, 59)


@pytest.mark.parametrize("texts, mode, greatest", [
    (["b", "a", "b", "a", None], "a", "b"),
    (["b", "b", "a"], "b", "b"),
    (["a", "a", "b"], "a", "b"),
    ([None, None], "", None),
])
def test_description(lines, texts, mode, greatest):
    data = lines(*[{"description": t} for t in texts])
    assert sku.sku_descriptions(sku.text_counts(data), SCRIPT).first().description == mode
    assert sku.sku_descriptions(sku.text_counts(data), SQL).first().description == greatest


@pytest.mark.parametrize("day, label", [
    ("2010-12-26", "2010-51"), ("2010-12-27", "2010-52"), ("2011-01-01", "2010-52"),
    ("2011-01-02", "2010-52"), ("2011-01-03", "2011-01"), ("2012-12-31", "2013-01"),
    ("2021-01-03", "2020-53"),
])
def test_iso_week_label(spark, day, label):
    data = spark.sql(f"SELECT DATE'{day}' AS d")
    assert data.select(iso_week_label(F.col("d"))).first()[0] == label
    assert data.select(iso_week_label(F.trunc("d", "week"))).first()[0] == label


def test_weekly_demand_sums_a_week_from_monday_to_sunday(lines):
    days = [dt.datetime(2011, 1, 1), dt.datetime(2011, 1, 2, 23, 59), dt.datetime(2011, 1, 3)]
    data = lines(*[{"invoice_date": d, "quantity": i + 1} for i, d in enumerate(days)])
    weeks = {r.year_week: r.qty_sold for r in StockPlan(data).weekly_demand.collect()}
    assert weeks == {"2010-52": 3, "2011-01": 3}


DEMAND = {
    "SKU001": ([10, 10, 10], "10.00", "0.00", "0.0000", "X", "X"),
    "SKU002": ([1, 2, 3], "2.00", "1.00", "0.5000", "X", "X"),
    "SKU003": ([1, 1, 1, 5], "2.00", "2.00", "1.0000", "Y", "Y"),
    "SKU004": ([1, 1, 1, 9], "3.00", "4.00", "1.3333", "Z", "Z"),
    "SKU005": ([149, 312], "230.50", "115.26", "0.5000", "X", "Y"),
    "SKU006": ([100], "100.00", None, None, "Z", "X"),
}


def test_demand_statistics_and_xyz_in_both_variants(lines):
    data = lines.weekly({code: spec[0] for code, spec in DEMAND.items()})
    for policy in (SQL, SCRIPT):
        stats = classes.with_xyz(StockPlan(data, policy).demand_stats, policy).collect()
        assert len(stats) == len(DEMAND)
        for row in stats:
            weeks, mean, deviation, cv, sql_class, script_class = DEMAND[row.stock_code]
            assert row.weeks_with_demand == len(weeks)
            if policy is SQL:
                assert str(row.weekly_demand_mean) == mean
                assert (row.weekly_demand_std is None) == (deviation is None)
                assert deviation is None or str(row.weekly_demand_std) == deviation
                assert (None if row.cv is None else str(row.cv)) == cv
                assert row.xyz_class == sql_class
            else:
                assert row.cv == pytest.approx(float(cv or 0), abs=5e-5)
                assert row.weekly_demand_std == pytest.approx(float(deviation or 0), abs=5e-3)
                assert row.xyz_class == script_class


def test_weeks_active_share_may_exceed_one(lines):
    row = StockPlan(lines.weekly({"SKU001": [1] * 60})).graded.first()
    assert row.weeks_active_pct == 60 / 52


def test_demand_statistics_agree_with_totals(lines):
    plan = StockPlan(lines.weekly({"SKU001": [4, 7], "SKU002": [3]}))
    wide = sku.sku_totals(plan.week_rollup, SQL).select(plan.demand_stats.columns)
    assert wide.exceptAll(plan.demand_stats).isEmpty()


def test_very_large_quantities_stay_exact(lines):
    big = 2_000_000_000
    row = StockPlan(lines.weekly({"SKU001": [big, big, big]}, price="99999.99")).graded.first()
    assert row.total_revenue == Decimal(big) * 3 * Decimal("99999.99")
    assert row.weekly_demand_std == 0


def test_prices_given_as_doubles_become_exact(lines):
    data = lines({"unit_price": "2.55"}, {"unit_price": "0.10", "quantity": 3})
    loose = data.withColumns({"unit_price": F.col("unit_price").cast("double"), "quantity": F.col("quantity").cast("long")})
    assert StockPlan(loose).graded.first().total_revenue == Decimal("2.85")


def test_exact_rounding(spark):
    data = spark.sql("SELECT CAST(41 AS BIGINT) AS s, CAST(40 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS z")
    row = data.select(
        rounded_mean(F.col("s"), F.col("n"), 2),           # 1.025
        rounded_share(F.col("s"), F.col("n"), 1, scale=100),  # 102.5
        rounded_mean(F.col("s"), F.lit(0), 2),
        clip(F.col("z").cast("double"), 0.0, 1.0),
    ).first()
    assert [str(v) for v in row] == ["1.03", "102.5", "None", "None"]
