"""Every registered query against DuckDB, and known figures of the test tables."""

import compare
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registry
from skumetry import StockPlan
from skumetry.operators import rationalise, reorder, summaries
from skumetry.sources.order_tables import OrderTables

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SF_DIR)


def test_every_query_has_an_oracle():
    assert set(registry.stock_queries()) <= set(registry.oracle_sql())


@pytest.mark.parametrize("name", list(registry.stock_queries()))
def test_query_matches_duckdb(spark, duck, name):
    result = registry.queries()[name](spark, SF_DIR)
    assert compare.differences(result, duck, registry.oracle_sql()[name]) == []


def test_entry(spark):
    assert registry.entry(spark).count() == 9


# Counts of the calendar year 1997, worked out independently of this engine:
# raw lines, cancelled lines, SKUs, eligible SKUs, one-week SKUs, the nine cells, CZ actions.
YEAR_1997 = {
    "0.001": (885, 273, 186, 116, 23, (39, 55, 9, 13, 21, 10, 10, 6, 23), (20, 0, 3)),
    "0.01": (8715, 2969, 1900, 1092, 325, (437, 589, 74, 175, 137, 146, 62, 44, 236), (218, 4, 14)),
    "0.1": (87698, 29149, 18891, 10962, 3221, (4321, 5626, 821, 1688, 1430, 1426, 713, 440, 2426), (2221, 28, 177)),
}


@pytest.mark.parametrize("scale", YEAR_1997)
def test_one_year_counts(spark, scale):
    raw, cancelled, skus, eligible, single, cells, actions = YEAR_1997[scale]
    transactions = OrderTables(spark, f"/root/testdata/sf{scale}").transactions(
        ("invoice_no", "stock_code", "quantity", "invoice_date", "unit_price", "customer_id"),
    ).where(F.year("invoice_date") == 1997)
    assert transactions.count() == raw
    assert transactions.where(F.col("invoice_no").startswith("C")).count() == cancelled
    plan = StockPlan(transactions)
    assert plan.graded.count() == skus
    assert reorder.eligible_skus(plan.graded, plan.policy).count() == eligible
    assert plan.graded.where("weeks_with_demand = 1").count() == single
    found = {r.abc_xyz: r.sku_count for r in summaries.cell_policy(plan.graded).collect()}
    assert tuple(found[a + x] for a in "ABC" for x in "XYZ") == cells
    profile = rationalise.action_profile(plan.rationalisation_numbers).first()
    assert (profile.single_event_skus, profile.protect_skus, profile.rationalise_skus) == actions
