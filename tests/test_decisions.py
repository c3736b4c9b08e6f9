from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from skumetry import Policy, StockPlan, schemas
from skumetry.operators import exports, rationalise, reorder
from skumetry.policy import PROTECT, RATIONALISE_SCRIPT, RATIONALISE_SQL, SINGLE_EVENT_SCRIPT, SINGLE_EVENT_SQL
from skumetry.sources import outputs

SQL, SCRIPT = Policy(), Policy(semantics="script")


def selected(spark, policy, abc, mean, deviation):
    kind = (lambda t: t) if policy.rounded else (lambda t: "double")
    return spark.sql(f"""
        SELECT 'SKU001' AS stock_code, 'TEXT' AS description, '{abc}' AS abc_class, 'X' AS xyz_class, '{abc}X' AS abc_xyz,
               CAST('{mean}' AS {kind('decimal(18,2)')}) AS weekly_demand_mean,
               CAST('{deviation}' AS {kind('decimal(18,2)')}) AS weekly_demand_std,
               CAST('1.3' AS {kind('decimal(12,4)')}) AS cv, CAST(9 AS decimal(18,2)) AS total_revenue,
               CAST(1 AS {kind('decimal(14,4)')}) AS avg_unit_price, CAST(1 AS BIGINT) AS total_qty_sold""")


@pytest.mark.parametrize("abc, mean, deviation, sql, script", [
    ("A", "100", "20", (200, 58, 258), (200, 58, 258)),
    ("A", "12.25", "10", (25, 29, 54), (24, 29, 54)),
    ("A", "12.2", "9.78", (24, 28, 53), (24, 28, 53)),
    ("B", "10", "5", (30, 14, 44), (30, 14, 44)),
    ("C", "10", "5", (40, 13, 53), (40, 13, 53)),
    ("C", "10", "250.00", (40, 641, 681), (40, 640, 680)),
])
def test_reorder_points(spark, abc, mean, deviation, sql, script):
    for policy, expected in ((SQL, sql), (SCRIPT, script)):
        rop = reorder.reorder_points(selected(spark, policy, abc, mean, deviation), policy)
        row = schemas.conform(rop, schemas.reorder_points(policy)).first()
        assert (int(row.avg_demand_lt), int(row.safety_stock), int(row.reorder_point)) == expected
        assert row.stockout_risk_flag
        assert (row.service_level_pct, row.lead_time_weeks) == {
            "A": (98, 2), "B": (95, 3), "C": (90, 4)}[abc]


def test_eligibility_comes_before_ranking(lines):
    data = lines.weekly({"BIG001": [900, 900], "SKU001": [5, 6, 7], "SKU002": [1, 2, 3], "SKU003": [1, 1, 1]})
    plan = StockPlan(data, Policy(rop_top_n=2))
    assert {r.stock_code for r in plan.reorder_points.collect()} == {"SKU001", "SKU002"}
    assert {r.description for r in plan.reorder_points.collect()} == {"LANTERN"}


def test_reorder_point_is_at_least_lead_time_demand(lines):
    data = lines.weekly({f"SKU{i:03d}": [i + 1, 3 * i % 11 + 1, 2, 5 * i % 7 + 1] for i in range(40)})
    for policy in (SQL, SCRIPT):
        assert StockPlan(data, policy).reorder_points.where("reorder_point < avg_demand_lt").isEmpty()


def test_rop_summary_and_lists(lines):
    data = lines.weekly({"SKU001": [100, 120, 80], "SKU002": [1, 1, 1, 30], "SKU003": [3, 3, 3]})
    plan = StockPlan(data)
    totals = reorder.rop_summary(plan.reorder_points, SQL).agg(
        F.sum("skus").alias("n"), F.sum("stockout_risk_skus").alias("r")).first()
    assert tuple(totals) == (3, 1)
    top = reorder.highest_reorder_points(plan.reorder_points, 1).first()
    assert top.stock_code == "SKU001"
    exported = exports.rop_export(plan.reorder_points)
    assert {"StockCode", "Annual Revenue (£)", "avg_weekly_demand"} <= set(exported.columns)
    flags = {r.stock_code: r.stockout_risk_flag for r in reorder.rop_sheet(plan.reorder_points).collect()}
    assert flags == {"SKU001": "OK", "SKU002": "⚠ YES", "SKU003": "OK"}


CASES = [
    ("S1", 1, 5, 4, "single", "SINGLE_EVENT"),
    ("S2", 2, 4, 1, "protect", "PROTECT"),
    ("S3", 2, 2, 3, "protect", "PROTECT"),
    ("S4", 2, 3, 2, "rationalise", "RATIONALISE"),
    ("S5", 2, 3, 0, "rationalise", "RATIONALISE"),
]


@pytest.fixture(scope="module")
def cz_master(spark):
    rows = [(c, w, i, k, "CZ") for c, w, i, k, *_ in CASES] + [("S9", 1, 9, 9, "AZ")]
    data = spark.createDataFrame(
        rows, "stock_code string, weeks_with_demand long, n_invoices long, n_customers long, abc_xyz string")
    return data.withColumns({
        "description": F.lit("TEXT"), "total_revenue": F.lit(Decimal("10.00")).cast(schemas.MONEY),
        "weekly_demand_mean": F.lit(Decimal("2.00")),
        "cv": F.when(F.col("weeks_with_demand") > 1, F.lit(Decimal("1.2345"))).cast(schemas.RATIO),
    })


@pytest.mark.parametrize("policy, single, rational", [
    (SQL, SINGLE_EVENT_SQL, RATIONALISE_SQL), (SCRIPT, SINGLE_EVENT_SCRIPT, RATIONALISE_SCRIPT)])
def test_recommended_action(cz_master, policy, single, rational):
    texts = {"single": single, "protect": PROTECT, "rationalise": rational}
    found = {r.stock_code: r.recommended_action for r in rationalise.rationalisation_list(cz_master, policy).collect()}
    assert found == {code: texts[kind] for code, *_, kind, _ in CASES}
    flags = {r[0]: r[1] for r in cz_master.select("stock_code", rationalise.rationalisation_flag(policy)).collect()}
    assert flags == {**{code: flag for code, *_, flag in CASES}, "S9": None}


def test_rationalisation_summary_and_profile(cz_master):
    cz = rationalise.rationalisation_list(cz_master, SQL)
    rows = {r.recommended_action.split()[0]: r for r in rationalise.rationalisation_summary(cz, SQL).collect()}
    assert (rows["PROTECT"].sku_count, int(rows["PROTECT"].total_revenue), str(rows["PROTECT"].avg_cv)) == (2, 20, "1.235")
    assert rows["SINGLE"].avg_cv is None and str(rows["RATIONALISE"].avg_customers) == "1.0"
    profile = rationalise.action_profile(cz).first()
    assert (profile.cz_skus, profile.protect_skus, profile.rationalise_skus, profile.single_event_skus) == (5, 2, 2, 1)
    # The single event has the loyalty flag as well, so it counts as protected revenue.
    assert (profile.protected_revenue, profile.unprotected_revenue) == (30, 20)
    assert (profile.protect_revenue, profile.rationalise_revenue, profile.single_event_revenue) == (20, 20, 10)
    keys = {r.action_key for r in rationalise.action_sheet(rationalise.rationalisation_summary(cz, SQL)).collect()}
    assert keys == {"PROTECT", "RATIONALISE", "SINGLE"}
    assert rationalise.rationalise_candidates(cz).count() == 2
    ordered = [r.action.split()[0] for r in outputs.in_file_order(exports.rationalisation_export(cz), "rationalisation_list").collect()]
    assert ordered == sorted(ordered)
