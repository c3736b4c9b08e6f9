import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skumetry import Policy, StockPlan
from skumetry.operators import rationalise, reports

SQL = Policy()


@pytest.fixture(scope="module")
def plan(lines):
    data = {f"SKU{i:03d}": [1 + (i * w * 7) % (3 + i) for w in range(1, 2 + i % 6)] for i in range(80)}
    return StockPlan(lines.weekly(data))


def test_pareto_points(plan):
    rows = reports.pareto_points(plan.graded).orderBy("sku_rank_pct").collect()
    assert len(rows) == 80
    shares = [r.revenue_pct for r in rows]
    assert shares == sorted(shares) and shares[-1] == 100.0
    assert rows[0].sku_rank_pct == 100 / 80
    cut = reports.pareto_cutoffs(plan.graded, SQL).first()
    assert cut.a_cutoff == sum(s <= 80 + 1e-9 for s in shares) / 80 * 100
    assert cut.a_cutoff <= cut.b_cutoff


def test_cv_histogram_matches_numpy(plan):
    cvs = [float(r.cv) for r in plan.graded.where("cv IS NOT NULL").collect()]
    expected, edges = np.histogram(np.clip(cvs, 0, 3), bins=60)
    rows = reports.cv_histogram(plan.graded).orderBy("bin").collect()
    assert [r.sku_count for r in rows] == expected.tolist()
    assert [r.bin_low for r in rows] == pytest.approx(edges[:-1].tolist())
    assert rows[-1].bin_high == pytest.approx(edges[-1])


def test_cv_histogram_of_one_value(lines):
    rows = reports.cv_histogram(StockPlan(lines.weekly({"SKU001": [2, 2]})).graded).orderBy("bin").collect()
    expected, _ = np.histogram([0.0], bins=60)
    assert [r.sku_count for r in rows] == expected.tolist()


def test_quadrant_sample_is_repeatable(plan):
    drawn = reports.quadrant_sample(plan.graded, size=10)
    again = reports.quadrant_sample(plan.graded.repartition(5), size=10)
    assert drawn.count() == 10 and drawn.exceptAll(again).isEmpty()
    assert reports.quadrant_sample(plan.graded, size=10, seed=1).exceptAll(drawn).count() > 0
    everything = reports.quadrant_sample(plan.graded)
    assert everything.count() == plan.graded.where("cv IS NOT NULL").count()
    assert everything.agg(F.max("cv")).first()[0] <= 2.5


def test_top_class_skus(plan):
    rows = plan.top_class_skus(n=5).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == [1, 2, 3, 4, 5]
    assert [r.total_revenue for r in rows] == sorted((r.total_revenue for r in rows), reverse=True)


def test_axis_caps(plan):
    cz = plan.rationalisation_numbers
    readings = [float(r.total_revenue) for r in cz.collect()]
    rows = {r.measure: r for r in reports.cz_axis_caps(cz).collect()}
    assert rows["total_revenue"].p98 == pytest.approx(float(np.quantile(readings, 0.98)))
    assert rows["total_revenue"].axis_limit == pytest.approx(rows["total_revenue"].p98 * 1.1)
    assert rows["n_customers"].axis_limit == rows["n_customers"].p98 + 2


def test_summary_stats(plan):
    rows = {r.position: r for r in plan.summary_stats().collect()}
    assert sorted(rows) == list(range(1, 19))
    assert rows[1].value == "80" and rows[1].amount == 80
    assert rows[3].value.startswith("2011-01-03 to 2011-")
    assert rows[4].value.startswith("£")
    assert sum(rows[p].amount for p in (5, 7, 8)) == 80
    assert sum(rows[p].amount for p in (9, 10, 11)) == 80
    assert math.isclose(sum(rows[p].detail for p in (9, 10, 11)), 1)
    actions = rationalise.action_profile(plan.rationalisation_numbers).first()
    assert rows[14].amount == actions.protect_skus
    assert rows[18].value.endswith(f" of {plan.reorder_numbers.count()} SKUs")


def test_kpi_strip(plan):
    rows = {r.position: r for r in plan.kpi_strip().collect()}
    assert sorted(rows) == list(range(1, 10))
    assert (rows[1].label, rows[1].value, rows[1].note) == ("Total SKUs", "80", "After data cleaning")
    assert rows[2].value.startswith("£") and rows[2].value.endswith("M")
    assert rows[2].note == "2-month period" and rows[8].value == f"Top {rows[8].amount:.0f} SKUs"
    assert rows[9].amount is None and rows[9].value.startswith("2011-01-03 to 2011-")
    assert rows[9].note.endswith(" transactions")


def test_texts_follow_the_policy_and_the_data(lines):
    data = lines.weekly({f"SKU{i:03d}": [i + 1, 2, 5 + i] for i in range(14)})
    for limit, modelled in ((10, 10), (80, 14)):
        plan = StockPlan(data, Policy(rop_top_n=limit))
        rows = {r.position: r for r in plan.summary_stats().collect()}
        assert rows[17].metric.startswith(f"Top {limit} ROP") and rows[18].value.endswith(f" of {modelled} SKUs")
        assert {r.position: r for r in plan.kpi_strip().collect()}[8].value == f"Top {modelled} SKUs"
