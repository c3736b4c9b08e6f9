import datetime as dt
from decimal import Decimal

import numpy as np
import pytest

from skumetry import Policy, StockPlan
from skumetry.operators import extensions, sku


def graded(spark, *rows):
    """SKUs as code, class, XYZ class; mean 10 and deviation 4 a week."""
    return spark.createDataFrame([(c, a, x, Decimal(10), Decimal(4), Decimal("0.4"), 9) for c, a, x in rows],
                                 "stock_code string, abc_class string, xyz_class string, weekly_demand_mean decimal(12,2), weekly_demand_std decimal(12,2), cv decimal(10,4), weeks_with_demand int")


def test_lead_times_are_shrunk_to_their_class(spark):
    top = graded(spark, ("S", "A", "X"), ("T", "A", "X"), ("U", "A", "X"), ("V", "B", "X"))
    days = {"S": [7, 14, 21, -5, None], "T": [70], "V": [3]}
    events = spark.createDataFrame([(c, d) for c, ds in days.items() for d in ds], "stock_code string, lead_days int")
    got = {r.stock_code: r for r in extensions.measured_lead_time(top, events, Policy(lead_time_prior=2)).collect()}
    of_class = np.array([7, 14, 21, 70])
    for code, own in (("S", [7, 14, 21]), ("T", [70]), ("U", [])):
        n = len(own)
        mean = (sum(own) + 2 * of_class.mean()) / (n + 2)
        own_variance = np.var(own, ddof=1) if n > 1 else of_class.var(ddof=1)
        variance = (n * own_variance + 2 * of_class.var(ddof=1)) / (n + 2)
        assert got[code].n_lead_times == n and got[code].lead_time_weeks == pytest.approx(mean / 7)
        assert got[code].lead_time_std_weeks == pytest.approx(variance**0.5 / 7)
        stock = 2.054 * np.sqrt(mean / 7 * 16 + 100 * variance / 49)
        assert got[code].safety_stock == pytest.approx(stock) and got[code].reorder_point == pytest.approx(10 * mean / 7 + stock)
    # One event does not describe class B: its constants count like the prior.
    assert got["V"].lead_time_weeks == pytest.approx((3 + 2 * 21) / 3 / 7) and got["V"].lead_time_std_weeks == pytest.approx(0.75)


def test_a_plain_table_uses_the_constants(spark, lines):
    plan = StockPlan(lines.weekly({"85123A": [5, 7, 9], "85123B": [1, 1, 2]}))
    for row in plan.measured_lead_time().collect():
        weeks, spread = {"A": (2, 0.5), "B": (3, 0.75), "C": (4, 1.0)}[row.abc_class]
        assert (row.n_lead_times, row.lead_time_weeks) == (0, weeks) and row.lead_time_std_weeks == pytest.approx(spread)


def brute_percentile(weeks, lead, percent):
    series = [weeks.get(w, 0) for w in range(min(weeks), max(weeks) + 1)]
    sums = [sum(series[i: i + lead]) for i in range(max(1, len(series) - lead + 1))]
    point = float(np.quantile(sums, percent / 100))
    return len(series), point, max(0.0, point - sum(series) * min(lead, len(series)) / len(series))


SERIES = {
    "DENSE": {w: 1 + w % 5 for w in range(30)}, "SPARSE": {0: 90, 17: 3, 40: 55}, "NEXT": {3: 9, 4: 0, 5: 9}, "SHORT": {7: 1, 8: 2, 9: 400},
    "LONG": {w * w: 7 * w + 1 for w in range(25)}, "EVEN": {w: 6 for w in range(0, 60, 3)},
}


@pytest.mark.parametrize("abc, lead, percent", [("A", 2, 98), ("B", 3, 95), ("C", 4, 90)])
def test_sparse_percentiles_equal_a_filled_calendar(spark, lines, abc, lead, percent):
    monday = dt.datetime(2011, 1, 3, 8)
    table = lines(*[
        {"stock_code": code, "quantity": q, "invoice_date": monday + dt.timedelta(weeks=w, days=w % 7)} for code, weeks in SERIES.items() for w, q in weeks.items()
    ])
    top = graded(spark, *[(c, abc, "Z") for c in SERIES], ("NEVER", abc, "Z"), ("STEADY", abc, "X"))
    got = {r.stock_code: tuple(r)[2:] for r in extensions.lead_time_percentile(top, sku.week_rollup(table), Policy()).collect()}
    assert got == {c: pytest.approx(brute_percentile(weeks, lead, percent)) for c, weeks in SERIES.items()}
