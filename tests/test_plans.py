"""The physical plans stay the ones that scale."""

import re

import pytest

import __spark_entry__ as registry
from skumetry import Policy, StockPlan
from skumetry.operators import classes, sku
from skumetry.session import written
from skumetry.sources.order_tables import CODE_PATTERN, OrderTables

SF_DIR = "/root/testdata/sf0.001"
SQL, SCRIPT = Policy(), Policy(semantics="script")


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def flat(spark, lines, tmp_path_factory):
    """Transactions as a Parquet table with every column."""
    path = str(tmp_path_factory.mktemp("flat") / "transactions")
    lines.weekly({f"SKU{i:03d}": [i + 1, 2, 3] for i in range(30)}).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("name", [
    "matrix_long", "sku_master", "reorder_points", "summary_stats", "cz_axis_caps", "cv_histogram", "heatmap_cells",
])
def test_no_cross_join_and_no_python(spark, name):
    plan = physical(registry.queries()[name](spark, SF_DIR))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "InArrow"):
        assert node not in plan


def test_invoice_lines_are_hash_aggregated(flat):
    """The first aggregate above each scan has fixed-size buffers or none."""
    for policy in (SQL, SCRIPT):
        plan = StockPlan(flat, policy)
        for table in (sku.sku_totals(plan.week_rollup, policy), plan.buyers, plan.descriptions):
            above_scan = physical(table).splitlines()[::-1]
            first = next(line for line in above_scan if "Aggregate" in line)
            assert "HashAggregate" in first, first


def test_cleaning_reaches_the_scan_and_columns_are_pruned(flat):
    rollup = StockPlan(flat).week_rollup
    plan = rollup._jdf.queryExecution().explainString(
        rollup._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    pushed = re.search(r"PushedFilters: \[(.*?)\]\n", plan).group(1)
    for predicate in ("StringStartsWith(invoice_no,C)", "GreaterThan(quantity,0)", "GreaterThan(unit_price,0.00)"):
        assert predicate in pushed
    read = re.search(r"ReadSchema: struct<(.*?)>", plan).group(1)
    assert {c.split(":")[0] for c in re.split(r",(?=[a-z_]+:)", read)} == {
        "invoice_no", "stock_code", "quantity", "invoice_date", "unit_price"}


def test_one_shuffle_of_lines_per_rollup(flat):
    plan = physical(sku.sku_totals(StockPlan(flat).week_rollup, SQL))
    assert plan.count("Exchange hashpartitioning(stock_code") == 2
    assert "SinglePartition" not in plan


def test_sku_rows_never_meet_in_one_task(flat):
    """The only single-task exchange under the graded table is over the per-range sums."""
    totals = written(sku.sku_totals(StockPlan(flat).week_rollup, SQL))
    plan = physical(classes.rank_by_revenue(totals, SQL, ranges=4))
    singles = [i for i, line in enumerate(plan.splitlines()) if "SinglePartition" in line]
    assert len(singles) == 1
    below = plan.splitlines()[singles[0] + 1]
    assert "HashAggregate(keys=[_range" in below


def test_summaries_read_no_buyers_or_texts(spark):
    plan = physical(registry.queries()["matrix_long"](spark, SF_DIR))
    assert "description" not in plan and "customer" not in plan


def test_top_list_is_not_fully_sorted(flat):
    plan = StockPlan(flat)
    assert "TakeOrderedAndProject(limit=80" in physical(plan.reorder_numbers)


@pytest.fixture()
def shuffled(spark):
    """Joins as they are planned for tables too large to broadcast."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {n: spark.conf.get(n, None) for n in names}
    for name in names:
        spark.conf.set(name, "-1")
    yield
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


@pytest.mark.parametrize("name", ["reorder_points", "sku_master"])
def test_lines_are_reduced_before_they_meet_the_parts(spark, shuffled, name):
    plan = physical(registry.queries()[name](spark, SF_DIR)).splitlines()
    for i, line in enumerate(plan):
        if "hashpartitioning(l_partkey" in line:
            assert "HashAggregate" in plan[i + 1]
    if name == "reorder_points":
        semi = next(line for line in plan if "LeftSemi" in line)
        assert "stock_code" in semi and "part" not in semi.split("LeftSemi")[0].split("[")[0]


@pytest.mark.parametrize("name", ["xyz_summary", "sku_distribution", "cv_histogram"])
def test_reports_of_variability_rank_nothing(spark, name):
    assert "total_revenue" not in physical(registry.queries()[name](spark, SF_DIR)).replace("total_revenue_cents", "")


def test_key_figures_read_no_orders(spark, monkeypatch):
    from skumetry.sources.order_tables import OrderTables

    asked = []
    real = OrderTables.table
    monkeypatch.setattr(OrderTables, "table", lambda self, name: asked.append(name) or real(self, name))
    plan = StockPlan(OrderTables(spark, SF_DIR), Policy(code_pattern=r"^[0-9A-Z]{5,}\z"))
    extent_only = __import__("skumetry.operators.reports", fromlist=["extent"]).extent(plan.graded)
    assert extent_only.count() == 1 and "orders" not in asked


def test_buyers_of_few_skus_read_only_their_lines(spark):
    plan = StockPlan(OrderTables(spark, SF_DIR), Policy(code_pattern=CODE_PATTERN))
    codes = plan.weekly_demand.select("stock_code").distinct().limit(3)
    few = plan.buyers_of(codes)
    every = {r.stock_code: tuple(r) for r in plan.buyers.collect()}
    assert sorted(map(tuple, few.collect())) == sorted(every[r.stock_code] for r in codes.collect())
    text = few._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("o_orderkey") < text.index("LeftSemi")  # the codes filter lines below the join with orders


def test_policy_chooses_sketched_medians(spark):
    exact = StockPlan(OrderTables(spark, SF_DIR), Policy(code_pattern=CODE_PATTERN))
    near = StockPlan(OrderTables(spark, SF_DIR), Policy(code_pattern=CODE_PATTERN, sketch_k=3200))
    medians = [{r.xyz_class: r.cv_median for r in p.xyz_summary().collect()} for p in (exact, near)]
    assert medians[0].keys() == medians[1].keys()
    assert all(abs(medians[0][c] - medians[1][c]) < 0.02 for c in medians[0])
