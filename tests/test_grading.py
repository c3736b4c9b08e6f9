from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from skumetry import Policy, StockPlan, schemas
from skumetry.operators import classes, summaries
from skumetry.policy import ACTIONS_SCRIPT, ACTIONS_SQL, CELL_TERMS

SQL, SCRIPT = Policy(), Policy(semantics="script")


def revenues(lines, *amounts):
    return lines(*[{"stock_code": f"SKU{i:03d}", "quantity": a} for i, a in enumerate(amounts)])


@pytest.mark.parametrize("amounts, sql_classes, script_classes", [
    ((80, 15, 5), "ABC", "ABC"),
    ((90, 6, 4), "BCC", "BCC"),
    ((80004, 14996, 5000), "ABC", "BBC"),
    ((100,), "C", "C"),
])
def test_abc_borders(lines, amounts, sql_classes, script_classes):
    for policy, expected in ((SQL, sql_classes), (SCRIPT, script_classes)):
        graded = StockPlan(revenues(lines, *amounts), policy).graded.orderBy("revenue_rank").collect()
        assert "".join(r.abc_class for r in graded) == expected
        assert float(graded[-1].revenue_cum_pct) == 1.0


def test_equal_revenues_are_ranked_by_stock_code(lines):
    rows = StockPlan(revenues(lines, 5, 5, 5)).graded.orderBy("revenue_rank").collect()
    assert [r.stock_code for r in rows] == ["SKU000", "SKU001", "SKU002"]
    assert [r.revenue_cumsum for r in rows] == [Decimal(5), Decimal(10), Decimal(15)]


def test_cell_and_action(spark):
    rows = [(abc, xyz) for abc in "ABC" for xyz in "XYZ"] + [("D", "X")]
    data = spark.createDataFrame(rows, "abc_class string, xyz_class string")
    for policy, actions in ((SQL, ACTIONS_SQL), (SCRIPT, ACTIONS_SCRIPT)):
        found = {r.abc_xyz: r.strategic_action for r in classes.with_cell(data, policy).collect()}
        assert found == {**actions, "DX": "Unclassified"}


@pytest.fixture(scope="module")
def graded(spark):
    rows = [
        ("S1", "A", "X", "70.00", "0.4000", "1.0000"), ("S2", "A", "Z", "10.00", None, "2.0000"),
        ("S3", "C", "Z", "19.50", "1.5000", "3.0000"), ("S4", "C", "Z", "0.50", "2.0000", "4.0000"),
    ]
    data = spark.createDataFrame(
        rows, "stock_code string, abc_class string, xyz_class string, r string, c string, p string"
    )
    return data.select(
        "stock_code", "abc_class", "xyz_class", F.concat("abc_class", "xyz_class").alias("abc_xyz"),
        F.col("r").cast(schemas.MONEY).alias("total_revenue"), F.col("c").cast(schemas.RATIO).alias("cv"),
        F.col("p").cast(schemas.UNIT_COST).alias("avg_unit_price"),
    )


def test_abc_summary(graded):
    rows = {r.abc_class: r for r in summaries.abc_summary(graded, SQL).collect()}
    assert set(rows) == {"A", "C"}
    a = rows["A"]
    assert (a.sku_count, str(a.pct_skus), int(a.total_revenue), str(a.pct_revenue), str(a.avg_price)) == (
        2, "50.0", 80, "80.0", "1.5000")
    full = {r.abc_class: r for r in summaries.abc_summary(graded, SQL, complete=True).collect()}
    assert (full["B"].sku_count, full["B"].total_revenue) == (0, 0)
    assert full["B"].implication.startswith("Standard service")
    script = {r.abc_class: r for r in summaries.abc_summary(graded, SCRIPT).collect()}
    assert (script["C"].pct_revenue, script["C"].pct_skus) == (0.2, 0.5)


def test_xyz_summary(graded):
    rows = {r.xyz_class: r for r in summaries.xyz_summary(graded, SQL, complete=True).collect()}
    assert (rows["Z"].sku_count, rows["Z"].cv_mean, rows["Z"].cv_median) == (3, 1.75, 1.75)
    assert (rows["Y"].sku_count, rows["Y"].cv_mean) == (0, None)


def test_matrix_views_agree(graded):
    counts = {r.abc_class: (r.X, r.Y, r.Z) for r in summaries.matrix_counts(graded).collect()}
    assert counts == {"A": (1, 0, 1), "B": (0, 0, 0), "C": (0, 0, 2)}
    money = {r.abc_class: (r.X, r.Y, r.Z) for r in summaries.matrix_revenue(graded).collect()}
    assert money["C"] == (0, 0, Decimal("20.00"))
    margins = {r.abc_class: r for r in summaries.matrix_margins(graded, SQL).collect()}
    assert (margins["A"].row_total, margins["A"].revenue, str(margins["A"].pct_revenue)) == (
        2, Decimal("80.00"), "80.0")
    assert margins["B"].row_total == 0 and margins["B"].revenue == 0
    cells = {(r.abc_class, r.xyz_class): r for r in summaries.matrix_long(graded, SQL).collect()}
    assert set(cells) == {("A", "X"), ("A", "Z"), ("C", "Z")}
    assert str(cells["C", "Z"].pct_revenue) == "20.00" and cells["C", "Z"].avg_cv == 1.75
    policies = {r.abc_xyz: r for r in summaries.cell_policy(graded).collect()}
    assert len(policies) == len(CELL_TERMS) and policies["BY"].sku_count == 0
    assert policies["CZ"].sku_count == 2 and policies["AX"].zone == "PREMIUM STOCK"


def test_high_value_volatile_and_floor(graded):
    row = summaries.high_value_volatile(graded).first()
    assert (row.sku_count, row.revenue) == (1, Decimal("10.00"))
    floors = {r.abc_class: r for r in summaries.class_revenue_floor(graded).collect()}
    assert floors["A"].min_revenue == Decimal("10.00") and floors["A"].log_min_revenue == 1.0
    assert "B" not in floors


def test_master_conforms_and_partitions_the_skus(lines):
    data = lines.weekly({"SKU001": [5, 6, 7], "SKU002": [1], "SKU003": [1, 1, 9], "SKU004": [2, 2]})
    for policy in (SQL, SCRIPT):
        master = StockPlan(data, policy).sku_master
        assert [f.name for f in master.schema] == schemas.sku_master(policy).fieldNames()
        assert master.count() == master.select("stock_code").distinct().count() == 4


def test_conform_reports_wrong_types(spark):
    with pytest.raises(schemas.SchemaMismatch, match="qty_sold"):
        schemas.conform(spark.sql("SELECT 'a' AS stock_code, DATE'2011-01-03' AS week_start, 'b' AS year_week, 1 AS qty_sold"),
                        schemas.WEEKLY_DEMAND)


def test_semantics_are_checked():
    with pytest.raises(ValueError, match="semantics"):
        Policy(semantics="pandas")


def test_order_of_input_does_not_matter(lines):
    data = lines.weekly({f"SKU{i:03d}": [i % 7 + 1, i % 3 + 1, i % 5 + 1] for i in range(60)})
    shuffled = data.orderBy(F.md5("invoice_no")).repartition(7)
    for policy in (SQL, SCRIPT):
        first, second = StockPlan(data, policy).sku_master, StockPlan(shuffled, policy).sku_master
        assert first.exceptAll(second).isEmpty() and second.exceptAll(first).isEmpty()


def test_one_cube_gives_cells_margins_and_the_total(spark, graded):
    cube = {(r.level, r.abc_class, r.xyz_class): r for r in summaries.class_cube(graded).collect()}
    assert len(cube) == 3 + 2 + 2 + 1
    assert (cube[0, "C", "Z"].sku_count, cube[0, "C", "Z"].revenue, cube[0, "C", "Z"].avg_cv) == (2, Decimal(20), 1.75)
    assert (cube[1, "A", None].sku_count, cube[1, "A", None].revenue, cube[1, "A", None].avg_cv) == (2, Decimal(80), 0.4)
    assert (cube[2, None, "Z"].sku_count, cube[2, None, "Z"].revenue) == (3, Decimal(30))
    assert (cube[3, None, None].sku_count, cube[3, None, None].revenue, cube[3, None, None].prices) == (4, Decimal(100), Decimal(10))
    assert cube[0, "A", "Z"].avg_cv is None
    empty = summaries.class_cube(graded.limit(0)).collect()
    assert [(r.level, r.sku_count) for r in empty] in ([], [(3, 0)])


def test_views_of_cells_equal_views_of_skus(graded):
    cells = summaries.class_cells(graded)
    views = (
        lambda g: summaries.abc_summary(g, SQL), lambda g: summaries.abc_summary(g, SCRIPT, complete=True), lambda g: summaries.matrix_long(g, SQL),
        summaries.matrix_counts, summaries.matrix_revenue, lambda g: summaries.matrix_margins(g, SQL), summaries.cell_policy, summaries.high_value_volatile,
    )
    for view in views:
        assert sorted(map(str, view(graded).collect())) == sorted(map(str, view(cells).collect()))


def test_means_of_doubles_do_not_depend_on_partitions(spark):
    values = [(f"S{i}", "A", "X", 0.1 + i / 7, 1.0 / (i + 1), 1.0) for i in range(300)]
    df = spark.createDataFrame(values, "stock_code string, abc_class string, xyz_class string, cv double, avg_unit_price double, revenue double")
    df = df.withColumn("total_revenue", F.col("revenue").cast(schemas.MONEY))
    found = {tuple(summaries.class_cube(df.repartition(n, "stock_code")).where("level = 0").first())[3:] for n in (1, 3, 17)}
    assert len(found) == 1


def test_the_graded_table_is_aggregated_once(lines):
    plan = StockPlan(revenues(lines, *range(1, 40)))
    plan.abc_summary().collect()
    for view in (plan.abc_summary(), plan.matrix_long(), summaries.matrix_counts(plan.cells), summaries.matrix_margins(plan.cells, SQL)):
        assert set(view.inputFiles()) <= set(plan.cells.inputFiles())
