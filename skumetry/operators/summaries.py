"""Class, cell and distribution summaries of the graded SKU table.

The graded table is aggregated once, to the sums of its at most nine cells (``class_cells``).
Classes, matrix, pivots and margins are levels of one cube over these cells; each function
takes the graded table or its cells. All sums are exact, so results do not depend on partitions.
The unpartitioned windows that turn sums into shares run over a handful of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skumetry.functions.exact import rounded_mean, rounded_share, share
from skumetry.operators.classes import abc_spine, cell_spine, xyz_spine
from skumetry.operators.ranking import quantiles
from skumetry.policy import XYZ_CLASSES, Policy


def _share_of_all(column: str, digits: int, policy: Policy) -> Column:
    """Share of the column's total: rounded percent, or raw fraction in the script variant."""
    total = F.sum(column).over(Window.partitionBy())
    if policy.rounded:
        return rounded_share(F.col(column), total, digits, scale=100)
    return share(F.col(column), total)


def _money(column: str, policy: Policy) -> Column:
    """Whole currency units in the SQL variant's summaries."""
    return F.round(column, 0) if policy.rounded else F.col(column)


MONEY_TOTAL = "decimal(28,2)"
#: Doubles are summed as whole multiples of 10^-15, in any order the same; decimals as they are.
EXACT_SUM = "decimal(38,15)"


def _exact(column: str, df: DataFrame) -> Column:
    return F.col(column).cast(EXACT_SUM) if df.schema[column].dataType == T.DoubleType() else F.col(column)


def class_cells(graded: DataFrame) -> DataFrame:
    """Counts and exact sums of each occupied ABC-XYZ cell."""
    return graded.groupBy("abc_class", "xyz_class").agg(
        F.count(F.lit(1)).alias("cell_skus"),
        F.sum("total_revenue").cast(MONEY_TOTAL).alias("cell_revenue"),
        F.sum(_exact("avg_unit_price", graded)).alias("cell_prices"),
        F.count("cv").alias("cell_cvs"),
        F.sum(_exact("cv", graded)).alias("cell_cv_sum"),
    )


def class_cube(graded: DataFrame) -> DataFrame:
    """The cells with every margin and the grand total: ``level`` 0 cells, 1 ABC, 2 XYZ, 3 all.

    ``graded`` is the graded table or its ``class_cells``. ``avg_cv`` is the exact mean of the CVs
    there are, null without any.
    """
    cells = graded if "cell_skus" in graded.columns else class_cells(graded)
    cube = cells.cube("abc_class", "xyz_class").agg(
        F.grouping_id().cast("int").alias("level"),
        F.sum("cell_skus").alias("sku_count"),
        F.sum("cell_revenue").cast(MONEY_TOTAL).alias("revenue"),
        F.sum("cell_prices").alias("prices"),
        share(F.sum("cell_cv_sum"), F.nullif(F.sum("cell_cvs"), F.lit(0).cast("long"))).alias("avg_cv"),
    )
    # A cube over no cells still has its grand total, as a row without SKUs.
    return cube.withColumn("sku_count", F.coalesce("sku_count", F.lit(0).cast("long")))


def _level(graded: DataFrame, level: int) -> DataFrame:
    return class_cube(graded).where(F.col("level") == level)


def abc_summary(graded: DataFrame, policy: Policy, complete: bool = False) -> DataFrame:
    """Count, revenue, shares and mean price per ABC class.

    ``complete`` adds a row of zeros for a class without SKUs, and the class's implication.
    """
    classes = _level(graded, 1).withColumnsRenamed({"revenue": "total_revenue", "prices": "_prices"})
    mean_price = (
        rounded_mean(F.col("_prices") * 100, F.col("sku_count") * 100, 4)
        if policy.rounded
        else share(F.col("_prices"), F.col("sku_count"))
    )
    summary = classes.select(
        "abc_class",
        "sku_count",
        _share_of_all("sku_count", 1, policy).alias("pct_skus"),
        _money("total_revenue", policy).alias("total_revenue"),
        _share_of_all("total_revenue", 1, policy).alias("pct_revenue"),
        mean_price.alias("avg_price"),
    )
    if not complete:
        return summary
    return _complete(abc_spine(graded.sparkSession), summary, ["abc_class"],
                     ["sku_count", "pct_skus", "total_revenue", "pct_revenue"])


def xyz_summary(graded: DataFrame, policy: Policy, complete: bool = False) -> DataFrame:
    """Count, share, mean and median CV per XYZ class."""
    classes = graded.groupBy("xyz_class").agg(
        F.count(F.lit(1)).alias("sku_count"), F.avg(F.col("cv").cast("double")).alias("cv_mean")
    )
    medians = quantiles(graded, "cv", {"cv_median": 0.5}, by=["xyz_class"], sketch_k=policy.sketch_k)
    summary = classes.join(medians, "xyz_class", "left").select(
        "xyz_class",
        "sku_count",
        "cv_mean",
        "cv_median",
        _share_of_all("sku_count", 1, policy).alias("pct_skus"),
    )
    if not complete:
        return summary
    return _complete(xyz_spine(graded.sparkSession), summary, ["xyz_class"], ["sku_count", "pct_skus"])


def matrix_long(graded: DataFrame, policy: Policy) -> DataFrame:
    """One row per occupied ABC-XYZ cell."""
    return _level(graded, 0).select(
        "abc_class",
        "xyz_class",
        "sku_count",
        _money("revenue", policy).alias("revenue"),
        "avg_cv",
        _share_of_all("revenue", 2, policy).alias("pct_revenue"),
        _share_of_all("sku_count", 2, policy).alias("pct_skus"),
    )


def _pivot(graded: DataFrame, measure: Column) -> DataFrame:
    """3 × 3 cross table; a class without SKUs is a row of zeros."""
    cross = _level(graded, 0).groupBy("abc_class").pivot("xyz_class", list(XYZ_CLASSES)).agg(measure)
    spine = abc_spine(graded.sparkSession).select("abc_class")
    return _complete(spine, cross, ["abc_class"], list(XYZ_CLASSES))


def matrix_counts(graded: DataFrame) -> DataFrame:
    return _pivot(graded, F.first("sku_count"))


def matrix_revenue(graded: DataFrame) -> DataFrame:
    return _pivot(graded, F.first("revenue"))


def matrix_margins(graded: DataFrame, policy: Policy) -> DataFrame:
    """The count matrix with each ABC class's total count, revenue and revenue share."""
    cube = class_cube(graded).where(F.col("level") < 2)
    rows = cube.groupBy("abc_class").agg(
        *[F.coalesce(F.max(F.when(F.col("xyz_class") == c, F.col("sku_count"))), F.lit(0).cast("long")).alias(c) for c in XYZ_CLASSES],
        F.max(F.when(F.col("level") == 1, F.col("sku_count"))).alias("row_total"),
        F.max(F.when(F.col("level") == 1, F.col("revenue"))).alias("revenue"),
    )
    rows = rows.withColumn("pct_revenue", _share_of_all("revenue", 1, policy))
    spine = abc_spine(graded.sparkSession).select("abc_class")
    return _complete(spine, rows, ["abc_class"], [c for c in rows.columns if c != "abc_class"])


def cell_policy(graded: DataFrame) -> DataFrame:
    """All nine cells with count, revenue (0 when empty) and their stocking policy."""
    cells = _level(graded, 0).select(F.concat("abc_class", "xyz_class").alias("abc_xyz"), "sku_count", "revenue")
    return _complete(cell_spine(graded.sparkSession), cells, ["abc_xyz"], ["sku_count", "revenue"])


def high_value_volatile(graded: DataFrame) -> DataFrame:
    """Count and revenue of the valuable but erratic cells AZ and BZ."""
    cells = _level(graded, 0).where(F.col("abc_class").isin("A", "B") & (F.col("xyz_class") == "Z"))
    return cells.agg(
        F.coalesce(F.sum("sku_count"), F.lit(0).cast("long")).alias("sku_count"),
        F.coalesce(F.sum("revenue"), F.lit(0)).cast(MONEY_TOTAL).alias("revenue"),
    )


def class_revenue_floor(graded: DataFrame) -> DataFrame:
    """Smallest SKU revenue in A and in B, plain and as the log10 chart line."""
    floors = graded.where(F.col("abc_class").isin("A", "B")).groupBy("abc_class")
    return floors.agg(F.min("total_revenue").alias("min_revenue")).withColumn(
        "log_min_revenue", F.log10(F.col("min_revenue").cast("double"))
    )


def sku_distribution(graded: DataFrame, policy: Policy | None = None) -> DataFrame:
    """Median weekly demand and mean CV over all SKUs."""
    median = quantiles(graded, "weekly_demand_mean", {"median_weekly_demand": 0.5}, sketch_k=policy.sketch_k if policy else None)
    mean = graded.agg(F.avg(F.col("cv").cast("double")).alias("mean_cv"))
    return median.select("median_weekly_demand", mean.scalar().alias("mean_cv"))


def _complete(spine: DataFrame, summary: DataFrame, key: list[str], zero: list[str]) -> DataFrame:
    """Every spine row, with zeros where the summary has none."""
    types = {f.name: f.dataType for f in summary.schema.fields}
    filled = {c: F.coalesce(F.col(c), F.lit(0).cast(types[c])) for c in zero}
    return spine.join(summary, key, "left").withColumns(filled)
