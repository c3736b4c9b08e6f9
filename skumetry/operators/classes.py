"""Pareto rank, ABC, XYZ and the combined cell of every SKU."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skumetry.functions.exact import rounded_share, share
from skumetry.functions.inline import inline_table
from skumetry.operators.ranking import SortKey, running_totals
from skumetry.policy import (
    ABC_CLASSES, ABC_IMPLICATIONS, CELL_TERMS, UNCLASSIFIED, XYZ_APPROACHES, XYZ_CLASSES,
    XYZ_THRESHOLDS, Policy,
)
from skumetry.schemas import MONEY_SUM, RATIO


def rank_by_revenue(sku: DataFrame, policy: Policy, ranges: int | None = None) -> DataFrame:
    """Add revenue rank, running revenue and its share of the total; ties go by stock code."""
    keys = [SortKey("total_revenue", falling=True), SortKey("stock_code")]
    ranked = running_totals(
        sku, keys, {"revenue": F.col("total_revenue"), "skus": F.lit(1).cast("long")}, ranges
    )
    running, total = F.col("revenue_running"), F.col("revenue_total")
    cum_share = rounded_share(running, total, 4).cast(RATIO) if policy.rounded else share(running, total)
    return ranked.withColumns({
        "revenue_cumsum": running.cast(MONEY_SUM),
        "revenue_cum_pct": cum_share,
        "revenue_rank": F.col("skus_running"),
        "sku_rank_pct": share(F.col("skus_running"), F.col("skus_total")) * 100,
    }).drop("revenue_running", "revenue_total", "skus_running", "skus_total")


def with_abc(ranked: DataFrame, policy: Policy) -> DataFrame:
    """A up to 80 % of cumulative revenue, B up to 95 %, C beyond."""
    cum_share = F.col("revenue_cum_pct")
    return ranked.withColumn(
        "abc_class",
        F.when(cum_share <= _border(policy.a_share, policy), "A")
        .when(cum_share <= _border(policy.b_share, policy), "B")
        .otherwise("C"),
    )


def with_xyz(sku: DataFrame, policy: Policy) -> DataFrame:
    """X steady, Y moderate, Z erratic or without a CV."""
    cv = F.col("cv")
    return sku.withColumn(
        "xyz_class",
        F.when(cv.isNull(), "Z")
        .when(cv <= _border(policy.x_cv, policy), "X")
        .when(cv <= _border(policy.y_cv, policy), "Y")
        .otherwise("Z"),
    )


def with_cell(sku: DataFrame, policy: Policy) -> DataFrame:
    """The combined cell and the strategic action that goes with it.

    The nine texts are a constant map, not a joined table, so a report that shows no
    action drops it together with the rest of the unused columns.
    """
    cell = F.concat("abc_class", "xyz_class")
    texts = F.create_map(*[F.lit(x) for pair in policy.actions.items() for x in pair])
    action = F.coalesce(F.element_at(texts, F.col("abc_xyz")), F.lit(UNCLASSIFIED))
    return sku.withColumn("abc_xyz", cell).withColumn("strategic_action", action)


def _border(value, policy: Policy):
    """A threshold in the number type the compared column has."""
    return F.lit(value) if policy.rounded else F.lit(float(value))


# Constant class tables ------------------------------------------------------------------


def abc_spine(spark: SparkSession) -> DataFrame:
    return inline_table(
        spark,
        {"abc_class": pa.string(), "implication": pa.string()},
        [(c, ABC_IMPLICATIONS[c]) for c in ABC_CLASSES],
    )


def xyz_spine(spark: SparkSession) -> DataFrame:
    return inline_table(
        spark,
        {"xyz_class": pa.string(), "cv_threshold": pa.string(), "approach": pa.string()},
        [(c, XYZ_THRESHOLDS[c], XYZ_APPROACHES[c]) for c in XYZ_CLASSES],
    )


def cell_spine(spark: SparkSession) -> DataFrame:
    columns = ("abc_xyz", "zone", "service_level", "review_cycle", "instruction")
    return inline_table(
        spark,
        {c: pa.string() for c in columns},
        [tuple(getattr(cell, c) for c in columns) for cell in CELL_TERMS],
    )


def class_terms(spark: SparkSession, policy: Policy) -> DataFrame:
    """Lead time, z-score and service level per ABC class."""
    return inline_table(
        spark,
        {
            "abc_class": pa.string(),
            "lead_time_weeks": pa.decimal128(4, 1),
            "z_score": pa.decimal128(5, 3),
            "service_level_pct": pa.int32(),
        },
        [(t.abc_class, t.lead_time_weeks, t.z_score, t.service_level_pct) for t in policy.class_terms],
    )
