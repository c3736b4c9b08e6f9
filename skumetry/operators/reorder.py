"""Safety stock and reorder points of the best-selling SKUs with enough history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skumetry.functions.exact import rounded_mean
from skumetry.operators.classes import class_terms
from skumetry.operators.ranking import top_by
from skumetry.policy import Policy
from skumetry.schemas import UNITS


def eligible_skus(graded: DataFrame, policy: Policy) -> DataFrame:
    """SKUs with enough weeks of demand and a computable variability."""
    return graded.where((F.col("weeks_with_demand") >= policy.rop_min_weeks) & F.col("cv").isNotNull())


def best_sellers(graded: DataFrame, policy: Policy) -> DataFrame:
    """The top eligible SKUs by revenue; eligibility is decided before ranking."""
    return top_by(eligible_skus(graded, policy), "total_revenue", policy.rop_top_n)


def stockout_risk(policy: Policy) -> Column:
    return F.col("cv") > (F.lit(policy.risk_cv) if policy.rounded else F.lit(float(policy.risk_cv)))


def reorder_points(top: DataFrame, policy: Policy) -> DataFrame:
    """Lead-time demand, safety stock and reorder point of already selected SKUs.

    The reorder point is rounded once, so it may differ by one from the sum of its rounded
    parts. ``sql`` rounds decimals half away from zero, ``script`` doubles half to even.
    """
    terms = F.broadcast(class_terms(top.sparkSession, policy))
    lead, z = F.col("lead_time_weeks"), F.col("z_score")
    mean, deviation = F.col("weekly_demand_mean"), F.col("weekly_demand_std")
    if policy.rounded:
        lead_demand = mean * lead
        buffer = z * deviation * F.sqrt(lead.cast("double")).cast("decimal(16,15)")
        total = lead_demand + buffer
        units = {name: F.round(value, 0).cast(UNITS) for name, value in (
            ("avg_demand_lt", lead_demand), ("safety_stock", buffer), ("reorder_point", total))}
        shown_mean, shown_deviation = mean, deviation
    else:
        lead_demand = mean * lead.cast("double")
        buffer = z.cast("double") * deviation * F.sqrt(lead.cast("double"))
        units = {name: F.bround(value, 0) for name, value in (
            ("avg_demand_lt", lead_demand), ("safety_stock", buffer),
            ("reorder_point", lead_demand + buffer))}
        shown_mean, shown_deviation = F.bround(mean, 1), F.bround(deviation, 1)
    return top.join(terms, "abc_class").select(
        "stock_code",
        *(["description"] if "description" in top.columns else []),
        "abc_class",
        "xyz_class",
        "abc_xyz",
        "service_level_pct",
        "lead_time_weeks",
        shown_mean.alias("avg_weekly_demand"),
        shown_deviation.alias("demand_std_weekly"),
        *[value.alias(name) for name, value in units.items()],
        stockout_risk(policy).alias("stockout_risk_flag"),
        F.col("total_revenue").alias("annual_revenue"),
        "avg_unit_price",
        "total_qty_sold",
        "weekly_demand_mean",
        "weekly_demand_std",
        "cv",
    )


def rop_summary(rop: DataFrame, policy: Policy) -> DataFrame:
    """Mean demand, safety stock and reorder point and the risk count per ABC class."""
    groups = rop.groupBy("abc_class")
    if policy.rounded:
        def mean(column: str) -> Column:
            return rounded_mean(F.sum(column), F.count(F.lit(1)), 0)
    else:
        def mean(column: str) -> Column:
            return F.avg(column)
    return groups.agg(
        F.count(F.lit(1)).alias("skus"),
        mean("avg_weekly_demand").alias("avg_weekly_demand"),
        mean("safety_stock").alias("avg_safety_stock"),
        mean("reorder_point").alias("avg_rop"),
        F.count_if("stockout_risk_flag").alias("stockout_risk_skus"),
    )


def highest_reorder_points(rop: DataFrame, n: int, text_length: int | None = None) -> DataFrame:
    """The SKUs whose reorder point is highest; descriptions cut to ``text_length``."""
    text = F.col("description") if text_length is None else F.substring("description", 1, text_length)
    return top_by(rop, "reorder_point", n).select(
        "stock_code", text.alias("description"), "abc_xyz", "avg_weekly_demand", "safety_stock",
        "reorder_point", "stockout_risk_flag", "annual_revenue", "cv",
    )


def rop_chart(rop: DataFrame, n: int = 20) -> DataFrame:
    """Bars and bubbles of the best sellers: label, reorder point, buffer, CV, bubble size."""
    return top_by(rop, "annual_revenue", n).select(
        F.concat_ws(": ", "stock_code", F.substring("description", 1, 30)).alias("label"),
        "abc_class", "reorder_point", "safety_stock", "cv", "stockout_risk_flag",
        (F.col("annual_revenue").cast("double") / 500).alias("bubble_size"),
    )


def safety_stock_profile(rop: DataFrame) -> DataFrame:
    """SKUs modelled, mean safety stock of the A class, SKUs at risk of a stockout."""
    return rop.agg(
        F.count(F.lit(1)).alias("skus"),
        F.avg(F.when(F.col("abc_class") == "A", F.col("safety_stock").cast("double"))).alias("avg_safety_stock_a"),
        F.count_if("stockout_risk_flag").alias("stockout_risk_skus"),
    )


def rop_sheet(rop: DataFrame) -> DataFrame:
    """The reorder table as the workbook shows it: short text, risk as a label."""
    return rop.withColumns({
        "description": F.substring("description", 1, 40),
        "stockout_risk_flag": F.when(F.col("stockout_risk_flag"), "⚠ YES").otherwise("OK"),
    }).drop("weekly_demand_mean", "weekly_demand_std")
