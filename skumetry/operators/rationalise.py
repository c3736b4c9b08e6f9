"""What to do with low-value erratic SKUs: review, protect or discontinue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skumetry.functions.exact import rounded_mean
from skumetry.policy import PROTECT, Policy


def single_event():
    return F.col("weeks_with_demand") == 1


def loyal_customer(policy: Policy):
    return (F.col("n_invoices") > policy.loyal_min_invoices) | (F.col("n_customers") > policy.loyal_min_customers)


def recommended_action(policy: Policy):
    """A single event outranks protection, protection outranks discontinuation."""
    return (
        F.when(single_event(), policy.single_event_text)
        .when(loyal_customer(policy), PROTECT)
        .otherwise(policy.rationalise_text)
    )


def rationalisation_flag(policy: Policy):
    """Short code of the recommended action; null outside the CZ cell."""
    return F.when(
        F.col("abc_xyz") == "CZ",
        F.when(single_event(), "SINGLE_EVENT").when(loyal_customer(policy), "PROTECT").otherwise("RATIONALISE"),
    )


def rationalisation_list(master: DataFrame, policy: Policy) -> DataFrame:
    """Every CZ SKU with its flags and recommended action."""
    return master.where(F.col("abc_xyz") == "CZ").select(
        "stock_code",
        *(["description"] if "description" in master.columns else []),
        "abc_xyz",
        "total_revenue",
        "n_invoices",
        "n_customers",
        "weekly_demand_mean",
        "cv",
        "weeks_with_demand",
        single_event().alias("single_event_flag"),
        loyal_customer(policy).alias("loyal_customer_flag"),
        recommended_action(policy).alias("recommended_action"),
    )


def rationalisation_summary(cz: DataFrame, policy: Policy) -> DataFrame:
    """SKUs, revenue, mean revenue, mean CV and mean customers per action."""
    per_action = cz.groupBy("recommended_action")
    count = F.count(F.lit(1))
    if not policy.rounded:
        return per_action.agg(
            count.alias("sku_count"),
            F.sum("total_revenue").alias("total_revenue"),
            (F.sum("total_revenue").cast("double") / count).alias("avg_revenue_per_sku"),
            F.avg("cv").alias("avg_cv"),
            F.avg("n_customers").alias("avg_customers"),
        )
    # CV has four decimals: its sum is scaled to whole numbers so the mean is exact.
    cv_mean = rounded_mean(F.sum("cv") * 10000, F.count("cv") * 10000, 3)
    return per_action.agg(
        count.alias("sku_count"),
        F.round(F.sum("total_revenue"), 0).alias("total_revenue"),
        rounded_mean(F.sum("total_revenue"), count, 0).alias("avg_revenue_per_sku"),
        cv_mean.alias("avg_cv"),
        rounded_mean(F.sum("n_customers"), count, 1).alias("avg_customers"),
    )


def action_profile(cz: DataFrame) -> DataFrame:
    """Counts and revenue per action and per loyalty flag, in one row.

    ``unprotected_revenue`` is all revenue without the loyalty flag. Single-event SKUs may
    carry that flag or not, so each action's own revenue is given as well.
    """
    def revenue(condition):
        return F.coalesce(F.sum(F.when(condition, F.col("total_revenue"))), F.lit(0).cast("decimal(28,2)"))

    actions = {"protect": "PROTECT", "rationalise": "RATIONALISE", "single_event": "SINGLE"}
    starts = {name: F.col("recommended_action").startswith(prefix) for name, prefix in actions.items()}
    return cz.agg(
        F.count(F.lit(1)).alias("cz_skus"),
        *[F.count_if(condition).alias(f"{name}_skus") for name, condition in starts.items()],
        revenue(F.col("loyal_customer_flag")).alias("protected_revenue"),
        revenue(~F.col("loyal_customer_flag")).alias("unprotected_revenue"),
        *[revenue(condition).alias(f"{name}_revenue") for name, condition in starts.items()],
    )


def rationalise_candidates(cz: DataFrame) -> DataFrame:
    """SKUs recommended for discontinuation, as listed in the workbook."""
    return cz.where(F.col("recommended_action").startswith("RATIONALISE")).select(
        "stock_code",
        F.substring("description", 1, 40).alias("description"),
        "total_revenue", "n_invoices", "n_customers", "weekly_demand_mean", "cv",
        F.substring("recommended_action", 1, 40).alias("action"),
    )


def action_sheet(summary: DataFrame) -> DataFrame:
    """The action summary as the workbook shows it, with the key that picks its colour."""
    text = F.upper("recommended_action")
    return summary.withColumns({
        "action_key": F.when(text.contains("PROTECT"), "PROTECT")
        .when(text.contains("RATIONALISE"), "RATIONALISE").otherwise("SINGLE"),
        "recommended_action": F.substring("recommended_action", 1, 55),
    })
