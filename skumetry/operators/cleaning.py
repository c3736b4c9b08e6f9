"""Row-level cleaning of invoice lines, its profile, and key and null checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skumetry.policy import Policy
from skumetry.schemas import MONEY

# Fixed value: a cancelled invoice starts with this letter.
CANCELLATION_PREFIX = "C"


def keep_rules(policy: Policy) -> dict[str, Column]:
    """One condition per cleaning rule; a row is kept when all of them hold."""
    invoice = F.col("invoice_no")
    if not policy.rounded:
        # A line without invoice number is no cancellation for this variant.
        invoice = F.coalesce(invoice, F.lit(""))
    well_formed = F.col("stock_code").rlike(policy.code_pattern)
    if policy.stop_at_odd_code:
        odd = F.raise_error(F.concat(F.lit("stock code outside the policy's pattern: "), F.col("stock_code")))
        well_formed = F.when(well_formed, True).when(F.col("stock_code").isNotNull(), odd.cast("boolean"))
    return {
        "cancelled": ~invoice.startswith(CANCELLATION_PREFIX),
        "nonpositive_quantity": F.col("quantity") > 0,
        "nonpositive_price": F.col("unit_price") > 0,
        "malformed_code": well_formed,
    }


def clean_transactions(transactions: DataFrame, policy: Policy) -> DataFrame:
    """Sold lines only, with their revenue."""
    kept = transactions
    for rule in keep_rules(policy).values():
        kept = kept.where(rule)
    return kept.withColumn("revenue", (F.col("quantity") * F.col("unit_price")).cast(MONEY))


#: The column that each rule reads.
RULE_COLUMNS = {
    "cancelled": "invoice_no", "nonpositive_quantity": "quantity", "nonpositive_price": "unit_price", "malformed_code": "stock_code",
}


def clean_present(table: DataFrame, policy: Policy) -> DataFrame:
    """The rows that pass the rules whose columns ``table`` has; the other rules are left to a later call."""
    for name, rule in keep_rules(policy).items():
        if RULE_COLUMNS[name] in table.columns:
            table = table.where(rule)
    return table


def clean_profile(transactions: DataFrame, policy: Policy) -> DataFrame:
    """Lines before and after cleaning and the lines each rule rejects, in one pass."""
    rules = keep_rules(policy)
    passed = {name: F.coalesce(rule, F.lit(False)) for name, rule in rules.items()}
    all_passed = F.lit(True)
    for rule in passed.values():
        all_passed = all_passed & rule
    return transactions.agg(
        F.count(F.lit(1)).alias("raw_lines"),
        *[F.count_if(~rule).alias(f"{name}_lines") for name, rule in passed.items()],
        F.count_if(all_passed).alias("clean_lines"),
    )


def dataset_profile(clean: DataFrame) -> DataFrame:
    """Extent of the cleaned data: lines, dates, SKUs, customers, revenue."""
    return clean.agg(
        F.count(F.lit(1)).alias("clean_lines"),
        F.to_date(F.min("invoice_date")).alias("first_date"),
        F.to_date(F.max("invoice_date")).alias("last_date"),
        F.countDistinct("stock_code").alias("n_skus"),
        F.countDistinct("customer_id").alias("n_customers"),
        F.sum("revenue").alias("total_revenue"),
    )


def null_violations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per declared NOT NULL column, how many rows break it."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot([], list(columns), "column_name", "violations")


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Key values that occur more than once, with their number of rows."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > 1)


def key_check(df: DataFrame, table: str, key: Sequence[str]) -> DataFrame:
    """One row: distinct keys of ``table`` and how many of them are not unique."""
    per_key = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows"))
    return per_key.agg(
        F.lit(table).alias("table_name"),
        F.count(F.lit(1)).alias("n_keys"),
        F.count_if(F.col("n_rows") > 1).alias("duplicate_keys"),
    )
