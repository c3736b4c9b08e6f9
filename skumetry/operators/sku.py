"""From clean invoice lines to one row per SKU.

The raw lines are reduced once, to one row per SKU and week, by an aggregate with fixed-size
buffers: it runs as a hash aggregate and combines on the map side, so a SKU that holds a
third of all lines leaves each task as a few rows. Sales totals and demand statistics both
come from that roll-up. Distinct buyers and descriptions have other keys and stay separate,
narrow aggregates: put into the same one, the distinct counts would multiply the wide rows
and the text maximum would turn the hash aggregate into a sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skumetry.functions.exact import (
    from_cents, iso_week_label, rounded_mean, sample_stddev, share, to_cents,
)
from skumetry.policy import Policy
from skumetry.schemas import DEMAND, MONEY, RATIO, UNIT_COST


def week_rollup(clean: DataFrame) -> DataFrame:
    """Sales of each SKU in each ISO week (weeks without sales have no row)."""
    return week_sums(clean, "stock_code", to_cents(F.col("unit_price")))


def week_sums(clean: DataFrame, code: str, cents: Column) -> DataFrame:
    """Sales of each ``code`` in each ISO week, of lines whose unit price in cents is ``cents``."""
    return clean.groupBy(code, F.trunc("invoice_date", "week").alias("week_start")).agg(
        F.sum(F.col("quantity").cast("long")).alias("qty_sold"),
        F.sum(F.col("quantity") * cents).alias("revenue_cents"),
        F.sum(cents).alias("price_cents"),
        F.count(F.lit(1)).alias("n_lines"),
        F.min("invoice_date").alias("first_sale"),
        F.max("invoice_date").alias("last_sale"),
    )


def merge_rollups(partials: DataFrame) -> DataFrame:
    """One roll-up of several over different lines: sums add up, dates are extremes."""
    return partials.groupBy("stock_code", "week_start").agg(
        *[F.sum(c).alias(c) for c in ("qty_sold", "revenue_cents", "price_cents", "n_lines")],
        F.min("first_sale").alias("first_sale"),
        F.max("last_sale").alias("last_sale"),
    )


def weekly_demand(rollup: DataFrame) -> DataFrame:
    """SKU × week quantities with the ISO week label."""
    return rollup.select(
        "stock_code", "week_start", iso_week_label(F.col("week_start")).alias("year_week"), "qty_sold"
    )


def _demand_moments() -> list:
    quantity = F.col("qty_sold").cast("decimal(19,0)")
    return [
        F.count(F.lit(1)).alias("weeks_with_demand"),
        F.sum("qty_sold").alias("total_qty_sold"),
        F.sum(quantity * quantity).alias("qty_squares"),
    ]


def _with_demand_stats(df: DataFrame, policy: Policy) -> DataFrame:
    """Mean, sample deviation and coefficient of variation from the moments."""
    weeks, total = F.col("weeks_with_demand"), F.col("total_qty_sold")
    deviation = sample_stddev(weeks, total, F.col("qty_squares"))
    mean = share(total, weeks)
    if policy.rounded:
        columns = {
            "weekly_demand_mean": rounded_mean(total, weeks, 2).cast(DEMAND),
            "weekly_demand_std": F.round(deviation, 2).cast(DEMAND),
            "cv": F.when(mean > 0, F.round(deviation / mean, 4)).cast(RATIO),
        }
    else:
        # One week has no deviation; this variant counts it as perfectly steady.
        deviation = F.coalesce(deviation, F.lit(0.0))
        columns = {
            "weekly_demand_mean": mean,
            "weekly_demand_std": deviation,
            "cv": F.when(mean > 0, deviation / mean),
        }
    return df.withColumns(columns).drop("qty_squares")


def demand_stats(rollup: DataFrame, policy: Policy) -> DataFrame:
    """Weekly demand statistics per SKU, over weeks with demand only."""
    moments = rollup.groupBy("stock_code").agg(*_demand_moments())
    return _with_demand_stats(moments, policy).select(
        "stock_code", "weekly_demand_mean", "weekly_demand_std", "weeks_with_demand", "cv"
    )


def sku_totals(rollup: DataFrame, policy: Policy) -> DataFrame:
    """Sales totals and demand statistics per SKU, from one pass over the roll-up."""
    totals = rollup.groupBy("stock_code").agg(
        *_demand_moments(),
        from_cents(F.sum("revenue_cents"), MONEY.precision).alias("total_revenue"),
        from_cents(F.sum("price_cents"), MONEY.precision).alias("price_total"),
        F.sum("n_lines").alias("n_lines"),
        F.min("first_sale").alias("first_sale_date"),
        F.max("last_sale").alias("last_sale_date"),
    )
    price, lines = F.col("price_total"), F.col("n_lines")
    if policy.rounded:
        totals = totals.withColumns({
            "avg_unit_price": rounded_mean(price, lines, 4).cast(UNIT_COST),
            "first_sale_date": F.to_date("first_sale_date"),
            "last_sale_date": F.to_date("last_sale_date"),
        })
    else:
        totals = totals.withColumn("avg_unit_price", share(price, lines))
    return (
        _with_demand_stats(totals, policy)
        .withColumn("weeks_active_pct", share(F.col("weeks_with_demand"), F.lit(policy.weeks_per_year)))
        .drop("price_total")
    )


def sku_buyers(clean: DataFrame) -> DataFrame:
    """Distinct invoices and customers per SKU; anonymous lines count for no customer."""
    return clean.groupBy("stock_code").agg(
        F.countDistinct("invoice_no").alias("n_invoices"),
        F.countDistinct("customer_id").alias("n_customers"),
    )


def buyers_of_pairs(
    pairs: DataFrame, code: str = "stock_code", invoice: Sequence[str] = ("invoice_no",), customer: str = "customer_id"
) -> DataFrame:
    """As ``sku_buyers``, for rows that hardly repeat; the first column of ``invoice`` is null where there is none.

    Two distinct counts in one aggregate would double every row. Here one row of each invoice is
    marked, the marks are added up by customer, and each SKU is left with sums of whole numbers.
    """
    of_invoice = Window.partitionBy(code, *invoice).orderBy(customer)
    new = (F.row_number().over(of_invoice) == 1) & F.col(invoice[0]).isNotNull()
    customers = pairs.select(code, customer, new.cast("long").alias("new")).groupBy(code, customer).agg(F.sum("new").alias("n"))
    return customers.groupBy(code).agg(F.sum("n").alias("n_invoices"), F.count(customer).alias("n_customers"))


def text_counts(clean: DataFrame) -> DataFrame:
    """How many lines carry each text of each SKU."""
    return clean.groupBy("stock_code", "description").agg(F.count(F.lit(1)).alias("n_lines"))


def sku_descriptions(texts: DataFrame, policy: Policy) -> DataFrame:
    """One description per SKU: the greatest, or the most frequent (ties: the smallest).

    ``texts`` are counted per SKU, so no task ever holds all the texts of a SKU, and the text
    comparison, which needs a sort, runs on distinct texts only. The count is part of the
    compared value in both variants: the optimizer drops an inner aggregate whose counts nobody
    reads and would then sort every invoice line.
    """
    per_sku = texts.groupBy("stock_code")
    if policy.rounded:
        greatest = F.max(F.struct("description", "n_lines"))
        return per_sku.agg(greatest["description"].alias("description"))
    ranked = F.when(
        F.col("description").isNotNull(),
        F.struct((-F.col("n_lines")).alias("order"), F.col("description").alias("text")),
    )
    return per_sku.agg(F.coalesce(F.min(ranked)["text"], F.lit("")).alias("description"))


def sku_revenue(totals: DataFrame, buyers: DataFrame, descriptions: DataFrame) -> DataFrame:
    """The full SKU aggregate; all three sides are already partitioned by stock code."""
    return (
        totals.join(buyers, "stock_code")
        .join(descriptions, "stock_code")
        .select(
            "stock_code", "description", "total_qty_sold", "total_revenue", "n_invoices",
            "n_customers", "avg_unit_price", "first_sale_date", "last_sale_date",
        )
    )
