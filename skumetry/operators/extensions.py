"""Extensions: ideas that the analysis this follows only describes, computed here.

They are not part of the graded tables. Their parameters are ``Policy`` fields.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skumetry.functions.exact import sample_stddev, share
from skumetry.operators.classes import class_terms
from skumetry.operators.reorder import eligible_skus
from skumetry.policy import Policy


def recent_spike(rollup: DataFrame, policy: Policy) -> DataFrame:
    """SKUs whose mean demand in the last weeks exceeds a multiple of their usual weekly demand.

    The last weeks end with the latest week of the data and count without demand too; usual
    demand is the mean over weeks with demand.
    """
    latest = rollup.agg(F.max("week_start").alias("w")).scalar()
    recent = F.col("week_start") > F.date_sub(F.col("latest"), 7 * policy.spike_weeks)
    sums = rollup.withColumn("latest", latest).groupBy("stock_code").agg(
        F.coalesce(F.sum(F.when(recent, F.col("qty_sold"))), F.lit(0).cast("long")).alias("recent_qty"),
        F.sum("qty_sold").alias("total_qty"),
        F.count(F.lit(1)).alias("weeks"),
    )
    # Whole numbers: recent / spike_weeks > factor * total / weeks.
    spike = F.col("recent_qty") * F.col("weeks") > policy.spike_factor * policy.spike_weeks * F.col("total_qty")
    return sums.select("stock_code", "recent_qty", "total_qty", F.col("weeks").alias("weeks_with_demand"), spike.alias("spike_flag"))


def lead_time_safety_stock(top: DataFrame, policy: Policy) -> DataFrame:
    """Safety stock when lead times vary: z * sqrt(LT * sd_demand^2 + mean^2 * sd_LT^2)."""
    spread = F.create_map(*[F.lit(x) for c, v in policy.lead_time_std_weeks for x in (c, float(v))])
    terms = F.broadcast(class_terms(top.sparkSession, policy))
    rows = top.join(terms, "abc_class").withColumn("lead_time_std", F.element_at(spread, F.col("abc_class")))
    mean, deviation = F.col("weekly_demand_mean").cast("double"), F.col("weekly_demand_std").cast("double")
    variance = F.col("lead_time_weeks").cast("double") * deviation * deviation + mean * mean * F.col("lead_time_std") * F.col("lead_time_std")
    stock = F.col("z_score").cast("double") * F.sqrt(variance)
    return rows.select(
        "stock_code", "abc_class", "xyz_class", "lead_time_std", stock.alias("safety_stock"),
        (mean * F.col("lead_time_weeks").cast("double") + stock).alias("reorder_point"),
    )


def percentile_safety_stock(graded: DataFrame, rollup: DataFrame, policy: Policy) -> DataFrame:
    """Safety stock of erratic SKUs from their own weeks instead of a normal distribution.

    The service level's percentile of a week's demand, less the mean week, over the square root
    of the lead time; never below 0. A SKU has one value a week, which bounds a group.
    """
    terms = F.broadcast(class_terms(graded.sparkSession, policy))
    erratic = eligible_skus(graded, policy).where(F.col("xyz_class") == "Z").select("stock_code", "abc_class").join(terms, "abc_class")
    weeks = rollup.select("stock_code", "qty_sold").join(erratic, "stock_code")
    levels = [(t.abc_class, t.service_level_pct / 100) for t in policy.class_terms]
    value = F.lit(None).cast("double")
    for name, level in levels:
        value = F.coalesce(value, F.percentile(F.when(F.col("abc_class") == name, F.col("qty_sold")), F.lit(level)))
    per_sku = weeks.groupBy("stock_code", "abc_class", "lead_time_weeks").agg(value.alias("percentile"), F.avg("qty_sold").alias("mean"))
    stock = F.greatest((F.col("percentile") - F.col("mean")) * F.sqrt(F.col("lead_time_weeks").cast("double")), F.lit(0.0))
    return per_sku.select("stock_code", "abc_class", F.col("percentile").alias("weekly_percentile"), stock.alias("safety_stock"))


def measured_lead_time(top: DataFrame, events: DataFrame, policy: Policy) -> DataFrame:
    """Lead times from pairs of events, and safety stock and reorder point that follow from them.

    ``events`` has ``stock_code`` and ``lead_days``, the days from order to shipping; negative and
    null ones are no lead times. A SKU's mean and variance are shrunk to those of its ABC class:
    the class counts like ``policy.lead_time_prior`` events. A class without two events uses the
    policy's constants. Moments are whole numbers, so results do not depend on partitions.
    """
    spread = F.create_map(*[F.lit(x) for c, v in policy.lead_time_std_weeks for x in (c, float(v))])
    terms = F.broadcast(class_terms(top.sparkSession, policy))
    days = F.col("lead_days").cast("long")
    moments = events.where("lead_days >= 0").groupBy("stock_code").agg(
        F.count(F.lit(1)).alias("n"), F.sum(days).alias("days"), F.sum(days.cast("decimal(19,0)") * days).alias("squares")
    )
    rows = top.join(moments, "stock_code", "left").withColumns({"n": F.coalesce("n", F.lit(0).cast("long"))})
    # One row for each class.
    of_class = rows.groupBy("abc_class").agg(
        F.sum("n").alias("class_n"), F.sum("days").alias("class_days"), F.sum("squares").alias("class_squares")
    )
    rows = rows.join(F.broadcast(of_class), "abc_class").join(terms, "abc_class")

    def variance(n: str, total: str, squares: str):
        deviation = sample_stddev(F.col(n), F.col(total), F.col(squares))
        return deviation * deviation

    measured = F.col("class_n") > 1
    class_mean = F.when(measured, share(F.col("class_days"), F.col("class_n"))).otherwise(F.col("lead_time_weeks").cast("double") * 7)
    class_variance = F.when(measured, variance("class_n", "class_days", "class_squares")).otherwise(
        F.pow(F.element_at(spread, F.col("abc_class")) * 7, F.lit(2.0))
    )
    weight = F.col("n") / (F.col("n") + F.lit(policy.lead_time_prior))
    own_mean = F.coalesce(share(F.col("days"), F.col("n")), class_mean)
    own_variance = F.coalesce(F.when(F.col("n") > 1, variance("n", "days", "squares")), class_variance)
    lead_mean = (weight * own_mean + (F.lit(1.0) - weight) * class_mean) / 7
    lead_variance = (weight * own_variance + (F.lit(1.0) - weight) * class_variance) / 49
    mean, deviation, z = (F.col(c).cast("double") for c in ("weekly_demand_mean", "weekly_demand_std", "z_score"))
    rows = rows.withColumns({"lead_time_weeks": lead_mean, "_variance": lead_variance})
    stock = z * F.sqrt(F.col("lead_time_weeks") * deviation * deviation + mean * mean * F.col("_variance"))
    return rows.select(
        "stock_code", "abc_class", F.col("n").alias("n_lead_times"), "lead_time_weeks", F.sqrt("_variance").alias("lead_time_std_weeks"),
        stock.alias("safety_stock"), (mean * F.col("lead_time_weeks") + stock).alias("reorder_point"),
    )


def lead_time_percentile(graded: DataFrame, rollup: DataFrame, policy: Policy) -> DataFrame:
    """Reorder point of erratic SKUs: the service level's percentile of demand during the lead time.

    A SKU's series runs from its first to its last week with demand, and weeks without demand
    count as zeros. Demand during the lead time is the sum of so many consecutive weeks, for every
    such stretch of the series (a shorter series is one stretch). The percentile interpolates
    linearly between stretches.

    No calendar is built: each week with demand raises the sum of the stretches that begin up to
    one lead time before it, so the sums change at two places a week at most, and equal
    neighbouring stretches are one row with their number. A SKU has two rows a week with demand
    at most, which bounds a window.
    """
    terms = F.broadcast(class_terms(graded.sparkSession, policy))
    erratic = eligible_skus(graded, policy).where(F.col("xyz_class") == "Z").select("stock_code", "abc_class")
    erratic = erratic.join(terms, "abc_class").select("stock_code", "abc_class", "service_level_pct", F.ceil("lead_time_weeks").cast("int").alias("lead"))
    whole = Window.partitionBy("stock_code")
    week = F.datediff("week_start", F.lit("1970-01-05").cast("date")) / 7
    weeks = rollup.select("stock_code", week.cast("int").alias("week"), "qty_sold").join(erratic, "stock_code").withColumns({
        "first": F.min("week").over(whole), "last": F.max("week").over(whole), "total": F.sum("qty_sold").over(whole),
    })
    end = F.greatest("first", F.col("last") - F.col("lead") + 1)
    change = F.explode(F.array(
        F.struct(F.greatest("first", F.col("week") - F.col("lead") + 1).alias("begin"), F.col("qty_sold").alias("by")),
        F.struct((F.col("week") + 1).alias("begin"), (-F.col("qty_sold")).alias("by")),
    ))
    fixed = ["stock_code", "abc_class", "service_level_pct", "lead", "first", "last", "total", "end"]
    changes = weeks.withColumn("end", end).select(*fixed, change.alias("change")).groupBy(*fixed, "change.begin").agg(F.sum("change.by").alias("by"))
    in_order = Window.partitionBy("stock_code").orderBy("begin")
    stretches = changes.withColumns({
        "demand": F.sum("by").over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        "next": F.coalesce(F.lead("begin").over(in_order), F.col("end") + 1),
    }).where(F.col("begin") <= F.col("end"))
    number = F.least("next", F.col("end") + 1) - F.col("begin")
    by_demand = Window.partitionBy("stock_code").orderBy("demand", "begin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = stretches.withColumn("number", number).withColumn("before", F.sum("number").over(by_demand) - F.col("number"))
    windows = F.col("end") - F.col("first") + 1
    hundredths = (windows - 1) * F.col("service_level_pct")
    lower, rest = F.floor(hundredths / 100), hundredths % 100
    per_sku = placed.groupBy("stock_code", "abc_class", "lead", "first", "last", "total").agg(
        F.max(F.when(F.col("before") <= lower, F.col("demand"))).cast("double").alias("low"),
        F.max(F.when(F.col("before") <= lower + F.when(rest > 0, 1).otherwise(0), F.col("demand"))).cast("double").alias("high"),
        F.max(rest).alias("rest"),
    )
    point = F.col("low") + (F.col("high") - F.col("low")) * F.col("rest") / 100
    length = F.col("last") - F.col("first") + 1
    usual = F.col("total") * F.least("lead", length) / length
    return per_sku.select(
        "stock_code", "abc_class", length.alias("series_weeks"), point.alias("reorder_point"), F.greatest(point - usual, F.lit(0.0)).alias("safety_stock")
    )
