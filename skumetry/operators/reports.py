"""Key-figure reports and the data behind the charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skumetry.functions.exact import clip
from skumetry.operators.ranking import add_rank, quantiles, top_by
from skumetry.policy import METRICS, TILES, Policy

CV_CHART_MAX = 3.0
CV_BINS = 60
QUADRANT_CV_MAX = 2.5
QUADRANT_SIZE = 1500
QUADRANT_SEED = 42


# Key figures ----------------------------------------------------------------------------


def grade_counts(graded: DataFrame) -> DataFrame:
    """One row with the SKU counts and revenues the key-figure reports quote."""
    def count(condition: Column) -> Column:
        return F.count_if(condition)

    def revenue(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("total_revenue"))), F.lit(0).cast("decimal(28,2)"))

    volatile = F.col("abc_xyz").isin("AZ", "BZ")
    return graded.agg(
        F.count(F.lit(1)).alias("n_skus"),
        revenue(F.lit(True)).alias("revenue"),
        *[count(F.col("abc_class") == c).alias(f"n_{c.lower()}") for c in "ABC"],
        *[count(F.col("xyz_class") == c).alias(f"n_{c.lower()}") for c in "XYZ"],
        revenue(F.col("abc_class") == "A").alias("a_revenue"),
        count(volatile).alias("n_volatile"),
        revenue(volatile).alias("volatile_revenue"),
        count(F.col("abc_xyz") == "CZ").alias("n_cz"),
    )


def _integer(value: Column) -> Column:
    return F.format_number(value, 0)


def _pounds(value: Column, digits: int) -> Column:
    return F.concat(F.lit("£"), F.format_number(value, digits))


def _percent(value: Column) -> Column:
    return F.concat(F.format_number(value * 100, 1), F.lit("%"))


def _figures(one_row: DataFrame, rows: list[tuple]) -> DataFrame:
    """Turn a one-row aggregate into (position, metric, amount, detail, value) rows."""
    structs = [
        F.struct(
            F.lit(position).alias("position"),
            F.lit(metric).alias("metric"),
            (F.lit(None) if amount is None else amount).cast("double").alias("amount"),
            (F.lit(None) if detail is None else detail).cast("double").alias("detail"),
            text.alias("value"),
        )
        for position, metric, amount, detail, text in rows
    ]
    return one_row.select(F.inline(F.array(*structs)))


def extent(graded: DataFrame) -> DataFrame:
    """Clean lines and first and last day, from the SKU table."""
    return graded.agg(
        F.coalesce(F.sum("n_lines"), F.lit(0).cast("long")).alias("clean_lines"),
        F.to_date(F.min("first_sale_date")).alias("first_date"),
        F.to_date(F.max("last_sale_date")).alias("last_date"),
    )


def summary_stats(profile: DataFrame, graded: DataFrame, rop: DataFrame, actions: DataFrame, policy: Policy) -> DataFrame:
    """The 18 key figures: number, accompanying share or revenue, and formatted text.

    ``profile`` holds lines and dates, ``rop`` is the safety-stock profile and ``actions`` the
    action profile; each is a single row, turned into metric rows and stacked. Texts quote the
    policy's limit and the number of SKUs that were modelled.
    """
    n = F.col("n_skus")

    def class_figure(position: int, metric: str, column: str) -> tuple:
        part = F.try_divide(F.col(column), n)
        text = F.concat(_integer(F.col(column)), F.lit(" ("), _percent(part), F.lit(")"))
        return position, metric, F.col(column), part, text

    def action_figure(position: int, metric: str, count: str, revenue: str) -> tuple:
        text = F.concat(_integer(F.col(count)), F.lit(" ("), _pounds(F.col(revenue), 0), F.lit(" revenue)"))
        return position, metric, F.col(count), F.col(revenue), text

    a_share = F.try_divide(F.col("a_revenue").cast("double"), F.col("revenue").cast("double"))
    dates = F.concat_ws(" to ", F.col("first_date").cast("string"), F.col("last_date").cast("string"))
    stock = F.col("avg_safety_stock_a")
    grades = _figures(grade_counts(graded), [
        (1, METRICS[1], n, None, _integer(n)),
        (4, METRICS[4], F.col("revenue"), None, _pounds(F.col("revenue"), 2)),
        class_figure(5, METRICS[5], "n_a"),
        (6, METRICS[6], a_share, None, _percent(a_share)),
        class_figure(7, METRICS[7], "n_b"),
        class_figure(8, METRICS[8], "n_c"),
        class_figure(9, METRICS[9], "n_x"),
        class_figure(10, METRICS[10], "n_y"),
        class_figure(11, METRICS[11], "n_z"),
        class_figure(12, METRICS[12], "n_cz"),
        (15, METRICS[15], F.col("n_volatile"), None, _integer(F.col("n_volatile"))),
        (16, METRICS[16], F.col("volatile_revenue"), None, _pounds(F.col("volatile_revenue"), 0)),
    ])
    extent = _figures(profile, [
        (2, METRICS[2], F.col("clean_lines"), None, _integer(F.col("clean_lines"))),
        (3, METRICS[3], None, None, dates),
    ])
    cz = _figures(actions, [
        action_figure(13, METRICS[13], "rationalise_skus", "unprotected_revenue"),
        action_figure(14, METRICS[14], "protect_skus", "protected_revenue"),
    ])
    reorder = _figures(rop, [
        (17, METRICS[17].format(n=policy.rop_top_n), stock, None,
         F.concat(F.format_string("%.0f", F.bround(stock, 0)), F.lit(" units"))),
        (18, METRICS[18], F.col("stockout_risk_skus"), None,
         F.concat_ws(" ", F.col("stockout_risk_skus"), F.lit("of"), F.col("skus"), F.lit("SKUs"))),
    ])
    return grades.unionByName(extent).unionByName(cz).unionByName(reorder)


def kpi_strip(graded: DataFrame, rop: DataFrame) -> DataFrame:
    """The nine tiles of the executive summary: label, value, note.

    Period, number of modelled SKUs and number of lines come from the data.
    """
    def millions(column: str) -> Column:
        return F.concat(F.lit("£"), F.format_string("%.1f", F.col(column).cast("double") / 1e6), F.lit("M"))

    def tile(position, label, column, text, note):
        note = F.lit(note) if isinstance(note, str) else note
        return position, label, F.col(column) if column else None, None, F.struct(text.alias("v"), note.alias("n"))

    months = F.concat(F.round(F.months_between("last_date", "first_date") + 0.5).cast("int").cast("string"), F.lit("-month period"))
    lines = F.concat(_integer(F.col("clean_lines")), F.lit(" transactions"))
    dates = F.concat_ws(" to ", F.col("first_date").cast("string"), F.col("last_date").cast("string"))

    tiles = [
        tile(1, TILES[1], "n_skus", _integer(F.col("n_skus")), "After data cleaning"),
        tile(2, TILES[2], "revenue", millions("revenue"), months),
        tile(3, TILES[3], "n_a", _integer(F.col("n_a")), "Drive 80% of revenue"),
        tile(4, TILES[4], "n_volatile", _integer(F.col("n_volatile")), "High value, unpredictable demand"),
        tile(5, TILES[5], "volatile_revenue", millions("volatile_revenue"), "At risk from stockouts"),
        tile(6, TILES[6], "n_cz", _integer(F.col("n_cz")), "Rationalisation candidates"),
        tile(7, TILES[7], "n_z", _integer(F.col("n_z")), "Intermittent demand (CV>1)"),
        tile(8, TILES[8], "modelled", F.concat_ws(" ", F.lit("Top"), F.col("modelled"), F.lit("SKUs")), "95-98% service level targets"),
        tile(9, TILES[9], None, dates, lines),
    ]
    # Single rows, so these joins have one row.
    one_row = grade_counts(graded).withColumn("modelled", rop.select("skus").scalar())
    for column in ("clean_lines", "first_date", "last_date"):
        one_row = one_row.withColumn(column, extent(graded).select(column).scalar())
    return _figures(one_row, tiles).select(
        "position", F.col("metric").alias("label"), "amount",
        F.col("value")["v"].alias("value"), F.col("value")["n"].alias("note"),
    )


def top_class_skus(master: DataFrame, abc_class: str = "A", n: int = 30) -> DataFrame:
    """Best sellers of one class with their rank."""
    top = top_by(master.where(F.col("abc_class") == abc_class), "total_revenue", n)
    return add_rank(top, "total_revenue", "rank").select(
        "rank", "stock_code", F.substring("description", 1, 50).alias("description"), "total_revenue",
        "total_qty_sold", "avg_unit_price", "xyz_class", "abc_xyz",
    )


# Chart data -----------------------------------------------------------------------------


def pareto_points(ranked: DataFrame) -> DataFrame:
    """Pareto curve: share of SKUs against share of revenue, both in percent."""
    return ranked.select(
        "stock_code", "sku_rank_pct", (F.col("revenue_cum_pct").cast("double") * 100).alias("revenue_pct")
    )


def pareto_cutoffs(ranked: DataFrame, policy: Policy) -> DataFrame:
    """Percent of SKUs up to the A and B revenue borders."""
    reached = F.col("revenue_cum_pct").cast("double")

    def percent(border) -> Column:
        return F.count_if(reached <= F.lit(float(border))) / F.count(F.lit(1)) * 100

    return ranked.agg(percent(policy.a_share).alias("a_cutoff"), percent(policy.b_share).alias("b_cutoff"))


def cv_histogram(graded: DataFrame) -> DataFrame:
    """SKUs per CV bin; bins span the data's own clipped range and the last one is closed."""
    spark = graded.sparkSession
    values = (
        graded.where(F.col("cv").isNotNull())
        .groupBy(clip(F.col("cv").cast("double"), 0.0, CV_CHART_MAX).alias("cv"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # A single value gets a bin range of one around it.
    low, high = F.min("cv"), F.max("cv")
    half = F.when(low == high, 0.5).otherwise(0.0)
    extent = values.agg(F.struct((low - half).alias("low"), (high + half).alias("high")))
    bounds = extent.scalar()
    placed = values.withColumn("_bounds", bounds)
    low, high = F.col("_bounds.low"), F.col("_bounds.high")
    position = F.floor((F.col("cv") - low) * F.lit(float(CV_BINS)) / (high - low)).cast("int")
    per_bin = placed.groupBy(F.least(position, F.lit(CV_BINS - 1)).alias("bin")).agg(F.sum("n").alias("sku_count"))
    bins = spark.range(CV_BINS).select(F.col("id").cast("int").alias("bin")).withColumn("_bounds", bounds)
    width = (high - low) / F.lit(float(CV_BINS))
    return bins.join(per_bin, "bin", "left").select(
        "bin",
        (low + width * F.col("bin")).alias("bin_low"),
        (low + width * (F.col("bin") + 1)).alias("bin_high"),
        F.coalesce("sku_count", F.lit(0).cast("long")).alias("sku_count"),
    )


def heatmap_cells(cells: DataFrame) -> DataFrame:
    """Heat-map cells with their zone label: count and thousands of revenue."""
    return cells.select(
        F.substring("abc_xyz", 1, 1).alias("abc_class"),
        F.substring("abc_xyz", 2, 1).alias("xyz_class"),
        "zone",
        "sku_count",
        (F.col("revenue").cast("double") / 1000).alias("revenue_thousands"),
    )


def cz_scatter(cz: DataFrame) -> DataFrame:
    return cz.select("stock_code", "n_customers", "total_revenue", "loyal_customer_flag")


def cz_axis_caps(cz: DataFrame, policy: Policy | None = None) -> DataFrame:
    """Chart limits from the 98th percentiles of customers and revenue."""
    measures = cz.select(
        F.col("n_customers").cast("double").alias("n_customers"),
        F.col("total_revenue").cast("double").alias("total_revenue"),
    ).unpivot([], ["n_customers", "total_revenue"], "measure", "reading")
    p98 = quantiles(measures, "reading", {"p98": 0.98}, by=["measure"], sketch_k=policy.sketch_k if policy else None)
    limit = F.when(F.col("measure") == "n_customers", F.col("p98") + 2).otherwise(F.col("p98") * 1.1)
    return p98.withColumn("axis_limit", limit)


def quadrant_sample(graded: DataFrame, size: int = QUADRANT_SIZE, seed: int = QUADRANT_SEED) -> DataFrame:
    """Repeatable sample of SKUs for the value/predictability chart.

    Rows are ordered by a hash of seed and stock code, so the same SKUs are drawn whatever
    the partitioning.
    """
    drawn = (
        graded.where(F.col("cv").isNotNull() & (F.col("total_revenue") > 0))
        .orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("stock_code"))), "stock_code")
        .limit(size)
    )
    return drawn.select(
        "stock_code",
        "abc_xyz",
        clip(F.col("cv").cast("double"), 0.0, QUADRANT_CV_MAX).alias("cv"),
        F.log10(F.col("total_revenue").cast("double") + 1).alias("log_revenue"),
    )
