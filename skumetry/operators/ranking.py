"""Running totals and quantiles over a whole table without moving it to one task.

A window without PARTITION BY sorts every row in a single task. Here the rows are split into
contiguous ranges of the sort order first; each range is summed on its own and shifted by the
total of the ranges before it.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skumetry.session import written

RANGE = "_range"
#: Rows that are looked at, for each range, to place its borders.
BORDER_SAMPLE = 40
#: A table with fewer rows for each range gets fewer ranges: sorting so many takes one task no time.
LEAST_ROWS = 20_000


@dataclass(frozen=True)
class SortKey:
    """One column of a sort order without nulls."""

    name: str
    falling: bool = False

    @property
    def order(self) -> Column:
        return F.col(self.name).desc() if self.falling else F.col(self.name).asc()


def _borders(df: DataFrame, keys: Sequence[SortKey], ranges: int, rows: int) -> list[Row]:
    """The first rows of all ranges but the first, from a sample whose size the ranges bound.

    Rows are drawn by a hash of all their sort columns, so equal leading values are drawn, and
    split, like any others.
    """
    if ranges < 2:
        return []
    names = [k.name for k in keys]
    wanted = BORDER_SAMPLE * ranges
    share = max(1, rows // wanted)
    sample = df.where(F.pmod(F.xxhash64(*names), F.lit(share)) == 0).select(*names)
    drawn = sample.orderBy(*[k.order for k in keys]).limit(2 * wanted).collect()
    return [drawn[i * len(drawn) // ranges] for i in range(1, ranges)] if len(drawn) >= ranges else []


def _range_number(keys: Sequence[SortKey], borders: Sequence[Row], types: Mapping[str, T.DataType]) -> Column:
    """How many borders a row stands at or behind, by binary search.

    The borders are one constant array and the search is one fold over its halving steps, so the
    expression is as deep for thousands of ranges as for two.
    """
    if not borders:
        return F.lit(0)
    # One text is parsed once, while the plan is optimized; an expression for each border would
    # make the plan itself grow.
    fields = T.StructType([T.StructField(f"k{i}", types[k.name]) for i, k in enumerate(keys)])
    texts = [{f"k{i}": value if isinstance(value, (int, float)) else str(value) for i, value in enumerate(border)} for border in borders]
    sorted_borders = F.from_json(F.lit(json.dumps(texts)), T.ArrayType(fields))
    steps = [1 << bit for bit in reversed(range(len(borders).bit_length()))]

    def not_before(border: Column) -> Column:
        result = F.lit(True)
        for i, key in reversed(list(enumerate(keys))):
            value, limit = F.col(key.name), border[f"k{i}"]
            behind = value < limit if key.falling else value > limit
            result = behind | ((value == limit) & result)
        return result

    def halve(passed: Column, step: Column) -> Column:
        further = passed + step
        # get() counts from 0 and gives null behind the end, where no row stands.
        return F.when(not_before(F.get(sorted_borders, further - 1)), further).otherwise(passed)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), halve)


def running_totals(
    df: DataFrame,
    keys: Sequence[SortKey],
    measures: Mapping[str, Column],
    ranges: int | None = None,
) -> DataFrame:
    """Add ``<name>_running`` (up to and including the row) and ``<name>_total`` per measure.

    ``keys`` must be a total order. ``df`` is read several times, so it should be a written
    table. Range borders are constants, so a row's range depends on the row alone, and the rows
    are shuffled once. There are as many ranges as ``ranges`` says, or as the session has shuffle
    partitions if the table has rows for them. Equal leading sort values are split by the later sort columns, so a value
    shared by many rows does not end up in one range.
    """
    inputs = {name: f"_{name}" for name in measures}
    rows = df.count()
    # Two at least: a range number that is constant would make the join with the offsets a nested loop.
    most = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = ranges or max(2, min(most, rows // LEAST_ROWS + 1))
    borders = _borders(df, keys, wanted, rows)
    number = _range_number(keys, borders, {f.name: f.dataType for f in df.schema.fields})
    split = df.withColumns({inputs[name]: value for name, value in measures.items()} | {RANGE: number})
    # One row per range, a number set by the session: the single-task window and the
    # broadcast below do not grow with the data.
    sums = split.groupBy(RANGE).agg(*[F.sum(c).alias(c) for c in inputs.values()])
    before = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    offsets = sums.select(
        RANGE,
        *[F.sum(c).over(before).alias(f"{c}_before") for c in inputs.values()],
        *[F.sum(c).over(everything).alias(f"{n}_total") for n, c in inputs.items()],
    )
    within = (
        Window.partitionBy(RANGE).orderBy(*[k.order for k in keys]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    running = {
        f"{name}_running": F.coalesce(F.col(f"{c}_before"), F.lit(0)) + F.sum(c).over(within)
        for name, c in inputs.items()
    }
    return (
        split.join(F.broadcast(offsets), RANGE)
        # One range per task; hashing the range numbers would put several into one.
        .repartitionById(len(borders) + 1, RANGE)
        .withColumns(running)
        .drop(RANGE, *inputs.values(), *[f"{c}_before" for c in inputs.values()])
    )


def quantiles(df: DataFrame, value: str, fractions: Mapping[str, float], by: Sequence[str] = (), sketch_k: int | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group, or sketched ones if ``sketch_k`` is given.

    Groups are classes or measures, a handful; their sizes are broadcast, so values are never
    shuffled by group.

    Spark's exact percentile keeps every distinct value of a group in one task. This counts
    equal values, ranks the counts by running totals and keeps the two rows around each
    wanted position.
    """
    by = list(by)
    if sketch_k is not None:
        return sketched_quantiles(df, value, fractions, by, sketch_k)
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).cast("double").alias("_value"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    keys = [SortKey(c) for c in by] + [SortKey("_value")]
    ranked = running_totals(written(counted), keys, {"seen": F.col("_n")})
    group_ends = ranked.groupBy(*by).agg(
        F.min(F.col("seen_running") - F.col("_n")).alias("_start"), F.sum("_n").alias("_size")
    )
    if by:
        placed = ranked.join(F.broadcast(group_ends), by)
    else:
        placed = ranked.withColumns({"_start": F.lit(0), "_size": F.col("seen_total")})
    last = F.col("seen_running") - F.col("_start") - 1
    first = last - F.col("_n") + 1
    picks = []
    for name, fraction in fractions.items():
        position = (F.col("_size") - 1) * F.lit(float(fraction))
        for side, target in (("low", F.floor(position)), ("high", F.ceil(position))):
            picks.append(F.max(F.when(target.between(first, last), F.col("_value"))).alias(f"{name}_{side}"))
    around = placed.groupBy(*by).agg(F.max("_size").alias("_size"), *picks)
    result = []
    for name, fraction in fractions.items():
        position = (F.col("_size") - 1) * F.lit(float(fraction))
        low, high = F.col(f"{name}_low"), F.col(f"{name}_high")
        result.append((low + (high - low) * (position - F.floor(position))).alias(name))
    return around.select(*by, *result)


def sketched_quantiles(df: DataFrame, value: str, fractions: Mapping[str, float], by: Sequence[str] = (), k: int = 3200) -> DataFrame:
    """Approximate quantiles, one row per group, from one pass: the values of ranks near the wanted ones.

    Without interpolation: a result is one of the values. See ``rank_error`` for how near its rank is.
    """
    return sketch_quantiles(merged_sketches(quantile_sketches(df, value, by, k), by, k), fractions, by)


def quantile_sketches(df: DataFrame, value: str, by: Sequence[str] = (), k: int = 3200) -> DataFrame:
    """A KLL sketch of the values of each group; nulls are left out.

    Sketches have a bounded size (some tens of KB for the default ``k``, whatever they describe) and can be
    kept and merged, for instance one for each period, so new data never needs old lines again.
    """
    return df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), k).alias("sketch"))


def merged_sketches(sketches: DataFrame, by: Sequence[str] = (), k: int = 3200) -> DataFrame:
    """One sketch for each group of rows with sketches, which may come from different periods."""
    return sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch", k).alias("sketch"))


def sketch_quantiles(sketches: DataFrame, fractions: Mapping[str, float], by: Sequence[str] = ()) -> DataFrame:
    """The quantiles that sketches hold; groups without values have none."""
    filled = sketches.where(F.col("sketch").isNotNull() & (F.kll_sketch_get_n_double("sketch") > 0))
    return filled.select(*by, *[F.kll_sketch_get_quantile_double("sketch", F.lit(float(f))).alias(name) for name, f in fractions.items()])


def rank_error(k: int) -> float:
    """How far, as a share of all values, a sketched quantile's rank may be off; holds with 99 % confidence."""
    return 2.296 / k**0.9021


def top_by(df: DataFrame, measure: str, n: int, key: str = "stock_code") -> DataFrame:
    """The ``n`` rows with the greatest ``measure``; equal values go by ``key``."""
    return df.orderBy(F.col(measure).desc(), F.col(key).asc()).limit(n)


def add_rank(top: DataFrame, measure: str, name: str, key: str = "stock_code") -> DataFrame:
    """Row numbers for an already limited list (one task; use running totals for a table)."""
    order = Window.orderBy(F.col(measure).desc(), F.col(key).asc())
    return top.withColumn(name, F.row_number().over(order))
