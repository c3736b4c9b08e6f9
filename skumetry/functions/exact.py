"""Column expressions whose rounding must not depend on partitioning or on binary fractions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_cents(amount: Column) -> Column:
    """A two-decimal amount as whole cents.

    Sums of cents stay in one machine word. Decimal sums of this width would add arbitrary
    precision objects for every invoice line. An overflow raises, it does not wrap.
    """
    return (amount * 100).cast("long")


def from_cents(cents: Column, digits: int = 18) -> Column:
    """Whole cents as a two-decimal amount of ``digits`` digits."""
    return (cents.cast("decimal(19,0)") * F.lit(Decimal("0.01"))).cast(f"decimal({digits},2)")


def rounded_mean(total: Column, count: Column, digits: int) -> Column:
    """``total / count`` as a decimal, rounded half away from zero."""
    return F.round(F.try_divide(total.cast("decimal(22,2)"), count.cast("decimal(14,0)")), digits)


def rounded_share(part: Column, whole: Column, digits: int, scale: int = 1) -> Column:
    """``scale * part / whole`` as a decimal, rounded half away from zero."""
    scaled = (part.cast("decimal(22,2)") * F.lit(scale)).cast("decimal(24,2)")
    return F.round(F.try_divide(scaled, whole.cast("decimal(22,2)")), digits)


def share(part: Column, whole: Column) -> Column:
    """``part / whole`` as an unrounded double."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def sample_stddev(count: Column, total: Column, squares: Column) -> Column:
    """Sample standard deviation from integer moments; null for fewer than two values.

    The moments are exact sums, so the result has the same bits in whatever order partial
    sums were merged. Class borders are compared against it, and a last-bit difference
    between two runs would move a SKU from one class to another.
    """
    n = count.cast("decimal(10,0)")
    s = total.cast("decimal(19,0)")
    spread = (n * squares - s * s).cast("double")
    pairs = (count * (count - F.lit(1))).cast("double")
    return F.sqrt(spread / F.nullif(pairs, F.lit(0.0)))


def iso_week_label(day: Column) -> Column:
    """``2010-52`` for 2011-01-01: ISO year and ISO week number."""
    return F.concat(
        F.extract(F.lit("YEAROFWEEK"), day).cast("string"),
        F.lit("-"),
        F.lpad(F.weekofyear(day).cast("string"), 2, "0"),
    )


def clip(value: Column, low: float, high: float) -> Column:
    """Clamp to [low, high]; null stays null."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))
