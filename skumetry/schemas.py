"""Declared tables and the check that an output conforms to its declaration.

Money and quantity columns are wider than a one-year retail extract would need, because a
single SKU may hold a third of a very large log. Decimals of up to 18 digits stay in one
machine word.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skumetry.policy import Policy

PRICE = T.DecimalType(10, 2)
MONEY = T.DecimalType(18, 2)
MONEY_SUM = T.DecimalType(22, 2)
UNIT_COST = T.DecimalType(14, 4)
DEMAND = T.DecimalType(18, 2)
RATIO = T.DecimalType(12, 4)
UNITS = T.DecimalType(18, 0)


class SchemaMismatch(ValueError):
    """An output lacks a declared column or carries it with another type."""


def _table(*columns: tuple) -> T.StructType:
    """Columns as ``(name, type)`` or ``(name, type, nullable)``."""
    return T.StructType([T.StructField(c[0], c[1], c[2] if len(c) > 2 else True) for c in columns])


TRANSACTIONS = _table(
    ("invoice_no", T.StringType(), False),
    ("stock_code", T.StringType(), False),
    ("description", T.StringType()),
    ("quantity", T.IntegerType(), False),
    ("invoice_date", T.TimestampType(), False),
    ("unit_price", PRICE, False),
    ("customer_id", T.StringType()),
    ("country", T.StringType()),
)

WEEKLY_DEMAND = _table(
    ("stock_code", T.StringType(), False),
    ("week_start", T.DateType(), False),
    ("year_week", T.StringType(), False),
    ("qty_sold", T.LongType(), False),
)


def _stat(policy: Policy, exact: T.DataType) -> T.DataType:
    return exact if policy.rounded else T.DoubleType()


def sku_master(policy: Policy) -> T.StructType:
    day = T.DateType() if policy.rounded else T.TimestampType()
    return _table(
        ("stock_code", T.StringType(), False),
        ("description", T.StringType()),
        ("total_qty_sold", T.LongType()),
        ("total_revenue", MONEY),
        ("n_invoices", T.LongType()),
        ("n_customers", T.LongType()),
        ("avg_unit_price", _stat(policy, UNIT_COST)),
        ("first_sale_date", day),
        ("last_sale_date", day),
        ("weekly_demand_mean", _stat(policy, DEMAND)),
        ("weekly_demand_std", _stat(policy, DEMAND)),
        ("cv", _stat(policy, RATIO)),
        ("weeks_with_demand", T.LongType()),
        ("weeks_active_pct", T.DoubleType()),
        ("revenue_cumsum", MONEY_SUM),
        ("revenue_cum_pct", _stat(policy, RATIO)),
        ("abc_class", T.StringType()),
        ("xyz_class", T.StringType()),
        ("abc_xyz", T.StringType()),
        ("strategic_action", T.StringType()),
        ("rationalisation_flag", T.StringType()),
    )


def reorder_points(policy: Policy) -> T.StructType:
    return _table(
        ("stock_code", T.StringType(), False),
        ("description", T.StringType()),
        ("abc_class", T.StringType()),
        ("xyz_class", T.StringType()),
        ("abc_xyz", T.StringType()),
        ("service_level_pct", T.IntegerType()),
        ("lead_time_weeks", T.DecimalType(4, 1)),
        ("avg_weekly_demand", _stat(policy, DEMAND)),
        ("demand_std_weekly", _stat(policy, DEMAND)),
        ("avg_demand_lt", _stat(policy, UNITS)),
        ("safety_stock", _stat(policy, UNITS)),
        ("reorder_point", _stat(policy, UNITS)),
        ("stockout_risk_flag", T.BooleanType()),
        ("annual_revenue", MONEY),
        ("avg_unit_price", _stat(policy, UNIT_COST)),
        ("total_qty_sold", T.LongType()),
        ("weekly_demand_mean", _stat(policy, DEMAND)),
        ("weekly_demand_std", _stat(policy, DEMAND)),
        ("cv", _stat(policy, RATIO)),
    )


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project ``df`` onto ``schema``; raise when a column is missing or of another type."""
    actual = {f.name: f.dataType for f in df.schema.fields}
    wrong = [
        f"{f.name}: {actual.get(f.name, 'missing')} instead of {f.dataType}"
        for f in schema.fields
        if actual.get(f.name) != f.dataType
    ]
    if wrong:
        raise SchemaMismatch("; ".join(wrong))
    return df.select(*[F.col(f.name) for f in schema.fields])
