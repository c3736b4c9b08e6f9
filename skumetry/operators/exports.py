"""Result tables with the columns of the files a run writes."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Column names of the written files.
KEYS = {"stock_code": "StockCode", "abc_class": "ABC", "xyz_class": "XYZ", "abc_xyz": "ABC_XYZ"}
ROP_NAMES = {
    **KEYS,
    "description": "Description",
    "annual_revenue": "Annual Revenue (£)",
    "avg_unit_price": "Avg Unit Price (£)",
    "total_qty_sold": "Annual Units Sold",
}
MASTER_COLUMNS = (
    "stock_code", "description", "abc_class", "xyz_class", "abc_xyz", "total_revenue", "total_qty_sold",
    "n_invoices", "n_customers", "avg_unit_price", "weekly_demand_mean", "weekly_demand_std", "cv",
    "weeks_with_demand", "weeks_active_pct", "first_sale_date", "last_sale_date", "revenue_cum_pct",
)
MATRIX_COLUMNS = ("abc_class", "xyz_class", "sku_count", "revenue", "avg_cv", "pct_revenue", "pct_skus")
# avg_weekly_demand and demand_std_weekly are written too: the workbook sheet shows them and
# would otherwise find zeros.
ROP_COLUMNS = (
    "stock_code", "description", "abc_class", "xyz_class", "abc_xyz", "annual_revenue", "avg_unit_price",
    "total_qty_sold", "weekly_demand_mean", "weekly_demand_std", "cv", "lead_time_weeks",
    "service_level_pct", "avg_demand_lt", "safety_stock", "reorder_point", "stockout_risk_flag",
    "avg_weekly_demand", "demand_std_weekly",
)
CZ_COLUMNS = (
    "stock_code", "description", "abc_xyz", "total_revenue", "n_customers", "n_invoices",
    "weekly_demand_mean", "cv", "loyal_customer_flag", "recommended_action",
)
# End of fixed values.


def master_export(master: DataFrame) -> DataFrame:
    return master.select(*MASTER_COLUMNS).withColumnsRenamed(KEYS)


def matrix_export(matrix: DataFrame) -> DataFrame:
    return matrix.select(*MATRIX_COLUMNS).withColumnsRenamed({**KEYS, "revenue": "total_revenue"})


def rop_export(rop: DataFrame) -> DataFrame:
    return rop.select(*ROP_COLUMNS).withColumnsRenamed(ROP_NAMES)


def rationalisation_export(cz: DataFrame) -> DataFrame:
    return cz.select(*CZ_COLUMNS).withColumnsRenamed({**KEYS, "recommended_action": "action"})


def stats_export(stats: DataFrame) -> DataFrame:
    return stats.select("metric", "value")
