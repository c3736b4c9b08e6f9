"""SKU demand grading and stock policy on Spark DataFrames."""

from skumetry.plans.stock_plan import StockPlan
from skumetry.policy import Policy

__all__ = ["Policy", "StockPlan"]
