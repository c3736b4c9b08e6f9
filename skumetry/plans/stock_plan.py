"""One analysis run: transactions and a policy in, every table out.

Each stage asks for the transaction columns it reads. Tables are built on first use and kept,
so a run that asks for several reports reduces the invoice lines once. The SKU totals and the
graded SKU table are written to the shared folder when they are first asked for; everything
after them reads SKU rows, not invoice lines.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skumetry import schemas
from skumetry.operators import classes, cleaning, exports, extensions, ledger, rationalise, reorder, reports, sku, summaries
from skumetry.policy import Policy
from skumetry.session import written

# Transaction columns that each stage reads.
CLEANING = ("invoice_no", "stock_code", "quantity", "unit_price")
SALES = CLEANING + ("invoice_date",)
BUYERS = CLEANING + ("customer_id",)
TEXTS = CLEANING + ("description",)

TransactionSource = Callable[[Sequence[str]], DataFrame]


class StockPlan:
    """``transactions`` is a table, or a source that gives the asked-for columns of one.

    A source, called with columns, can leave out the work behind columns a stage does not
    read, such as joins. One with methods ``text_counts``, ``buyer_pairs``, ``buyer_counts``,
    ``week_rollup`` or ``lead_events`` counts descriptions, finds or counts buyers, sums weeks or
    measures lead times itself.
    """

    def __init__(self, transactions: DataFrame | TransactionSource, policy: Policy | None = None) -> None:
        self._transactions = transactions
        self.policy = policy or Policy()

    # Lines ------------------------------------------------------------------------------

    def transactions(self, columns: Sequence[str]) -> DataFrame:
        """The asked-for columns in their declared types, so that prices are exact cents."""
        given = self._transactions
        table = given if isinstance(given, DataFrame) else given(columns)
        return self._typed(table.select(*columns))

    @staticmethod
    def _typed(table: DataFrame) -> DataFrame:
        types = {f.name: f.dataType for f in schemas.TRANSACTIONS.fields}
        return table.select(*[F.col(c).cast(types[c]).alias(c) if c in types else F.col(c) for c in table.columns])

    def clean(self, columns: Sequence[str]) -> DataFrame:
        return cleaning.clean_transactions(self.transactions(columns), self.policy)

    @cached_property
    def week_rollup(self) -> DataFrame:
        find = getattr(self._transactions, "week_rollup", None)
        return sku.week_rollup(self.clean(SALES)) if find is None else find(SALES, self._clean_typed)

    @cached_property
    def weekly_demand(self) -> DataFrame:
        return schemas.conform(sku.weekly_demand(self.week_rollup), schemas.WEEKLY_DEMAND)

    @cached_property
    def demand_stats(self) -> DataFrame:
        return sku.demand_stats(self.week_rollup, self.policy)

    def buyer_pairs_of(self, codes: DataFrame | None = None) -> DataFrame:
        """``stock_code``, ``invoice_no`` and ``customer_id``, with repeats, of all lines or those of ``codes``."""
        find = getattr(self._transactions, "buyer_pairs", None)
        if find is not None:
            return find(CLEANING, self._clean_typed, codes)
        lines = self.clean(BUYERS).select("stock_code", "invoice_no", "customer_id")
        return lines if codes is None else lines.join(codes, "stock_code", "left_semi")

    @property
    def pairs_differ(self) -> bool:
        """Whether ``buyer_pairs_of`` gives each pair once."""
        return getattr(self._transactions, "pairs_differ", False)

    def buyers_of(self, codes: DataFrame | None = None) -> DataFrame:
        """Distinct invoices and customers of each SKU, or of each of ``codes``, whose lines alone are read."""
        count = getattr(self._transactions, "buyer_counts", None)
        if count is not None:
            return count(CLEANING, self._clean_typed, codes)
        return sku.sku_buyers(self.buyer_pairs_of(codes))

    @cached_property
    def buyers(self) -> DataFrame:
        return self.buyers_of()

    def _clean_typed(self, lines: DataFrame) -> DataFrame:
        return cleaning.clean_present(self._typed(lines), self.policy)

    def text_counts_of(self, codes: DataFrame | None = None) -> DataFrame:
        """How many lines carry each text of each SKU, or of each of ``codes``."""
        count = getattr(self._transactions, "text_counts", None)
        if count is not None:
            return count(CLEANING, self._clean_typed, codes)
        lines = self.clean(TEXTS)
        return sku.text_counts(lines if codes is None else lines.join(codes, "stock_code", "left_semi"))

    def descriptions_of(self, codes: DataFrame | None = None) -> DataFrame:
        """One description for each SKU, or for each of ``codes``, whose lines alone are counted."""
        return sku.sku_descriptions(self.text_counts_of(codes), self.policy)

    @cached_property
    def descriptions(self) -> DataFrame:
        return self.descriptions_of()

    @cached_property
    def sku_revenue(self) -> DataFrame:
        totals = sku.sku_totals(self.week_rollup, self.policy)
        return sku.sku_revenue(totals, self.buyers, self.descriptions)

    # Graded SKUs ------------------------------------------------------------------------

    @cached_property
    def totals(self) -> DataFrame:
        """Totals, demand statistics and XYZ class, written once; nothing is ranked yet."""
        return written(classes.with_xyz(sku.sku_totals(self.week_rollup, self.policy), self.policy))

    @cached_property
    def volatility(self) -> DataFrame:
        """Demand statistics and XYZ class for reports that need no rank; reads what is written, if it is."""
        if "totals" in self.__dict__:
            return self.totals
        return classes.with_xyz(sku.sku_totals(self.week_rollup, self.policy), self.policy)

    @cached_property
    def graded(self) -> DataFrame:
        """Totals, demand statistics, Pareto rank and classes; no texts or buyers yet.

        The ranked table is written once, as Parquet, so every report after it reads just the
        columns it needs and nothing is ranked twice.
        """
        ranked = classes.with_abc(classes.rank_by_revenue(self.totals, self.policy), self.policy)
        return classes.with_cell(written(ranked), self.policy)

    @cached_property
    def cells(self) -> DataFrame:
        """Sums of each ABC-XYZ cell, written once: class tables, matrix and pivots all come from these nine rows."""
        return written(summaries.class_cells(self.graded))

    @cached_property
    def graded_with_buyers(self) -> DataFrame:
        return self.graded.join(self.buyers, "stock_code")

    @cached_property
    def _described(self) -> DataFrame:
        master = self.graded_with_buyers.join(self.descriptions, "stock_code")
        return master.withColumn("rationalisation_flag", rationalise.rationalisation_flag(self.policy))

    @cached_property
    def sku_abc(self) -> DataFrame:
        return self._described.select(
            "stock_code", "description", "total_qty_sold", "total_revenue", "n_invoices", "n_customers",
            "avg_unit_price", "first_sale_date", "last_sale_date", "revenue_cumsum", "revenue_cum_pct",
            "abc_class",
        )

    @cached_property
    def sku_master(self) -> DataFrame:
        return schemas.conform(self._described, schemas.sku_master(self.policy))

    # Summaries --------------------------------------------------------------------------

    def abc_summary(self, complete: bool = False) -> DataFrame:
        return summaries.abc_summary(self.cells, self.policy, complete)

    def xyz_summary(self, complete: bool = False) -> DataFrame:
        return summaries.xyz_summary(self.volatility, self.policy, complete)

    def matrix_long(self) -> DataFrame:
        return summaries.matrix_long(self.cells, self.policy)

    # Decisions --------------------------------------------------------------------------

    def _with_descriptions(self, few: DataFrame) -> DataFrame:
        """Descriptions for a list limited to a fixed number of SKUs.

        Only their invoice lines are counted for it: the list's stock codes filter the lines
        before any other join. The list is written first, because it is read twice and costs a
        pass over all SKUs; its file size decides how it is joined.
        """
        few = written(few)
        return few.join(self.descriptions_of(few.select("stock_code")), "stock_code")

    @cached_property
    def reorder_points(self) -> DataFrame:
        top = self._with_descriptions(reorder.best_sellers(self.graded, self.policy))
        return schemas.conform(
            reorder.reorder_points(top, self.policy), schemas.reorder_points(self.policy)
        )

    @cached_property
    def reorder_numbers(self) -> DataFrame:
        """The reorder table without descriptions, for summaries that show none."""
        return reorder.reorder_points(reorder.best_sellers(self.graded, self.policy), self.policy)

    @cached_property
    def rationalisation_list(self) -> DataFrame:
        cz = self.graded.where(F.col("abc_xyz") == "CZ")
        codes = cz.select("stock_code")
        master = cz.join(self.buyers_of(codes), "stock_code").join(self.descriptions_of(codes), "stock_code")
        return rationalise.rationalisation_list(master, self.policy)

    @cached_property
    def rationalisation_numbers(self) -> DataFrame:
        """The rationalisation list without descriptions."""
        cz = self.graded.where(F.col("abc_xyz") == "CZ")
        return rationalise.rationalisation_list(cz.join(self.buyers_of(cz.select("stock_code")), "stock_code"), self.policy)

    def rationalisation_summary(self) -> DataFrame:
        return rationalise.rationalisation_summary(self.rationalisation_numbers, self.policy)

    # Extensions -------------------------------------------------------------------------

    def recent_spike(self) -> DataFrame:
        return extensions.recent_spike(self.week_rollup, self.policy)

    def lead_time_safety_stock(self) -> DataFrame:
        return extensions.lead_time_safety_stock(reorder.best_sellers(self.graded, self.policy), self.policy)

    def percentile_safety_stock(self) -> DataFrame:
        return extensions.percentile_safety_stock(self.graded, self.week_rollup, self.policy)

    def lead_time_percentile(self) -> DataFrame:
        return extensions.lead_time_percentile(self.graded, self.week_rollup, self.policy)

    def stock_gap(self) -> DataFrame:
        """Stock on hand of the best sellers at every month's end against their reorder points.

        All lines with a real stock code move stock, cancelled and free ones too.
        """
        rop = written(self.reorder_numbers)
        lines = self.transactions(("stock_code", "quantity", "invoice_date")).join(rop.select("stock_code"), "stock_code", "left_semi")
        movements = written(ledger.stock_movements(lines))
        return ledger.stock_gap(rop, movements, ledger.month_ends(movements), self.policy)

    def measured_lead_time(self) -> DataFrame:
        """Reorder points of the best sellers from measured lead times, if the source measures them."""
        top = written(reorder.best_sellers(self.graded, self.policy))
        measure = getattr(self._transactions, "lead_events", None)
        if measure is None:
            events = top.sparkSession.createDataFrame([], "stock_code string, lead_days int")
        else:
            events = measure(CLEANING + ("invoice_date",), self._clean_typed, top.select("stock_code"))
        return extensions.measured_lead_time(top, events, self.policy)

    # Reports ----------------------------------------------------------------------------

    def summary_stats(self) -> DataFrame:
        return reports.summary_stats(
            reports.extent(self.graded),
            self.graded,
            reorder.safety_stock_profile(self.reorder_numbers),
            rationalise.action_profile(self.rationalisation_numbers),
            self.policy,
        )

    def kpi_strip(self) -> DataFrame:
        return reports.kpi_strip(self.graded, reorder.safety_stock_profile(self.reorder_numbers))

    def top_class_skus(self, abc_class: str = "A", n: int = 30) -> DataFrame:
        of_class = self.graded.where(F.col("abc_class") == abc_class)
        few = self._with_descriptions(reports.top_by(of_class, "total_revenue", n))
        return reports.top_class_skus(few, abc_class, n)

    def outputs(self) -> dict[str, DataFrame]:
        """The five result tables a run writes, with the column names of their files."""
        return {
            "sku_master": exports.master_export(self.sku_master),
            "abc_xyz_matrix": exports.matrix_export(self.matrix_long()),
            "reorder_points": exports.rop_export(self.reorder_points),
            "rationalisation_list": exports.rationalisation_export(self.rationalisation_list),
            "summary_stats": exports.stats_export(self.summary_stats()),
        }
