"""Invoice lines derived from order, line-item, part, customer and nation tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skumetry.functions.exact import from_cents
from skumetry.operators import sku
from skumetry.schemas import PRICE, TRANSACTIONS


def seasonal_code(part_key, day):
    """A stock code per part and calendar year.

    SKU demand is graded over about one year. The line items cover several, so each part gets
    a new code every year, as seasonal ranges do; this keeps every line in the analysis. Part
    key and full year are written in base 36, counted from 36^5 so that no padding is needed.
    The length grows with the part key, which ``CODE_PATTERN`` allows.
    """
    return _written_code(_code_number(part_key, day))


def _code_number(part_key: Column, day: Column) -> Column:
    """The number that a stock code writes: one machine word for each part and year."""
    return part_key * 10_000 + F.year(day) + F.lit(36**5)


def _written_code(number: Column) -> Column:
    return F.conv(number.cast("string"), 10, 36)


#: The codes of these tables: no upper length, unlike those of a retail extract.
CODE_PATTERN = r"^[0-9A-Z]{5,}\z"


class OrderTables:
    """Transactions from a folder of order tables; each table's footer is read once."""

    #: ``buyer_pairs`` gives each pair once.
    pairs_differ = True

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._spark = spark
        self._folder = folder
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self._spark.read.parquet(f"{self._folder}/{name}.parquet")
        return self._tables[name]

    def transactions(self, columns: Iterable[str] = tuple(TRANSACTIONS.fieldNames())) -> DataFrame:
        """The requested transaction columns; returned lines become cancelled invoices.

        Descriptions, customers and countries come from other tables. They are joined only
        when asked for: the optimizer cannot know that those tables' keys are unique, so it
        would keep a join whose columns nobody reads. No join is forced to broadcast – the
        part and order tables grow with the data, so their sizes decide at run time.
        """
        wanted = [c for c in TRANSACTIONS.fieldNames() if c in set(columns)]
        lines = self.table("lineitem")
        if "customer_id" in wanted or "country" in wanted:
            orders = self.table("orders").select("o_orderkey", "o_custkey")
            if "country" in wanted:
                nations = self.table("nation").select("n_nationkey", "n_name")
                customers = self.table("customer").select("c_custkey", "c_nationkey")
                places = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left")
                orders = orders.join(places, F.col("o_custkey") == F.col("c_custkey"), "left")
            lines = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
        if "description" in wanted:
            parts = self.table("part").select("p_partkey", "p_name")
            lines = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"), "left")
        expressions = _transaction_columns()
        return lines.select(*[expressions[c].alias(c) for c in wanted])

    __call__ = transactions

    def dated(self, keep: Callable[[Column], Column]) -> OrderTables:
        """The same tables with the lines whose invoice date ``keep`` allows."""
        some = OrderTables(self._spark, self._folder)
        some._tables = {**self._tables, "lineitem": self.table("lineitem").where(keep(F.col("l_shipdate").cast("timestamp")))}
        return some

    def week_rollup(self, columns: Iterable[str], clean: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """As ``sku.week_rollup`` of the clean lines, grouped by the number of a code, with prices in cents throughout."""
        lines = self._sold(columns, clean, None, _unit_cents().alias("unit_cents"))
        return self._coded(sku.week_sums(lines, "code_number", F.col("unit_cents")), clean)

    def text_counts(self, columns: Iterable[str], clean: Callable[[DataFrame], DataFrame], codes: DataFrame | None = None) -> DataFrame:
        """``stock_code``, ``description``, ``n_lines``: how many clean lines carry each text.

        Lines are cleaned, filtered to ``codes`` and counted by part before the part table is
        joined, so a part with a third of all lines reaches the join as a few rows.
        """
        counted = self._sold(columns, clean, codes, "l_partkey").groupBy("code_number", "l_partkey").agg(F.count(F.lit(1)).alias("n"))
        parts = self.table("part").select("p_partkey", F.col("p_name").alias("description"))
        named = counted.join(parts, F.col("l_partkey") == F.col("p_partkey"), "left")
        # A code has one part, so the part is no further key; with it, rows stay where the join put them.
        named = named.groupBy("l_partkey", "code_number", "description").agg(F.sum("n").alias("n_lines"))
        return self._coded(named.drop("l_partkey"), clean)

    def _sold(self, columns: Iterable[str], clean: Callable[[DataFrame], DataFrame], codes: DataFrame | None, *keys: str | Column) -> DataFrame:
        """``keys``, ``code_number`` and other ``columns`` of the lines that pass all rules but the one on codes; nothing is joined yet.

        A code is a text that costs more to write and to check than all else in a line, so lines are
        grouped by its number, and ``_coded`` writes and checks the code of each group. Only for a list of
        ``codes``, which leaves few lines, each line's code is written.
        """
        expressions = _transaction_columns()
        others = [expressions[c].alias(c) for c in columns if c != "stock_code"]
        number = _code_number(F.col("l_partkey"), F.col("l_shipdate")).alias("code_number")
        lines = clean(self.table("lineitem").select(*keys, number, *others))
        if codes is not None:
            lines = lines.withColumn("stock_code", _written_code(F.col("code_number"))).join(codes, "stock_code", "left_semi")
        return lines

    @staticmethod
    def _coded(groups: DataFrame, clean: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``groups`` with ``stock_code`` in place of its number, those with a clean code."""
        others = [c for c in groups.columns if c != "code_number"]
        return clean(groups.select(_written_code(F.col("code_number")).alias("stock_code"), *others))

    def _cleaned(self, columns: Iterable[str], clean: Callable[[DataFrame], DataFrame], codes: DataFrame | None, *keys: str) -> DataFrame:
        """Clean lines, those of ``codes`` if given, with keys of other tables; nothing is joined yet."""
        expressions = _transaction_columns()
        lines = clean(self.table("lineitem").select(*keys, *[expressions[c].alias(c) for c in columns]))
        return lines if codes is None else lines.join(codes, "stock_code", "left_semi")

    def _numbered_pairs(self, columns: Iterable[str], clean: Callable[[DataFrame], DataFrame], codes: DataFrame | None) -> DataFrame:
        """``code_number``, ``l_orderkey``, ``returned`` and ``o_custkey`` of all invoices of each SKU.

        An order has few lines, so they are joined as they are; what the join puts together is reduced
        to different rows in place.
        """
        pairs = self._sold(columns, clean, codes, "l_orderkey", "l_returnflag")
        returned = F.when(F.col("l_returnflag") == "R", True).otherwise(False)
        orders = self.table("orders").select("o_orderkey", "o_custkey")
        pairs = pairs.select("code_number", "l_orderkey", returned.alias("returned")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
        return pairs.select("code_number", "l_orderkey", "returned", "o_custkey").distinct()

    def buyer_pairs(self, columns: Iterable[str], clean: Callable[[DataFrame], DataFrame], codes: DataFrame | None = None) -> DataFrame:
        """The different ``stock_code``, ``invoice_no``, ``customer_id`` of clean lines."""
        pairs = self._coded(self._numbered_pairs(columns, clean, codes), clean)
        return pairs.select("stock_code", _invoice_no(F.col("returned")).alias("invoice_no"), F.col("o_custkey").cast("string").alias("customer_id"))

    def buyer_counts(self, columns: Iterable[str], clean: Callable[[DataFrame], DataFrame], codes: DataFrame | None = None) -> DataFrame:
        """``stock_code``, ``n_invoices``, ``n_customers``: counted on whole numbers, which texts are made of one to one."""
        pairs = self._numbered_pairs(columns, clean, codes)
        return self._coded(sku.buyers_of_pairs(pairs, "code_number", ["l_orderkey", "returned"], "o_custkey"), clean)

    def lead_events(self, columns: Iterable[str], clean: Callable[[DataFrame], DataFrame], codes: DataFrame) -> DataFrame:
        """``stock_code`` and ``lead_days``, from order to shipping, of the clean lines of ``codes``."""
        lines = self._cleaned(columns, clean, codes, "l_orderkey").select("stock_code", "l_orderkey", "invoice_date")
        orders = self.table("orders").select("o_orderkey", "o_orderdate")
        dated = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        return dated.select("stock_code", F.datediff("invoice_date", "o_orderdate").alias("lead_days"))


def _invoice_no(returned: Column) -> Column:
    return F.concat(F.when(returned, "C").otherwise(""), F.col("l_orderkey").cast("string"))


def _units() -> Column:
    return F.col("l_quantity").cast("int")


def _unit_cents() -> Column:
    units = _units()
    cents = F.rint(F.col("l_extendedprice") * 100).cast("long")
    # Whole cents per unit, rounded half up in whole numbers. No units, no price. Half a cent a
    # unit at most is gained or lost, and a line below half a cent a unit has no price.
    twice = F.nullif(2 * units.cast("long"), F.lit(0).cast("long"))
    return F.call_function("div", 2 * cents + units.cast("long"), twice)


def _transaction_columns() -> dict[str, Column]:
    returned = F.col("l_returnflag") == "R"
    units = _units()
    return {
        "invoice_no": _invoice_no(returned),
        "stock_code": seasonal_code(F.col("l_partkey"), F.col("l_shipdate")),
        "description": F.col("p_name"),
        "quantity": F.when(returned, -units).otherwise(units),
        "invoice_date": F.col("l_shipdate").cast("timestamp"),
        "unit_price": from_cents(_unit_cents(), PRICE.precision),
        "customer_id": F.col("o_custkey").cast("string"),
        "country": F.col("n_name"),
    }
