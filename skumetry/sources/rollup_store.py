"""A roll-up that grows by batches: new lines are reduced once, old lines are never read again.

Every batch leaves three partial tables: weekly moments (SKU × week), counted descriptions and
the different buyers. All three merge exactly: moments and counts are whole-number sums, dates
are extremes, buyers are a set. A run over the store therefore equals a run over all lines.

A batch is written to a folder of its own, and one line of the manifest, written last, makes it
count. A batch that is added again replaces its former version, so a repeated or failed run does
no harm. ``compact`` merges what has accumulated into one version of all batches.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skumetry.operators import sku

MANIFEST = "manifest"
_MANIFEST_SCHEMA = "version string, semantics string, code_pattern string, batches array<string>"
_TABLES = {
    "weeks": (
        "stock_code string, week_start date, qty_sold long, revenue_cents long, price_cents long, n_lines long, "
        "first_sale timestamp, last_sale timestamp"
    ),
    "texts": "stock_code string, description string, n_lines long",
    "buyers": "stock_code string, invoice_no string, customer_id string",
}


class BatchConflict(ValueError):
    """A batch does not fit to what the store holds."""


class RollupStore:
    """Partial tables in ``folder``; give it to ``StockPlan`` in place of transactions.

    The plan's tables that need sales, descriptions or buyers come from it. It keeps no lines:
    asking for transactions raises ``LookupError``.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._spark = spark
        self._folder = folder

    # Writing ----------------------------------------------------------------------------

    def add(self, plan, batch: str) -> str:
        """Reduces the lines of ``plan``, a ``StockPlan`` over new lines, and adds them as ``batch``.

        Lines of one invoice may come in different batches, each line in one of them. Returns the
        version's name. All batches have to be cleaned by the same rules. A batch that ``compact``
        has merged with others cannot be replaced. Both cases raise ``BatchConflict``.
        """
        rules = self._rules(plan.policy)
        versions = self._versions()
        for version in versions:
            if (version.semantics, version.code_pattern) != rules:
                raise BatchConflict(f"the store was cleaned by {(version.semantics, version.code_pattern)}, this batch by {rules}")
            if batch in version.batches and len(version.batches) > 1:
                raise BatchConflict(f"{batch} is merged with other batches")
        pairs = plan.buyer_pairs_of()
        tables = {"weeks": plan.week_rollup, "texts": plan.text_counts_of(), "buyers": pairs if plan.pairs_differ else pairs.distinct()}
        return self._write(tables, rules, [batch])

    def compact(self) -> str | None:
        """Merges all batches into one version; readers see the former ones until it is whole.

        Files of former versions stay, so that running readers end; None if there is nothing to merge.
        """
        versions = self._versions()
        if len(versions) < 2:
            return None
        rules = (versions[0].semantics, versions[0].code_pattern)
        tables = {"weeks": self.week_rollup(), "texts": self.text_counts((), None), "buyers": self._table("buyers").distinct()}
        return self._write(tables, rules, sorted(b for v in versions for b in v.batches))

    @staticmethod
    def _rules(policy) -> tuple[str, str]:
        return policy.semantics, policy.code_pattern

    def _write(self, tables: dict[str, DataFrame], rules: tuple[str, str], batches: list[str]) -> str:
        version = f"{dt.datetime.now(dt.timezone.utc):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"
        for name, df in tables.items():
            df.select(*self._columns(name)).write.parquet(f"{self._folder}/{version}/{name}")
        line = self._spark.createDataFrame([(version, *rules, batches)], _MANIFEST_SCHEMA)
        line.coalesce(1).write.mode("append").json(f"{self._folder}/{MANIFEST}")
        return version

    # Reading ----------------------------------------------------------------------------

    @property
    def batches(self) -> list[str]:
        return sorted(b for v in self._versions() for b in v.batches)

    def _versions(self) -> list:
        """The versions that count, oldest first: for each batch the newest one that holds it."""
        try:
            lines = self._spark.read.schema(_MANIFEST_SCHEMA).json(f"{self._folder}/{MANIFEST}").collect()  # a line for each batch
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        newest = {batch: line for line in sorted(lines, key=lambda v: v.version) for batch in line.batches}
        return sorted({line.version: line for line in newest.values()}.values(), key=lambda v: v.version)

    @staticmethod
    def _columns(name: str) -> list[str]:
        return [column.split()[0] for column in _TABLES[name].split(", ")]

    def _table(self, name: str) -> DataFrame:
        paths = [f"{self._folder}/{v.version}/{name}" for v in self._versions()]
        if not paths:
            return self._spark.createDataFrame([], _TABLES[name])
        return self._spark.read.schema(_TABLES[name]).parquet(*paths)

    def week_rollup(self, columns: Iterable[str] = (), clean: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """Sales of each SKU in each week over all batches; a filter on weeks reaches the scan."""
        return sku.merge_rollups(self._table("weeks"))

    def text_counts(self, columns: Iterable[str], clean: Callable[[DataFrame], DataFrame] | None, codes: DataFrame | None = None) -> DataFrame:
        """Counted descriptions, of ``codes`` if given; the lines were cleaned when they were added."""
        texts = self._table("texts")
        if codes is not None:
            texts = texts.join(codes, "stock_code", "left_semi")
        return texts.groupBy("stock_code", "description").agg(F.sum("n_lines").alias("n_lines"))

    def buyer_pairs(self, columns: Iterable[str], clean: Callable[[DataFrame], DataFrame] | None, codes: DataFrame | None = None) -> DataFrame:
        """Buyers of each batch, of ``codes`` if given; one pair may come once for each batch."""
        pairs = self._table("buyers")
        return pairs if codes is None else pairs.join(codes, "stock_code", "left_semi")

    def buyer_counts(self, columns: Iterable[str], clean: Callable[[DataFrame], DataFrame] | None, codes: DataFrame | None = None) -> DataFrame:
        """Distinct invoices and customers of each SKU over all batches, of ``codes`` if given."""
        return sku.buyers_of_pairs(self.buyer_pairs(columns, clean, codes))

    def __call__(self, columns: Iterable[str]) -> DataFrame:
        raise LookupError("the store keeps no lines")
