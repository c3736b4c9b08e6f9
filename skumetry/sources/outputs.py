"""Writing the result tables and loading them again.

Tables can be written one by one (``save_outputs``), each replacing its former version, or as a
run (``save_run``): a run's tables go to a folder of their own, and a manifest that names them is
written last. Readers take the newest run with a manifest, so they see all tables of one run or
of the one before, whatever fails in between.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
import warnings
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

OUTPUT_TABLES = ("sku_master", "abc_xyz_matrix", "reorder_points", "rationalisation_list", "summary_stats")


class EmptyMaster(RuntimeError):
    """The SKU master table is missing or has no rows."""


#: The order in which tables are written: column and whether it falls.
FILE_ORDER = {
    "sku_master": (("total_revenue", True), ("StockCode", False)),
    "reorder_points": (("Annual Revenue (£)", True), ("StockCode", False)),
    "rationalisation_list": (("action", False), ("total_revenue", True), ("StockCode", False)),
    "rationalisation_summary": (("sku_count", True), ("recommended_action", False)),
    "rationalise_candidates": (("total_revenue", True), ("stock_code", False)),
}


def in_file_order(df: DataFrame, name: str) -> DataFrame:
    """Sorted as the file of that name is; tables without an order stay as they are.

    Sorting is part of writing only: a range shuffle whose files follow one another.
    """
    order = FILE_ORDER.get(name)
    return df.orderBy(*[F.col(f"`{c}`").desc() if falls else F.col(f"`{c}`").asc() for c, falls in order]) if order else df


def save_table(df: DataFrame, folder: str, name: str, fmt: str = "parquet") -> str:
    """Write one table in its file order, replacing an earlier version.

    CSV files get a header line, and quotes inside a text are doubled.
    """
    path = f"{folder}/{name}"
    writer = in_file_order(df, name).write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.format(fmt).save(path)
    return path


def save_outputs(tables: Mapping[str, DataFrame], folder: str, fmt: str = "parquet") -> list[str]:
    return [save_table(df, folder, name, fmt) for name, df in tables.items()]


def load_table(
    spark: SparkSession, folder: str, name: str, schema: T.StructType, fmt: str = "parquet", multi_line: bool = False
) -> DataFrame:
    """A written table; a missing one is empty and warned about.

    ``multi_line`` is for CSV with line breaks inside texts.
    """
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("escape", '"').option("multiLine", multi_line)
    try:
        return reader.format(fmt).load(f"{folder}/{name}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        warnings.warn(f"{name} not found in {folder}; run the analysis first", stacklevel=2)
        return spark.createDataFrame([], schema)


MANIFESTS = "manifests"


def save_run(spark: SparkSession, tables: Mapping[str, DataFrame], folder: str, fmt: str = "parquet") -> str:
    """Writes all ``tables`` as one run and returns its name; the run counts once its manifest is written.

    The manifest is one small JSON file, written by Spark to wherever ``folder`` is, with the
    tables' rows and columns as they were read back. Names sort by time.
    """
    run = f"{dt.datetime.now(dt.timezone.utc):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"
    entries = []
    for name, df in tables.items():
        path = save_table(df, f"{folder}/{run}", name, fmt)
        rows = load_table(spark, f"{folder}/{run}", name, df.schema, fmt).count()
        entries.append((run, fmt, name, path, rows, json.dumps(df.columns, ensure_ascii=False)))
    columns = "run string, format string, name string, path string, rows long, columns string"
    spark.createDataFrame(entries, columns).coalesce(1).write.mode("append").json(f"{folder}/{MANIFESTS}")
    return run


def runs(spark: SparkSession, folder: str) -> list[str]:
    """The names of all complete runs, oldest first."""
    return sorted(r.run for r in _manifests(spark, folder).select("run").distinct().collect())


def _manifests(spark: SparkSession, folder: str) -> DataFrame:
    schema = "run string, format string, name string, path string, rows long, columns string"
    try:
        return spark.read.schema(schema).json(f"{folder}/{MANIFESTS}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def load_run(spark: SparkSession, folder: str, schemas: Mapping[str, T.StructType], run: str | None = None) -> dict[str, DataFrame]:
    """The tables of a complete run, by default of the newest one.

    Raises ``EmptyMaster`` if there is no such run or its SKU master is empty. A table that the run
    did not write is empty and warned about.
    """
    chosen = run or max(runs(spark, folder), default=None)
    entries = {r.name: r for r in _manifests(spark, folder).where(F.col("run") == F.lit(chosen)).collect()}
    if entries.get("sku_master") is None or not entries["sku_master"].rows:
        raise EmptyMaster(f"no complete run with a sku_master in {folder}")
    fmt = entries["sku_master"].format
    return {name: load_table(spark, f"{folder}/{chosen}", name, schema, fmt) for name, schema in schemas.items()}


def load_outputs(
    spark: SparkSession, folder: str, schemas: Mapping[str, T.StructType], fmt: str = "parquet"
) -> dict[str, DataFrame]:
    """All written tables; stops when there is no SKU master to report on."""
    tables = {name: load_table(spark, folder, name, schema, fmt) for name, schema in schemas.items()}
    if tables["sku_master"].isEmpty():
        raise EmptyMaster(f"sku_master in {folder} is empty")
    return tables
