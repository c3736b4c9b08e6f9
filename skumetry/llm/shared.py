"""Intermediate tables in the folder that every executor shares."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Bytes of rows that go to a Python worker at a time, about; one longer row goes alone.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 1 << 20

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Gives the Python workers of the session's executors this package, once an application."""
    application = spark.sparkContext.applicationId
    if application not in _SHIPPED:
        package = Path(__file__).resolve().parents[1]
        archive = os.path.join(tempfile.mkdtemp(prefix="skumetry-code-"), "skumetry_code.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted(package.rglob("*.py")):
                out.write(file, file.relative_to(package.parent))
        spark.sparkContext.addPyFile(archive)
        _SHIPPED.add(application)


def shipped(run: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``run``, whose first argument is the session, with this package on the executors."""

    @functools.wraps(run)
    def with_package(spark: SparkSession, *args):
        ship_package(spark)
        return run(spark, *args)

    return with_package


def in_small_batches(run: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``run``, whose first argument is the session, with Arrow batches of about ``BATCH_BYTES`` of rows.

    Spark's own bound of 10,000 rows lets a batch hold all texts of a task, in the executor and again
    in its Python worker. A bound on bytes that the session already has stays.
    """

    @functools.wraps(run)
    def bounded(spark: SparkSession, *args):
        if spark.conf.get(BATCH_SETTING, None) is None:
            spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
        return run(spark, *args)

    return bounded


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Only a one-machine ``local[...]`` session without that setting, as in tests, gets a
    temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="skumetry-llm-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    This cuts the lineage: later steps depend on files, not on executors that may be lost,
    and nothing upstream is computed twice.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``stored`` wrote and whose successors are written."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.stored_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
