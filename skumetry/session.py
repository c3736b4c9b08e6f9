"""Session construction and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app_name: str, cores: int = 8, shuffle_partitions: int | None = None) -> SparkSession:
    """A ``local[n]`` session for tests and benchmarks; clusters bring their own.

    Tables on the way go to a temporary folder, which one machine shares with itself.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix=f"{app_name}-"))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_path(session: SparkSession, kind: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names; every session has to name one."""
    folder = session.conf.get("spark.checkpoint.dir", None) or session.sparkContext.getCheckpointDir()
    if folder is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return f"{folder}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again, columns as they are needed.

    What follows depends on these files, not on executors that may be lost.
    """
    session = df.sparkSession
    path = shared_path(session, "written")
    df.write.parquet(path)
    return session.read.schema(df.schema).parquet(path)
