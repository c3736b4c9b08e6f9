"""Small constant tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def inline_table(spark: SparkSession, schema: dict[str, pa.DataType], rows: list[tuple]) -> DataFrame:
    """A literal table; the Arrow path makes it a local scan of known size."""
    arrow = pa.schema(list(schema.items()))
    columns = [pa.array([row[i] for row in rows], type=t) for i, t in enumerate(arrow.types)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=arrow))
