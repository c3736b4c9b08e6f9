"""Comparison of a Spark result with the same query in DuckDB."""

from __future__ import annotations

import os

import duckdb

TABLES = ("nation", "customer", "part", "orders", "lineitem")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        path = os.path.join(sf_dir, f"{table}.parquet")
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _sortable(row: tuple) -> tuple:
    return tuple((v is None, str(type(v)), v) if v is not None else (True, "", "") for v in row)


def rows_by_name(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    picked = [tuple(row[i] for i in order) for row in rows]
    return [columns[i] for i in order], sorted(picked, key=_sortable)


def differences(spark_df, connection, sql: str) -> list[str]:
    """Empty when columns, row count and every value agree exactly."""
    spark_columns, spark_rows = rows_by_name(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    result = connection.execute(sql)
    duck_columns, duck_rows = rows_by_name([d[0] for d in result.description], result.fetchall())
    if spark_columns != duck_columns:
        return [f"columns {spark_columns} != {duck_columns}"]
    found = []
    if len(spark_rows) != len(duck_rows):
        found.append(f"rows {len(spark_rows)} != {len(duck_rows)}")
    for ours, theirs in zip(spark_rows, duck_rows):
        if ours != theirs or [type(v) for v in ours] != [type(v) for v in theirs]:
            found.append(f"{ours} != {theirs}")
            if len(found) > 4:
                break
    return found
