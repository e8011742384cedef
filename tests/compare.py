"""Compare a registered query with its SQL on DuckDB."""

from __future__ import annotations

import glob
import math
import os

import duckdb

TESTDATA = os.environ.get("TESTDATA", "/root/testdata")


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def canonical(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(canonical(row[i]) for i in order) for row in rows), key=lambda r: repr(r)
    )


def spark_rows(df):
    return sorted(df.columns), rows_of(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(connection, sql):
    cursor = connection.execute(sql)
    columns = [d[0] for d in cursor.description]
    return sorted(columns), rows_of(columns, cursor.fetchall())


def type_names(df, connection, sql):
    spark_types = {n: t for n, t in df.dtypes}
    duck_types = {r[0]: r[1] for r in connection.execute(f"DESCRIBE {sql}").fetchall()}
    return spark_types, duck_types
