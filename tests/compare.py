"""Run a query and its SQL side by side and compare rows, names, types and values."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TYPES = {
    "string": "VARCHAR",
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "date": "DATE",
    "boolean": "BOOLEAN",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def _sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def spark_result(df):
    types = {f.name: TYPES[f.dataType.simpleString()] for f in df.schema}
    return dict(sorted(types.items())), _sorted_rows(df.columns, [tuple(r) for r in df.collect()])


def duckdb_result(connection, sql):
    cursor = connection.execute(sql)
    types = {d[0]: str(d[1]) for d in cursor.description}
    return dict(sorted(types.items())), _sorted_rows(list(types), cursor.fetchall())
