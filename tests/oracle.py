"""Runs queries beside their SQL in DuckDB."""

from __future__ import annotations

import os
from pathlib import Path

import duckdb

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def tables(folder: str = FOLDER) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for path in Path(folder).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}{'/**/*.parquet' if path.is_dir() else ''}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if value != value else round(value, 6)
    if isinstance(value, list | tuple):
        return tuple(map(plain, value))
    return value


def rows_of(columns: list[str], rows) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str([plain(row[i]) for i in order]) for row in rows)


def compare(spark, query, sql: str, folder: str = FOLDER) -> int:
    """The number of rows, which must be those of the SQL."""
    df = query(spark, folder)
    want = tables(folder).sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    got, expected = rows_of(df.columns, df.collect()), rows_of(want.columns, want.fetchall())
    assert got == expected, ([x for x in got if x not in expected][:3], [x for x in expected if x not in got][:3])
    return len(got)
