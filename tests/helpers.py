"""Comparison of a query with its SQL in DuckDB."""

import datetime
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in sorted(os.listdir(sf_dir)):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if value != value else round(value, 7) + 0.0
    return value.isoformat() if isinstance(value, datetime.datetime) else value


def same_rows(df, con, sql: str) -> tuple[list, list]:
    """Both results as sorted rows of plain values, columns by name."""
    columns = sorted(df.columns)
    mine = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    rel = con.sql(sql)
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    theirs = [tuple(plain(r[i]) for i in at) for r in rel.fetchall()]
    return sorted(mine, key=repr), sorted(theirs, key=repr)
