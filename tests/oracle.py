"""Comparison of a DataFrame with the rows of its SQL twin in DuckDB."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import os

import duckdb


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        inner = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{inner}')")
    return con


def cell(x):
    """A value in a form that sorts and compares: numbers to ten significant digits."""
    if isinstance(x, (bool, type(None), str)):
        return repr(x)
    if isinstance(x, (int, float, decimal.Decimal)):
        return repr(None) if x != x else f"{float(x) + 0.0:.10g}"
    if isinstance(x, dt.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (list, tuple)):
        return str([cell(y) for y in x])
    return str(x)


def both(frame, sql: str, con) -> tuple[list, list]:
    names = sorted(frame.columns)
    ours = sorted(tuple(cell(r[c]) for c in names) for r in frame.collect())
    got = con.execute(sql)
    at = [[d[0] for d in got.description].index(c) for c in names]
    assert len(got.description) == len(names), f"{[d[0] for d in got.description]} and {names}"
    return ours, sorted(tuple(cell(r[i]) for i in at) for r in got.fetchall())
