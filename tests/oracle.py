"""Compares a query with its SQL in DuckDB."""

import math
from pathlib import Path

import duckdb


def connection(sf_dir):
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in rows)


def compare(df, con, sql):
    """Names of columns and rows of both sides."""
    rel = con.sql(sql)
    mine, theirs = sorted(df.columns), sorted(rel.columns)
    return (mine, rows_of(df.columns, df.collect())), (theirs, rows_of(rel.columns, rel.fetchall()))
