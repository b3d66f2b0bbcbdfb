"""Runs a registered query on Spark and its SQL twin on DuckDB and compares the rows."""

from __future__ import annotations

import math
from decimal import Decimal

import duckdb

from flowspark.plans.fixtures import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)):
        v = float(v)
        return "nan" if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark_df, con, sql: str) -> str | None:
    """None if both results hold the same rows, else a short description."""
    names, got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    want_names, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if names != want_names:
        return f"columns differ: {set(names) ^ set(want_names)}"
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}; first {got[:1]} / {want[:1]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        g, w = bad[0]
        diff = [(names[i], a, x) for i, (a, x) in enumerate(zip(g, w)) if a != x]
        return f"{len(bad)} of {len(got)} rows differ: {diff[:4]}"
    return None
