"""Query registry: a key, a DataFrame builder and, where SQL can say it, the SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if key in QUERIES:
            raise KeyError(f"query {key} registered twice")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn
    return add


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Round the named columns (all DOUBLE columns if none is named)."""
    names = columns or [f.name for f in df.schema.fields if f.dataType.simpleString() == "double"]
    return df.withColumns({x: F.round(F.col(f"`{x}`"), digits) for x in names})


def b(x: Column) -> Column:
    return x.cast("bigint")
