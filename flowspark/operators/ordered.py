"""Order-dependent operators that stay parallel inside one key.

``lag`` and running sums over ``partitionBy(key)`` put a whole key into one task, and
one flow or one stream may hold a large share of all rows. The operators here cut the
order of a key into *chunks* of bounded size, work inside the chunks, and carry only one
row per chunk across the borders.

The bound is by construction: the order column is a unique integer (an arrival number),
so a chunk of ``chunk_rows`` consecutive numbers holds at most that many rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowspark.operators.lookups import lookup

CHUNK_ROWS = 1 << 20


def chunk_of(order_col: str, chunk_rows: int = CHUNK_ROWS) -> Column:
    return F.floor(F.col(order_col) / F.lit(chunk_rows)).cast("bigint")


def lag_in_order(df: DataFrame, keys: Sequence[str], order_col: str, value: str, out: str,
                 chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``out`` = previous ``value`` of the same key in ``order_col`` order."""
    keys = list(keys)
    chunked = df.withColumn("__chunk", chunk_of(order_col, chunk_rows))
    # last value of every chunk: map-side combined, one row per (key, chunk)
    tails = chunked.groupBy(*keys, "__chunk").agg(F.max_by(value, order_col).alias("__tail"))
    over_chunks = Window.partitionBy(*keys).orderBy("__chunk")
    previous = tails.select(*keys, "__chunk", F.lag("__tail").over(over_chunks).alias("__prev"))
    inside = Window.partitionBy(*keys, "__chunk").orderBy(order_col)
    lagged = chunked.withColumns({
        "__lag": F.lag(value).over(inside),
        "__first": F.row_number().over(inside) == 1,
    })
    joined = lookup(lagged, previous, [*keys, "__chunk"])
    return joined.withColumn(
        out, F.when(F.col("__first"), F.col("__prev")).otherwise(F.col("__lag"))
    ).select(*df.columns, out)


def running(df: DataFrame, keys: Sequence[str], order_col: str,
            exprs: dict[str, tuple[str, Column]], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add inclusive running aggregates per key, in ``order_col`` order.

    ``exprs`` maps an output name to ``("sum" | "max", integer expression)``. The rows keep
    their ``__chunk`` column and its partitioning, so several calls share one shuffle; drop it
    when done. A running maximum is NULL until the first non-NULL value.
    """
    keys = list(keys)
    folds = {"sum": F.sum, "max": F.max}
    if "__chunk" not in df.columns:
        df = df.withColumn("__chunk", chunk_of(order_col, chunk_rows))
    part = {name: f"__part_{name}" for name in exprs}
    valued = df.withColumns({part[name]: e.cast("bigint") for name, (_, e) in exprs.items()})
    totals = valued.groupBy(*keys, "__chunk").agg(
        *[folds[kind](part[name]).alias(part[name]) for name, (kind, _) in exprs.items()])
    before = Window.partitionBy(*keys).orderBy("__chunk") \
                   .rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, "__chunk", *[
        folds[kind](part[name]).over(before).alias(f"__carry_{name}")
        for name, (kind, _) in exprs.items()])
    inside = Window.partitionBy(*keys, "__chunk").orderBy(order_col) \
                   .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = valued.withColumns({f"__local_{name}": folds[kind](part[name]).over(inside)
                                for name, (kind, _) in exprs.items()})
    joined = lookup(local, carried, [*keys, "__chunk"])
    out = []
    for name, (kind, _) in exprs.items():
        here, carry = F.col(f"__local_{name}"), F.col(f"__carry_{name}")
        both = F.coalesce(here, F.lit(0)) + F.coalesce(carry, F.lit(0)) if kind == "sum" \
            else F.greatest(here, carry)
        out.append(both.alias(name))
    return joined.select(*df.columns, *out)


def split_on_gaps(df: DataFrame, keys: Sequence[str], ts_col: str, timeout_us: int, out: str,
                  slice_us: int = 1_000_000) -> DataFrame:
    """Add ``out`` = 0-based segment number: a silence above ``timeout_us`` starts a new one.

    Time is cut into slices (a second by default) no longer than the timeout, so a segment never ends inside a
    slice: the segment number depends on (key, slice) alone. Slices are combined map-side
    to their first and last time, numbered, and looked up by the rows.
    """
    keys = list(keys)
    width = min(slice_us, timeout_us)
    sliced = df.withColumn("__slice", F.floor(F.col(ts_col) / F.lit(width)).cast("bigint"))
    segments = number_segments(
        sliced.groupBy(*keys, "__slice").agg(F.min(ts_col).alias("__from"),
                                             F.max(ts_col).alias("__to")),
        keys, timeout_us, out)
    return lookup(sliced, segments.select(*keys, "__slice", out), [*keys, "__slice"]) \
        .select(*df.columns, out)


def number_segments(slices: DataFrame, keys: Sequence[str], timeout_us: int, out: str,
                    gap: str = "__gap") -> DataFrame:
    """Segment number and gap before each slice; one row per (key, slice) in and out.

    A key has at most one row per slice, so the window holds (capture time / slice length)
    rows however many packets the key has.
    """
    over_slices = Window.partitionBy(*keys).orderBy("__slice")
    running = over_slices.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return slices.withColumn(gap, F.col("__from") - F.lag("__to").over(over_slices)) \
        .withColumn(out, F.sum(F.when(F.col(gap) > timeout_us, 1).otherwise(0)).over(running)
                    .cast("bigint"))
