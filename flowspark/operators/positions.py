"""Positions in a global order: range partitions, a count per range, prefix sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowspark.operators.lookups import few
from flowspark.session import materialize

# the lower bits of a row's number count inside its range, the others number the range
_WITHIN = 33


def ordered(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``df`` stored in ranges of the order, which must be total, with ``__no``: range and place inside it."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(ranged.withColumn("__no", F.monotonically_increasing_id()), "ordered")


def range_starts(stored: DataFrame) -> DataFrame:
    """(part, start, n) per range: one row per written partition, so the window over them is small."""
    sizes = stored.groupBy(F.shiftright("__no", _WITHIN).alias("part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))


def with_position(df: DataFrame, order: Sequence[Column], out: str = "position") -> DataFrame:
    """Add the 0-based position of each row in a total order, without numbering rows in one task."""
    stored = ordered(df, order)
    starts = few(range_starts(stored)).select(F.col("part").alias("__part"), F.col("start").alias("__start"))
    placed = stored.join(starts, F.shiftright("__no", _WITHIN) == F.col("__part"))
    within = F.col("__no").bitwiseAND(F.lit((1 << _WITHIN) - 1))
    return placed.select(*[F.col(f"`{x}`") for x in df.columns], (F.col("__start") + within).alias(out))


def rows_at(df: DataFrame, order: Sequence[Column], positions: Sequence[float]) -> list:
    """The rows at the given fractions of a total order (position ``int(f * n)``); None behind the last row.

    ``df`` is stored once, narrow, then in order; the ranges are counted, and only the stored blocks that
    hold a wanted row are read again.
    """
    stored = ordered(df, order)
    ranges = range_starts(stored).orderBy("part").collect()
    n = sum(r.n for r in ranges)
    wanted = [int(f * n) for f in positions]
    numbers = [next(((r.part << _WITHIN) + at - r.start for r in ranges if r.start <= at < r.start + r.n), None)
               for at in wanted]
    known = [x for x in numbers if x is not None]
    found = {r["__no"]: r for r in stored.filter(F.col("__no").isin(known)).collect()} if known else {}
    return [found[x] if x is not None else None for x in numbers]


def order_cuts(df: DataFrame, order: Column, tie: Column, fractions: Sequence[float]) -> DataFrame:
    """One row with the cut keys of a split by position, without ranking the rows.

    For the ordering (``order``, ``tie``), both BIGINT and the pair unique, fraction i of n rows ends before the
    key (``cut_i``, ``tie_i``): the row at position ``int(f * n)``. The key is NULL when the cut lies behind the
    last row. Reads ``df`` once, for two columns; runs when it is called.
    """
    keyed = materialize(df.select(order.alias("o"), tie.alias("t")), "keys")
    rows = rows_at(keyed, [F.col("o"), F.col("t")], fractions)
    columns = [x for i in range(len(fractions)) for x in (f"cut_{i}", f"tie_{i}")]
    values = tuple(v for r in rows for v in ((None, None) if r is None else (r.o, r.t)))
    return df.sparkSession.createDataFrame([values], ", ".join(f"{x} bigint" for x in columns))
