"""Joins against reference tables: membership, parameters and row alignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Most rows of a table that is declared to be small; more of them fail the query.
FEW_ROWS = 100_000


def few(table: DataFrame, limit: int = FEW_ROWS) -> DataFrame:
    """The table, marked for broadcast, with its row count checked while the query runs.

    For tables whose size does not follow the data (runs, classes, cuts). At most one row above
    the limit is ever gathered before the query fails.
    """
    counted = table.limit(limit + 1).withColumn("__rows", F.count(F.lit(1)).over(Window.partitionBy()))
    checked = counted.filter(F.when(F.col("__rows") <= limit, F.lit(True)).otherwise(F.raise_error(
        F.lit(f"a table declared small has more than {limit} rows")).cast("boolean")))
    return F.broadcast(checked.drop("__rows"))


def lookup(rows: DataFrame, table: DataFrame, on: Sequence[str], how: str = "left",
           small: bool = False) -> DataFrame:
    """Join ``rows`` to a table with one row per key. NULL is a key like any other.

    ``small`` declares a table that does not grow with the rows: it is broadcast, and its size
    checked at run time. Otherwise both sides are plain inputs of the join, so Spark picks the
    strategy and splits partitions of crowded keys.
    """
    on = list(on)
    renamed = table.withColumnsRenamed({x: f"__on_{x}" for x in on})
    if small:
        renamed = few(renamed)
    same = [rows[f"`{x}`"].eqNullSafe(renamed[f"`__on_{x}`"]) for x in on]
    return rows.join(renamed, same, how).drop(*[f"__on_{x}" for x in on])


def flag_members(rows: DataFrame, members: DataFrame, key: str, out: str) -> DataFrame:
    """Add ``out`` = whether ``rows.key`` occurs in the one-column table ``members``."""
    table = members.select(F.col(members.columns[0]).alias(key)).dropna().distinct() \
                   .withColumn(out, F.lit(True))
    return lookup(rows, table, [key]) \
        .withColumn(out, F.coalesce(F.col(out), F.lit(False)))


def exclude_members(rows: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in ``members``; a NULL key is kept."""
    return flag_members(rows, members, key, "__member").filter(~F.col("__member")) \
        .drop("__member")


def class_names(rows: DataFrame, names: Sequence[str] | None, idx: str, out: str,
                width: int | None = None) -> DataFrame:
    """Class index to name; ``class_<i>`` where no name is known. Names beyond ``width`` are cut."""
    fallback = F.concat(F.lit("class_"), F.col(idx).cast("string"))
    if not names:
        return rows.withColumn(out, fallback)
    known = F.array(*[F.lit(n) for n in list(names)[:width]])
    return rows.withColumn(out, F.coalesce(F.try_element_at(known, (F.col(idx) + 1).cast("int")),
                                           fallback))


def with_single_row(rows: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row table (an ungrouped aggregate) to every row."""
    return rows.crossJoin(F.broadcast(one_row))


def align_by_row(truth: DataFrame, predictions: DataFrame, row_id: str = "row_index") -> DataFrame:
    """Truth and prediction of the same row, by identifier and never by position."""
    return truth.join(predictions, row_id)


def agreement(rows: DataFrame, prob_a: str, prob_b: str, threshold_a: float,
              threshold_b: float = 0.5) -> DataFrame:
    """How often two models decide alike: rows, agreeing rows, percent."""
    same = (F.col(prob_a) >= threshold_a) == (F.col(prob_b) >= threshold_b)
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(same).alias("agree")).select(
        "n_rows", "agree",
        F.round(F.lit(100.0) * F.col("agree") / F.greatest(F.col("n_rows"), F.lit(1)), 2)
        .alias("agree_pct"))
