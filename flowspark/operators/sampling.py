"""Sorting, splitting and reproducible sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowspark.contract import TRAIN_FRACTION, VALIDATION_FRACTION
from flowspark.functions.scalar import c, is_attack_label
from flowspark.operators.positions import order_cuts

LAST = 2**63 - 1
SALTS = 64


def seeded_key(seed: int, *ids: str) -> Column:
    """Reproducible pseudo-random text per row, the same in every engine that has md5."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[c(x).cast("string") for x in ids]))


def sort_by_time(df: DataFrame, ts: str, row_index: str) -> DataFrame:
    """Time order with unreadable times last; equal times keep their row order.

    A global sort splits its ranges on the pair, so one crowded instant is spread out too.
    """
    return df.orderBy(c(ts).asc_nulls_last(), c(row_index))


def time_cuts(df: DataFrame, ts_us: Column, row_index: str, train: float = TRAIN_FRACTION,
              validation: float = VALIDATION_FRACTION) -> DataFrame:
    """The two cut keys of a split by position in time order, unreadable times last."""
    order = F.coalesce(ts_us, F.lit(LAST)).cast("bigint")
    return order_cuts(df, order, c(row_index).cast("bigint"), [train, train + validation])


def time_split(df: DataFrame, ts_us: Column, row_index: str, train: float = TRAIN_FRACTION,
               validation: float = VALIDATION_FRACTION, out: str = "part",
               cuts: DataFrame | None = None) -> DataFrame:
    """Add ``out`` = train / validation / test by position in time order.

    Only the two cut keys are computed (or passed in), from a narrow copy of the order's columns; rows
    are compared with them, never ranked or sorted. ``row_index`` must be a unique BIGINT.
    """
    if cuts is None:
        cuts = time_cuts(df, ts_us, row_index, train, validation)
    key = F.struct(F.coalesce(ts_us, F.lit(LAST)).cast("bigint").alias("o"),
                   c(row_index).cast("bigint").alias("t"))

    def before(i: int) -> Column:
        cut = F.struct(F.col(f"cut_{i}").alias("o"), F.col(f"tie_{i}").alias("t"))
        return F.col(f"cut_{i}").isNull() | (key < cut)

    return df.crossJoin(F.broadcast(cuts)).withColumn(
        out, F.when(before(0), F.lit("train")).when(before(1), F.lit("validation"))
        .otherwise(F.lit("test"))).drop("cut_0", "cut_1", "tie_0", "tie_1")


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
                    salts: int | None = None, rank: str = "rn") -> DataFrame:
    """The first ``k`` rows of every group in the given (total) order, with their rank.

    Works in two rounds: first inside ``salts`` parts of each group, then over the at
    most ``salts * k`` survivors, so a group of any size is spread over the tasks. There are as many
    parts as the session has shuffle partitions, but ``SALTS`` at least.
    """
    if salts is None:
        salts = max(SALTS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    parts = Window.partitionBy(*keys, "__salt").orderBy(*order)
    whole = Window.partitionBy(*keys).orderBy(*order)
    survivors = salted.withColumn(rank, F.row_number().over(parts)).filter(F.col(rank) <= k)
    return survivors.withColumn(rank, F.row_number().over(whole)).filter(F.col(rank) <= k) \
        .drop("__salt")


def balanced_sample(df: DataFrame, file: str, row_id: str, label: str = "label",
                    per_file: int = 300, seed: int = 42) -> DataFrame:
    """Up to ``per_file`` attacks of each file and as many benign rows; files without attacks skipped.

    Rows without a label must be dropped before. The choice depends on seed and row id only.
    """
    flagged = df.withColumns({"__attack": is_attack_label(c(label)),
                              "__order": seeded_key(seed, row_id)})
    order = [F.col("__order"), c(row_id)]
    picked = first_per_group(flagged, [f"`{file}`", "__attack"], order, per_file, rank="__rn")
    # at most 2 * per_file rows of a file are left for this window
    n_attacks = F.sum("__attack").over(Window.partitionBy(c(file)))
    keep = (F.col("__attack") == 1) | (F.col("__rn") <= F.col("__n_attacks"))
    return picked.withColumn("__n_attacks", n_attacks) \
        .filter((F.col("__n_attacks") > 0) & keep).select(*[c(x) for x in df.columns])


def shuffle_rows(df: DataFrame, row_id: str, seed: int = 42) -> DataFrame:
    """Reproducible permutation as a distributed sort on a seeded key."""
    return df.orderBy(seeded_key(seed, row_id), c(row_id))


def sample_rows(df: DataFrame, row_id: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement; every task keeps at most ``n`` candidates."""
    return shuffle_rows(df, row_id, seed).limit(n)


def head_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    return df.orderBy(*[c(x) for x in order]).limit(n)


def dedup_files(files: DataFrame, name: str = "name", order: str = "ord") -> DataFrame:
    """First of equal file names in listing order."""
    rest = [x for x in files.columns if x != name]
    first = F.min_by(F.struct(*[c(x) for x in rest]), c(order)).alias("r")
    return files.groupBy(c(name)).agg(first).select(c(name), "r.*")
