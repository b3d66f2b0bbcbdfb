"""Cleaning, imputation, scaling parameters and value profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.contract import CLIP_LIMIT
from flowspark.functions.scalar import (
    c, clip, quoted, replace_columns, sql_clean, sql_finite, sql_text,
)
from flowspark.operators.lookups import with_single_row
from flowspark.operators.quantiles import medians


def nonfinite_to_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return replace_columns(df, {x: sql_finite(x) for x in columns})


def nonfinite_to_zero(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return replace_columns(df, {x: f"coalesce({sql_finite(x)}, 0D)" for x in columns})


def clip_columns(df: DataFrame, columns: Sequence[str], limit: float = CLIP_LIMIT) -> DataFrame:
    return df.withColumns({x: clip(c(x), limit) for x in columns})


def clean_columns(df: DataFrame, columns: Sequence[str],
                  limit: float | None = CLIP_LIMIT) -> DataFrame:
    """Non-finite to NULL, then clip; ``limit=None`` skips the clip, as training does."""
    return replace_columns(df, {x: sql_clean(x, limit) for x in columns})


def impute_median(df: DataFrame, columns: Sequence[str], mode: str = "global",
                  batch: Sequence[str] = (), fixed: DataFrame | None = None) -> DataFrame:
    """Fill NULLs with a column median, then 0.

    ``global``     exact median over all rows; one row of medians is broadcast.
    ``per_batch``  median inside each batch of bounded size (columns ``batch``).
    ``fixed``      medians from a one-row table fitted earlier; the only mode for streams.
    """
    if mode == "per_batch":
        inside = "PARTITION BY " + ", ".join(quoted(x) for x in batch)
        return replace_columns(df, {
            x: f"coalesce({quoted(x)}, median({quoted(x)}) OVER ({inside}), 0D)" for x in columns})
    table = medians(df, columns) if mode == "global" else fixed
    if table is None:
        raise ValueError("mode 'fixed' needs a table of medians")
    joined = with_single_row(df, median_array(table, columns))
    filled = replace_columns(joined, {
        x: f"coalesce({quoted(x)}, get(__medians, {i}), 0D)" for i, x in enumerate(columns)})
    return filled.drop("__medians")


def median_array(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One-row table of medians as one array column ``__medians`` in the given order."""
    values = ", ".join(f"CAST({quoted(x)} AS DOUBLE)" for x in columns)
    return table.selectExpr(f"array({values}) AS __medians")


def column_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact medians of the cleaned columns, one row; input of the ``fixed`` imputation."""
    return medians(clean_columns(df, columns), columns)


def fit_scaler(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and population deviation per feature (``idx, feature, mean, scale``), 0 read as 1."""
    rows = ", ".join(
        f"struct({i} AS idx, {sql_text(x)} AS feature, avg({quoted(x)}) AS mean, "
        f"if(stddev_pop({quoted(x)}) = 0, 1D, stddev_pop({quoted(x)})) AS scale)"
        for i, x in enumerate(columns))
    return df.agg(F.expr(f"array({rows})").alias("rows")) \
        .select(F.explode("rows").alias("r")).select("r.*")


def params_row(params: DataFrame, features: Sequence[str]) -> DataFrame:
    """Parameter table (one row per feature) as one row with arrays ``__mean``, ``__scale`` in feature order.

    Rows are found by ``feature``. Stored flags ``with_mean`` and ``with_std`` that are false turn
    their step off; ``n_features_in``, where stored, must be the number of features.
    """
    known = set(params.columns)
    flag = lambda x: F.coalesce(F.col(x), F.lit(True)) if x in known else F.lit(True)
    width = F.max("n_features_in") if "n_features_in" in known else F.lit(None).cast("int")
    one = params.agg(
        F.map_from_entries(F.collect_list(F.struct("feature", F.struct(
            F.when(flag("with_mean"), F.col("mean")).otherwise(0.0).alias("mean"),
            F.when(flag("with_std"), F.col("scale")).otherwise(1.0).alias("scale"))))).alias("p"),
        F.count(F.lit(1)).alias("n"), width.alias("width"))
    names = F.array(*[F.lit(x) for x in features])
    missing = F.array_except(names, F.map_keys("p"))
    wrong = (F.col("n") != len(features)) | (F.coalesce("width", F.lit(len(features))) != len(features))
    problem = F.when(F.size(missing) > 0, F.concat(F.lit("no scaling parameters for: "), F.array_join(missing, ", "))) \
        .when(wrong, F.concat(F.lit("scaling parameters for "), F.coalesce("width", "n").cast("string"),
                              F.lit(f" features, the table has {len(features)}")))
    checked = one.select(F.when(problem.isNull(), F.transform(names, lambda f: F.col("p")[f])).otherwise(
        F.raise_error(problem)).alias("p"))
    return checked.select(F.col("p.mean").alias("__mean"), F.col("p.scale").alias("__scale"))


def sql_scaled(value: str, i: int, with_mean: bool = True, with_std: bool = True) -> str:
    """SQL text: ``value`` scaled with entry ``i`` of ``__mean`` and ``__scale``."""
    out = f"({value} - get(__mean, {i}))" if with_mean else value
    return f"({out} / if(get(__scale, {i}) = 0, 1D, get(__scale, {i})))" if with_std else out


def apply_scaler(df: DataFrame, columns: Sequence[str], params: DataFrame,
                 with_mean: bool = True, with_std: bool = True) -> DataFrame:
    """Standard-scale the columns with fitted parameters (one broadcast row)."""
    joined = with_single_row(df, params_row(params, columns))
    return replace_columns(joined, {x: sql_scaled(quoted(x), i, with_mean, with_std)
                                    for i, x in enumerate(columns)}).drop("__mean", "__scale")


def invalid_value_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: missing or NaN, +Inf and -Inf counts, and whether any occurs."""
    def entry(x: str) -> str:
        v = f"CAST({quoted(x)} AS DOUBLE)"
        return (f"struct({sql_text(x)} AS name, count_if({v} IS NULL OR isnan({v})) AS n_nan, "
                f"count_if({v} = double('Infinity')) AS n_pos_inf, "
                f"count_if({v} = double('-Infinity')) AS n_neg_inf)")
    rows = df.agg(F.expr(f"array({', '.join(entry(x) for x in columns)})").alias("rows"))
    return rows.select(F.explode("rows").alias("r")).select("r.*").withColumn(
        "bad", F.col("n_nan") + F.col("n_pos_inf") + F.col("n_neg_inf") > 0)


def all_finite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: whether every value of the columns is present and finite."""
    good = " AND ".join(f"({sql_finite(x)}) IS NOT NULL" for x in columns)
    return df.agg(F.expr(f"coalesce(bool_and({good}), true)").alias("all_finite"),
                  F.count(F.lit(1)).alias("n_rows"))


def coerce_time(df: DataFrame, column: str, out: str | None = None,
                fmt: str | None = None) -> DataFrame:
    """Text to timestamp, NULL where it cannot be read."""
    parsed = F.try_to_timestamp(c(column), F.lit(fmt)) if fmt else F.try_to_timestamp(c(column))
    return df.withColumn(out or column, parsed)


def drop_invalid_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows with a usable label; blank, NULL and ``nan`` labels are dropped."""
    text = F.upper(F.trim(F.coalesce(c(label).cast("string"), F.lit("nan"))))
    return df.filter(~text.isin("", "NAN"))


def calibration_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Shape, range, mean and population deviation over all values of a scaled sample."""
    values = df.select(F.explode(F.array(*[c(x).cast("double") for x in columns])).alias("v"))
    stats = values.agg(F.count(F.lit(1)).alias("n_values"), F.min("v").alias("min"),
                       F.max("v").alias("max"), F.avg("v").alias("mean"),
                       F.stddev_pop("v").alias("std"))
    width = len(columns)
    return stats.select((F.col("n_values") / width).cast("bigint").alias("n_rows"),
                        F.lit(width).alias("n_features"), "min", "max", "mean", "std")
