"""Benchmark analytics over timing and resource series."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.functions.scalar import safe_div
from flowspark.operators.actions import relative_time
from flowspark.operators.lookups import FEW_ROWS, lookup
from flowspark.operators.quantiles import quantile_row
from flowspark.operators.sampling import first_per_group
from flowspark.session import materialize

# --- fixed values: timed stages of a batch ---
STAGES = ["read", "preprocess", "inference", "postprocess", "log"]

# --- fixed values: scaling metrics, and whether a higher value wins ---
SCALING_METRICS = {
    "rows_per_s": True,
    "batch_avg_ms": False,
    "lat_per_inf_ms": False,
    "inf_avg_ms": False,
    "preprocess_avg_ms": False,
    "batch_p95_ms": False,
    "cpu_proc_avg": False,
    "rss_mb": False,
}


def drop_warmup(df: DataFrame, run: Sequence[str], order: Sequence[str], n: int,
                skip_short_runs: bool = False) -> DataFrame:
    """Drop the first ``n`` rows of every run that has more than ``n``.

    Shorter runs stay whole, or vanish with ``skip_short_runs``. Only the first rows of a
    run are ranked; the others are compared with the key at the cut. The cuts are found once, when
    this is called; those of a few runs are broadcast, those of many joined plainly.
    """
    key = F.struct(*[F.col(x) for x in order])
    head = first_per_group(df.select(*run, *[F.col(x) for x in order]), run,
                           [F.col(x) for x in order], n + 1)
    cuts = materialize(head.groupBy(*run).agg(F.max(F.when(F.col("rn") == n + 1, key)).alias("__cut")), "cuts")
    kept = lookup(df, cuts, run, "inner", small=cuts.count() <= FEW_ROWS)
    reached = F.col("__cut").isNotNull() & (key >= F.col("__cut"))
    rule = reached if skip_short_runs else reached | F.col("__cut").isNull()
    return kept.filter(rule).drop("__cut")


def stage_latency(timing: DataFrame, variants: Sequence[str] = ("cpu", "npu")) -> DataFrame:
    """Mean milliseconds per stage and variant, with the ratio of the second to the first."""
    names = [*STAGES, "total"]
    means = timing.groupBy("variant").agg(*[F.avg(f"t_{s}_ms").alias(s) for s in names])
    a, b = variants
    wide = means.unpivot("variant", names, "stage", "ms") \
        .groupBy("stage").pivot("variant", [a, b]).agg(F.max("ms"))
    ratio = F.when(F.col(a) > 0, F.col(b) / F.col(a))
    return wide.withColumn("ratio", ratio)


def timing_stats(timing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, batches, throughput, latency means and exact percentiles per run."""
    base = timing.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_batches"), F.sum("n_rows").cast("bigint").alias("total_rows"),
        safe_div(F.sum("n_rows"), F.sum("t_total_ms") / 1000.0).alias("rows_per_s"),
        safe_div(F.avg("t_inference_ms"), F.avg("n_rows")).alias("lat_per_inf_ms"),
        F.avg("t_total_ms").alias("batch_avg_ms"),
        F.avg("t_inference_ms").alias("inf_avg_ms"),
        F.avg("t_preprocess_ms").alias("preprocess_avg_ms"),
        F.avg("t_postprocess_ms").alias("postprocess_avg_ms"),
        F.avg("t_log_ms").alias("log_avg_ms"),
        us_per_row(F.col("t_total_ms"), F.col("n_rows")).alias("us_per_row"))
    tails = quantile_row(timing, {
        "batch_p50_ms": ("t_total_ms", 0.5), "batch_p95_ms": ("t_total_ms", 0.95),
        "batch_p99_ms": ("t_total_ms", 0.99), "inf_p95_ms": ("t_inference_ms", 0.95)}, keys)
    return base.join(tails, list(keys))


def us_per_row(total_ms: Column, n_rows: Column) -> Column:
    return F.sum(total_ms) * 1000 / F.sum(n_rows)


def resource_stats(resources: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean and peak CPU, memory and temperature; blank temperatures are ignored."""
    aggs = [F.count(F.lit(1)).alias("n_samples")]
    for column, name in (("cpu_total_pct", "cpu_total"), ("cpu_proc_pct", "cpu_proc"),
                         ("rss_mb", "rss"), ("temp_c", "temp")):
        aggs += [F.avg(column).alias(f"{name}_avg"), F.max(column).alias(f"{name}_max")]
    return resources.groupBy(*keys).agg(*aggs)


def core_columns(df: DataFrame) -> list[str]:
    """Columns ``core<i>_pct`` by core number."""
    found = {int(m[1]): x for x in df.columns if (m := re.fullmatch(r"core(\d+)_pct", x))}
    return [found[i] for i in sorted(found)]


def per_core(resources: DataFrame, keys: Sequence[str], first: int | None = None) -> DataFrame:
    """Mean percent per core, one row per core; ``first`` limits the cores reported."""
    cores = core_columns(resources)[:first]
    return resources.groupBy(*keys).agg(*[F.avg(x).alias(x) for x in cores]) \
        .unpivot(list(keys), cores, "core", "avg_pct")


def run_summary(timing: DataFrame, resources: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Throughput, latency, CPU, cores used and top temperature per run."""
    n_cores = len(core_columns(resources))
    use = resource_stats(resources, keys).select(
        *keys, "cpu_proc_avg", (F.col("cpu_proc_avg") / 100).alias("cores_used"),
        F.lit(n_cores).alias("n_cores"), "temp_max")
    base = timing.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_batches"),
        safe_div(F.sum("n_rows"), F.sum("t_total_ms") / 1000.0).alias("rows_per_s"),
        F.avg("t_total_ms").alias("batch_avg_ms"))
    return base.join(use, list(keys), "full")


def pair_variants(stats: DataFrame, by: str, values: Sequence[str],
                  variants: Sequence[str] = ("cpu", "npu")) -> DataFrame:
    """Statistics of both variants side by side: ``<value>_<variant>``."""
    return stats.groupBy(by).agg(*[
        F.max(F.when(F.col("variant") == v, F.col(x))).alias(f"{x}_{v}")
        for x in values for v in variants])


def efficiency_gain(summary: DataFrame, by: str = "batch_size",
                    variants: Sequence[str] = ("cpu", "npu")) -> DataFrame:
    """Change of the second variant against the first, percent (temperature in degrees)."""
    a, b = variants
    wide = pair_variants(summary, by, ["batch_avg_ms", "cpu_proc_avg", "rows_per_s", "temp_max"],
                         variants)

    def change(x: str) -> Column:
        base = F.col(f"{x}_{a}")
        return F.try_divide(F.col(f"{x}_{b}") - base, base) * 100

    return wide.select(
        by, change("batch_avg_ms").alias("d_latency_pct"), change("cpu_proc_avg").alias("d_cpu_pct"),
        (F.coalesce(f"temp_max_{b}", F.lit(0)) - F.coalesce(f"temp_max_{a}", F.lit(0)))
        .alias("d_temp_c"), change("rows_per_s").alias("d_throughput_pct"))


def scaling_pivot(timing: DataFrame, resources: DataFrame, by: str = "batch_size",
                  variants: Sequence[str] = ("cpu", "npu")) -> DataFrame:
    """Long scaling table: metric, batch size, both values, winner (NULL on a tie).

    ``resources`` must already be without its warm-up rows.
    """
    keys = ["variant", by]
    stats = timing_stats(timing, keys).join(
        resources.groupBy(*keys).agg(F.avg("cpu_proc_pct").alias("cpu_proc_avg"),
                                     F.avg("rss_mb").alias("rss_mb")), keys, "left")
    a, b = variants
    long = stats.unpivot(keys, list(SCALING_METRICS), "metric", "value") \
        .groupBy("metric", by).pivot("variant", [a, b]).agg(F.max("value"))
    higher = F.col("metric").isin([m for m, up in SCALING_METRICS.items() if up])
    better_a = F.when(higher, F.col(a) > F.col(b)).otherwise(F.col(a) < F.col(b))
    better_b = F.when(higher, F.col(b) > F.col(a)).otherwise(F.col(b) < F.col(a))
    return long.withColumn("winner", F.when(better_a, F.lit(a)).when(better_b, F.lit(b)))


def wall_throughput(wall: DataFrame, rows: Column) -> DataFrame:
    """Rows per wall second, cut (not rounded) to one decimal."""
    return wall.withColumn("rows_per_wall_s",
                           F.floor(safe_div(rows, F.col("wall_s")) * 10) / 10)


def histogram(df: DataFrame, value: str, keys: Sequence[str], bins: int = 50) -> DataFrame:
    """Counts in ``bins`` equal bins between each group's extremes; the top edge is inclusive."""
    ends = df.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    joined = lookup(df, ends, keys, "inner", small=True)
    width = F.col("hi") - F.col("lo")
    # a group with a single value falls into the middle bin
    share = F.when(width == 0, F.lit(0.5)).otherwise(F.try_divide(F.col(value) - F.col("lo"), width))
    number = F.least(F.floor(share * bins), F.lit(bins - 1)).cast("int")
    return joined.groupBy(*keys, number.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.max("lo").alias("lo"), F.max("hi").alias("hi"))


def time_series(resources: DataFrame, keys: Sequence[str], ts: str,
                values: Sequence[str]) -> DataFrame:
    """Samples against seconds since the start of their run."""
    return relative_time(resources, keys, ts).select(*keys, "t_rel", *values)


def efficiency_points(timing: DataFrame, resources: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One (mean process CPU, rows per second) point per run."""
    return run_summary(timing, resources, keys).select(*keys, "cpu_proc_avg", "rows_per_s")


def stacked_stages(timing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean stage times per run with the running height of the stack below each stage."""
    stages = ["preprocess", "inference", "postprocess", "log"]
    means = timing.groupBy(*keys).agg(*[F.avg(f"t_{s}_ms").alias(s) for s in stages])
    below, parts = F.lit(0.0), []
    for i, s in enumerate(stages):
        parts.append(F.struct(F.lit(s).alias("stage"), F.col(s).alias("ms"), below.alias("bottom")))
        below = below + F.col(s)
    return means.select(*keys, F.explode(F.array(*parts)).alias("p")).select(*keys, "p.*")


def best_per_group(df: DataFrame, keys: Sequence[str], score: str, tie: str,
                   out: str = "is_best") -> DataFrame:
    """Mark the row with the highest score of each group; the lowest ``tie`` wins ties."""
    best = df.groupBy(*keys).agg(
        F.max_by(tie, F.struct(F.col(score), -F.col(tie))).alias("__best"))
    return lookup(df, best, keys, "inner", small=True).withColumn(out, F.col(tie) == F.col("__best")) \
        .drop("__best")
