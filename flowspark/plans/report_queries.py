"""Benchmark report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowspark.operators import reports as rp
from flowspark.operators.actions import relative_time
from flowspark.plans.fixtures import table, view, with_views
from flowspark.plans.registry import b, query, rounded
from flowspark.session import scratch_path
from flowspark.sources.tables import read_bench_runs

RUN = ["variant", "batch_size"]
T_ORDER = ["batch_idx", "l_partkey", "l_suppkey"]
R_ORDER = ["ts_epoch", "l_linenumber", "l_partkey", "l_suppkey"]


def timing(spark, sf):
    return view(spark, sf, "timing")


def resources(spark, sf):
    return view(spark, sf, "resources")


def warm_timing(spark, sf, n=5):
    return rp.drop_warmup(timing(spark, sf), RUN, T_ORDER, n)


def warm_resources(spark, sf, n=3, **kw):
    return rp.drop_warmup(resources(spark, sf), RUN, R_ORDER, n, **kw)


def _warm(name: str, order: list[str], n: int, out: str) -> str:
    w = f"PARTITION BY variant, batch_size"
    return f"""{out} AS (SELECT * EXCLUDE (rn, cnt) FROM (SELECT *,
  row_number() OVER ({w} ORDER BY {", ".join(order)}) AS rn, count(*) OVER ({w}) AS cnt FROM {name})
  WHERE rn > {n} OR cnt <= {n})"""


_WT = _warm("timing", T_ORDER, 5, "wt")
_WR = _warm("resources", R_ORDER, 3, "wr")


@query("drop_warmup", with_views("timing", f"""
WITH {_WT} SELECT variant, batch_size, batch_idx, l_partkey, l_suppkey FROM wt"""))
def drop_warmup(spark, sf):
    return warm_timing(spark, sf).select(*RUN, *T_ORDER)


# runs here are (supplier, day of week): many of them are shorter than the warm-up
_SHORT_RUN = ["l_suppkey", "variant", "batch_size", "n_rows"]


def _short(skip: bool) -> str:
    w = "PARTITION BY " + ", ".join(_SHORT_RUN)
    rule = "rn > 2" if skip else "rn > 2 OR cnt <= 2"
    return f"""SELECT {", ".join(_SHORT_RUN)}, batch_idx, l_partkey FROM (SELECT *,
  row_number() OVER ({w} ORDER BY batch_idx, l_partkey) AS rn, count(*) OVER ({w}) AS cnt FROM timing)
  WHERE {rule}"""


@query("drop_warmup_short_runs", with_views("timing", _short(False)))
def drop_warmup_short_runs(spark, sf):
    return rp.drop_warmup(timing(spark, sf), _SHORT_RUN, ["batch_idx", "l_partkey"], 2) \
        .select(*_SHORT_RUN, "batch_idx", "l_partkey")


@query("drop_warmup_skip_short", with_views("timing", _short(True)))
def drop_warmup_skip_short(spark, sf):
    return rp.drop_warmup(timing(spark, sf), _SHORT_RUN, ["batch_idx", "l_partkey"], 2, True) \
        .select(*_SHORT_RUN, "batch_idx", "l_partkey")


@query("stage_latency", with_views("timing", "WITH m AS (" + " UNION ALL ".join(
    f"""SELECT '{s}' AS stage, avg(t_{s}_ms) FILTER (variant = 'cpu') AS cpu,
avg(t_{s}_ms) FILTER (variant = 'npu') AS npu FROM timing""" for s in [*rp.STAGES, "total"])
    + """) SELECT stage, round(cpu, 6) AS cpu, round(npu, 6) AS npu,
round(CASE WHEN cpu > 0 THEN npu / cpu END, 6) AS ratio FROM m"""))
def stage_latency(spark, sf):
    return rounded(rp.stage_latency(timing(spark, sf)), 6)


def _stats_sql(source: str, keys: str = "variant, batch_size") -> str:
    return f"""SELECT {keys}, count(*) AS n_batches, CAST(sum(n_rows) AS BIGINT) AS total_rows,
sum(n_rows) / (sum(t_total_ms) / 1000.0) AS rows_per_s, avg(t_inference_ms) / avg(n_rows) AS lat_per_inf_ms,
avg(t_total_ms) AS batch_avg_ms, avg(t_inference_ms) AS inf_avg_ms, avg(t_preprocess_ms) AS preprocess_avg_ms,
avg(t_postprocess_ms) AS postprocess_avg_ms, avg(t_log_ms) AS log_avg_ms,
sum(t_total_ms) * 1000 / sum(n_rows) AS us_per_row,
quantile_cont(t_total_ms, 0.5) AS batch_p50_ms, quantile_cont(t_total_ms, 0.95) AS batch_p95_ms,
quantile_cont(t_total_ms, 0.99) AS batch_p99_ms, quantile_cont(t_inference_ms, 0.95) AS inf_p95_ms
FROM {source} GROUP BY {keys}"""


_STAT_NAMES = ["rows_per_s", "lat_per_inf_ms", "batch_avg_ms", "inf_avg_ms", "preprocess_avg_ms",
               "postprocess_avg_ms", "log_avg_ms", "us_per_row", "batch_p50_ms", "batch_p95_ms",
               "batch_p99_ms", "inf_p95_ms"]


@query("throughput", with_views("timing", f"""
WITH {_WT}, s AS ({_stats_sql("wt")}) SELECT variant, batch_size, n_batches, total_rows,
{", ".join(f"round({x}, 4) AS {x}" for x in _STAT_NAMES)} FROM s"""))
def throughput(spark, sf):
    return rounded(rp.timing_stats(warm_timing(spark, sf), RUN), 4)


@query("us_per_row", with_views("timing", """
SELECT variant, batch_size, round(sum(t_total_ms) * 1000 / sum(n_rows), 4) AS us_per_row
FROM timing GROUP BY 1, 2"""))
def us_per_row(spark, sf):
    return rounded(timing(spark, sf).groupBy(*RUN).agg(
        rp.us_per_row(F.col("t_total_ms"), F.col("n_rows")).alias("us_per_row")), 4)


_RES = ["cpu_total", "cpu_proc", "rss", "temp"]
_RES_COL = {"cpu_total": "cpu_total_pct", "cpu_proc": "cpu_proc_pct", "rss": "rss_mb", "temp": "temp_c"}


@query("resource_usage", with_views("resources", f"""
WITH {_WR} SELECT variant, batch_size, count(*) AS n_samples, {", ".join(
    f"round(avg({_RES_COL[x]}), 4) AS {x}_avg, round(max({_RES_COL[x]}), 4) AS {x}_max" for x in _RES)}
FROM wr GROUP BY 1, 2"""))
def resource_usage(spark, sf):
    return rounded(rp.resource_stats(warm_resources(spark, sf), RUN), 4)


@query("per_core", with_views("resources", f"WITH {_WR} " + " UNION ALL ".join(
    f"SELECT variant, batch_size, 'core{i}_pct' AS core, round(avg(core{i}_pct), 4) AS avg_pct "
    f"FROM wr GROUP BY 1, 2" for i in range(4))))
def per_core(spark, sf):
    return rounded(rp.per_core(warm_resources(spark, sf), RUN, 4), 4)


_SUMMARY = f"""{_WT}, {_WR},
t AS (SELECT variant, batch_size, count(*) AS n_batches,
        sum(n_rows) / (sum(t_total_ms) / 1000.0) AS rows_per_s, avg(t_total_ms) AS batch_avg_ms
      FROM wt GROUP BY 1, 2),
r AS (SELECT variant, batch_size, avg(cpu_proc_pct) AS cpu_proc_avg, max(temp_c) AS temp_max
      FROM wr GROUP BY 1, 2),
summary AS (SELECT * FROM t FULL JOIN r USING (variant, batch_size))"""


def summary(spark, sf):
    return rp.run_summary(warm_timing(spark, sf), warm_resources(spark, sf), RUN)


@query("run_summary", with_views("timing resources", f"""
WITH {_SUMMARY} SELECT variant, batch_size, n_batches, round(rows_per_s, 4) AS rows_per_s,
  round(batch_avg_ms, 4) AS batch_avg_ms, round(cpu_proc_avg, 4) AS cpu_proc_avg,
  round(cpu_proc_avg / 100, 4) AS cores_used, 4 AS n_cores, temp_max FROM summary"""))
def run_summary(spark, sf):
    return rounded(summary(spark, sf), 4, "rows_per_s", "batch_avg_ms", "cpu_proc_avg", "cores_used")


_PAIR = """pair AS (SELECT c.batch_size, c.batch_avg_ms AS lc, n.batch_avg_ms AS ln, c.cpu_proc_avg AS cc,
  n.cpu_proc_avg AS cn, c.rows_per_s AS rc, n.rows_per_s AS rn, c.temp_max AS tc, n.temp_max AS tn
  FROM summary c JOIN summary n USING (batch_size) WHERE c.variant = 'cpu' AND n.variant = 'npu')"""


@query("engine_pairing", with_views("timing resources", f"""
WITH {_SUMMARY}, {_PAIR} SELECT batch_size, round(rc, 4) AS rows_per_s_cpu, round(rn, 4) AS rows_per_s_npu,
  tc AS temp_max_cpu, tn AS temp_max_npu FROM pair"""))
def engine_pairing(spark, sf):
    return rounded(rp.pair_variants(summary(spark, sf), "batch_size", ["rows_per_s", "temp_max"]), 4,
                   "rows_per_s_cpu", "rows_per_s_npu")


@query("efficiency_gain", with_views("timing resources", f"""
WITH {_SUMMARY}, {_PAIR} SELECT batch_size, round((ln - lc) / lc * 100, 4) AS d_latency_pct,
  round((cn - cc) / cc * 100, 4) AS d_cpu_pct, round(tn - tc, 4) AS d_temp_c,
  round((rn - rc) / rc * 100, 4) AS d_throughput_pct FROM pair"""))
def efficiency_gain(spark, sf):
    return rounded(rp.efficiency_gain(summary(spark, sf)), 4)


_SCALING_UNION = " UNION ALL ".join(
    f"SELECT '{m}' AS metric, {str(up).lower()} AS up, variant, batch_size, {m} AS v FROM joined"
    for m, up in rp.SCALING_METRICS.items())


@query("scaling_pivot", with_views("timing resources", f"""
WITH {_warm("resources", R_ORDER, 2, "wr")},
s AS ({_stats_sql("timing")}),
r AS (SELECT variant, batch_size, avg(cpu_proc_pct) AS cpu_proc_avg, avg(rss_mb) AS rss_mb FROM wr GROUP BY 1, 2),
joined AS (SELECT * FROM s LEFT JOIN r USING (variant, batch_size)),
long AS ({_SCALING_UNION}),
wide AS (SELECT metric, up, batch_size, max(v) FILTER (variant = 'cpu') AS cpu,
                max(v) FILTER (variant = 'npu') AS npu FROM long GROUP BY 1, 2, 3)
SELECT metric, batch_size, round(cpu, 4) AS cpu, round(npu, 4) AS npu,
  CASE WHEN (up AND cpu > npu) OR (NOT up AND cpu < npu) THEN 'cpu'
       WHEN (up AND npu > cpu) OR (NOT up AND npu < cpu) THEN 'npu' END AS winner FROM wide"""))
def scaling_pivot(spark, sf):
    warm = warm_resources(spark, sf, 2, skip_short_runs=True)
    return rounded(rp.scaling_pivot(timing(spark, sf), warm), 4)


@query("wall_time", with_views("timing", """
WITH w AS (SELECT variant, batch_size, sum(n_rows) AS n, round(sum(t_total_ms) / 1000, 2) AS wall_s
           FROM timing GROUP BY 1, 2)
SELECT variant, batch_size, wall_s, floor(n / wall_s * 10) / 10 AS rows_per_wall_s FROM w"""))
def wall_time(spark, sf):
    wall = timing(spark, sf).groupBy(*RUN).agg(
        F.sum("n_rows").alias("n"), F.round(F.sum("t_total_ms") / 1000, 2).alias("wall_s"))
    return rp.wall_throughput(wall, F.col("n")).drop("n") \
        .withColumn("rows_per_wall_s", F.col("rows_per_wall_s").cast("double"))


@query("histogram", with_views("timing", """
WITH e AS (SELECT variant, batch_size, min(t_total_ms) AS lo, max(t_total_ms) AS hi FROM timing GROUP BY 1, 2)
SELECT variant, batch_size, CAST(least(floor(CASE WHEN hi = lo THEN 0.5
         ELSE (t_total_ms - lo) / (hi - lo) END * 50), 49) AS INT) AS bin, count(*) AS n,
       round(max(lo), 4) AS lo, round(max(hi), 4) AS hi
FROM timing JOIN e USING (variant, batch_size) GROUP BY 1, 2, 3"""))
def histogram(spark, sf):
    return rounded(rp.histogram(timing(spark, sf), "t_total_ms", RUN), 4)


@query("relative_time", with_views("resources", """
SELECT variant, batch_size, ts_epoch - min(ts_epoch) OVER (PARTITION BY variant, batch_size) AS t_rel
FROM resources"""))
def relative(spark, sf):
    return relative_time(resources(spark, sf), RUN, "ts_epoch").select(*RUN, "t_rel")


@query("time_series", with_views("resources", f"""
WITH {_WR} SELECT variant, batch_size, ts_epoch - min(ts_epoch) OVER (PARTITION BY variant, batch_size) AS t_rel,
  cpu_proc_pct, temp_c FROM wr"""))
def time_series(spark, sf):
    return rp.time_series(warm_resources(spark, sf), RUN, "ts_epoch", ["cpu_proc_pct", "temp_c"])


@query("efficiency_points", with_views("timing resources", f"""
WITH {_SUMMARY} SELECT variant, batch_size, round(cpu_proc_avg, 4) AS cpu_proc_avg,
  round(rows_per_s, 4) AS rows_per_s FROM summary"""))
def efficiency_points(spark, sf):
    return rounded(rp.efficiency_points(warm_timing(spark, sf), warm_resources(spark, sf), RUN), 4)


_STACK = ["preprocess", "inference", "postprocess", "log"]


@query("stacked_stages", with_views("timing", "WITH m AS (SELECT variant, batch_size, " + ", ".join(
    f"avg(t_{s}_ms) AS {s}" for s in _STACK) + " FROM timing GROUP BY 1, 2) " + " UNION ALL ".join(
    f"""SELECT variant, batch_size, '{s}' AS stage, round({s}, 4) AS ms,
round({" + ".join(_STACK[:i]) or "0.0::DOUBLE"}, 4) AS bottom FROM m""" for i, s in enumerate(_STACK))))
def stacked_stages(spark, sf):
    return rounded(rp.stacked_stages(timing(spark, sf), RUN), 4)


def _write_runs(spark, sf, path):
    """Timing rows as a benchmark folder in both layouts, one of them with its columns in another order."""
    rows = timing(spark, sf)
    for variant in ("cpu", "npu"):
        for size, target, columns in (
                (32, f"batch_32/timing_{variant}.csv", ("batch_idx", "n_rows", "t_total_ms")),
                (128, f"batch_128/timing_{variant}.csv", ("batch_idx", "n_rows", "t_total_ms")),
                (512, f"timing_{variant}_b512.csv", ("t_total_ms", "batch_idx", "n_rows"))):
            rows.filter((F.col("variant") == variant) & (F.col("batch_size") == size)) \
                .select(*columns).write.option("header", True).csv(f"{path}/{target}")


@query("read_bench_runs", with_views("timing", """
SELECT variant, batch_size, count(*) AS n_batches, CAST(sum(n_rows) AS BIGINT) AS n_rows,
       round(sum(t_total_ms), 2) AS total_ms FROM timing GROUP BY 1, 2"""))
def bench_runs(spark, sf):
    path = scratch_path(spark, "runs")
    _write_runs(spark, sf, path)
    return read_bench_runs(spark, path).groupBy("variant", "batch_size").agg(
        F.count(F.lit(1)).alias("n_batches"), b(F.sum("n_rows")).alias("n_rows"),
        F.round(F.sum("t_total_ms"), 2).alias("total_ms"))
