"""Flow building queries (packets -> flows)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.contract import BULK_FEATURES, FEATURES, TCP_FLAGS
from flowspark.functions.scalar import c, flow_id, safe_div, start_time_text
from flowspark.operators import flows as fl
from flowspark.operators.evaluate import duration_summary
from flowspark.operators.ordered import lag_in_order, split_on_gaps
from flowspark.plans.fixtures import view, with_views
from flowspark.plans.registry import b, query

# ---- SQL twin of the flow features -------------------------------------------------------

_LO = "(src_ip < dst_ip OR (src_ip = dst_ip AND src_port <= dst_port))"
_KEYED = f"""
keyed AS (SELECT *, {_LO} AS from_lo,
                 CASE WHEN {_LO} THEN src_ip ELSE dst_ip END AS lo_ip,
                 CASE WHEN {_LO} THEN src_port ELSE dst_port END AS lo_port,
                 CASE WHEN {_LO} THEN dst_ip ELSE src_ip END AS hi_ip,
                 CASE WHEN {_LO} THEN dst_port ELSE src_port END AS hi_port FROM packets)"""
_K = "lo_ip, lo_port, hi_ip, hi_port, proto"


def _flow_ctes(key: str = _K, source: str = "keyed", gap_us: int = 5_000_000) -> str:
    return f"""
headed AS (SELECT *, first_value(src_ip) OVER w AS f_ip, first_value(src_port) OVER w AS f_port,
                  first_value(dst_ip) OVER w AS d_ip, first_value(dst_port) OVER w AS d_port
           FROM {source} WINDOW w AS (PARTITION BY {key} ORDER BY seq)),
turned AS (SELECT *, (src_ip = f_ip AND src_port = f_port) AS fwd FROM headed),
gaps AS (SELECT *,
           ts_us - lag(ts_us) OVER (PARTITION BY {key} ORDER BY ts_us, seq) AS gap_t,
           ts_us - lag(ts_us) OVER (PARTITION BY {key}, fwd ORDER BY seq) AS gap_d
         FROM turned),
parts AS (SELECT *, sum(CASE WHEN gap_t > {gap_us} THEN 1 ELSE 0 END) OVER
            (PARTITION BY {key} ORDER BY ts_us, seq ROWS UNBOUNDED PRECEDING) AS period FROM gaps),
periods AS (SELECT {key}, period, max(ts_us) - min(ts_us) AS active,
                   max(CASE WHEN gap_t > {gap_us} THEN gap_t END) AS idle
            FROM parts GROUP BY {key}, period),
quiet AS (SELECT {key}, avg(active) AS a_mean, stddev_samp(active) AS a_std, max(active) AS a_max,
                 min(active) AS a_min, avg(idle) AS i_mean, stddev_samp(idle) AS i_std,
                 max(idle) AS i_max, min(idle) AS i_min
          FROM periods GROUP BY {key}),
base AS (SELECT {key}, any_value(f_ip) AS f_ip, any_value(f_port) AS f_port,
           any_value(d_ip) AS d_ip, any_value(d_port) AS d_port, count(*) AS n,
           arg_min(ts_us, seq) AS t0, arg_max(ts_us, seq) - arg_min(ts_us, seq) AS dur,
           count(*) FILTER (fwd) AS fn, count(*) FILTER (NOT fwd) AS bn,
           coalesce(sum(total_len) FILTER (fwd), 0) AS fb,
           coalesce(sum(total_len) FILTER (NOT fwd), 0) AS bb,
           max(total_len) FILTER (fwd) AS f_max, min(total_len) FILTER (fwd) AS f_min,
           avg(total_len) FILTER (fwd) AS f_avg, stddev_samp(total_len) FILTER (fwd) AS f_std,
           max(total_len) FILTER (NOT fwd) AS b_max, min(total_len) FILTER (NOT fwd) AS b_min,
           avg(total_len) FILTER (NOT fwd) AS b_avg,
           stddev_samp(total_len) FILTER (NOT fwd) AS b_std,
           max(total_len) AS l_max, min(total_len) AS l_min, avg(total_len) AS l_avg,
           coalesce(stddev_samp(total_len), 0) AS l_std,
           avg(gap_t) AS t_mean, stddev_samp(gap_t) AS t_std, max(gap_t) AS t_max, min(gap_t) AS t_min,
           sum(gap_d) FILTER (fwd) AS fi_tot, avg(gap_d) FILTER (fwd) AS fi_mean,
           stddev_samp(gap_d) FILTER (fwd) AS fi_std, max(gap_d) FILTER (fwd) AS fi_max,
           min(gap_d) FILTER (fwd) AS fi_min,
           sum(gap_d) FILTER (NOT fwd) AS bi_tot, avg(gap_d) FILTER (NOT fwd) AS bi_mean,
           stddev_samp(gap_d) FILTER (NOT fwd) AS bi_std, max(gap_d) FILTER (NOT fwd) AS bi_max,
           min(gap_d) FILTER (NOT fwd) AS bi_min,
           count(*) FILTER (fwd AND tcp_flags & 8 <> 0) AS f_psh,
           count(*) FILTER (NOT fwd AND tcp_flags & 8 <> 0) AS b_psh,
           count(*) FILTER (fwd AND tcp_flags & 32 <> 0) AS f_urg,
           count(*) FILTER (NOT fwd AND tcp_flags & 32 <> 0) AS b_urg,
           {", ".join(f"count(*) FILTER (tcp_flags & {bit} <> 0) AS n_{name}"
                      for name, bit in TCP_FLAGS.items())},
           sum(l4_hdr_len) FILTER (fwd) AS f_hdr, sum(l4_hdr_len) FILTER (NOT fwd) AS b_hdr,
           arg_min(tcp_window, seq) FILTER (fwd AND tcp_flags IS NOT NULL) AS f_win,
           arg_min(tcp_window, seq) FILTER (NOT fwd AND tcp_flags IS NOT NULL) AS b_win,
           count(*) FILTER (fwd AND tcp_flags IS NOT NULL
                            AND total_len - ip_hdr_len - l4_hdr_len > 0) AS f_data,
           min(l4_hdr_len) FILTER (fwd AND tcp_flags IS NOT NULL) AS f_seg
         FROM parts GROUP BY {key}),
flows AS (SELECT * FROM base JOIN quiet USING ({key}))"""


def _per_second(x: str) -> str:
    return f"CASE WHEN dur = 0 THEN 0 ELSE {x} / (dur / 1000000.0) END"


_SQL = {
    "source port": "f_port", "destination port": "d_port", "protocol": "proto",
    "flow duration": "dur", "total fwd packets": "fn", "total backward packets": "bn",
    "total length of fwd packets": "fb", "total length of bwd packets": "bb",
    "flow bytes/s": _per_second("(fb + bb)"), "flow packets/s": _per_second("n"),
    "fwd packets/s": _per_second("fn"), "bwd packets/s": _per_second("bn"),
    "fwd psh flags": "f_psh", "bwd psh flags": "b_psh", "fwd urg flags": "f_urg",
    "bwd urg flags": "b_urg", "fwd header length": "f_hdr", "bwd header length": "b_hdr",
    "fwd header length.1": "f_hdr",
    "min packet length": "l_min", "max packet length": "l_max", "packet length mean": "l_avg",
    "packet length std": "l_std", "packet length variance": "l_std * l_std",
    "average packet size": "l_avg", "down/up ratio": "bn * 1.0 / fn",
    "avg fwd segment size": "f_avg", "avg bwd segment size": "b_avg",
    "subflow fwd packets": "fn", "subflow fwd bytes": "fb", "subflow bwd packets": "bn",
    "subflow bwd bytes": "bb", "act_data_pkt_fwd": "f_data", "min_seg_size_forward": "f_seg",
    "fin flag count": "n_fin", "syn flag count": "n_syn", "rst flag count": "n_rst",
    "psh flag count": "n_psh", "ack flag count": "n_ack", "urg flag count": "n_urg",
    "cwe flag count": "n_cwr", "ece flag count": "n_ece",
    "init_win_bytes_forward": "coalesce(f_win, -1)",
    "init_win_bytes_backward": "coalesce(b_win, -1)",
    **{name: "0" for name in BULK_FEATURES},
    **{f"{d} packet length {s}": f"{d[0]}_{'avg' if s == 'mean' else s}"
       for d in ("fwd", "bwd") for s in ("max", "min", "mean", "std")},
    **{f"flow iat {s}": f"t_{s}" for s in ("mean", "std", "max", "min")},
    **{f"{d} iat {s}": f"{d[0]}i_{'tot' if s == 'total' else s}"
       for d in ("fwd", "bwd") for s in ("total", "mean", "std", "max", "min")},
    **{f"{a} {s}": f"CASE WHEN n > 1 THEN {a[0]}_{s} ELSE 0 END"
       for a in ("active", "idle") for s in ("mean", "std", "max", "min")},
}
_FID = "concat_ws('-', f_ip, d_ip, f_port, d_port, proto)"
DIGITS = 3


def flow_sql(names: list[str], key: str = _K, source: str = "keyed", before: str = "",
             extra: str = "") -> str:
    columns = ", ".join(
        f'round(CAST(coalesce({_SQL[x]}, 0) AS DOUBLE), {DIGITS}) AS "{x}"' for x in names)
    return with_views("packets", f"WITH {_KEYED}{before}, {_flow_ctes(key, source)} "
                      f'SELECT {_FID} AS "flow id"{extra}, {columns} FROM flows')


def shown(df: DataFrame, names: list[str], *extra: str) -> DataFrame:
    return df.select(c("flow id"), *[c(x) for x in extra],
                     *[F.round(c(x).cast("double"), DIGITS).alias(x) for x in names])


def _stats(prefix: str, order: str = "max min mean std") -> list[str]:
    return [f"{prefix} {s}" for s in order.split()]


GROUPS = {
    "flow_direction": ["source port", "destination port", "protocol"],
    "flow_duration": ["flow duration"],
    "flow_counts": ["total fwd packets", "total backward packets",
                    "total length of fwd packets", "total length of bwd packets"],
    "fwd_len_stats": _stats("fwd packet length"),
    "bwd_len_stats": _stats("bwd packet length"),
    "all_len_stats": ["min packet length", "max packet length", "packet length mean",
                      "packet length std", "packet length variance", "average packet size"],
    "flow_rates": ["flow bytes/s", "flow packets/s", "fwd packets/s", "bwd packets/s"],
    "dir_flags": ["fwd psh flags", "bwd psh flags", "fwd urg flags", "bwd urg flags"],
    "flag_counts": [f"{x} flag count" for x in "fin syn rst psh ack urg cwe ece".split()],
    "header_len": ["fwd header length", "bwd header length", "fwd header length.1"],
    "ratios": ["down/up ratio", "avg fwd segment size", "avg bwd segment size"],
    "bulk_zero": list(BULK_FEATURES),
    "subflow": ["subflow fwd packets", "subflow fwd bytes", "subflow bwd packets",
                "subflow bwd bytes"],
    "init_window": ["init_win_bytes_forward", "init_win_bytes_backward"],
    "tcp_fwd_payload": ["act_data_pkt_fwd", "min_seg_size_forward"],
}


def _totals_query(names: list[str]):
    return lambda spark, sf: shown(fl.flow_totals(view(spark, sf, "packets")), names)


for _key, _names in GROUPS.items():
    query(_key, flow_sql(_names))(_totals_query(_names))

_TIMELINE = [*_stats("flow iat", "mean std max min")]
_PERIODS = [f"{a} {s}" for a in ("active", "idle") for s in ("mean", "std", "max", "min")]
_DIR_IAT = [f"{d} iat {s}" for d in ("fwd", "bwd") for s in ("total", "mean", "std", "max", "min")]
_KEY_SQL = "lo_ip, lo_port, hi_ip, hi_port, proto"


def _keyed_sql(names: list[str]) -> str:
    columns = ", ".join(
        f'round(CAST(coalesce({_SQL[x]}, 0) AS DOUBLE), {DIGITS}) AS "{x}"' for x in names)
    return with_views("packets", f"WITH {_KEYED}, {_flow_ctes()} "
                                 f"SELECT {_KEY_SQL}, {columns} FROM flows")


def _keyed_shown(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*fl.FLOW_KEY, *[F.round(c(x).cast("double"), DIGITS).alias(x) for x in names])


@query("flow_iat", _keyed_sql(_TIMELINE))
def flow_iat(spark, sf):
    return _keyed_shown(fl.flow_timeline(view(spark, sf, "packets")), _TIMELINE)


@query("active_idle", _keyed_sql(_PERIODS))
def active_idle(spark, sf):
    return _keyed_shown(fl.flow_timeline(view(spark, sf, "packets")), _PERIODS)


@query("dir_iat", flow_sql(_DIR_IAT))
def dir_iat(spark, sf):
    return shown(fl.directional_gaps(view(spark, sf, "packets")), _DIR_IAT)


@query("flow_table", with_views("packets", f"""
WITH {_KEYED}, {_flow_ctes()}
SELECT {_FID} AS "flow id", f_ip AS "source ip", d_ip AS "destination ip",
       strftime(make_timestamp(t0), '%Y-%m-%d %H:%M:%S') AS "timestamp", '' AS label,
       {", ".join(f'round(CAST(coalesce({_SQL[x]}, 0) AS DOUBLE), {DIGITS}) AS "{x}"'
                  for x in FEATURES)}
FROM flows"""))
def flow_table(spark, sf):
    table = fl.flow_table(view(spark, sf, "packets"))
    return shown(table, FEATURES, "source ip", "destination ip", "timestamp", "label")


@query("flow_key", with_views("packets", f"""
WITH {_KEYED} SELECT seq, lo_ip, lo_port, hi_ip, hi_port, proto, from_lo FROM keyed"""))
def flow_key(spark, sf):
    return fl.with_flow_key(view(spark, sf, "packets")).select("seq", *fl.FLOW_KEY, "from_lo")


@query("flow_id", with_views("packets", """
SELECT seq, concat_ws('-', src_ip, dst_ip, src_port, dst_port, proto) AS flow_id FROM packets"""))
def flow_ids(spark, sf):
    return view(spark, sf, "packets").select("seq", flow_id(
        F.col("src_ip"), F.col("dst_ip"), F.col("src_port"), F.col("dst_port"),
        F.col("proto")).alias("flow_id"))


@query("format_start_ts", with_views("packets", """
SELECT seq, strftime(make_timestamp(ts_us), '%Y-%m-%d %H:%M:%S') AS start_ts FROM packets"""))
def format_start_ts(spark, sf):
    return view(spark, sf, "packets").select("seq", start_time_text(F.col("ts_us")).alias("start_ts"))


@query("tcp_flag_bits", with_views("packets", "SELECT seq, " + ", ".join(
    f"coalesce(tcp_flags & {bit} <> 0, false) AS is_{name}" for name, bit in TCP_FLAGS.items())
    + " FROM packets"))
def tcp_flag_bits(spark, sf):
    return fl.tcp_flag_bits(view(spark, sf, "packets")) \
        .select("seq", *[f"is_{x}" for x in TCP_FLAGS])


@query("lag_gap", with_views("packets", f"""
WITH {_KEYED} SELECT seq, ts_us - lag(ts_us) OVER (PARTITION BY {_K} ORDER BY seq) AS gap
FROM keyed"""))
def lag_gap(spark, sf):
    rows = fl.with_flow_key(view(spark, sf, "packets"))
    return lag_in_order(rows, fl.FLOW_KEY, "seq", "ts_us", "before") \
        .select("seq", (F.col("ts_us") - F.col("before")).alias("gap"))


def _segments_sql(gap_us: int) -> str:
    return f"""
timed AS (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY {_K} ORDER BY ts_us, seq) AS g FROM keyed),
split AS (SELECT * EXCLUDE (g), CAST(sum(CASE WHEN g > {gap_us} THEN 1 ELSE 0 END) OVER
            (PARTITION BY {_K} ORDER BY ts_us, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment
          FROM timed)"""


@query("sessionize", with_views("packets", f"""
WITH {_KEYED}, {_segments_sql(5_000_000)} SELECT seq, segment FROM split"""))
def sessionize(spark, sf):
    rows = fl.with_flow_key(view(spark, sf, "packets"))
    return split_on_gaps(rows, fl.FLOW_KEY, "ts_us", 5_000_000, "segment").select("seq", "segment")


_SEGMENT_COLS = ["flow duration", "total fwd packets", "total backward packets", "flow iat max",
                 "fwd iat std", "active mean", "idle max"]


@query("flow_timeout_split", flow_sql(
    _SEGMENT_COLS, _K + ", segment", "split", ", " + _segments_sql(10_000_000), ", segment"))
def flow_timeout_split(spark, sf):
    rows = fl.split_on_timeout(view(spark, sf, "packets"), 10_000_000)
    return shown(fl.flow_table(rows, ["segment"]), _SEGMENT_COLS, "segment")


# resets before a packet, FIN pairs since that reset; parts are numbered by their first packet
_CLOSE_SQL = f"""
counted AS (SELECT *,
    coalesce(sum(CASE WHEN tcp_flags & 4 <> 0 THEN 1 ELSE 0 END) OVER b, 0) AS resets,
    coalesce(sum(CASE WHEN tcp_flags & 1 <> 0 THEN 1 ELSE 0 END) OVER b, 0) AS fins
  FROM keyed
  WINDOW b AS (PARTITION BY {_K} ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
paired AS (SELECT *, (fins - min(fins) OVER (PARTITION BY {_K}, resets)) // 2 AS pairs FROM counted)"""


@query("flow_tcp_close", with_views("packets", f"""
WITH {_KEYED}, {_CLOSE_SQL}
SELECT seq, CAST(dense_rank() OVER (PARTITION BY {_K} ORDER BY resets, pairs) - 1 AS BIGINT)
       AS segment FROM paired"""))
def flow_tcp_close(spark, sf):
    return fl.split_on_close(view(spark, sf, "packets")).select("seq", "segment")


@query("distinct_flows", with_views("packets", f"""
WITH {_KEYED} SELECT count(*) AS n_packets, count(DISTINCT ({_K})) AS n_flows FROM keyed"""))
def distinct_flows(spark, sf):
    return fl.distinct_flows(view(spark, sf, "packets")).select(
        b(F.col("n_packets")).alias("n_packets"), "n_flows")


@query("duration_summary", with_views("packets", f"""
WITH {_KEYED}, {_flow_ctes()}
SELECT CAST(min(dur) AS DOUBLE) AS "min", CAST(median(dur) AS DOUBLE) AS "median",
       CAST(max(dur) AS DOUBLE) AS "max" FROM flows"""))
def duration(spark, sf):
    return duration_summary(fl.flow_totals(view(spark, sf, "packets")))


@query("top_sources", with_views("packets", f"""
WITH {_KEYED}, {_flow_ctes()}
SELECT f_ip AS "source ip", count(*) AS n_flows FROM flows GROUP BY f_ip
ORDER BY n_flows DESC, f_ip LIMIT 5"""))
def top_sources(spark, sf):
    return fl.top_sources(fl.flow_totals(view(spark, sf, "packets")))


@query("safe_div", with_views("packets", """
SELECT seq, CASE WHEN coalesce(tcp_flags, 0) = 0 THEN 0.0 ELSE total_len / tcp_flags::DOUBLE END
       AS ratio FROM packets"""))
def safe_division(spark, sf):
    return view(spark, sf, "packets").select(
        "seq", safe_div(F.col("total_len"), F.col("tcp_flags")).alias("ratio"))
