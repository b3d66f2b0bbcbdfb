"""Packets to bidirectional flows with 80 features.

Three operators read one kind of feature each; all are safe for a flow that holds any share of all packets:

``flow_totals``    counts, sums, extrema, deviations and first values. Mergeable, so packets
                   are combined map-side and only one row per flow and task is shuffled.
``arrival_gaps``   gaps between packets of one direction in arrival order.
``flow_timeline``  gaps, active and idle periods in time order.

The last two need neighbours. They sort inside bounded pieces of a flow (arrival chunks,
time slices) and then combine the pieces, one row each. ``flow_table`` makes both kinds of pieces in one pass:
each packet goes to its arrival chunk and to its time slice, where the totals are counted too, and one
grouping by flow chains all pieces. It shuffles packets instead of totals, but once.

Both directions are aggregated under the canonical endpoint order (``lo``/``hi``) and named
forward/backward at the end, when the first arrival is known, so finding the direction
costs no extra pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.contract import (
    ACTIVITY_TIMEOUT_US, BULK_FEATURES, FEATURES, FLOW_METADATA, FLOW_TIMEOUT_US,
    TCP_FLAGS,
)
from flowspark.functions.scalar import (
    flag_set, flow_id, safe_div, safe_stat, start_time_text,
)
from flowspark.operators.ordered import (
    CHUNK_ROWS, chunk_of, number_segments, running, split_on_gaps,
)

PACKET_SCHEMA = T.StructType([
    T.StructField("seq", T.LongType(), False),
    T.StructField("ts_us", T.LongType(), False),
    T.StructField("src_ip", T.StringType(), False),
    T.StructField("src_port", T.IntegerType(), False),
    T.StructField("dst_ip", T.StringType(), False),
    T.StructField("dst_port", T.IntegerType(), False),
    T.StructField("proto", T.IntegerType(), False),
    T.StructField("total_len", T.IntegerType(), False),
    T.StructField("ip_hdr_len", T.IntegerType(), False),
    T.StructField("l4_hdr_len", T.IntegerType(), False),
    T.StructField("tcp_flags", T.IntegerType(), True),
    T.StructField("tcp_window", T.IntegerType(), True),
])

FLOW_KEY = ["lo_ip", "lo_port", "hi_ip", "hi_port", "proto"]
SLICE_US = 1_000_000


def with_flow_key(packets: DataFrame) -> DataFrame:
    """Add the direction-free flow key and ``from_lo``: sent by the smaller endpoint.

    Endpoints compare as (ip text, port number).
    """
    from_lo = (F.col("src_ip") < F.col("dst_ip")) | (
        (F.col("src_ip") == F.col("dst_ip")) & (F.col("src_port") <= F.col("dst_port")))

    def pick(a: str, b: str) -> Column:
        return F.when(from_lo, F.col(a)).otherwise(F.col(b))

    return packets.select(
        *packets.columns, from_lo.alias("from_lo"),
        pick("src_ip", "dst_ip").alias("lo_ip"), pick("src_port", "dst_port").alias("lo_port"),
        pick("dst_ip", "src_ip").alias("hi_ip"), pick("dst_port", "src_port").alias("hi_port"))


def _key(extra: Sequence[str]) -> list[str]:
    return [*FLOW_KEY, *extra]


def flow_totals(packets: DataFrame, extra_keys: Sequence[str] = ()) -> DataFrame:
    """One row per flow with every feature that merges: one map-side combined aggregate."""
    keys = _key(extra_keys)
    p = with_flow_key(packets)
    flags, seq, ts, size = (F.col(x) for x in ("tcp_flags", "seq", "ts_us", "total_len"))
    is_tcp = flags.isNotNull()
    payload = size - F.col("ip_hdr_len") - F.col("l4_hdr_len")
    aggs = [
        F.count(F.lit(1)).alias("n"),
        F.min_by(ts, seq).alias("first_ts"),
        F.max_by(ts, seq).alias("last_ts"),
        F.min(size).alias("len_min"), F.max(size).alias("len_max"),
        F.avg(size).alias("len_avg"), F.stddev_samp(size).alias("len_std"),
        *[F.count_if(flag_set(flags, bit)).alias(f"{name}_n") for name, bit in TCP_FLAGS.items()],
    ]
    for side, own in (("lo", F.col("from_lo")), ("hi", ~F.col("from_lo"))):
        def only(x: Column, own: Column = own) -> Column:
            return F.when(own, x)
        tcp_seq = F.when(own & is_tcp, seq)
        aggs += [
            F.count_if(own).alias(f"{side}_n"),
            F.min(only(seq)).alias(f"{side}_first_seq"),
            F.sum(only(size.cast("bigint"))).alias(f"{side}_bytes"),
            F.min(only(size)).alias(f"{side}_len_min"), F.max(only(size)).alias(f"{side}_len_max"),
            F.avg(only(size)).alias(f"{side}_len_avg"),
            F.stddev_samp(only(size)).alias(f"{side}_len_std"),
            F.count_if(own & flag_set(flags, TCP_FLAGS["psh"])).alias(f"{side}_psh"),
            F.count_if(own & flag_set(flags, TCP_FLAGS["urg"])).alias(f"{side}_urg"),
            F.sum(only(F.col("l4_hdr_len").cast("bigint"))).alias(f"{side}_hdr"),
            F.min_by(F.col("tcp_window"), tcp_seq).alias(f"{side}_win"),
            F.count_if(own & is_tcp & (payload > 0)).alias(f"{side}_data"),
            F.min(F.when(own & is_tcp, F.col("l4_hdr_len"))).alias(f"{side}_seg_min"),
        ]
    return named_totals(p.groupBy(*keys).agg(*aggs), keys)


def named_totals(g: DataFrame, keys: Sequence[str], *extra: str) -> DataFrame:
    """Features of flows from the totals of their two sides, ``lo`` and ``hi``; keeps the columns ``extra``."""
    lo_first = F.col("hi_first_seq").isNull() | (F.col("lo_first_seq") < F.col("hi_first_seq"))
    lo_first = F.coalesce(lo_first, F.lit(False))

    def fwd(x: str) -> Column:
        return F.when(F.col("lo_first"), F.col(f"lo_{x}")).otherwise(F.col(f"hi_{x}"))

    def bwd(x: str) -> Column:
        return F.when(F.col("lo_first"), F.col(f"hi_{x}")).otherwise(F.col(f"lo_{x}"))

    g = g.withColumn("lo_first", lo_first)
    duration = F.col("last_ts") - F.col("first_ts")
    seconds = duration / F.lit(1_000_000)
    fwd_n, bwd_n = fwd("n"), bwd("n")
    fwd_bytes = F.coalesce(fwd("bytes"), F.lit(0))
    bwd_bytes = F.coalesce(bwd("bytes"), F.lit(0))
    n_bytes = fwd_bytes + bwd_bytes
    fwd_hdr = F.coalesce(fwd("hdr"), F.lit(0))
    std = safe_stat(F.col("len_std"))
    features = {
        "source port": fwd("port"), "destination port": bwd("port"), "protocol": F.col("proto"),
        "flow duration": duration,
        "total fwd packets": fwd_n, "total backward packets": bwd_n,
        "total length of fwd packets": fwd_bytes, "total length of bwd packets": bwd_bytes,
        "flow bytes/s": safe_div(n_bytes, seconds),
        "flow packets/s": safe_div(F.col("n"), seconds),
        "fwd packets/s": safe_div(fwd_n, seconds), "bwd packets/s": safe_div(bwd_n, seconds),
        "fwd psh flags": fwd("psh"), "bwd psh flags": bwd("psh"),
        "fwd urg flags": fwd("urg"), "bwd urg flags": bwd("urg"),
        "fwd header length": fwd_hdr, "bwd header length": F.coalesce(bwd("hdr"), F.lit(0)),
        "fwd header length.1": fwd_hdr,
        "min packet length": safe_stat(F.col("len_min")),
        "max packet length": safe_stat(F.col("len_max")),
        "packet length mean": safe_stat(F.col("len_avg")), "packet length std": std,
        "packet length variance": std * std, "average packet size": safe_stat(F.col("len_avg")),
        "down/up ratio": safe_div(bwd_n, fwd_n),
        "avg fwd segment size": safe_stat(fwd("len_avg")),
        "avg bwd segment size": safe_stat(bwd("len_avg")),
        "subflow fwd packets": fwd_n, "subflow fwd bytes": fwd_bytes,
        "subflow bwd packets": bwd_n, "subflow bwd bytes": bwd_bytes,
        "init_win_bytes_forward": F.coalesce(fwd("win"), F.lit(-1)),
        "init_win_bytes_backward": F.coalesce(bwd("win"), F.lit(-1)),
        "act_data_pkt_fwd": fwd("data"),
        "min_seg_size_forward": F.coalesce(fwd("seg_min"), F.lit(0)),
    }
    for side, pick in (("fwd", fwd), ("bwd", bwd)):
        for stat, src in (("max", "len_max"), ("min", "len_min"), ("mean", "len_avg"),
                          ("std", "len_std")):
            features[f"{side} packet length {stat}"] = safe_stat(pick(src))
    for name in TCP_FLAGS:
        shown = "cwe" if name == "cwr" else name
        features[f"{shown} flag count"] = F.col(f"{name}_n")
    features.update({name: F.lit(0) for name in BULK_FEATURES})
    source_ip, dest_ip = fwd("ip"), bwd("ip")
    return g.select(
        *keys, *extra, F.col("lo_first"), F.col("n").alias("n_packets"), F.col("first_ts"),
        flow_id(source_ip, dest_ip, fwd("port"), bwd("port"), F.col("proto")).alias("flow id"),
        source_ip.alias("source ip"), dest_ip.alias("destination ip"),
        start_time_text(F.col("first_ts")).alias("timestamp"), F.lit("").alias("label"),
        *[e.alias(name) for name, e in features.items()])


def _merged_std(n: Column, squares: Column) -> Column:
    """Sample deviation from a count and a sum of squared deviations; 0 below two values."""
    return F.when(n > 1, F.sqrt(F.greatest(squares, F.lit(0.0)) / (n - 1))).otherwise(F.lit(0.0))


def arrival_gaps(packets: DataFrame, extra_keys: Sequence[str] = (),
                 chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Per flow and direction (``lo``/``hi``): total, mean, std, max and min gap in arrival order.

    Gaps inside an arrival chunk come from a window over at most ``chunk_rows`` packets.
    Chunks are then chained, one row each: the gap across a border is the next chunk's first
    time minus this chunk's last time. The overall mean is known from the ends, so squared
    deviations add up exactly around it.
    """
    keys = _key(extra_keys)
    p = with_flow_key(packets).select(*keys, "from_lo", "seq", "ts_us",
                                      chunk_of("seq", chunk_rows).alias("chunk"))
    inside = Window.partitionBy(*keys, "from_lo", "chunk").orderBy("seq")
    gap = F.col("gap")
    pieces = p.withColumn("gap", F.col("ts_us") - F.lag("ts_us").over(inside)) \
        .groupBy(*keys, "from_lo", "chunk").agg(
            F.count(F.lit(1)).alias("n"),
            F.min_by("ts_us", "seq").alias("head"), F.max_by("ts_us", "seq").alias("tail"),
            F.min(gap).alias("gap_min"), F.max(gap).alias("gap_max"),
            F.var_pop(gap).alias("gap_var"))
    side = Window.partitionBy(*keys, "from_lo")
    order = side.orderBy("chunk")
    mean = F.try_divide(F.max_by("tail", "chunk").over(side) - F.min_by("head", "chunk").over(side),
                        F.sum("n").over(side) - 1)
    chained = pieces.repartition(*[F.col(k) for k in keys]) \
        .withColumns({"border": F.col("head") - F.lag("tail").over(order), "mean": mean})
    inner_n = F.col("n") - 1
    inner_mean = F.try_divide(F.col("tail") - F.col("head"), inner_n)
    squares = (
        F.coalesce(inner_n * (F.col("gap_var") + F.pow(inner_mean - F.col("mean"), F.lit(2))),
                   F.lit(0.0))
        + F.coalesce(F.pow(F.col("border") - F.col("mean"), F.lit(2)), F.lit(0.0)))
    aggs = []
    for name, own in (("lo", F.col("from_lo")), ("hi", ~F.col("from_lo"))):
        def only(x: Column, own: Column = own) -> Column:
            return F.when(own, x)
        gaps = F.sum(only(F.col("n"))) - 1
        aggs += [
            F.coalesce(F.max_by("tail", only(F.col("chunk"))) -
                       F.min_by("head", only(F.col("chunk"))), F.lit(0))
            .cast("double").alias(f"{name}_iat_total"),
            safe_stat(F.max(only(F.col("mean")))).alias(f"{name}_iat_mean"),
            F.coalesce(_merged_std(gaps, F.sum(only(squares))), F.lit(0.0))
            .alias(f"{name}_iat_std"),
            safe_stat(F.max(only(F.greatest("gap_max", "border")))).alias(f"{name}_iat_max"),
            safe_stat(F.min(only(F.least("gap_min", "border")))).alias(f"{name}_iat_min"),
        ]
    return chained.groupBy(*keys).agg(*aggs)


def flow_timeline(packets: DataFrame, extra_keys: Sequence[str] = (),
                  activity_timeout_us: int = ACTIVITY_TIMEOUT_US,
                  slice_us: int = SLICE_US) -> DataFrame:
    """Gaps, active and idle periods of each flow in time order, both directions together.

    Packets with equal (flow, time) are combined map-side first: they add only zero gaps.
    A time slice then holds at most ``slice_us`` distinct times, whatever the packet rate, and
    since a slice is not longer than the timeout, periods can only end between slices.
    """
    keys = _key(extra_keys)
    width = min(slice_us, activity_timeout_us)
    instants = with_flow_key(packets) \
        .select(*keys, F.floor(F.col("ts_us") / F.lit(width)).cast("bigint").alias("__slice"),
                "ts_us") \
        .groupBy(*keys, "__slice", "ts_us").agg(F.count(F.lit(1)).alias("copies"))
    inside = Window.partitionBy(*keys, "__slice").orderBy("ts_us")
    gap = F.col("gap")
    slices = instants.withColumn("gap", F.col("ts_us") - F.lag("ts_us").over(inside)) \
        .groupBy(*keys, "__slice").agg(
            F.min("ts_us").alias("__from"), F.max("ts_us").alias("__to"),
            F.sum("copies").alias("n"), F.count(gap).alias("gap_n"),
            F.min(gap).alias("gap_min"), F.max(gap).alias("gap_max"),
            F.var_pop(gap).alias("gap_var"))
    whole = Window.partitionBy(*keys)
    mean = F.try_divide(F.max("__to").over(whole) - F.min("__from").over(whole),
                        F.sum("n").over(whole) - 1)
    chained = number_segments(slices.repartition(*[F.col(k) for k in keys]), keys,
                              activity_timeout_us, "period", gap="border") \
        .withColumn("mean", mean)
    zeros = F.col("n") - 1 - F.col("gap_n")
    inner_mean = F.try_divide(F.col("__to") - F.col("__from"), F.col("gap_n"))
    squares = (
        F.coalesce(F.col("gap_n") * (F.col("gap_var")
                                     + F.pow(inner_mean - F.col("mean"), F.lit(2))), F.lit(0.0))
        + F.coalesce(zeros * F.pow(F.col("mean"), F.lit(2)), F.lit(0.0))
        + F.coalesce(F.pow(F.col("border") - F.col("mean"), F.lit(2)), F.lit(0.0)))
    zero_gap = F.when(zeros > 0, F.lit(0).cast("bigint"))
    periods = chained.groupBy(*keys, "period").agg(
        F.min("__from").alias("begin"), F.max("__to").alias("end"), F.sum("n").alias("n"),
        F.max("mean").alias("mean"), F.sum(squares).alias("squares"),
        F.max(F.greatest("gap_max", "border", zero_gap)).alias("gap_max"),
        F.min(F.least("gap_min", "border", zero_gap)).alias("gap_min"),
        F.max(F.when(F.col("border") > activity_timeout_us, F.col("border"))).alias("idle"))
    active = F.col("end") - F.col("begin")
    flows = periods.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.max("mean").alias("mean"), F.sum("squares").alias("squares"),
        F.max("gap_max").alias("gap_max"), F.min("gap_min").alias("gap_min"),
        *[f(x).alias(f"{name}_{stat}")
          for name, x in (("active", active), ("idle", F.col("idle")))
          for stat, f in (("mean", F.avg), ("std", F.stddev_samp), ("max", F.max),
                          ("min", F.min))])
    return flows.select(
        *keys,
        safe_stat(F.col("mean")).alias("flow iat mean"),
        _merged_std(F.col("n") - 1, F.col("squares")).alias("flow iat std"),
        safe_stat(F.col("gap_max")).alias("flow iat max"),
        safe_stat(F.col("gap_min")).alias("flow iat min"),
        *[F.when(F.col("n") > 1, safe_stat(F.col(f"{name}_{stat}"))).otherwise(F.lit(0.0))
          .alias(f"{name} {stat}")
          for name in ("active", "idle") for stat in ("mean", "std", "max", "min")])


def name_directions(flows: DataFrame) -> list[Column]:
    out = []
    for stat in ("total", "mean", "std", "max", "min"):
        lo, hi = F.col(f"lo_iat_{stat}"), F.col(f"hi_iat_{stat}")
        out.append(F.when(F.col("lo_first"), lo).otherwise(hi).alias(f"fwd iat {stat}"))
        out.append(F.when(F.col("lo_first"), hi).otherwise(lo).alias(f"bwd iat {stat}"))
    return out


def directional_gaps(packets: DataFrame, extra_keys: Sequence[str] = (),
                     chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Forward and backward gap features per flow."""
    keys = _key(extra_keys)
    totals = flow_totals(packets, extra_keys).select(*keys, "lo_first", "`flow id`")
    joined = totals.join(arrival_gaps(packets, extra_keys, chunk_rows), keys)
    return joined.select(*keys, "`flow id`", *name_directions(joined))


# the flow, which side sent (NULL: both, in time order) and the piece of that order
_ID, _LINE, _PIECE = ["__a", "__b"], ["__a", "__b", "__side"], ["__a", "__b", "__side", "__piece"]
_STATS = ("mean", "std", "max", "min")


def _pieces(packets: DataFrame, keys: Sequence[str], chunk_rows: int, width: int) -> DataFrame:
    """Pieces of every flow: arrival chunks of each side, and time slices, which hold the totals as well.

    A packet belongs to one of each. A flow goes by two 64-bit hashes of its key, so the key itself, text mostly, is
    not compared; gaps are those to the packet before inside the piece.
    """
    p = with_flow_key(packets)
    flags, seq, size = F.col("tcp_flags"), F.col("seq"), F.col("total_len").cast("bigint")
    places = F.array(
        F.struct(F.col("from_lo").alias("__side"), chunk_of("seq", chunk_rows).alias("__piece"), seq.alias("__at")),
        F.struct(F.lit(None).cast("boolean").alias("__side"),
                 F.floor(F.col("ts_us") / F.lit(width)).cast("bigint").alias("__piece"), F.col("ts_us").alias("__at")))
    own_key = F.struct(*keys)
    placed = p.select(
        F.xxhash64(*keys).alias("__a"), F.xxhash64(F.lit(1), *keys).alias("__b"), own_key.alias("__key"), "from_lo", "seq",
        "ts_us", size.alias("__size"), F.col("l4_hdr_len").cast("bigint").alias("__hdr"), "tcp_window", "tcp_flags",
        (size - F.col("ip_hdr_len") - F.col("l4_hdr_len") > 0).alias("__data"), F.explode(places).alias("__p")) \
        .select("*", "__p.*").drop("__p")
    inside = Window.partitionBy(*_PIECE).orderBy("__at", "seq")
    gapped = placed.withColumn("__gap", F.col("ts_us") - F.lag("ts_us").over(inside))
    gap, whole = F.col("__gap"), F.col("__side").isNull()
    aggs = [F.first("__key").alias("__key"), F.count(F.lit(1)).alias("n"), F.min_by("ts_us", "__at").alias("head"),
            F.max_by("ts_us", "__at").alias("tail"), F.min(gap).alias("gap_min"), F.max(gap).alias("gap_max"),
            F.var_pop(gap).alias("gap_var"),
            F.min(F.when(whole, F.struct("seq", "ts_us"))).alias("first"), F.max(F.when(whole, F.struct("seq", "ts_us"))).alias("last"),
            *[F.count_if(whole & flag_set(flags, bit)).alias(f"{name}_n") for name, bit in TCP_FLAGS.items()]]
    for side, sent in (("lo", F.col("from_lo")), ("hi", ~F.col("from_lo"))):
        own = whole & sent
        tcp = own & flags.isNotNull()
        aggs += [
            F.count_if(own).alias(f"{side}_n"), F.min(F.when(own, F.col("seq"))).alias(f"{side}_first_seq"),
            F.sum(F.when(own, F.col("__size"))).alias(f"{side}_bytes"),
            F.sum(F.when(own, F.col("__size") * F.col("__size"))).alias(f"{side}_squares"),
            F.min(F.when(own, F.col("__size"))).alias(f"{side}_len_min"),
            F.max(F.when(own, F.col("__size"))).alias(f"{side}_len_max"),
            F.count_if(own & flag_set(flags, TCP_FLAGS["psh"])).alias(f"{side}_psh"),
            F.count_if(own & flag_set(flags, TCP_FLAGS["urg"])).alias(f"{side}_urg"),
            F.sum(F.when(own, F.col("__hdr"))).alias(f"{side}_hdr"),
            F.min(F.when(tcp, F.struct("seq", "tcp_window"))).alias(f"{side}_win"),
            F.count_if(tcp & F.col("__data")).alias(f"{side}_data"),
            F.min(F.when(tcp, F.col("__hdr"))).alias(f"{side}_seg_min")]
    return gapped.groupBy(*_PIECE).agg(*aggs)


def _chained(pieces: DataFrame, activity_us: int) -> DataFrame:
    """Pieces with the gap before them, the mean gap of their line, and the active period they are in."""
    line = Window.partitionBy(*_LINE)
    order = line.orderBy("__piece")
    # one row per piece from here on, all of a flow together
    brought = pieces.repartition(*[F.col(x) for x in _ID])
    border = F.col("head") - F.lag("tail").over(order)
    mean = F.try_divide(F.max_by("tail", "__piece").over(line) - F.min_by("head", "__piece").over(line),
                        F.sum("n").over(line) - 1)
    breaks = F.when(F.col("__side").isNull() & (F.col("border") > activity_us), 1).otherwise(0)
    period = F.sum(breaks).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inner = F.try_divide(F.col("tail") - F.col("head"), F.col("n") - 1)
    squares = (F.coalesce((F.col("n") - 1) * (F.col("gap_var") + F.pow(inner - F.col("mean"), F.lit(2))), F.lit(0.0))
               + F.coalesce(F.pow(F.col("border") - F.col("mean"), F.lit(2)), F.lit(0.0)))
    return brought.withColumns({"border": border, "mean": mean}).withColumns({"period": period, "squares": squares})


_SUMS = [f"{name}_n" for name in TCP_FLAGS] + [f"{s}_{x}" for s in ("lo", "hi") for x in (
    "n", "bytes", "squares", "psh", "urg", "hdr", "data")]
_LEAST = ["first"] + [f"{s}_{x}" for s in ("lo", "hi") for x in ("first_seq", "len_min", "win", "seg_min")]
_MOST = ["last", "lo_len_max", "hi_len_max"]


def _merged(extra: Sequence[Column] = ()) -> list[Column]:
    """Aggregates that join pieces, or periods, of a flow."""
    return [F.first("__key").alias("__key"), *[F.sum(x).alias(x) for x in _SUMS], *[F.min(x).alias(x) for x in _LEAST],
            *[F.max(x).alias(x) for x in _MOST], *extra]


def _ordered_totals(packets: DataFrame, keys: Sequence[str], activity_us: int, chunk_rows: int, slice_us: int) -> DataFrame:
    """One row per flow: totals of both sides and all order statistics, from one scan and two exchanges."""
    chained = _chained(_pieces(packets, keys, chunk_rows, min(slice_us, activity_us)), activity_us)
    # periods of the time line; each side's arrivals are one period
    periods = chained.groupBy(*_LINE, "period").agg(*_merged([
        F.sum("n").alias("n"), F.min("head").alias("begin"), F.max("tail").alias("end"), F.max("mean").alias("mean"),
        F.sum("squares").alias("squares"), F.max(F.greatest("gap_max", "border")).alias("gap_max"),
        F.min(F.least("gap_min", "border")).alias("gap_min"), F.min_by("head", "__piece").alias("head"),
        F.max_by("tail", "__piece").alias("tail"),
        F.max(F.when(F.col("border") > activity_us, F.col("border"))).alias("idle")]))
    lines = [("flow", F.col("__side").isNull()), ("lo", F.col("__side")), ("hi", ~F.col("__side"))]
    aggs = []
    for name, own in lines:
        def only(x: str, own: Column = own) -> Column:
            return F.when(F.coalesce(own, F.lit(False)), F.col(x))
        aggs += [F.sum(only("n")).alias(f"{name}_m"), F.max(only("mean")).alias(f"{name}_mean"),
                 F.sum(only("squares")).alias(f"{name}_sq"), F.max(only("gap_max")).alias(f"{name}_max"),
                 F.min(only("gap_min")).alias(f"{name}_min"), F.max(only("tail")).alias(f"{name}_tail"),
                 F.max(only("head")).alias(f"{name}_head")]
    whole = F.col("__side").isNull()
    for name, x in (("active", F.when(whole, F.col("end") - F.col("begin"))), ("idle", F.when(whole, F.col("idle")))):
        aggs += [f(x).alias(f"{name}_{stat}") for stat, f in zip(_STATS, (F.avg, F.stddev_samp, F.max, F.min))]
    flows = periods.groupBy(*_ID).agg(*_merged(aggs))
    out = {"n": F.col("flow_m"), "first_ts": F.col("first.ts_us"), "last_ts": F.col("last.ts_us"),
           "len_min": F.least("lo_len_min", "hi_len_min"), "len_max": F.greatest("lo_len_max", "hi_len_max"),
           **{f"{x}_n": F.col(f"{x}_n") for x in TCP_FLAGS}}

    def spread(n: Column, total: Column, squares: Column) -> list[Column]:
        n, total, squares = (F.coalesce(x, F.lit(0)).cast("double") for x in (n, total, squares))
        return [F.try_divide(total, n),
                F.when(n > 1, F.sqrt(F.greatest(n * squares - total * total, F.lit(0.0)) / (n * (n - 1))))]

    both = [F.coalesce(F.col(f"lo_{x}"), F.lit(0)) + F.coalesce(F.col(f"hi_{x}"), F.lit(0)) for x in ("n", "bytes", "squares")]
    out["len_avg"], out["len_std"] = spread(*both)
    for side in ("lo", "hi"):
        out |= {f"{side}_{x}": F.col(f"{side}_{x}") for x in (
            "n", "first_seq", "bytes", "len_min", "len_max", "psh", "urg", "hdr", "data", "seg_min")}
        out[f"{side}_len_avg"], out[f"{side}_len_std"] = spread(*[F.col(f"{side}_{x}") for x in ("n", "bytes", "squares")])
        out[f"{side}_win"] = F.col(f"{side}_win.tcp_window")
        out |= {f"{side}_iat_total": F.coalesce(F.col(f"{side}_tail") - F.col(f"{side}_head"), F.lit(0)).cast("double"),
                f"{side}_iat_mean": safe_stat(F.col(f"{side}_mean")),
                f"{side}_iat_std": F.coalesce(_merged_std(F.col(f"{side}_m") - 1, F.col(f"{side}_sq")), F.lit(0.0)),
                f"{side}_iat_max": safe_stat(F.col(f"{side}_max")), f"{side}_iat_min": safe_stat(F.col(f"{side}_min"))}
    out |= {"flow iat mean": safe_stat(F.col("flow_mean")), "flow iat std": _merged_std(F.col("flow_m") - 1, F.col("flow_sq")),
            "flow iat max": safe_stat(F.col("flow_max")), "flow iat min": safe_stat(F.col("flow_min"))}
    out |= {f"{name} {stat}": F.when(F.col("flow_m") > 1, safe_stat(F.col(f"{name}_{stat}"))).otherwise(F.lit(0.0))
            for name in ("active", "idle") for stat in _STATS}
    return flows.select("__key.*", *[e.alias(x) for x, e in out.items()])


def flow_table(packets: DataFrame, extra_keys: Sequence[str] = (),
               activity_timeout_us: int = ACTIVITY_TIMEOUT_US, chunk_rows: int = CHUNK_ROWS,
               slice_us: int = SLICE_US, features: Sequence[str] = FEATURES) -> DataFrame:
    """One row per flow: 5 identification columns, then the features, by default all 80 in contract order.

    With a feature of gaps or periods, all come from pieces of the flows (one scan, two exchanges); without one,
    from the totals, which are combined before the shuffle.
    """
    keys = _key(extra_keys)
    timed = [f"{x} {s}" for x in ("flow iat", "active", "idle") for s in _STATS]
    if any(x.startswith(("fwd iat", "bwd iat")) or x in timed for x in features):
        pieces = _ordered_totals(packets, keys, activity_timeout_us, chunk_rows, slice_us)
        gaps = [f"{s}_iat_{x}" for s in ("lo", "hi") for x in ("total", "mean", "std", "max", "min")]
        table = named_totals(pieces, keys, *[f"`{x}`" for x in timed], *gaps)
        table = table.select("*", *name_directions(table))
    else:
        table = flow_totals(packets, extra_keys)
    return table.select(*[f"`{x}`" for x in [*FLOW_METADATA, *extra_keys, *features]])


def split_on_timeout(packets: DataFrame, timeout_us: int = FLOW_TIMEOUT_US,
                     out: str = "segment") -> DataFrame:
    """Number the parts of a flow that are separated by more than ``timeout_us`` of silence.

    Pass ``extra_keys=[out]`` to the flow operators to get one flow per part.
    """
    keyed = with_flow_key(packets)
    return split_on_gaps(keyed, FLOW_KEY, "ts_us", timeout_us, out) \
        .select(*packets.columns, out)


def split_on_close(packets: DataFrame, out: str = "segment",
                   chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Number the parts of a flow ended by a reset or by every second FIN, in arrival order.

    The closing packet belongs to the part it closes. FINs are counted from the last reset.
    """
    rst = flag_set(F.col("tcp_flags"), TCP_FLAGS["rst"])
    fin = flag_set(F.col("tcp_flags"), TCP_FLAGS["fin"])

    def step(df: DataFrame, name: str, kind: str, expr: Column) -> DataFrame:
        return running(df, FLOW_KEY, "seq", {name: (kind, expr)}, chunk_rows)

    rows = step(with_flow_key(packets), "__fins", "sum", fin.cast("int"))
    rows = step(rows, "__base", "max", F.when(rst, F.col("__fins")))
    since_reset = F.col("__fins") - F.coalesce(F.col("__base"), F.lit(0))
    closes = rst | (fin & (since_reset % 2 == 0))
    rows = step(rows.withColumn("__closes", closes.cast("int")), "__closed", "sum",
                F.col("__closes"))
    return rows.select(*packets.columns, (F.col("__closed") - F.col("__closes")).alias(out))


def tcp_flag_bits(packets: DataFrame) -> DataFrame:
    """Packets plus one boolean per TCP flag; false for packets without TCP."""
    return packets.withColumns({f"is_{name}": flag_set(F.col("tcp_flags"), bit)
                                for name, bit in TCP_FLAGS.items()})


def distinct_flows(packets: DataFrame) -> DataFrame:
    """Number of packets and of flows."""
    return with_flow_key(packets).groupBy(*FLOW_KEY).agg(F.count(F.lit(1)).alias("n")) \
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_packets"),
             F.count(F.lit(1)).alias("n_flows"))


def top_sources(flows: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` source addresses with most flows; ties by address."""
    return flows.groupBy("`source ip`").agg(F.count(F.lit(1)).alias("n_flows")) \
        .orderBy(F.desc("n_flows"), F.col("`source ip`")).limit(k)
