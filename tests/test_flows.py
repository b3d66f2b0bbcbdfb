"""Hand-computed packets and brute force over random ones."""

import math
import random
import statistics

import pytest

from flowspark.contract import FEATURES
from flowspark.operators import flows as fl

A, B = ("10.0.0.9", 5000), ("10.0.0.10", 80)


def packet(seq, ts, src=A, dst=B, proto=6, size=60, l4=20, flags=0, window=100, ip=20):
    tcp = proto == 6
    return (seq, ts, src[0], src[1], dst[0], dst[1], proto, size, ip, l4,
            flags if tcp else None, window if tcp else None)


def table(spark, packets):
    return spark.createDataFrame(packets, fl.PACKET_SCHEMA)


def only_flow(spark, packets, **kw):
    rows = fl.flow_table(table(spark, packets), **kw).collect()
    assert len(rows) == 1
    return rows[0].asDict()


def test_columns(spark):
    assert fl.flow_table(table(spark, [packet(0, 0)])).columns == [
        "flow id", "source ip", "destination ip", "timestamp", "label", *FEATURES]


def test_single_packet(spark):
    f = only_flow(spark, [packet(0, 1_000_000, flags=0x02)])
    assert f["flow duration"] == 0 and f["flow packets/s"] == 0 and f["flow iat mean"] == 0
    assert f["total fwd packets"] == 1 and f["total backward packets"] == 0
    assert f["syn flag count"] == 1 and f["fwd packet length std"] == 0
    assert f["active mean"] == 0 and f["idle max"] == 0
    assert f["init_win_bytes_forward"] == 100 and f["init_win_bytes_backward"] == -1
    assert f["timestamp"] == "1970-01-01 00:00:01" and f["label"] == ""


def test_zero_duration(spark):
    f = only_flow(spark, [packet(0, 7), packet(1, 7, B, A)])
    assert f["flow bytes/s"] == 0 and f["flow iat max"] == 0 and f["down/up ratio"] == 1


def test_first_packet_is_forward_even_from_larger_endpoint(spark):
    # as text "10.0.0.10" < "10.0.0.9", so A is the larger endpoint
    f = only_flow(spark, [packet(0, 0), packet(1, 10, B, A), packet(2, 30)])
    assert f["source ip"] == "10.0.0.9" and f["total fwd packets"] == 2
    f = only_flow(spark, [packet(0, 0, B, A), packet(1, 10), packet(2, 30)])
    assert f["source ip"] == "10.0.0.10" and f["total fwd packets"] == 1


@pytest.mark.parametrize("gap, idle", [(5_000_000, 0), (5_000_001, 5_000_001)])
def test_gap_at_the_activity_limit(spark, gap, idle):
    f = only_flow(spark, [packet(0, 0), packet(1, 100), packet(2, 100 + gap)])
    assert f["idle max"] == idle
    assert f["active max"] == (100 if idle else 100 + gap)


def test_icmp_udp_and_ipv6_headers(spark):
    f = only_flow(spark, [packet(0, 0, ("a", 0), ("b", 0), proto=1, l4=0)])
    assert f["source port"] == 0 and f["fwd header length"] == 0
    assert f["init_win_bytes_forward"] == -1 and f["min_seg_size_forward"] == 0
    f = only_flow(spark, [packet(0, 0, proto=17, l4=8)])
    assert f["fwd header length"] == 8 and f["act_data_pkt_fwd"] == 0
    f = only_flow(spark, [packet(0, 0, ("2001:db8::1", 1), ("2001:db8::2", 2), ip=40, size=61)])
    assert f["act_data_pkt_fwd"] == 1


def test_out_of_order_gaps_may_be_negative(spark):
    f = only_flow(spark, [packet(0, 100), packet(1, 40), packet(2, 90)])
    assert f["fwd iat min"] == -60 and f["fwd iat max"] == 50 and f["flow duration"] == -10
    assert f["flow iat min"] == 10 and f["flow iat max"] == 50


def random_packets(n=400, flows=6, seed=3):
    rng, out = random.Random(seed), []
    for seq in range(n):
        a, b = (f"10.0.0.{rng.randrange(1, flows)}", 1000), ("10.0.0.3", 80)
        if rng.random() < 0.4:
            a, b = b, a
        # the first flow holds most packets; times repeat and arrive out of order
        ts = rng.choice([seq * 90_000, seq * 90_000 - 700_000, (seq // 50) * 9_000_000])
        out.append(packet(seq, ts, a, b, 6, rng.randrange(40, 1500), 20, rng.randrange(256)))
    return out


def brute(packets):
    """Flow features of a few packets in plain Python, for the order-dependent columns."""
    groups = {}
    for p in packets:
        key = (min(p[2:4], p[4:6]), max(p[2:4], p[4:6]), p[6])
        groups.setdefault(key, []).append(p)
    out = {}
    for rows in groups.values():
        first = rows[0]
        fwd = [r for r in rows if r[2:4] == first[2:4]]
        bwd = [r for r in rows if r[2:4] != first[2:4]]
        times = sorted(r[1] for r in rows)

        def gaps(ts):
            return [y - x for x, y in zip(ts, ts[1:])]

        def four(prefix, xs):
            return {f"{prefix} mean": statistics.mean(xs) if xs else 0,
                    f"{prefix} std": statistics.stdev(xs) if len(xs) > 1 else 0,
                    f"{prefix} max": max(xs, default=0), f"{prefix} min": min(xs, default=0)}

        active, idle, start = [], [], times[0]
        for x, y in zip(times, times[1:]):
            if y - x > 5_000_000:
                active.append(x - start)
                idle.append(y - x)
                start = y
        active = [*active, times[-1] - start] if len(times) > 1 else []
        f = {"total fwd packets": len(fwd), "flow duration": rows[-1][1] - rows[0][1]}
        f |= four("flow iat", gaps(times))
        f |= four("fwd iat", gaps([r[1] for r in fwd])) | four("bwd iat", gaps([r[1] for r in bwd]))
        f |= {"fwd iat total": sum(gaps([r[1] for r in fwd]))}
        f |= four("active", active) | four("idle", idle) | four("fwd packet length", [r[7] for r in fwd])
        out[f"{first[2]}-{first[4]}-{first[3]}-{first[5]}-{first[6]}"] = f
    return out


@pytest.mark.parametrize("chunk_rows, slice_us", [(1 << 20, 1_000_000), (16, 250_000), (1, 1)])
def test_pieces_do_not_change_the_result(spark, chunk_rows, slice_us):
    packets = random_packets(120 if slice_us == 1 else 400)
    want = brute(packets)
    got = {r["flow id"]: r for r in fl.flow_table(
        table(spark, packets), chunk_rows=chunk_rows, slice_us=slice_us).collect()}
    assert set(got) == set(want)
    for key, features in want.items():
        for name, value in features.items():
            assert math.isclose(got[key][name], value, rel_tol=1e-9, abs_tol=1e-6), (key, name)


def test_totals_are_consistent(spark):
    packets = random_packets()
    rows = fl.flow_table(table(spark, packets)).collect()
    assert sum(r["total fwd packets"] + r["total backward packets"] for r in rows) == len(packets)
    for r in rows:
        n = r["total fwd packets"] + r["total backward packets"]
        span = r["flow iat mean"] * (n - 1)
        assert span >= 0 and r["flow iat max"] <= span + 1e-6


def test_close_splits_after_reset_and_every_second_fin(spark):
    flags = [1, 0, 1, 0, 4, 1, 4, 1, 1, 0]
    packets = [packet(i, i, flags=f) for i, f in enumerate(flags)]
    for chunk in (1 << 20, 3):
        rows = fl.split_on_close(table(spark, packets), chunk_rows=chunk).orderBy("seq").collect()
        assert [r["segment"] for r in rows] == [0, 0, 0, 1, 1, 2, 2, 3, 3, 4]


def test_timeout_split(spark):
    limit = 120_000_000
    packets = [packet(0, 0), packet(1, limit), packet(2, 2 * limit + 1)]
    rows = fl.split_on_timeout(table(spark, packets)).orderBy("seq").collect()
    assert [r["segment"] for r in rows] == [0, 0, 1]


def test_flow_table_is_one_scan_and_two_exchanges(spark, tmp_path):
    path = str(tmp_path / "packets")
    table(spark, random_packets()).write.parquet(path)
    df = fl.flow_table(spark.read.parquet(path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan


def test_flow_table_equals_its_three_parts(spark):
    rows = table(spark, random_packets()).withColumn("part", __import__("pyspark.sql.functions", fromlist=["col"]).col("seq") % 2)
    whole = {(r["flow id"], r["part"]): r for r in fl.flow_table(rows, ["part"], chunk_rows=16).collect()}
    totals = fl.flow_totals(rows, ["part"])
    gaps = fl.arrival_gaps(rows, ["part"], 16).join(totals, [*fl.FLOW_KEY, "part"])
    named = gaps.select("part", "`flow id`", *fl.name_directions(gaps)).collect()
    line = fl.flow_timeline(rows, ["part"]).join(totals.select(*fl.FLOW_KEY, "part", "`flow id`"), [*fl.FLOW_KEY, "part"]).collect()
    assert len(whole) == len(named) == len(line)
    for r in [*totals.collect(), *named, *line]:
        got = whole[r["flow id"], r["part"]]
        for name, value in r.asDict().items():
            if name in FEATURES:
                assert got[name] == pytest.approx(value, rel=1e-9, abs=1e-6), name
