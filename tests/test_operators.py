"""Edge cases of cleaning, decisions, samples, sources and plans."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from flowspark.contract import FEATURES
from flowspark.operators import actions as ac
from flowspark.operators import clean as cl
from flowspark.operators import evaluate as ev
from flowspark.operators import lookups as lk
from flowspark.operators import sampling as sp
from flowspark.operators import schema as sm
from flowspark.operators import ordered as od
from flowspark.operators import reports as rp
from flowspark.operators import scoring as sg
from flowspark.operators.ordered import lag_in_order, running
from flowspark.operators import positions
from flowspark.operators import quantiles as qu
from flowspark.operators.positions import order_cuts
from flowspark.operators.quantiles import exact_quantiles
from flowspark.sources import flow_csv as fc
from flowspark.sources.captures import decode_capture
from flowspark.sources.flow_csv import discover_and_union, read_flow_csv, unique_headers


def test_infinity_becomes_the_median_not_the_limit(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (float("inf"),), (1e13,), (None,), (float("nan"),)], "x double")
    got = [r["x"] for r in cl.impute_median(cl.clean_columns(df, ["x"]), ["x"]).collect()]
    assert got == [1.0, 3.0, 3.0, 1e12, 3.0, 3.0]


def test_column_without_values_becomes_zero(spark):
    df = spark.createDataFrame([(None,), (float("inf"),)], "x double")
    got = [r["x"] for r in cl.impute_median(cl.clean_columns(df, ["x"]), ["x"]).collect()]
    assert got == [0.0, 0.0]


def test_zero_scale_reads_as_one(spark):
    df = spark.createDataFrame([(5.0, 1.0), (5.0, 3.0)], "a double, b double")
    params = cl.fit_scaler(df, ["a", "b"])
    assert [(r["mean"], r["scale"]) for r in params.orderBy("idx").collect()] == [(5.0, 1.0), (2.0, 1.0)]
    assert [tuple(r) for r in cl.apply_scaler(df, ["a", "b"], params).collect()] == [(0.0, -1.0), (0.0, 1.0)]


def test_contract_errors_name_the_columns(spark):
    df = spark.createDataFrame([(1.0, "x")], "a double, b string")
    with pytest.raises(sm.ContractError, match="b, c"):
        sm.assert_contract(df, ["a", "b", "c"])
    with pytest.raises(sm.ContractError, match="80"):
        sm.assert_contract(df, ["a"], 80)


def test_label_and_time_candidates():
    assert sm.pick_label(["x", "class", "label"]) == "label"
    assert sm.pick_label(["x", "my_attack"]) == "my_attack"
    assert sm.pick_label(["x", "result"], "eval") is None
    assert sm.pick_label(["x", "SubLabel"], "sample") == "SubLabel"
    assert sm.pick_time(["a", "Start Time"]) == "Start Time"
    with pytest.raises(sm.ContractError):
        sm.pick_label(["x"])


def test_missing_label_is_an_attack(spark):
    df = spark.createDataFrame([(None,), (" benign ",), ("Bot",)], "label string")
    assert [r["y_true"] for r in sm.binary_label(df).collect()] == [1, 0, 1]


@pytest.mark.parametrize("left, size", [(1, 75), (1, 83), (20, 999), (100, 855), (10_000, 855)])
def test_quantiles_match_numpy(spark, left, size):
    import numpy as np
    rng = random.Random(size)
    values = [rng.choice([0.0, rng.random(), rng.gauss(0, 1e6), 5e-324, -1e-310]) for _ in range(size)]
    df = spark.createDataFrame([("a", v, None) for v in values] + [(None, 2.0, 1.0), (None, 4.0, float("nan"))],
                               "k string, x double, y double")
    rows = exact_quantiles(df, ["x", "y"], [0.0, 0.5, 0.95, 1.0], ["k"], left).collect()
    got = {(r["k"], r["name"], r["prob"]): r["value"] for r in rows}
    for p in (0.0, 0.5, 0.95, 1.0):
        assert got["a", "x", p] == pytest.approx(np.quantile(values, p), rel=1e-12)
        assert got["a", "y", p] is None and got[None, "y", p] == 1.0
    assert got[None, "x", 0.5] == 3.0
    assert exact_quantiles(df.limit(0), ["x"], [0.5], ["k"], left).count() == 0


def test_order_keys_sort_like_doubles_and_come_back(spark):
    import struct
    rng = random.Random(4)
    values = [0.0, 1.0, 2.0, 4.0, 1.7976931348623157e308, 2.2250738585072014e-308, 2.225073858507201e-308, 5e-324,
              float("inf")]
    values += [struct.unpack("<d", struct.pack("<Q", rng.getrandbits(63)))[0] for _ in range(500)]
    values += [2.0 ** rng.randint(-1074, 1023) for _ in range(200)]
    values += [v * (1 + s * 2.0 ** -52) for v in (2.0 ** k for k in range(-50, 60, 7)) for s in (1, -1)]
    values = sorted({s * v for v in values if v == v for s in (1, -1)})
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = {r.v: r for r in df.selectExpr("v", f"{qu.sql_order_key('v')} AS k").selectExpr(
        "v", "k", f"{qu.sql_from_key('k')} AS back").collect()}
    keys = [got[v].k for v in values]
    assert all(a < b for a, b in zip(keys, keys[1:])) and all(got[v].back == v for v in values)
    # the bits of a double, but for the sign
    assert all(got[v].k == struct.unpack("<q", struct.pack("<d", v))[0] for v in values if v > 0)


def test_quantiles_read_few_times_and_sort_no_share_of_the_rows(spark, tmp_path, monkeypatch):
    plans = []

    def kept(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return original(df, name)

    original = qu.materialize
    monkeypatch.setattr(qu, "materialize", kept)
    path = str(tmp_path / "x")
    spark.range(20_000).select(*[(F.col("id") * (i + 1) % 7919 / 7).alias(f"x{i}") for i in range(5)]).write.parquet(path)
    columns = [f"x{i}" for i in range(5)]
    for left, scans in ((10, 4), (qu.LEFT, 2)):
        plans.clear()
        out = exact_quantiles(spark.read.parquet(path), columns, [0.1, 0.5], left=left)
        assert out.count() == 10 and len(plans) <= scans
        for i, plan in enumerate(plans):
            assert plan.count(f"{path}") == 1
            # windows see counted places, never rows
            assert plan.index("Window") < plan.index("HashAggregate") < plan.index("Generate")


def test_quantiles_of_repeated_values_take_two_scans(spark, tmp_path, monkeypatch):
    """However often a value repeats, no further scan is needed to part it from others."""
    from flowspark import session
    plans = []

    def kept(df, name, original=session.materialize):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return original(df, name)

    monkeypatch.setattr(session, "materialize", kept)
    monkeypatch.setattr(qu, "materialize", kept)
    path = str(tmp_path / "x")
    spark.range(20_000).selectExpr("id % 9 / 100D AS x", "IF(id % 3 = 0, double('-Infinity'), 7D) AS y", "id % 2 AS k").write.parquet(path)
    got = {(r.k, r.name): r.value for r in exact_quantiles(spark.read.parquet(path), ["x", "y"], [0.5], ["k"], left=100).collect()}
    assert got == {(k, x): v for k in (0, 1) for x, v in (("x", 0.04), ("y", 7.0))}
    assert sum(plan.count(path) for plan in plans) == 2


def test_quantiles_outside_their_brackets_are_found(spark, monkeypatch):
    original = qu._brackets
    monkeypatch.setattr(qu, "_brackets", lambda *args: original(*args).withColumns({
        "lo0": F.when(F.col("g0") == 1, 3.0).otherwise(F.col("lo0")), "hi0": F.when(F.col("g0") == 1, 5.0).otherwise(F.col("hi0"))}))
    rows = spark.range(1_000).selectExpr("CAST(id AS DOUBLE) AS x", "id % 2 AS k")
    got = {(r.k, r.prob): r.value for r in exact_quantiles(rows, ["x"], [0.9, 0.5], ["k"], left=10).collect()}
    assert got == {(0, 0.5): 499.0, (0, 0.9): pytest.approx(898.2), (1, 0.5): 500.0, (1, 0.9): pytest.approx(899.2)}


def test_layouts_of_files_sort_no_lines(spark, tmp_path):
    for i, data in enumerate([b"a,b\n1,2\n", b"a\n\xe4 \x80\n", b"c\n\x81\n\xc3\xa4\n", "a,b\n\u00e4,\u20ac\n".encode()]):
        (tmp_path / f"{i}.csv").write_bytes(data)
    layouts = fc.file_layouts(spark, str(tmp_path))
    plan = layouts._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" in plan and "Sort" not in plan
    got = sorted((r.path.rsplit("/", 1)[-1], r.encoding, r.header) for r in layouts.collect())
    assert got == [("0.csv", "utf-8", "a,b"), ("1.csv", "cp1252", "a"), ("2.csv", "latin1", "c"), ("3.csv", "utf-8", "a,b")]


def test_order_cuts_with_one_crowded_instant(spark):
    rows = [(10 if i % 3 else i, i) for i in range(200)]
    df = spark.createDataFrame(rows, "ts long, id long")
    cut = order_cuts(df, F.col("ts"), F.col("id"), [0.5, 1.0]).first()
    assert (cut["cut_0"], cut["tie_0"]) == sorted(rows)[100]
    assert cut["cut_1"] is None
    none = order_cuts(df.limit(0), F.col("ts"), F.col("id"), [0.5]).first()
    assert none["cut_0"] is None


def test_positions_in_a_global_order(spark):
    rows = [(7 if i % 3 else None, (i * 37) % 211) for i in range(211)]
    df = spark.createDataFrame(rows, "ts long, id long").repartition(5)
    got = positions.with_position(df, [F.col("ts").asc_nulls_last(), F.col("id")]).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert [(r.ts, r.id) for r in sorted(got, key=lambda r: r.position)] == order
    assert sorted(r.position for r in got) == list(range(211))


def test_time_split_reads_its_input_twice(spark, tmp_path, monkeypatch):
    from flowspark.operators import sampling
    path, stored = str(tmp_path / "x"), []
    original = positions.materialize
    monkeypatch.setattr(positions, "materialize", lambda df, name: stored.append(
        df._jdf.queryExecution().executedPlan().toString()) or original(df, name))
    spark.range(1000).selectExpr("id", "id * 37 % 101 AS ts").write.parquet(path)
    split = sampling.time_split(spark.read.parquet(path), F.col("ts"), "id")
    assert sorted(r["count"] for r in split.groupBy("part").count().collect()) == [150, 150, 700]
    plans = [*stored, split._jdf.queryExecution().executedPlan().toString()]
    assert sum(p.count(path) for p in plans) == 2


def test_running_and_lag_across_chunks(spark):
    rows = [(i % 2, i, (i * 7) % 11) for i in range(50)]
    df = spark.createDataFrame(rows, "k int, seq long, v long")
    got = {r["seq"]: r for r in running(df, ["k"], "seq", {
        "s": ("sum", F.col("v")), "m": ("max", F.when(F.col("v") > 3, F.col("v")))}, 4).collect()}
    lags = {r["seq"]: r["p"] for r in lag_in_order(df, ["k"], "seq", "v", "p", 4).collect()}
    for k in (0, 1):
        seen = []
        for _, seq, v in [r for r in rows if r[0] == k]:
            assert lags[seq] == (seen[-1] if seen else None)
            seen.append(v)
            assert got[seq]["s"] == sum(seen)
            assert got[seq]["m"] == max((x for x in seen if x > 3), default=None)


def test_every_action_reason(spark):
    rows = [(0, 0, 0.9, " "), (0, 1, 0.9, "9.9.9.9"), (0, 2, 0.9, "1.1.1.1"), (0, 3, 0.9, "1.1.1.1"),
            (0, 4, 0.9, "2.2.2.2"), (0, 5, 0.9, "2.2.2.2"), (0, 6, 0.1, "3.3.3.3"), (1, 7, 0.5, "1.1.1.1"),
            (1, 8, 0.9, None)]
    scored = spark.createDataFrame(rows, "run_id int, row_index long, prob double, src_ip string")
    allowed = spark.createDataFrame([("9.9.9.9",)], "ip string")
    blocked = spark.createDataFrame([("2.2.2.2",), ("9.9.9.9",)], "ip string")
    got = ac.decide_actions(scored, allowed, blocked).orderBy("row_index").collect()
    assert [(r["action"], r["reason"]) for r in got] == [
        ("skip", "invalid_src_ip"), ("skip", "whitelisted"), ("dry-run", None),
        ("skip", "already_seen_this_run"), ("skip", "already_blocked"),
        ("skip", "already_seen_this_run"), ("dry-run", None), ("skip", "invalid_src_ip")]
    assert got[2]["cmd"] == "sudo iptables -A INPUT -s 1.1.1.1 -j DROP"


def test_lookup_is_the_same_small_or_large(spark):
    rows = spark.range(500).select("id", F.when(F.col("id") % 4 < 3, F.col("id") % 4).alias("k"))
    table = spark.createDataFrame([(0, "a"), (2, "c"), (None, "n")], "k long, v string")
    want = [(i, {0: "a", 2: "c", 3: "n"}.get(i % 4)) for i in range(500)]
    for small in (True, False):
        joined = lk.lookup(rows, table, ["k"], small=small).select("id", "v")
        assert sorted(map(tuple, joined.collect())) == want


def test_a_small_table_that_grows_fails(spark):
    with pytest.raises(Exception, match="declared small"):
        lk.few(spark.range(30), 20).collect()
    assert lk.few(spark.range(20), 20).count() == 20


def test_warmup_of_many_runs(spark):
    """More runs than a broadcast table may have rows; a third of them are longer than the warm-up."""
    rows = spark.range(270_000).selectExpr("id DIV 3 * 2 + IF(id % 9 < 5, 0, 1) AS k", "id AS o")
    sizes = rows.groupBy("k").count()
    assert sizes.count() > lk.FEW_ROWS
    want = {skip: sizes.selectExpr(f"sum(IF(count > 2, count - 2, {0 if skip else 'count'}))").first()[0] for skip in (False, True)}
    for skip, n in want.items():
        assert rp.drop_warmup(rows, ["k"], ["o"], 2, skip).count() == n > 0


def test_null_keys_stay(spark):
    rows = spark.createDataFrame([(None, 1, 5.0), (None, 2, 3.0), ("a", 1, 4.0)], "k string, o long, v double")
    assert od.running(rows, ["k"], "o", {"s": ("sum", F.lit(1))}).count() == 3
    assert ac.run_epoch(rows, ["k"], "o", "v").filter("k is null").agg(F.max("run_id")).first()[0] == 1
    assert ac.first_occurrence(rows, ["v"], "o", ["k"]).count() == 3
    assert rp.drop_warmup(rows, ["k"], ["o"], 1).filter("k is null").count() == 1
    assert rp.histogram(rows, "v", ["k"], 2).agg(F.sum("n")).first()[0] == 3
    assert ac.relative_time(rows, ["k"], "v").count() == 3


def test_unusable_vectors_are_not_scored(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0])],
                                 "id int, x array<double>")
    layers = [sg.Layer([[1.0, 1.0]], [0.0])]
    for forward in (sg.forward_native, sg.forward_arrow):
        raw = {r["id"]: r["z"] for r in forward(rows, "x", layers, "z").collect()}
        assert raw == {1: [3.0], 2: None, 3: None, 4: None}
        with pytest.raises(Exception, match="the network takes 2"):
            forward(spark.createDataFrame([([1.0],)], "x array<double>"), "x", layers, "z").collect()
    scored = {r["id"]: (r["pred"], r["pred_label"]) for r in sg.score_binary(rows, "x", layers).collect()}
    assert scored == {1: (1, "ATTACK"), 2: (None, None), 3: (None, None), 4: (None, None)}


def test_parameters_belong_to_features_by_name(spark):
    df = spark.createDataFrame([(1.0, 20.0)], "a double, b double")
    params = spark.createDataFrame([(0, "b", 10.0, 5.0), (1, "a", 0.0, 1.0)], "idx int, feature string, mean double, scale double")
    assert sg.prepare_features(df, params, ["a", "b"]).first()["x"] == [1.0, 2.0]
    assert sg.prepare_features(df, params, []).first()["x"] == [1.0, 2.0]
    off = params.withColumn("with_mean", F.lit(False))
    assert sg.prepare_features(df, off, ["a", "b"]).first()["x"] == [1.0, 4.0]
    for bad in (params.limit(1), params.withColumn("n_features_in", F.lit(3)),
                params.unionByName(params.withColumn("feature", F.concat("feature", F.lit("x"))))):
        with pytest.raises(Exception, match="scaling parameters"):
            sg.prepare_features(df, bad, ["a", "b"]).collect()


def test_csv_rows_do_not_depend_on_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text(" Flow Duration,Label,x\n1,BENIGN,2\n3\nbad,DDoS,\n")
    rows = fc.read_flow_csv(spark, str(tmp_path / "a.csv"))
    assert rows.count() == 3 and rows.select("label").count() == 3
    assert [tuple(r) for r in rows.collect()] == [(1.0, "BENIGN", "2"), (3.0, None, None), (None, "DDoS", None)]
    (tmp_path / "b.csv").write_text("Flow Duration,Label\n1,BENIGN\n1,BENIGN,9\n")
    for action in ("count", "collect"):
        with pytest.raises(Exception, match="more than 2 fields"):
            getattr(fc.read_flow_csv(spark, str(tmp_path / "b.csv")).select("label"), action)()


def test_text_is_no_feature(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Flow Duration,Protocol,Label\n1,tcp,BENIGN\ninf,6,DDoS\n,,\n")
    rows = fc.read_flow_csv(spark, str(tmp_path / "a.csv"), strict=True)
    assert dict(rows.dtypes) == {"flow duration": "double", "protocol": "string", "label": "string"}
    with pytest.raises(sm.ContractError, match="protocol"):
        sm.assert_contract(rows, ["flow duration", "protocol"])


def test_cores_by_number(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "core10_pct double, core2_pct double, core0_pct double")
    assert rp.core_columns(df) == ["core0_pct", "core2_pct", "core10_pct"]


def test_sweep_bounds(spark):
    df = spark.createDataFrame([(0.5, 1), (0.001, 0), (float("nan"), 1), (None, 0)], "prob double, y_true int")
    rows = {r["threshold"]: r for r in ev.threshold_sweep(df).collect()}
    assert rows[0.5]["tp"] == 1 and rows[0.001]["fp"] == 1 and rows[0.6]["detected"] == 0
    assert rows[0.9]["fn"] == 2 and rows[0.9]["tn"] == 2


def test_sample_depends_on_ids_only(spark):
    rows = [(f"f{i % 2}", i, "BENIGN" if i % 3 else "DDoS") for i in range(300)]
    df = spark.createDataFrame(rows, "file string, id long, label string")
    a = sorted(map(tuple, sp.balanced_sample(df, "file", "id", per_file=20).collect()))
    b = sorted(map(tuple, sp.balanced_sample(df.repartition(7), "file", "id", per_file=20).collect()))
    assert a == b and len(a) == 80 and sum(r[2] == "DDoS" for r in a) == 40


def test_duplicate_headers():
    assert unique_headers(["a", " b", "c", "b", "b"]) == ["a", " b", "c", "b.1", "b.2"]
    assert unique_headers(["f0", "f1", None]) == ["f0", "f1", "unnamed: 2"]


def test_csv_encodings_bom_and_bad_numbers(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿ Flow Duration,Label\n1.5,grün\ninf,x\nabc,y\n".encode())
    (tmp_path / "b.csv").write_bytes("Flow Duration,Label\n2,gr–n\n".encode("cp1252"))
    (tmp_path / "c.csv").write_bytes("Flow Duration,Label\n3,x\u0081y\n".encode("latin-1"))
    df = read_flow_csv(spark, str(tmp_path))
    got = {r["label"]: r["flow duration"] for r in df.collect()}
    assert got == {"grün": 1.5, "x": float("inf"), "y": None, "gr–n": 2.0, "x\u0081y": 3.0}


def test_labelled_folder(spark, tmp_path):
    (tmp_path / "x.pcap_ISCX.csv").write_text("Flow Duration, Label\n1, BENIGN\n")
    (tmp_path / "y.csv").write_text("Protocol,attack_type\n6,\n")
    rows = discover_and_union(spark, str(tmp_path)).orderBy("__source_file").collect()
    assert [(r["label"], r["flow duration"], r["protocol"], r["__source_file"]) for r in rows] == [
        ("BENIGN", 1.0, None, "x.pcap_ISCX.csv"), ("nan", None, 6.0, "y.csv")]


def _frame(kind, payload, vlan=False):
    tag = b"\x81\x00\x00\x05" if vlan else b""
    return b"\0" * 12 + tag + struct.pack(">H", kind) + payload


def _capture(frames, order="<", nano=False):
    magic = 0xA1B23C4D if nano else 0xA1B2C3D4
    out = struct.pack(order + "IHHIIII", magic, 2, 4, 0, 0, 65535, 1)
    for i, f in enumerate(frames):
        out += struct.pack(order + "IIII", 5, i * (1000 if nano else 1), len(f), len(f)) + f
    return out


@pytest.mark.parametrize("order, nano", [("<", False), (">", True)])
def test_capture_headers(order, nano):
    ip4 = struct.pack(">BBHHHBBH4s4s", 0x46, 0, 70, 0, 0, 64, 6, 0, b"\x0a\0\0\1", b"\x0a\0\0\2") + b"\0" * 4
    tcp = struct.pack(">HHIIBBHHH", 1234, 80, 0, 0, 0x80, 0x12, 512, 0, 0)
    ip6 = struct.pack(">IHBB16s16s", 6 << 28, 20, 17, 64, b"\0" * 15 + b"\1", b"\0" * 15 + b"\2")
    udp = struct.pack(">HHHH", 53, 5353, 20, 0)
    fragment = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 60, 0, 7, 64, 6, 0, b"\x0a\0\0\1", b"\x0a\0\0\2")
    rows = decode_capture(_capture([
        _frame(0x0800, ip4 + tcp), _frame(0x0806, b"\0" * 30), _frame(0x86DD, ip6 + udp, vlan=True),
        _frame(0x0800, fragment + tcp)], order, nano))
    assert list(rows["seq"]) == [0, 2, 3] and list(rows["ts_us"]) == [5_000_000, 5_000_002, 5_000_003]
    first, second, third = (rows.iloc[i] for i in range(3))
    assert (first.src_ip, first.src_port, first.dst_port, first.total_len, first.ip_hdr_len, first.l4_hdr_len,
            first.tcp_flags, first.tcp_window) == ("10.0.0.1", 1234, 80, 70, 24, 32, 0x12, 512)
    assert (second.src_ip, second.proto, second.src_port, second.total_len, second.ip_hdr_len,
            second.l4_hdr_len) == ("::1", 17, 53, 60, 40, 8)
    assert third.src_port == 0 and third.l4_hdr_len == 0


@pytest.mark.parametrize("order", ["<", ">"])
def test_block_structured_capture(order):
    def block(kind, body):
        body += b"\0" * (-len(body) % 4)
        size = struct.pack(order + "I", len(body) + 12)
        return struct.pack(order + "I", kind) + size + body + size

    ip4 = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 41, 0, 0, 64, 6, 0, b"\x0a\0\0\1", b"\x0a\0\0\2")
    frame = _frame(0x0800, ip4 + struct.pack(">HHIIBBHHH", 7, 8, 0, 0, 0x50, 2, 9, 0, 0) + b"x")
    nano = struct.pack(order + "HHBxxxHH", 9, 1, 9, 0, 0)
    data = block(0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1))
    data += block(1, struct.pack(order + "HHI", 1, 0, 0))
    data += block(1, struct.pack(order + "HHI", 1, 0, 0) + nano)
    for port, ticks in ((0, 7_000_001), (1, 7_000_002_000)):
        data += block(6, struct.pack(order + "IIIII", port, ticks >> 32, ticks & 0xFFFFFFFF,
                                     len(frame), len(frame)) + frame)
    rows = decode_capture(data + b"cut off")
    assert list(rows["ts_us"]) == [7_000_001, 7_000_002]
    assert list(rows["src_port"]) == [7, 7] and list(rows["total_len"]) == [41, 41]


def test_scan_reads_only_the_columns_of_the_features(spark):
    from flowspark.plans.fixtures import view
    from flowspark.plans.packet_queries import GROUPS, shown
    from flowspark.operators.flows import flow_totals
    df = shown(flow_totals(view(spark, "/root/testdata/sf0.001", "packets")), GROUPS["flow_counts"])
    plan = df._jdf.queryExecution().toString()
    assert "tcp_window" not in plan.split("Physical Plan")[1]
    assert "cartesian" not in plan.lower()


def test_metrics_ignore_row_order(spark):
    rows = [(i % 2, i % 3 % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "y_true int, pred int")
    a = ev.metrics(ev.confusion(df)).first()
    b = ev.metrics(ev.confusion(df.orderBy(F.rand(1)))).first()
    assert a == b and a["tp"] + a["fp"] + a["tn"] + a["fn"] == 40


def test_feature_contract_is_complete():
    assert len(FEATURES) == 80 == len(set(FEATURES))


def test_report_of_two_models(spark):
    import json
    from flowspark.operators.evaluate import models_report
    rows = [(1, 3.0, 0.9), (1, -1.0, 0.7), (0, -2.0, 0.6), (0, 0.5, None), (1, float("nan"), 0.2)]
    df = spark.createDataFrame(rows, "y_true int, a double, b double")
    r = json.loads(models_report(df, {"a": ("a", True), "b": ("b", False)}, thresholds=[0.5, 0.8]).first().report)
    a, b = r["models"]
    assert (a["model"], a["logits"], a["sigmoid_applied"], b["logits"]) == ("a", True, True, False)
    assert [a["metrics"][k] for k in ("tp", "fp", "tn", "fn")] == [1, 1, 1, 2]
    assert [b["metrics"][k] for k in ("tp", "fp", "tn", "fn")] == [2, 1, 1, 1]
    assert [p["tp"] for p in b["sweep"]] == [2, 1] and b["best_threshold"] == 0.5
    # rows 1 and 5 are decided alike
    assert (r["n_rows"], r["agreement"], r["agreement_pct"]) == (5, 2, 40.0)
    one = json.loads(models_report(df, {"b": ("b", False)}).first().report)
    assert "agreement" not in one and len(one["models"]) == 1


def test_stored_scaling_flags(spark, tmp_path):
    from flowspark.sources.tables import read_params, write_params
    path = str(tmp_path / "params")
    params = spark.createDataFrame([(0, "a", 5.0, 2.0, False, True, 1)],
                                   "idx int, feature string, mean double, scale double, with_mean boolean, with_std boolean, n_features_in int")
    write_params(params, path)
    df = spark.createDataFrame([(4.0,)], "a double")
    assert cl.apply_scaler(df, ["a"], read_params(spark, path)).first().a == 2.0
    write_params(params.select("idx", "feature", "mean", "scale"), path)
    assert cl.apply_scaler(df, ["a"], read_params(spark, path)).first().a == -0.5
    write_params(params.withColumn("n_features_in", F.lit(3)), path)
    with pytest.raises(Exception, match="scaling parameters for 3"):
        cl.apply_scaler(df, ["a"], read_params(spark, path)).collect()
