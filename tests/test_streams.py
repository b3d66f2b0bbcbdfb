"""Streams: closed flows with order features, repeated batches, ends of runs, stage times, growing files."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from flowspark.contract import FEATURES, FLOW_METADATA
from flowspark.operators import actions as ac
from flowspark.operators import flows as fl
from flowspark.sources import growing
from flowspark.streaming import decisions, runs, timing
from flowspark.streaming import flows as sflows
from flowspark.streaming import score as sscore
from flowspark.streaming import small_flows
from test_flows import A, B, packet, random_packets

GAP = 3_000_000
END = 10**13


def arriving(spark, folder, *batches):
    """One file per batch, in order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, fl.PACKET_SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return sscore.stream_parquet(spark, folder, fl.PACKET_SCHEMA, 1)


def drained(spark, stream, folder):
    q = sscore.write_stream(stream, f"{folder}/out", f"{folder}/checkpoint")
    q.awaitTermination()
    return spark.read.parquet(f"{folder}/out"), q


def far(seq, ts=END):
    return [packet(seq, ts, ("flush", 1), ("flush", 2))]


def rounded(rows):
    def plain(v):
        return round(v, 6) if isinstance(v, float) else v
    return sorted(tuple(plain(r[x]) for x in [*FLOW_METADATA, *FEATURES]) for r in rows)


@pytest.mark.parametrize("parts, slice_us", [(1, 1_000_000), (3, 500_000)])
def test_streamed_flows_equal_the_batch_table(spark, tmp_path, parts, slice_us):
    packets = random_packets(300)
    size = -(-len(packets) // parts)
    stream = arriving(spark, str(tmp_path / "in"), *[packets[i:i + size] for i in range(0, len(packets), size)], far(10**6))
    closed, _ = drained(spark, sflows.stream_flows(stream, GAP, late_us=10**9, slice_us=slice_us), str(tmp_path))
    table = spark.createDataFrame(packets, fl.PACKET_SCHEMA)
    batch = fl.flow_table(fl.split_on_timeout(table, GAP), ["segment"])
    got = closed.collect()
    assert {r.kind for r in got} == {"flow"} and sum(r.n_packets for r in got) == len(packets)
    assert rounded(got) == rounded(batch.collect())


def test_arrival_chunks_and_batches_chain(spark, tmp_path, monkeypatch):
    """Arrival numbers that interleave over batches and chunks still give gaps in arrival order."""
    packets = [packet(i, (i * 37 % 50) * 10_000, *((A, B) if i % 3 else (B, A)), size=40 + i) for i in range(60)]
    even, odd = packets[::2], packets[1::2]
    monkeypatch.setattr(sflows, "ARRIVAL_CHUNK", 8)
    state = sflows.FlowState(GAP, 5_000_000, 1_000_000)
    stream = arriving(spark, str(tmp_path / "in"), odd, even, far(10**6))
    closed, q = drained(spark, sflows.stream_flows(stream, GAP, late_us=10**9), str(tmp_path))
    batch = fl.flow_table(spark.createDataFrame(packets, fl.PACKET_SCHEMA))
    assert rounded(closed.collect()) == rounded(batch.collect()) and state.slice_us == 1_000_000


def test_late_packets_are_counted_and_state_ends(spark, tmp_path):
    first = [packet(0, 0), packet(1, 100), packet(2, 40_000_000, ("c", 1), ("d", 2))]
    # the watermark stands at 35 seconds now: two late packets, one that is not
    second = [packet(3, 200), packet(4, 300), packet(5, 39_000_000, ("c", 1), ("d", 2))]
    stream = arriving(spark, str(tmp_path / "in"), first, second, far(6))
    out, q = drained(spark, sflows.stream_flows(stream, GAP, late_us=5_000_000), str(tmp_path))
    flows = {(r.kind, r["source ip"]): r.n_packets for r in out.filter("kind = 'flow'").collect()}
    assert flows == {("flow", A[0]): 2, ("flow", "c"): 2}
    late = out.filter("kind = 'late'").collect()
    assert [r.n_packets for r in late] == [2]
    # only the last packet's slice, arrival chunk and timer are left
    left = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]][-1]
    assert left <= 3


class _Store:
    """A state store in memory that counts its calls."""

    def __init__(self):
        self.maps, self.calls = {}, 0

    def getMapState(self, name, *_):
        rows, store = self.maps.setdefault(name, {}), self

        class Map:
            def __getattr__(self, call):
                store.calls += 1
                return {"getValue": rows.get, "updateValue": rows.__setitem__, "containsKey": rows.__contains__,
                        "removeKey": rows.pop, "keys": lambda: iter(list(rows))}[call]
        return Map()

    def registerTimer(self, _):
        self.calls += 1


def test_sparse_flows_take_few_state_calls():
    """Packets far apart in time and arrival number cost no state calls of their own."""
    import numpy as np
    import pandas as pd
    store, state = _Store(), sflows.FlowState(GAP, 5_000_000, 1_000_000)
    state.init(store)
    long = lambda x: np.array([x], "<i8").tobytes()
    rows = pd.DataFrame({"slice": range(50), "totals": [[int(not x.startswith("lo_")) for x, _ in sflows._TOTALS]] * 50,
                         "marks": [long(2 * i * sflows.ARRIVAL_CHUNK) for i in range(50)],
                         "times": [long(i * 1_000_000) for i in range(50)]})
    watermark = type("Timer", (), {"getCurrentWatermarkInMs": lambda self: 10**9})()
    before = type("Timer", (), {"getCurrentWatermarkInMs": lambda self: 0})()
    assert not list(state.handleInputRows(("a", 1, "b", 2, 6), iter([rows]), before)) and store.calls < 20
    closed = list(state.handleExpiredTimer(("a", 1, "b", 2, 6), watermark, None))
    assert len(closed) == 1 and closed[0]["last_ts"][0] == 49_000_000 and store.calls < 40
    assert not any(store.maps.values())


class _Time:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def shard_packets(n, flows, seed=5):
    """Packed rows of one shard: some columns NULL, some rows twice, flows in several parts."""
    import pyarrow as pa
    rng, rows = random.Random(seed), []
    for i in range(n):
        flow = rng.randrange(flows)
        tcp = rng.random() < 0.7
        rows.append({
            "lo_ip": f"10.0.0.{flow // 2}", "lo_port": None if flow % 7 == 3 else 1000 + flow % 2, "hi_ip": "9.9.9.9",
            "hi_port": 80, "proto": 6 if tcp else 17, "from_lo": rng.random() < 0.6 and flow % 5 != 1, "seq": 10_000 * seed + i,
            "ts_us": rng.randrange(12) * 1_700_000 + rng.randrange(9) * 1000,
            "total_len": None if rng.random() < 0.1 else rng.randrange(40, 1500), "ip_hdr_len": rng.choice([20, 24, None]),
            "l4_hdr_len": rng.choice([8, 20, None]), "tcp_flags": rng.randrange(256) if tcp else None,
            "tcp_window": rng.choice([None, 512, 1024])})
    rows += rng.sample(rows, n // 10)
    return pa.RecordBatch.from_pylist(rows, schema=small_flows.PACKETS)


def shard_run(store, batches, large, ends):
    """Rows that a shard gives for batches, each with the watermark before it, and for a timer at the end."""
    import pandas as pd
    state, out = sflows.ShardState(GAP, 1_000_000, 500_000, large), []
    state.init(store)
    for batch, watermark in batches:
        halves = [batch.slice(0, len(batch) // 2), batch.slice(len(batch) // 2)]
        frames = [pd.DataFrame({"packets": [small_flows.to_bytes(x)]}) for x in halves]
        out += [x for x in state.handleInputRows((3,), iter(frames), _Time(watermark))]
        out += [x for x in state.handleExpiredTimer((3,), _Time(watermark), None)]
    out += [x for x in state.handleExpiredTimer((3,), _Time(ends), None)]
    return pd.concat(out).sort_values(["kind", "lo_ip", "lo_port", "proto", "first_ts", "n"]).reset_index(drop=True)


def test_small_flows_equal_flows_with_own_state():
    """The same rows whether a flow is closed with others or from its own state, with late packets and NULLs."""
    import pandas as pd
    batches = [(shard_packets(400, 9), 0), (shard_packets(300, 12, 6), 9_000)]
    stores = [_Store() for _ in range(3)]
    together, apart, some = (shard_run(s, batches, large, 10**6) for s, large in zip(stores, (10**6, 0, 25)))
    assert len(together) > 60 and set(together["kind"]) == {"flow", "late"}
    assert together.loc[together["kind"] == "flow", "n"].sum() + together.loc[together["kind"] == "late", "n"].sum() == 770
    for other in (apart, some):
        pd.testing.assert_frame_equal(together, other, check_exact=False, rtol=1e-9)
    assert not any(rows for s in stores for rows in s.maps.values())


def test_shards_take_few_state_calls():
    """State calls of a shard do not grow with its flows."""
    store = _Store()
    closed = shard_run(store, [(shard_packets(2000, 400, i), 0) for i in range(3)], 10**6, 10**6)
    assert len(closed) > 1000 and store.calls < 40


def test_what_waits_in_a_shard_is_bounded(monkeypatch):
    """Ended flows are closed, and grown ones given own state, as soon as many packets wait, without a timer."""
    monkeypatch.setattr(sflows, "PENDING", 300)
    monkeypatch.setattr(sflows, "STEP", 50)
    monkeypatch.setattr(sflows, "RUN", 40)
    batches = [(shard_packets(500, 12, i), 0) for i in range(3)]
    store = _Store()
    got = shard_run(store, batches, 60, 10**6)
    want = shard_run(_Store(), batches, 10**6, 10**6)
    __import__("pandas").testing.assert_frame_equal(want, got, check_exact=False, rtol=1e-9)
    assert not any(store.maps.values())


@pytest.mark.parametrize("large", [0, 20])
def test_streamed_flows_with_own_state_equal_the_batch_table(spark, tmp_path, large):
    packets = random_packets(240)
    stream = arriving(spark, str(tmp_path / "in"), packets[::2], packets[1::2], far(10**6))
    closed, _ = drained(spark, sflows.stream_flows(stream, GAP, late_us=10**9, shards=3, large=large), str(tmp_path))
    batch = fl.flow_table(fl.split_on_timeout(spark.createDataFrame(packets, fl.PACKET_SCHEMA), GAP), ["segment"])
    assert rounded(closed.collect()) == rounded(batch.collect())


def test_pages_keep_large_entries_apart(monkeypatch):
    import numpy as np
    monkeypatch.setattr(sflows, "PAGE", 4)
    monkeypatch.setattr(sflows, "OWN_BYTES", 40)
    rng, store, want = random.Random(2), _Store(), {}
    pages = sflows._Pages(store, "x")
    for _ in range(30):
        added = {rng.randrange(-9, 9): np.arange(rng.randrange(1, 4)) for _ in range(3)}
        pages.merge({n: (a, a + 1) for n, a in added.items()}, sflows._joined_arrivals)
        for n, a in added.items():
            want[n] = [*want.get(n, []), *a.tolist()]
        gone = set(rng.sample(sorted(want), 1))
        pages.remove(gone)
        want = {n: a for n, a in want.items() if n not in gone}
        short = {n: a[1:] for n, a in want.items() if n % 3 == 0}
        seen = {}

        def step(n, a, b):
            seen[n] = a.tolist()
            assert (b == a + 1).all()
            return (a, b) if n % 3 else (a[1:], b[1:]) if len(a) > 1 else None

        pages.visit(step)
        assert seen == want and list(seen) == sorted(seen)
        want = {n: a for n, a in (want | short).items() if a}
        assert set(k[0] for k in store.maps["x"]) <= set(want)
    assert store.maps["x"] and want


def test_moments_merge_like_one_pass():
    values = [5.0, 1.0, 7.5, 7.5, -2.0, 100.0]
    m = sflows.Moments()
    for part in (values[:1], values[1:4], [], values[4:]):
        m.add(__import__("numpy").array(part, float))
    mean = sum(values) / 6
    std = math.sqrt(sum((v - mean) ** 2 for v in values) / 5)
    assert m.shown("x") == pytest.approx({"x_mean": mean, "x_std": std, "x_max": 100.0, "x_min": -2.0})
    assert sflows.Moments().shown("x") == {"x_mean": 0.0, "x_std": 0.0, "x_max": 0.0, "x_min": 0.0}


# ---- decisions ----

SCORED = "row_index long, run_id long, prob double, src_ip string"


def scored_rows(n=240):
    ips = ["1.1.1.1", "2.2.2.2", "3.3.3.3", "9.9.9.9", None, "", "nan", " 4.4.4.4 "]
    return [(i, i // 80, [0.2, 0.9, 0.7][i * 7 % 3], ips[i * 5 % 8 if i % 2 else i % 4]) for i in range(n)]


class Stopped(Exception):
    pass


def test_decisions_survive_a_stop_in_the_middle(spark, tmp_path):
    rows, folder = scored_rows(), str(tmp_path / "in")
    for i in range(0, len(rows), 20):
        spark.createDataFrame(rows[i:i + 20], SCORED).coalesce(1).write.mode("append").parquet(folder)
    stream = sscore.stream_parquet(spark, folder, spark.createDataFrame([], SCORED).schema, 1)
    allowed = spark.createDataFrame([("9.9.9.9",)], "ip string")
    blocked = spark.createDataFrame([("3.3.3.3",)], "ip string")
    path, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    calls = []

    def stop_once(number):
        calls.append(number)
        if number == 5 and calls.count(5) == 1:
            # the batch is written as a whole, then the stream dies before it is committed
            raise Stopped()

    def start():
        return decisions.stream_decisions(stream, allowed, blocked, path, checkpoint, before=stop_once)

    with pytest.raises(Exception):
        start().awaitTermination()
    # as if the first try of the batch had got as far as its decisions
    decisions.decide_batch(spark.createDataFrame(rows[100:120], SCORED), 5, allowed, blocked, path)
    start().awaitTermination()
    assert calls.count(5) == 2 and max(calls) == 11
    want = ac.decide_actions(spark.createDataFrame(rows, SCORED), allowed, blocked)
    got = decisions.decisions(spark, path, want.schema)
    assert got.select("batch").distinct().count() == 12
    assert sorted(map(str, got.drop("batch").collect())) == sorted(map(str, want.collect()))


# ---- runs ----

def test_state_of_a_run_ends_with_it(spark, tmp_path):
    schema = "row_index long, run_id long, prob double, src_ip string, s long"
    batches = [
        [(0, 1, 0.9, "1.1.1.1", 0), (1, 1, 0.9, "1.1.1.1", 1), (2, 1, 0.1, "2.2.2.2", 2), (3, 1, 0.9, "9.9.9.9", 2)],
        # the run goes on without attacks, so its addresses stay known
        [(4, 1, 0.1, "5.5.5.5", 100)],
        [(5, 1, 0.9, "1.1.1.1", 190), (6, 1, 0.9, None, 190), (7, 1, 0.9, "3.3.3.3", 191)],
        # a new run sees every address again; the old one is silent from now on
        [(0, 2, 0.9, "1.1.1.1", 200)],
        [(1, 2, 0.1, "1.1.1.1", 280)],
        [(2, 2, 0.1, "1.1.1.1", 370)],
        [(3, 2, 0.9, "1.1.1.1", 400)]]
    folder = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = sscore.stream_parquet(spark, folder, spark.createDataFrame([], schema).schema, 1)
    allowed = spark.createDataFrame([("9.9.9.9",)], "ip string")
    seen = runs.stream_run_addresses(stream, allowed, F.timestamp_seconds("s"), idle_ms=120_000, shards=3)
    out, q = drained(spark, seen, str(tmp_path))
    assert sorted(tuple(r) for r in out.collect()) == [(1, "1.1.1.1", 0), (1, "3.3.3.3", 7), (2, "1.1.1.1", 0)]
    state = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    # at the end only the second run is there: an end and its timers for each of three shards, one address
    assert max(state) > state[-1]
    spark.createDataFrame([(9, 3, 0.1, "x", 10_000)], schema).coalesce(1).write.mode("append").parquet(folder)
    spark.createDataFrame([(9, 4, 0.1, "x", 20_000)], schema).coalesce(1).write.mode("append").parquet(folder)
    again, q = drained(spark, seen, str(tmp_path))
    after = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]][-1]
    assert again.count() == 3 and after == min(state[-1] - 1, after)


# ---- stage times ----

def test_stage_times_of_many_batches(spark, tmp_path):
    stream = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 8).load() \
        .select("value", F.array(F.col("value").cast("double"), F.lit(1.0)).alias("x"))
    from flowspark.operators.scoring import Layer
    scored = timing.score_timed(stream, "x", [Layer([[1.0, -100.0]], [0.0])])
    path = str(tmp_path / "times")
    times = timing.StageTimes(spark, path, "many", rows=40)
    spark.streams.addListener(times)
    try:
        q = scored.select("value", "pred").writeStream.queryName("many").format("noop") \
            .option("checkpointLocation", str(tmp_path / "checkpoint")).start()
        while q.lastProgress is None or q.lastProgress["batchId"] < 105:
            assert q.isActive
            q.awaitTermination(1)
        # rows are there while the query runs
        assert spark.read.schema(timing.TIMING_DDL).parquet(path).count() >= 40
        q.stop()
        times.wait()
    finally:
        spark.streams.removeListener(times)
    rows = spark.read.schema(timing.TIMING_DDL).parquet(path).orderBy("batch_idx").collect()
    assert [r.batch_idx for r in rows] == list(range(len(rows))) and len(rows) > 100
    assert all(r.n_rows == r.n_scored == 8 for r in rows)
    # values from 100 on have a positive logit
    assert sum(r.n_attacks for r in rows) == max(0, 8 * len(rows) - 100)
    for r in rows:
        assert r.t_inference_ms > 0 and r.t_upstream_ms > 0
        parts = r.t_offsets_ms + r.t_planning_ms + r.t_execution_ms + r.t_commit_ms + r.t_other_ms
        assert r.t_execution_ms > 0 and parts == pytest.approx(max(parts, r.t_total_ms))


# ---- growing files ----

def test_a_file_that_starts_over_is_a_new_run(spark, tmp_path, monkeypatch):
    path, state = str(tmp_path / "live.csv"), str(tmp_path / "state.json")
    schema = spark.createDataFrame([], "b long, a string").schema

    def write(text, mode="a"):
        with open(path, mode) as f:
            f.write(text)

    write("A, b ,c\nx,1,0\ny,oops\n")
    stream = growing.stream_growing_csv(spark, path, schema, state)

    def rows():
        out, _ = drained(spark, stream, str(tmp_path))
        return sorted(tuple(r) for r in out.collect())

    first = [(0, 8, 1, "x"), (0, 14, None, "y")]
    assert rows() == first
    write("z,3")
    assert rows() == first
    write(",9\n\n\"q,r\",4\n")
    first += [(0, 21, 3, "z"), (0, 28, 4, "q,r")]
    assert rows() == first
    write("A, b ,c\nnew,7,7\n", "w")
    assert rows() == first + [(1, 8, 7, "new")]
    write("far,8,7\n")
    assert rows() == first + [(1, 8, 7, "new"), (1, 16, 8, "far")]
    with pytest.raises(ValueError):
        growing.stream_growing_csv(spark, path, spark.createDataFrame([], "d long").schema, state)
    write("one,2,3,4\n")
    with pytest.raises(Exception, match="more than 3 fields"):
        rows()


@pytest.mark.parametrize("size", [1, 3, 7, 64])
def test_ranges_of_a_file_give_every_line_once(tmp_path, monkeypatch, size):
    path = str(tmp_path / "lines")
    lines = ["", "a", "bb" * 40, "", "c,d", "é" * 5, "end"]
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n" + "unfinished")
    monkeypatch.setattr(growing, "SPLIT_BYTES", size)
    monkeypatch.setattr(growing, "_BLOCK", 5)
    reader = growing._LinesReader({"path": path, "state": f"{path}.json"})
    end = reader.latestOffset()
    assert end == {"run": 0, "bytes": os.path.getsize(path) - len("unfinished")}
    got = [(r["row_index"], r["value"]) for p in reader.partitions(reader.initialOffset(), end)
           for batch in reader.read(p) for r in batch.to_pylist()]
    assert [v for _, v in sorted(got)] == lines and len(got) == len({o for o, _ in got})


def test_a_csv_stream_refuses_columns_in_another_order(spark, tmp_path):
    schema = spark.createDataFrame([], "` A` long, b long").schema
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.csv").write_text(" A , b\n1,2\n3\n")
    rows, _ = drained(spark, sscore.stream_flow_csv(spark, str(folder), schema), str(tmp_path))
    assert sorted(tuple(r) for r in rows.collect()) == [(1, 2), (3, None)]
    (folder / "2.csv").write_text("b,a\n1,2\n")
    with pytest.raises(Exception, match="FAILED_READ_FILE"):
        drained(spark, sscore.stream_flow_csv(spark, str(folder), schema), str(tmp_path))
