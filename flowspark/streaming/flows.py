"""Continuous flow building: keyed state of open flows, closed by event-time timers.

Flows are dealt over shards. The state of a shard holds the packets of its small open flows together: an update
appends them in one entry, and a timer closes all flows that have ended at once, so state calls and Python steps
are per shard, not per flow. A flow with many open packets gets state of its own: time slices (counts, sums,
extrema and the distinct times in it) and chunks of arrival numbers. Small neighbours share a state entry,
a large one has its own, so an update touches few entries of limited size, and closing such a flow handles one of
them at a time: pieces are sorted inside and then chained, as the batch operators do.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from flowspark.contract import ACTIVITY_TIMEOUT_US, FEATURES, FLOW_METADATA, FLOW_TIMEOUT_US, TCP_FLAGS
from flowspark.operators.flows import FLOW_KEY, SLICE_US, name_directions, named_totals, with_flow_key
from flowspark.streaming import small_flows as small

# arrival numbers per entry of a flow's arrival state
ARRIVAL_CHUNK = 1 << 16
# neighbouring slices or chunks per state entry, and the bytes of times from which one has its own entry
PAGE, OWN_BYTES = 64, 1 << 13
# parts of the state; open packets from which a flow has state of its own
SHARDS, LARGE = 128, 1 << 14
# packets of a shard taken at a time, per state entry, and new ones that are looked through without waiting for a timer
STEP, RUN, PENDING = 1 << 18, 1 << 16, 1 << 19
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STORE = "spark.sql.streaming.stateStore.providerClass"
_NONE = 1 << 62

# totals of a side, in the order of the state, with how two pieces combine
_SIDE = [("n", "sum"), ("bytes", "sum"), ("squares", "sum"), ("psh", "sum"), ("urg", "sum"), ("hdr", "sum"),
         ("data", "sum"), ("len_min", "min"), ("seg_min", "min"), ("win_seq", "min"), ("len_max", "max"), ("win", "first")]
_TOTALS = [(f"{side}_{name}", how) for side in ("lo", "hi") for name, how in _SIDE] + \
    [(f"{name}_n", "sum") for name in TCP_FLAGS]
_AT = {name: i for i, (name, _) in enumerate(_TOTALS)}
_EMPTY = {"sum": 0, "min": _NONE, "max": -_NONE, "first": -1}
_SUM, _MIN, _MAX = (np.array([how == k for _, how in _TOTALS]) for k in ("sum", "min", "max"))


# ---- pieces ----

def _columns(t: pa.Table) -> dict[str, pa.ChunkedArray]:
    """What the totals of a piece are made of, one column per total."""
    def long(x):
        return pc.cast(x, pa.int64())

    flags, size, hdr = t["tcp_flags"], long(t["total_len"]), long(t["l4_hdr_len"])
    is_tcp = pc.is_valid(flags)
    payload = pc.subtract(pc.subtract(size, long(t["ip_hdr_len"])), hdr)

    def has(bit):
        return pc.fill_null(pc.not_equal(pc.bit_wise_and(flags, pa.scalar(bit, flags.type)), 0), False)

    out = {}
    for side, own in (("lo", t["from_lo"]), ("hi", pc.invert(t["from_lo"]))):
        tcp = pc.and_(own, is_tcp)
        none = pa.scalar(None, pa.int64())
        out |= {
            f"{side}_n": long(own), f"{side}_bytes": pc.if_else(own, size, 0),
            f"{side}_squares": pc.if_else(own, pc.multiply(size, size), 0),
            f"{side}_psh": long(pc.and_(own, has(TCP_FLAGS["psh"]))), f"{side}_urg": long(pc.and_(own, has(TCP_FLAGS["urg"]))),
            f"{side}_hdr": pc.if_else(own, hdr, 0), f"{side}_data": long(pc.and_(tcp, pc.greater(payload, 0))),
            f"{side}_len_min": pc.if_else(own, size, none), f"{side}_seg_min": pc.if_else(tcp, hdr, none),
            f"{side}_win_seq": pc.if_else(tcp, t["seq"], none), f"{side}_len_max": pc.if_else(own, size, none),
            f"{side}_win": pc.if_else(tcp, pc.fill_null(long(t["tcp_window"]), -1), none)}
    return out | {f"{name}_n": long(has(bit)) for name, bit in TCP_FLAGS.items()}


def _packed(lists: pa.ListArray) -> pa.Array:
    """Lists of longs as their bytes."""
    values = lists.flatten()
    cuts = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy())) * 8
    data = np.ascontiguousarray(values.to_numpy(zero_copy_only=False).astype("<i8"))
    return pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(data)])


def _pieces(batches: Iterator[pa.RecordBatch], slice_us: int) -> Iterator[pa.RecordBatch]:
    """One row per flow and time slice of an Arrow batch: totals, and (arrival number, side) with time of each packet."""
    folds = {"sum": "sum", "min": "min", "max": "max", "first": "first"}
    for batch in batches:
        if not batch.num_rows:
            continue
        # the first window of a side is that of its first packet
        t = pa.Table.from_batches([batch]).sort_by("seq")
        times = t["ts_us"].to_numpy()
        marks = t["seq"].to_numpy() * 2 + t["from_lo"].to_numpy(zero_copy_only=False)
        work = pa.table({**{k: t[k] for k in FLOW_KEY}, "slice": pa.array(times // slice_us), "marks": pa.array(marks),
                         "times": t["ts_us"], **_columns(t)})
        made = work.group_by([*FLOW_KEY, "slice"], use_threads=False).aggregate(
            [(name, folds[how]) for name, how in _TOTALS] + [("marks", "list"), ("times", "list")])
        totals = np.stack([pc.fill_null(made[f"{name}_{folds[how]}"], _EMPTY[how]).to_numpy() for name, how in _TOTALS],
                          axis=1).astype(np.int64)
        cuts = np.arange(len(totals) + 1, dtype=np.int32) * len(_TOTALS)
        yield pa.RecordBatch.from_arrays(
            [*[made[k].combine_chunks() for k in [*FLOW_KEY, "slice"]],
             pa.ListArray.from_arrays(pa.array(cuts), pa.array(totals.ravel())),
             *[_packed(made[f"{x}_list"].combine_chunks()) for x in ("marks", "times")]],
            names=[*FLOW_KEY, "slice", "totals", "marks", "times"])


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Totals of two pieces together."""
    out = np.where(_SUM, a + b, np.where(_MIN, np.minimum(a, b), np.maximum(a, b)))
    for side in ("lo", "hi"):
        first = a if a[_AT[f"{side}_win_seq"]] <= b[_AT[f"{side}_win_seq"]] else b
        out[_AT[f"{side}_win"]] = first[_AT[f"{side}_win"]]
    return out


# ---- statistics that chain ----

class Moments:
    """Count, mean, squared deviations, extrema of values that come in pieces."""

    def __init__(self):
        self.n, self.mean, self.squares, self.min, self.max = 0, 0.0, 0.0, math.inf, -math.inf

    def add(self, values: np.ndarray) -> None:
        if len(values):
            mean = float(values.mean())
            away = values - mean
            self.merge(len(values), mean, float((away * away).sum()), float(values.min()), float(values.max()))

    def merge(self, n: int, mean: float, squares: float, least: float, most: float) -> None:
        if n:
            total, step = self.n + n, mean - self.mean
            self.squares += squares + step * step * self.n * n / total
            self.mean += step * n / total
            self.n, self.min, self.max = total, min(self.min, least), max(self.max, most)

    def shown(self, prefix: str, sep: str = "_") -> dict[str, float]:
        """mean, sample std, max, min; zeros where there are no values."""
        std = math.sqrt(max(self.squares, 0.0) / (self.n - 1)) if self.n > 1 else 0.0
        stats = (self.mean, std, self.max, self.min) if self.n else (0.0, 0.0, 0.0, 0.0)
        return {f"{prefix}{sep}{k}": float(v) for k, v in zip(("mean", "std", "max", "min"), stats)}


class _Flow:
    """A flow that is being closed: slices in time order, then arrivals in arrival order."""

    def __init__(self, begin: int):
        self.begin, self.end = begin, begin
        self.totals = np.array([_EMPTY[how] for _, how in _TOTALS], np.int64)
        self.gaps, self.active, self.idle = Moments(), [], []
        self.slices: list[int] = []
        self.first = self.last = None
        self.sides = {0: [None, None, None, Moments()], 1: [None, None, None, Moments()]}

    def add_slice(self, number: int, totals: np.ndarray, times: np.ndarray, activity_us: int) -> None:
        first, last = int(times[0]), int(times[-1])
        if self.slices:
            border = first - self.end
            self.gaps.merge(1, border, 0.0, border, border)
            if border > activity_us:
                self.active.append(self.end - self.begin_active)
                self.idle.append(border)
                self.begin_active = first
        else:
            self.begin_active = first
        self.gaps.add(np.diff(times).astype(np.float64))
        copies = int(totals[_AT["lo_n"]] + totals[_AT["hi_n"]]) - len(times)
        self.gaps.merge(copies, 0.0, 0.0, 0.0, 0.0)
        self.totals = _joined(self.totals, totals)
        self.slices.append(number)
        self.end = last

    def add_arrivals(self, marks: np.ndarray, times: np.ndarray) -> None:
        """Packets of the next arrival chunk, sorted by arrival."""
        if not len(marks):
            return
        if self.first is None:
            self.first = int(times[0])
        self.last = int(times[-1])
        for side in (0, 1):
            own = times[(marks & 1) == side]
            if len(own):
                state = self.sides[side]
                if state[0] is None:
                    state[0], state[1] = int(marks[(marks & 1) == side][0] >> 1), int(own[0])
                    gaps = np.diff(own)
                else:
                    gaps = np.diff(np.append(state[2], own))
                state[3].add(gaps.astype(np.float64))
                state[2] = int(own[-1])

    def row(self) -> dict:
        """Totals and order features under the names the batch operators use."""
        t = {name: int(x) for (name, _), x in zip(_TOTALS, self.totals)}
        out = {"n": t["lo_n"] + t["hi_n"], "first_ts": self.first, "last_ts": self.last,
               **{f"{name}_n": t[f"{name}_n"] for name in TCP_FLAGS}}
        sizes = [t[x] for x in ("lo_len_min", "lo_len_max", "hi_len_min", "hi_len_max") if abs(t[x]) < _NONE]
        both = {x: t[f"lo_{x}"] + t[f"hi_{x}"] for x in ("n", "bytes", "squares")}
        out |= {"len_min": min(sizes, default=None), "len_max": max(sizes, default=None), **_average("len", both)}
        for side, code in (("lo", 1), ("hi", 0)):
            first_seq, head, tail, gaps = self.sides[code]
            some = t[f"{side}_n"] > 0
            out |= {f"{side}_{x}": t[f"{side}_{x}"] for x in ("n", "psh", "urg", "data")}
            out |= {f"{side}_first_seq": first_seq,
                    **{f"{side}_{x}": t[f"{side}_{x}"] if some and abs(t[f"{side}_{x}"]) < _NONE else None
                       for x in ("bytes", "hdr", "len_min", "len_max")},
                    **_average(f"{side}_len", {x: t[f"{side}_{x}"] for x in ("n", "bytes", "squares")}),
                    f"{side}_win": t[f"{side}_win"] if t[f"{side}_win_seq"] < _NONE else None,
                    f"{side}_seg_min": t[f"{side}_seg_min"] if t[f"{side}_seg_min"] < _NONE else None,
                    f"{side}_iat_total": float(tail - head) if some else 0.0, **gaps.shown(f"{side}_iat")}
        out |= self.gaps.shown("flow iat", " ")
        for name, values in (("active", [*self.active, self.end - self.begin_active]), ("idle", self.idle)):
            moments = Moments()
            if out["n"] > 1:
                moments.add(np.array(values, np.float64))
            out |= moments.shown(name, " ")
        return out


def _average(name: str, side: dict[str, int]) -> dict[str, float | None]:
    """Mean and sample deviation from count, sum and sum of squares, in exact integers until the root."""
    n, total = side["n"], side["bytes"]
    squares = n * side["squares"] - total * total
    return {f"{name}_avg": total / n if n else None,
            f"{name}_std": math.sqrt(squares / (n * (n - 1))) if n > 1 else None}


_LONGS = ["n", "first_ts", "last_ts", *[f"{x}_n" for x in TCP_FLAGS], "len_min", "len_max",
          *[f"{s}_{x}" for s in ("lo", "hi") for x in (
              "n", "psh", "urg", "data", "first_seq", "bytes", "hdr", "len_min", "len_max", "win", "seg_min")]]
_DOUBLES = ["len_avg", "len_std", *[f"{s}_{x}" for s in ("lo", "hi") for x in (
    "len_avg", "len_std", "iat_total", "iat_mean", "iat_std", "iat_max", "iat_min")],
    *[f"{x} {s}" for x in ("flow iat", "active", "idle") for s in ("mean", "std", "max", "min")]]
_KEY_DDL = "lo_ip string, lo_port int, hi_ip string, hi_port int, proto int"
_CLOSED_DDL = f"kind string, {_KEY_DDL}, " + ", ".join(
    [f"`{x}` long" for x in _LONGS] + [f"`{x}` double" for x in _DOUBLES])
_CLOSED_COLUMNS = ["kind", *FLOW_KEY, *_LONGS, *_DOUBLES]


# ---- state ----

class _Pages:
    """Numbered pairs of byte strings of one key; every access is a call to the state store, so small neighbours share one."""

    def __init__(self, handle: StatefulProcessorHandle, name: str):
        # a number without bytes in its page has them in an entry of its own
        self.pages = handle.getMapState(f"{name}_pages", "page long", "numbers array<long>, a array<binary>, b array<binary>")
        self.own = handle.getMapState(name, "number long", "a binary, b binary")

    def _page(self, page: int) -> dict[int, tuple]:
        found = self.pages.getValue((page,))
        return {n: (a, b) for n, a, b in zip(*found)} if found else {}

    def _save(self, page: int, items: dict[int, tuple]) -> None:
        if items:
            self.pages.updateValue((page,), (list(items), [a for a, _ in items.values()], [b for _, b in items.values()]))
        else:
            self.pages.removeKey((page,))

    def merge(self, added: dict, join) -> None:
        """Add pairs of arrays; ``join(old pair or None, new)`` gives the pair to keep."""
        numbers = sorted(added)
        for page in sorted({n // PAGE for n in numbers}):
            items = self._page(page)
            for n in [x for x in numbers if x // PAGE == page]:
                old = items.get(n)
                if old is not None and old[0] is None:
                    self.own.updateValue((n,), self._bytes(join(self._pair(self.own.getValue((n,))), added[n])))
                    continue
                a, b = self._bytes(join(self._pair(old), added[n]))
                if len(b) > OWN_BYTES:
                    self.own.updateValue((n,), (a, b))
                    a = b = None
                items[n] = (a, b)
            self._save(page, items)

    def numbers(self) -> list[int]:
        """All numbers in order."""
        return sorted(n for k in list(self.pages.keys()) for n in self._page(k[0]))

    def visit(self, step) -> None:
        """Call ``step(number, a, b)`` in order; it returns the pair to keep in its place, or None to remove the number."""
        for page in sorted(k[0] for k in self.pages.keys()):
            items, changed = self._page(page), False
            for n in sorted(items):
                own = items[n][0] is None
                pair = self._pair(self.own.getValue((n,)) if own else items[n])
                kept = step(n, *pair)
                if kept is None:
                    del items[n]
                    if own:
                        self.own.removeKey((n,))
                elif kept[0] is not pair[0]:
                    if own:
                        self.own.updateValue((n,), self._bytes(kept))
                    else:
                        items[n] = self._bytes(kept)
                else:
                    continue
                changed = True
            if changed:
                self._save(page, items)

    def remove(self, numbers: set[int]) -> None:
        for page in sorted({n // PAGE for n in numbers}):
            items = self._page(page)
            for n in [x for x in items if x in numbers]:
                if items.pop(n)[0] is None:
                    self.own.removeKey((n,))
            self._save(page, items)

    @staticmethod
    def _pair(stored):
        return None if stored is None else tuple(np.frombuffer(x, "<i8") for x in stored)

    @staticmethod
    def _bytes(pair) -> tuple[bytes, bytes]:
        return tuple(np.ascontiguousarray(x, "<i8").tobytes() for x in pair)


def _joined_slices(old, parts: list) -> tuple[np.ndarray, np.ndarray]:
    parts = parts if old is None else [*parts, old]
    merged = parts[0][0]
    for totals, _ in parts[1:]:
        merged = _joined(merged, totals)
    return merged, np.unique(np.concatenate([t for _, t in parts]))


def _joined_arrivals(old, new) -> tuple[np.ndarray, np.ndarray]:
    return new if old is None else tuple(np.append(a, b) for a, b in zip(old, new))


class FlowState(StatefulProcessor):
    """State of the open flows of one key."""

    def __init__(self, timeout_us: int, activity_us: int, slice_us: int):
        self.timeout_us, self.activity_us, self.slice_us = timeout_us, activity_us, slice_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slices, self.arrivals = _Pages(handle, "slices"), _Pages(handle, "arrivals")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # 0 stands for no watermark yet
        watermark = timerValues.getCurrentWatermarkInMs() * 1000 or -_NONE
        late, slices, marks, times = 0, {}, [], []
        for part in rows:
            for number, totals, m, t in zip(part["slice"], part["totals"], part["marks"], part["times"]):
                t = np.frombuffer(t, "<i8")
                if (number + 1) * self.slice_us <= watermark:
                    late += len(t)
                    continue
                slices.setdefault(int(number), []).append((np.array(totals, np.int64), t))
                marks.append(np.frombuffer(m, "<i8"))
                times.append(t)
        if slices:
            self._store(slices, np.concatenate(marks), np.concatenate(times))
        if late:
            row = dict(zip(_CLOSED_COLUMNS, ["late", *key])) | {"n": late}
            yield _frame([row])

    def _store(self, slices: dict, marks: np.ndarray, times: np.ndarray) -> None:
        self.slices.merge(slices, _joined_slices)
        chunk = (marks >> 1) // ARRIVAL_CHUNK
        self.arrivals.merge({n: (marks[chunk == n], times[chunk == n]) for n in np.unique(chunk).tolist()}, _joined_arrivals)
        # timers stand at multiples of the timeout, so a busy flow has few of them
        quiet = int(times.max()) + self.timeout_us + self.slice_us
        self.handle.registerTimer((quiet // self.timeout_us + 1) * self.timeout_us // 1000 + 1)

    def _may_end(self, watermark: int) -> bool:
        """Whether the numbers of the slices leave room for the end of a flow, so that times need not be read to see that none ended."""
        numbers = self.slices.numbers()
        wide = [(b - a + 1) * self.slice_us > self.timeout_us for a, b in zip(numbers, numbers[1:])] + [True]
        return any(w and n * self.slice_us + self.timeout_us + self.slice_us <= watermark for n, w in zip(numbers, wide))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        if not self._may_end(watermark):
            return
        flows: list[_Flow] = []

        def add_slice(number, totals, t):
            if not flows or int(t[0]) - flows[-1].end > self.timeout_us:
                flows.append(_Flow(int(t[0])))
            flows[-1].add_slice(number, totals, t, self.activity_us)
            return totals, t

        self.slices.visit(add_slice)
        # a packet that is not late any more would come a timeout after the end
        ended = [f for f in flows if f.end + self.timeout_us + self.slice_us <= watermark]
        if not ended:
            return
        begins = np.array([f.begin for f in flows])

        def add_arrivals(number, m, t):
            order = np.argsort(m, kind="stable")
            m, t = m[order], t[order]
            flow = np.searchsorted(begins, t, "right") - 1
            for i in np.unique(flow[flow < len(ended)]).tolist():
                ended[i].add_arrivals(m[flow == i], t[flow == i])
            rest = flow >= len(ended)
            return (m[rest], t[rest]) if rest.any() else None

        self.arrivals.visit(add_arrivals)
        self.slices.remove({number for f in ended for number in f.slices})
        yield _frame([dict(zip(_CLOSED_COLUMNS, ["flow", *key])) | f.row() for f in ended])


class _OwnState:
    """Handle that gives map states of one flow at a time, kept in map states of a shard under the flow's key."""

    def __init__(self, handle: StatefulProcessorHandle):
        self.handle, self.flow = handle, None

    def getMapState(self, name: str, keys: str, values: str) -> _OwnMap:
        return _OwnMap(self, self.handle.getMapState(name, f"{_KEY_DDL}, {keys}", values))

    def registerTimer(self, ms: int) -> None:
        self.handle.registerTimer(ms)


class _OwnMap:
    def __init__(self, owner: _OwnState, rows):
        self.owner, self.rows = owner, rows

    def getValue(self, key: tuple):
        return self.rows.getValue((*self.owner.flow, *key))

    def updateValue(self, key: tuple, value: tuple) -> None:
        self.rows.updateValue((*self.owner.flow, *key), value)

    def removeKey(self, key: tuple) -> None:
        self.rows.removeKey((*self.owner.flow, *key))

    def keys(self) -> Iterator[tuple]:
        return iter([tuple(k)[len(FLOW_KEY):] for k in self.rows.keys() if tuple(k)[:len(FLOW_KEY)] == self.owner.flow])


class ShardState(StatefulProcessor):
    """State of the open flows of one shard: runs of packets of small flows, and own state for each large flow."""

    def __init__(self, timeout_us: int, activity_us: int, slice_us: int, large: int = LARGE):
        self.timeout_us, self.activity_us, self.slice_us, self.large_from = timeout_us, activity_us, slice_us, large
        self.looked = {}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.own = handle, _OwnState(handle)
        # the number of packets, and whether they have been looked through, stand in the key: it is read without them
        self.runs = handle.getMapState("runs", "number long, kept boolean, n long", "packets binary")
        self.large = handle.getMapState("large", _KEY_DDL, "since long")
        self.flow = FlowState(self.timeout_us, self.activity_us, self.slice_us)
        self.flow.init(self.own)

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # 0 stands for no watermark yet
        watermark = timerValues.getCurrentWatermarkInMs() * 1000 or -_NONE
        late, held, n = [], [], 0
        for part in rows:
            for packets in part["packets"]:
                held.append(small.from_bytes(packets))
                n += held[-1].num_rows
                if n >= STEP:
                    yield from self._take(held, watermark, late)
                    held, n = [], 0
        if held:
            yield from self._take(held, watermark, late)
        if late:
            counts = pa.concat_tables(late).group_by(FLOW_KEY).aggregate([("n", "sum")])
            yield _frame({"kind": "late", **{x: counts[x].to_pandas(integer_object_nulls=True) for x in FLOW_KEY},
                          "n": counts["n_sum"].to_numpy()})

    def _take(self, held: list[pa.RecordBatch], watermark: int, late: list[pa.Table]) -> Iterator[pd.DataFrame]:
        """Store packets; those that are late are counted in ``late``."""
        t = pa.Table.from_batches(held).combine_chunks()
        passed = (t["ts_us"].to_numpy() // self.slice_us + 1) * self.slice_us <= watermark
        if passed.any():
            late.append(t.filter(pa.array(passed)).group_by(FLOW_KEY).aggregate([([], "count_all")]).rename_columns([*FLOW_KEY, "n"]))
            t = t.filter(pa.array(~passed)).combine_chunks()
        if not t.num_rows:
            return
        earliest = int(t["ts_us"].to_numpy().min())
        t = self._without_large(t, small.flow_codes(t) if t.num_rows > self.large_from else None)
        runs = [tuple(k) for k in self.runs.keys()]
        self._save(t, max((k[0] for k in runs), default=-1) + 1, kept=False)
        self._register(earliest)
        new, old = (sum(n for _, kept, n in runs if kept == x) for x in (False, True))
        if new + t.num_rows > max(PENDING, old):
            yield from self._close(watermark)

    def _register(self, end: int) -> None:
        """A timer at which a flow that ends here is closed; timers stand at multiples of the timeout, so they are few."""
        quiet = end + self.timeout_us + self.slice_us
        self.handle.registerTimer((quiet // self.timeout_us + 1) * self.timeout_us // 1000 + 1)

    def _save(self, t: pa.Table, at: int, kept: bool) -> None:
        for i in range(0, t.num_rows, RUN):
            rows = small.one_batch(t.slice(i, RUN))
            self.runs.updateValue((at + i // RUN, kept, rows.num_rows), (small.to_bytes(rows),))

    def _without_large(self, t: pa.Table, code: np.ndarray | None) -> pa.Table:
        """Gives packets of large flows, also of those that are large with these, to their own state; returns the others."""
        large = [tuple(k) for k in self.large.keys()]
        if code is not None:
            first, n = np.unique(code, return_index=True, return_counts=True)[1:]
            grown = t.select(FLOW_KEY).take(pa.array(first[n > self.large_from])).to_pylist()
            for key in (tuple(x.values()) for x in grown):
                if key not in large:
                    self.large.updateValue(key, (int(t["ts_us"][0].as_py()),))
                    large.append(key)
        if not large:
            return t
        columns = [pa.array([key[i] for key in large], small.PACKETS.field(x).type) for i, x in enumerate(FLOW_KEY)]
        both = pa.concat_tables([t.select(FLOW_KEY), pa.table(columns, names=FLOW_KEY)])
        code = small.flow_codes(both)
        for key, number in zip(large, code[t.num_rows:]):
            own = code[:t.num_rows] == number
            if own.any():
                self.own.flow = key
                pieces = _pieces([small.one_batch(t.filter(pa.array(own)))], self.slice_us)
                # what is late has been taken out
                list(self.flow.handleInputRows(key, (x.to_pandas() for x in pieces), TimerValues(0, 0)))
        return t.filter(pa.array(~np.isin(code[:t.num_rows], code[t.num_rows:]))).combine_chunks()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        # a later timer of the same batch finds nothing new
        if self.looked.get(tuple(key)) == watermark:
            return
        self.looked[tuple(key)] = watermark
        yield from self._close(watermark)
        for flow in [tuple(k) for k in self.large.keys()]:
            self.own.flow = flow
            yield from self.flow.handleExpiredTimer(flow, timerValues, expiredTimerInfo)
            if not list(self.flow.slices.pages.keys()):
                self.large.removeKey(flow)

    def _close(self, watermark: int) -> Iterator[pd.DataFrame]:
        """Close the small flows that have ended; what is left is stored anew."""
        numbers = sorted(tuple(k) for k in self.runs.keys())
        if not numbers:
            return
        t = pa.Table.from_batches([small.from_bytes(self.runs.getValue(k)[0]) for k in numbers]).combine_chunks()
        t = self._without_large(t, None)
        code, times = small.flow_codes(t), t["ts_us"].to_numpy()
        order = np.lexsort((times, code))
        times, code = times[order], code[order]
        begins = np.append(True, (code[1:] != code[:-1]) | (np.diff(times) > self.timeout_us))[:len(times)]
        starts = np.flatnonzero(begins)
        ends = times[np.append(starts, len(times))[1:] - 1]
        # a packet that is not late any more would come a timeout after the end
        ended = ends + self.timeout_us + self.slice_us <= watermark
        closed = np.repeat(ended, np.diff(np.append(starts, len(times))))
        if closed.any():
            flows = t.take(pa.array(order[closed])).combine_chunks()
            yield _frame({"kind": "flow", **small.closed_flows(flows, np.flatnonzero(begins[closed]), self.activity_us)})
        elif len(numbers) == 1 and numbers[0][1] and t.num_rows == numbers[0][2]:
            self._register(int(ends.min()))
            return
        for k in numbers:
            self.runs.removeKey(k)
        rest = t.take(pa.array(np.sort(order[~closed]))).combine_chunks()
        if rest.num_rows:
            self._register(int(ends[~ended].min()))
            rest = self._without_large(rest, small.flow_codes(rest) if rest.num_rows > self.large_from else None)
            self._save(rest, 0, kept=True)


_TYPES = {**{x: ("Int64", "int64") for x in [*_LONGS, "lo_port", "hi_port", "proto"]}, **{x: ("float64",) for x in _DOUBLES}}


def _frame(rows: list[dict] | dict) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=_CLOSED_COLUMNS)
    found = {x: str(kind) for x, kind in out.dtypes.items()}
    return out.astype({x: kinds[0] for x, kinds in _TYPES.items() if found[x] not in kinds})


# ---- stream ----

def use_keyed_state(spark: SparkSession) -> None:
    """Keep the state of streams that start from now on in RocksDB, which timers and keyed maps need."""
    spark.conf.set(_STORE, ROCKSDB)


def stream_flows(packets: DataFrame, timeout_us: int = FLOW_TIMEOUT_US, late_us: int = 60_000_000,
                 activity_timeout_us: int = ACTIVITY_TIMEOUT_US, slice_us: int = SLICE_US, shards: int = SHARDS,
                 large: int = LARGE) -> DataFrame:
    """Closed flows of a packet stream, with the columns of the batch flow table, and counts of late packets.

    A row of ``kind`` ``flow`` is a flow that ended with more than ``timeout_us`` of silence: ``first_ts``,
    ``n_packets``, the identification columns and all features, equal to those of ``flow_table`` over
    ``split_on_timeout`` of the same packets, in whatever order they arrive. A row of ``kind`` ``late`` counts,
    in ``n_packets``, packets of a flow and batch whose time slice the watermark (``late_us`` behind the
    newest packet) had passed; those are in no flow. State of a flow is gone when it is closed. The
    query needs RocksDB state, which is set for the session.

    Flows are dealt over ``shards`` by their key; one task holds the packets of the small open flows of a shard at
    a time, so more open flows take more shards. A flow of more than ``large`` open packets is held in pieces.
    """
    width = min(slice_us, activity_timeout_us, timeout_us)
    use_keyed_state(packets.sparkSession)
    timed = packets.withColumn("__ts", F.timestamp_micros("ts_us")).withWatermark("__ts", f"{late_us // 1000} milliseconds")
    shard = F.pmod(F.xxhash64(*FLOW_KEY), F.lit(shards)).cast("int").alias("shard")
    keyed = with_flow_key(timed).select(*small.PACKETS.names, shard)
    closed = keyed.mapInArrow(small.packed, "shard int, packets binary").groupBy("shard").transformWithStateInPandas(
        ShardState(timeout_us, activity_timeout_us, width, large), _CLOSED_DDL, "append", "eventTime")
    order = [f"`{x} {s}`" for x in ("flow iat", "active", "idle") for s in ("mean", "std", "max", "min")]
    gaps = [f"{s}_iat_{x}" for s in ("lo", "hi") for x in ("total", "mean", "std", "max", "min")]
    table = named_totals(closed, FLOW_KEY, "kind", *order, *gaps)
    return table.select("*", *name_directions(table)).select(
        "kind", "first_ts", "n_packets", *[f"`{x}`" for x in [*FLOW_METADATA, *FEATURES]])
