"""Flows of few packets, many at once: packets packed by shard, and the statistics of whole flows in numpy.

Rows are sorted by flow and time, a flow is a run of neighbouring rows, and each statistic is one reduction
over all runs. The values are those of ``flows._Flow``, which takes a flow in pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

from flowspark.contract import TCP_FLAGS
from flowspark.operators.flows import FLOW_KEY

# rows that are packed together
PACK_ROWS = 1 << 16
PACKETS = pa.schema([
    ("lo_ip", pa.string()), ("lo_port", pa.int32()), ("hi_ip", pa.string()), ("hi_port", pa.int32()),
    ("proto", pa.int32()), ("from_lo", pa.bool_()), ("seq", pa.int64()), ("ts_us", pa.int64()),
    ("total_len", pa.int32()), ("ip_hdr_len", pa.int32()), ("l4_hdr_len", pa.int32()),
    ("tcp_flags", pa.int32()), ("tcp_window", pa.int32())])
_NONE = 1 << 62


# ---- rows as bytes ----

def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with a column ``shard`` as one row per shard and ``PACK_ROWS`` rows: shard, packets."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= PACK_ROWS:
            yield _by_shard(held)
            held, rows = [], 0
    if rows:
        yield _by_shard(held)


def _by_shard(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    t = pa.Table.from_batches(batches)
    if any(t[x].null_count for x in ("from_lo", "seq", "ts_us")):
        raise ValueError("a packet without address, number or time")
    shard = t["shard"].to_numpy()
    order = np.argsort(shard, kind="stable")
    rows = one_batch(t.select(PACKETS.names).cast(PACKETS).combine_chunks().take(order))
    starts = group_starts(shard[order])
    ends = np.append(starts[1:], len(order))
    return pa.RecordBatch.from_arrays(
        [pa.array(shard[order][starts], pa.int32()),
         pa.array([to_bytes(rows.slice(a, b - a)) for a, b in zip(starts.tolist(), ends.tolist())], pa.binary())],
        names=["shard", "packets"])


def one_batch(t: pa.Table) -> pa.RecordBatch:
    batches = t.combine_chunks().to_batches()
    return batches[0] if batches else pa.RecordBatch.from_pylist([], schema=t.schema)


def to_bytes(rows: pa.RecordBatch) -> bytes:
    return rows.serialize().to_pybytes()


def from_bytes(packets: bytes) -> pa.RecordBatch:
    return pa.ipc.read_record_batch(pa.py_buffer(packets), PACKETS)


# ---- groups of rows ----

def group_starts(group: np.ndarray) -> np.ndarray:
    """Where the groups of a sorted array begin."""
    return np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)


def flow_codes(t: pa.Table) -> np.ndarray:
    """A number from 0 for the flow key of each row; a NULL is a value like others."""
    code = np.zeros(t.num_rows, np.int64)
    for name in FLOW_KEY:
        values = t[name].combine_chunks().dictionary_encode(null_encoding="encode")
        code = pd.factorize(code * len(values.dictionary) + values.indices.to_numpy())[0]
    return code


def _moments(values: np.ndarray, group: np.ndarray, k: int, prefix: str) -> dict[str, np.ndarray]:
    """mean, sample std, max, min of the values of each of ``k`` groups; zeros where there are none."""
    out = {x: np.zeros(k) for x in ("mean", "std", "max", "min")}
    if len(values):
        values, starts = values.astype(np.float64), group_starts(group)
        at, n = group[starts], np.diff(np.append(starts, len(values)))
        mean = np.add.reduceat(values, starts) / n
        away = values - np.repeat(mean, n)
        out["mean"][at], out["std"][at] = mean, np.sqrt(np.add.reduceat(away * away, starts) / np.maximum(n - 1, 1))
        out["max"][at], out["min"][at] = np.maximum.reduceat(values, starts), np.minimum.reduceat(values, starts)
    return {f"{prefix}{x}": v for x, v in out.items()}


def _average(name: str, n: np.ndarray, total: np.ndarray, squares: np.ndarray) -> dict[str, np.ndarray]:
    """Mean and sample deviation from count, sum and sum of squares, in exact integers until the root."""
    avg, std, some, two = np.full(len(n), np.nan), np.full(len(n), np.nan), n > 0, n > 1
    avg[some] = total[some] / n[some]
    count, total, squares = (x[two].astype(object) for x in (n, total, squares))
    std[two] = np.sqrt(((count * squares - total * total) / (count * (count - 1))).astype(np.float64))
    return {f"{name}_avg": avg, f"{name}_std": std}


def _nullable(values: np.ndarray, known: np.ndarray | None = None) -> pd.arrays.IntegerArray:
    """Integers that are NULL where they are not ``known``, or are the extremum of nothing."""
    return pd.arrays.IntegerArray(values.astype(np.int64), np.abs(values) == _NONE if known is None else ~known)


def closed_flows(t: pa.Table, starts: np.ndarray, activity_us: int) -> dict:
    """Key, totals and order features of whole flows, one array each; rows sorted by flow and time, flows begin at ``starts``."""
    k, n = len(starts), np.diff(np.append(starts, t.num_rows))
    group = np.repeat(np.arange(k), n)
    seq, times = t["seq"].to_numpy(), t["ts_us"].to_numpy()
    from_lo = t["from_lo"].to_numpy()

    def values(name: str) -> tuple[np.ndarray, np.ndarray]:
        """A column with 0 for NULL, and where it is not NULL."""
        return t[name].fill_null(0).to_numpy().astype(np.int64), t[name].is_valid().to_numpy()

    def total(x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x.astype(np.int64), starts)

    def least(x: np.ndarray, among: np.ndarray) -> np.ndarray:
        return np.minimum.reduceat(np.where(among, x, _NONE), starts)

    def most(x: np.ndarray, among: np.ndarray) -> np.ndarray:
        return np.maximum.reduceat(np.where(among, x, -_NONE), starts)

    (size, has_size), (ip_hdr, has_ip_hdr), (hdr, has_hdr) = (values(x) for x in ("total_len", "ip_hdr_len", "l4_hdr_len"))
    (flags, is_tcp), (window, has_window) = values("tcp_flags"), values("tcp_window")
    data = is_tcp & has_size & has_ip_hdr & has_hdr & (size - ip_hdr - hdr > 0)
    window = np.where(has_window, window, -1)
    by_arrival = np.lexsort((from_lo, seq, group))

    out = {}
    for name in FLOW_KEY:
        key = t[name].take(pa.array(starts))
        out[name] = key.to_pandas() if pa.types.is_string(key.type) else \
            _nullable(key.fill_null(0).to_numpy(), key.is_valid().to_numpy())
    ends = starts + n - 1
    out |= {"n": n, "first_ts": times[by_arrival[starts]], "last_ts": times[by_arrival[ends]],
            **{f"{name}_n": total((flags & bit) != 0) for name, bit in TCP_FLAGS.items()},
            "len_min": _nullable(least(size, has_size)), "len_max": _nullable(most(size, has_size)),
            **_average("len", n, total(size), total(size * size))}
    for side, own in (("lo", from_lo), ("hi", ~from_lo)):
        count = total(own)
        some = count > 0
        mine = by_arrival[own[by_arrival]]
        at = group_starts(group[mine])
        owner, head = group[mine][at], mine[at]
        tail = mine[np.append(at, len(mine))[1:] - 1]
        first_seq, iat_total = np.zeros(k, np.int64), np.zeros(k)
        first_seq[owner], iat_total[owner] = seq[head], times[tail] - times[head]
        inside = group[mine][1:] == group[mine][:-1]
        tcp = mine[is_tcp[mine]]
        at, win = group_starts(group[tcp]), np.zeros(k, np.int64)
        win[group[tcp][at]] = window[tcp[at]]
        own_size = np.where(own, size, 0)
        out |= {
            f"{side}_n": count, f"{side}_data": total(own & data),
            **{f"{side}_{x}": total(own & ((flags & TCP_FLAGS[x]) != 0)) for x in ("psh", "urg")},
            f"{side}_first_seq": _nullable(first_seq, some), f"{side}_bytes": _nullable(total(own_size), some),
            f"{side}_hdr": _nullable(total(np.where(own, hdr, 0)), some),
            f"{side}_len_min": _nullable(least(size, own & has_size)), f"{side}_len_max": _nullable(most(size, own & has_size)),
            f"{side}_win": _nullable(win, total(own & is_tcp) > 0),
            f"{side}_seg_min": _nullable(least(hdr, own & is_tcp & has_hdr)),
            **_average(f"{side}_len", count, total(own_size), total(own_size * own_size)),
            f"{side}_iat_total": iat_total,
            **_moments(np.diff(times[mine])[inside], group[mine][1:][inside], k, f"{side}_iat_")}
    # gaps in time order: the one before each row that does not begin a flow
    gap = np.diff(times, prepend=0)
    follows = np.append(False, group[1:] == group[:-1])
    rests = follows & (gap > activity_us)
    begins = np.flatnonzero(rests | ~follows)
    periods = times[np.append(begins[1:], len(times)) - 1] - times[begins]
    several = n[group[begins]] > 1
    return out | _moments(gap[follows], group[follows], k, "flow iat ") | \
        _moments(periods[several], group[begins][several], k, "active ") | _moments(gap[rests], group[rests], k, "idle ")
