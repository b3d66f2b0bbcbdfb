"""Packet captures to packet rows.

One capture file is one unit of work: rotated captures are read in parallel, each decoded
by a small numpy helper inside the task. Record boundaries are chained, so they are walked one
by one; all header fields are then gathered for the whole file at once.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowspark.contract import PROTO_TCP, PROTO_UDP
from flowspark.operators.flows import PACKET_SCHEMA

# --- fixed values: capture file magic numbers -> (byte order, ticks per second) ---
MAGIC = {
    b"\xa1\xb2\xc3\xd4": (">", 1_000_000),
    b"\xd4\xc3\xb2\xa1": ("<", 1_000_000),
    b"\xa1\xb2\x3c\x4d": (">", 1_000_000_000),
    b"\x4d\x3c\xb2\xa1": ("<", 1_000_000_000),
}
# --- fixed values: block types of the block-structured capture format ---
SECTION_BLOCK, INTERFACE_BLOCK, PACKET_BLOCK = 0x0A0D0D0A, 1, 6
SECTION_START = b"\x0a\x0d\x0d\x0a"
LITTLE_ENDIAN_MARK = b"\x4d\x3c\x2b\x1a"
TIME_RESOLUTION_OPTION = 9
# --- fixed values: link types -> bytes before the EtherType, None for raw IP ---
LINK_ETHERTYPE_AT = {1: 12, 113: 14, 12: None, 101: None, 228: None, 229: None}
ROWS_PER_BATCH = 100_000
MAX_CAPTURE_BYTES = 1 << 28  # one task holds a file several times over
ETHERTYPE_IPV4, ETHERTYPE_IPV6 = 0x0800, 0x86DD
VLAN_TAGS = (0x8100, 0x88A8)
IPV6_EXTENSIONS = (0, 43, 60)


def _records(content: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Link type, then start, length and time (microseconds) of every complete record."""
    if content[:4] == SECTION_START:
        return _block_records(content)
    order, ticks = MAGIC.get(content[:4], (None, 0))
    if order is None:
        raise ValueError("not a capture file")
    link = struct.unpack_from(order + "I", content, 20)[0] & 0xFFFF
    head = struct.Struct(order + "IIII")
    starts, sizes, times = [], [], []
    at, end, per_us = 24, len(content), ticks // 1_000_000
    while at + 16 <= end:
        sec, frac, size, _ = head.unpack_from(content, at)
        at += 16
        if at + size > end:
            break
        starts.append(at)
        sizes.append(size)
        times.append(sec * 1_000_000 + frac // per_us)
        at += size
    return (link, np.array(starts, dtype=np.int64), np.array(sizes, dtype=np.int64),
            np.array(times, dtype=np.int64))


def _ticks(content: bytes, order: str, at: int, end: int) -> int:
    """Ticks per second of an interface, from its options; microseconds unless stated."""
    while at + 4 <= end:
        code, size = struct.unpack_from(order + "HH", content, at)
        if code == TIME_RESOLUTION_OPTION:
            value = content[at + 4]
            return 2 ** (value & 127) if value & 128 else 10 ** value
        if code == 0:
            break
        at += 4 + (size + 3) // 4 * 4
    return 1_000_000


def _block_records(content: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """The records of a block-structured capture; all its interfaces must share a link type."""
    starts, sizes, times, links, ticks, seen = [], [], [], [], [], set()
    at, end, order = 0, len(content), "<"
    while at + 12 <= end:
        if content[at:at + 4] == SECTION_START:
            order = "<" if content[at + 8:at + 12] == LITTLE_ENDIAN_MARK else ">"
            links, ticks = [], []
        kind, size = struct.unpack_from(order + "II", content, at)
        if size < 12 or at + size > end:
            break
        if kind == INTERFACE_BLOCK:
            links.append(struct.unpack_from(order + "H", content, at + 8)[0])
            ticks.append(_ticks(content, order, at + 16, at + size - 4))
        elif kind == PACKET_BLOCK:
            port, high, low, length, _ = struct.unpack_from(order + "IIIII", content, at + 8)
            seen.add(links[port])
            starts.append(at + 28)
            sizes.append(length)
            times.append(((high << 32) | low) * 1_000_000 // ticks[port])
        at += size
    if len(seen) > 1:
        raise ValueError(f"capture mixes link types {sorted(seen)}")
    return (seen.pop() if seen else 1, np.array(starts, dtype=np.int64),
            np.array(sizes, dtype=np.int64), np.array(times, dtype=np.int64))


def _u16(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (buf[at].astype(np.int64) << 8) | buf[at + 1]


def _ip_text(raw: np.ndarray) -> list[str]:
    import ipaddress
    kind = ipaddress.IPv4Address if raw.shape[1] == 4 else ipaddress.IPv6Address
    names, where = np.unique(raw, axis=0, return_inverse=True)
    text = np.array([str(kind(bytes(row))) for row in names], dtype=object)
    return list(text[where.reshape(-1)]) if len(text) else []


def decode_capture(content: bytes) -> pd.DataFrame:
    """Packet rows of one capture file; anything that is not IP is left out."""
    link, start, size, ts = _records(content)
    if link not in LINK_ETHERTYPE_AT:
        raise ValueError(f"unsupported link type {link}")
    # padding lets every gather read past a short packet; lengths are checked separately
    buf = np.concatenate([np.frombuffer(content, dtype=np.uint8), np.zeros(128, dtype=np.uint8)])
    index = np.arange(len(start))
    at = LINK_ETHERTYPE_AT[link]
    if at is None:
        ip_at = start
        kind = np.where(buf[ip_at] >> 4 == 6, ETHERTYPE_IPV6, ETHERTYPE_IPV4)
    else:
        type_at = start + at
        last = start + size
        # as many tags as there are; every step moves on, so the packet's end bounds the steps
        while (tagged := np.isin(_u16(buf, np.minimum(type_at, last)), VLAN_TAGS) & (type_at + 6 <= last)).any():
            type_at = np.where(tagged, type_at + 4, type_at)
        kind, ip_at = _u16(buf, type_at), type_at + 2
    room = start + size - ip_at
    v4 = (kind == ETHERTYPE_IPV4) & (room >= 20)
    v6 = (kind == ETHERTYPE_IPV6) & (room >= 40)
    tables = []
    for version, mask in ((4, v4), (6, v6)):
        if not mask.any():
            continue
        p, left = ip_at[mask], room[mask]
        if version == 4:
            hdr = (buf[p].astype(np.int64) & 15) * 4
            total, proto = _u16(buf, p + 2), buf[p + 9].astype(np.int64)
            src = buf[(p + 12)[:, None] + np.arange(4)]
            dst = buf[(p + 16)[:, None] + np.arange(4)]
            upper, l4 = proto.copy(), p + hdr
            upper[(_u16(buf, p + 6) & 0x1FFF) != 0] = -1   # later fragments hold no header
        else:
            hdr = np.full(len(p), 40, dtype=np.int64)
            total, proto = _u16(buf, p + 4) + 40, buf[p + 6].astype(np.int64)
            src = buf[(p + 8)[:, None] + np.arange(16)]
            dst = buf[(p + 24)[:, None] + np.arange(16)]
            upper, l4 = proto.copy(), p + 40
            while (more := np.isin(upper, IPV6_EXTENSIONS) & (l4 + 2 <= p + left)).any():
                safe = np.where(more, l4, p)
                step = (buf[safe + 1].astype(np.int64) + 1) * 8
                upper = np.where(more, buf[safe], upper)
                l4 = np.where(more, l4 + step, l4)
        have = p + left - l4
        tcp = (upper == PROTO_TCP) & (have >= 20)
        udp = (upper == PROTO_UDP) & (have >= 8)
        safe = np.where(tcp | udp, l4, 0)
        ports = tcp | udp
        tables.append(pd.DataFrame({
            "seq": index[mask], "ts_us": ts[mask],
            "src_ip": _ip_text(src), "src_port": np.where(ports, _u16(buf, safe), 0),
            "dst_ip": _ip_text(dst), "dst_port": np.where(ports, _u16(buf, safe + 2), 0),
            "proto": proto, "total_len": total, "ip_hdr_len": hdr,
            "l4_hdr_len": np.where(tcp, (buf[safe + 12] >> 4).astype(np.int64) * 4,
                                   np.where(udp, 8, 0)),
            "tcp_flags": pd.array(buf[safe + 13], dtype="Int32"),
            "tcp_window": pd.array(_u16(buf, safe + 14), dtype="Int32"),
        }))
        tables[-1].loc[~tcp, ["tcp_flags", "tcp_window"]] = pd.NA
    if not tables:
        return pd.DataFrame({f.name: [] for f in PACKET_SCHEMA.fields})
    return pd.concat(tables).sort_values("seq", ignore_index=True)


def decode_captures(files: DataFrame, file_no: str = "file_no",
                    content: str = "content") -> DataFrame:
    """Packet rows of a table of captures; ``seq`` orders by file number, then by position."""
    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number, data in zip(batch[file_no], batch[content]):
                packets = decode_capture(bytes(data))
                packets["seq"] = packets["seq"].astype("int64") + (int(number) << 32)
                for at in range(0, len(packets), ROWS_PER_BATCH):
                    yield packets.iloc[at:at + ROWS_PER_BATCH]
    return files.select(file_no, content).mapInPandas(decode, PACKET_SCHEMA)


def read_captures(spark: SparkSession, path: str, file_no: Column | None = None,
                  max_bytes: int = MAX_CAPTURE_BYTES) -> DataFrame:
    """Packets of all capture files below ``path``; files are ordered by ``file_no``.

    ``file_no`` defaults to the rank of the path, and must be distinct per file for a defined order. A
    file is decoded by one task, so one of more than ``max_bytes`` fails: rotate captures at recording.
    """
    files = spark.read.format("binaryFile").load(path)
    content = F.when(F.col("length") <= max_bytes, F.col("content")).otherwise(
        F.raise_error(F.concat(F.lit(f"a capture of more than {max_bytes} bytes: "), F.col("path"))))
    if file_no is not None:
        return decode_captures(files.select(file_no.alias("file_no"), content.alias("content")))
    # one row per file is ranked, and joined back to the contents
    ranked = files.select("path", (F.row_number().over(Window.orderBy("path")) - 1).alias("file_no"))
    return decode_captures(files.join(ranked, "path").select("file_no", content.alias("content")))
