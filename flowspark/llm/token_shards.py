"""Token ids in raw binary shards with a minimal perfect hash index.

A shard file holds, document after document in key order, ids as little-endian integers of fixed width, each
document closed by the end id. Behind the last document stands the index of the shard: a minimal perfect hash
of its keys, and per slot a fingerprint, the first document of that key and how many there are; and per
document its id offset, id count and key. The last 16 bytes before the final end id are the index's length and a
mark. Spark's own text writer makes the files: one row is one document's ids, the row separator is the end id. So files
appear only when their task commits, in any store that Spark can write.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from tokenizers import Tokenizer

from flowspark.session import materialize, scratch_path

MARK = b"IDSHARD1"
GAMMA = 2.0
LEVELS = 40
MAX_SHARD = 1 << 30
CACHED = 3 << 17
LONGEST_CACHED = 64
SLICE = 256
# bytes of texts whose words are looked up at once
SLICE_BYTES = 4 << 20
NULL_KEY = -1 << 63
# white space beyond ASCII with a blank behind it: whether a pre-token ends between them depends on what follows
_WIDE_BLANKS = "[%s] " % "".join(r"\x{%x}" % c for c in range(0x80, 0x3001) if chr(c).isspace())
# kinds of bytes: white space, letters, digits, marks, the apostrophe; nothing is known of the others
_SPACE, _LETTER, _DIGIT, _MARK, _QUOTE = range(1, 6)
_KINDS = np.zeros(256, np.uint8)
_KINDS[[9, 10, 11, 12, 13, 32]] = _SPACE
_KINDS[33:127] = _MARK
_KINDS[48:58] = _DIGIT
_KINDS[[*range(65, 91), *range(97, 123)]] = _LETTER
_KINDS[ord("'")] = _QUOTE


# ---- minimal perfect hash ----

def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mixing of keys, other for each seed."""
    x = keys ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class PerfectHash:
    """Levels of bit maps: a key's slot is the rank of the first bit it hits alone."""
    bits: list[np.ndarray]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """``keys``: different unsigned 64-bit integers."""
        bits, left, level = [], keys.astype(np.uint64), 0
        while len(left):
            if level == LEVELS:
                raise ValueError("keys repeat")
            size = max(64, int(GAMMA * len(left)))
            place = _mix(left, level) % np.uint64(size)
            alone = np.bincount(place.astype(np.int64), minlength=size) == 1
            bits.append(alone)
            left, level = left[~alone[place.astype(np.int64)]], level + 1
        return cls(bits)

    def __post_init__(self):
        self.ranks, before = [], 0
        for b in self.bits:
            self.ranks.append(np.cumsum(b) - b + before)
            before += int(b.sum())

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, in constant time; -1, or any slot, for keys that were not built in."""
        found, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        keys = keys.astype(np.uint64)
        for level, (b, rank) in enumerate(zip(self.bits, self.ranks)):
            if not len(left):
                break
            place = (_mix(keys[left], level) % np.uint64(len(b))).astype(np.int64)
            hit = b[place]
            found[left[hit]] = rank[place[hit]]
            left = left[~hit]
        return found

    def packed(self) -> tuple[list[int], bytes]:
        return [len(b) for b in self.bits], b"".join(np.packbits(b).tobytes() for b in self.bits)

    @classmethod
    def unpacked(cls, sizes: list[int], data: bytes) -> PerfectHash:
        bits, at = [], 0
        for n in sizes:
            bits.append(np.unpackbits(np.frombuffer(data, np.uint8, -(-n // 8), at), count=n).astype(bool))
            at += -(-n // 8)
        return cls(bits)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys.astype(np.uint64), 1 << 20) >> np.uint64(32)).astype(np.uint32)


# ---- shard format ----

def _index(keys: Sequence[int], counts: Sequence[int], shard: int, width: int, end_id: int) -> bytes:
    """Index of documents in file order; equal keys are neighbours."""
    k, n = np.array(keys, np.int64), np.array(counts, np.int64)
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    own = k[first].view(np.uint64)
    perfect = PerfectHash.build(own)
    slot = perfect.slots(own)
    table = np.zeros((len(own), 3), np.uint32)
    table[slot] = np.stack([fingerprints(own), first.astype(np.uint32),
                            np.diff(np.r_[first, len(k)]).astype(np.uint32)], axis=1)
    sizes, bits = perfect.packed()
    offsets = np.cumsum(n) - n
    head = json.dumps({"shard": shard, "width": width, "end": end_id, "docs": len(k), "keys": len(own),
                       "ids": int(n.sum()), "levels": sizes}).encode()
    body = struct.pack("<I", len(head)) + head + bits + table.tobytes() + offsets.tobytes() + n.tobytes() + k.tobytes()
    return body + struct.pack("<Q", len(body)) + MARK


class Shard:
    """A shard file's bytes, with keyed access."""

    def __init__(self, data: bytes):
        self.head = None
        if not data:
            return
        # the separator that Spark writes behind the index has the width of one id
        for width in (2, 4):
            if data[-width - 8:-width] == MARK:
                size = struct.unpack_from("<Q", data, len(data) - width - 16)[0]
                body = len(data) - width - 16 - size
                head = struct.unpack_from("<I", data, body)[0] if body >= 0 else 0
                self.head = json.loads(data[body + 4:body + 4 + head])
                if self.head["width"] == width:
                    break
        if self.head is None:
            raise ValueError("no shard file")
        at, h = body + 4 + head, self.head
        used = sum(-(-n // 8) for n in h["levels"])
        self.perfect = PerfectHash.unpacked(h["levels"], data[at:at + used])
        self.table = np.frombuffer(data, np.uint32, 3 * h["keys"], at + used).reshape(-1, 3)
        at += used + 12 * h["keys"]
        self.offsets, self.counts, self.keys = (np.frombuffer(data, np.int64, h["docs"], at + 8 * i * h["docs"])
                                                for i in range(3))
        if h["ids"] * h["width"] != body:
            raise ValueError(f"the payload has {body} bytes, its index says {h['ids']} ids")
        self.ids = np.frombuffer(data, f"<u{h['width']}", h["ids"])

    def lookup(self, keys: np.ndarray) -> list[list[int]]:
        """Numbers of the documents of each key; none for unknown keys."""
        keys = np.asarray(keys, np.int64).view(np.uint64)
        slot = self.perfect.slots(keys)
        rows = self.table[np.maximum(slot, 0)] if len(self.table) else np.zeros((len(keys), 3), np.uint32)
        good = (slot >= 0) & (rows[:, 0] == fingerprints(keys))
        found = [list(range(f, f + n)) if ok else [] for ok, (_, f, n) in zip(good, rows.tolist())]
        # a fingerprint can be equal by chance: the stored key decides
        return [x if not x or self.keys[x[0]] == k else [] for x, k in zip(found, keys.view(np.int64))]

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.offsets[i]:self.offsets[i] + self.counts[i]]


# ---- encoding ----

def _cuts(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Whether a pre-token ends before each byte of UTF-8 texts that begin at ``begins``, as far as its neighbours show.

    The pre-tokens are `'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`. None reaches over a
    place found here, none looks back, and none looks ahead over it with another outcome. Not every end is found.
    """
    kind = _KINDS[data]
    # two bytes from 0xC3 on: À to ÿ, letters but for × and ÷
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = _LETTER
    first = np.zeros(len(data) + 1, bool)
    first[begins] = True
    first = first[:-1]
    shown, space, quote = kind > _SPACE, kind == _SPACE, kind == _QUOTE
    blank = data == 32
    cut = first.copy()
    # letters, digits and marks end where another of them begins; an apostrophe may stand for the beginning of 's
    differs = (kind[1:] != kind[:-1]) & shown[1:] & shown[:-1]
    cut[1:] |= differs & ~quote[:-1] & ~(quote[1:] & (kind[:-1] == _MARK))
    # what is no white space ends before it
    cut[1:] |= space[1:] & shown[:-1]
    cut[1:] |= blank[1:] & (data[:-1] >= 0x80)
    # a single white space character other than a blank stands alone
    alone = space & ~blank
    alone[1:] &= shown[:-1] | first[1:]
    cut[1:] |= shown[1:] & alone[:-1]
    return cut


class Encoder:
    """A byte-level tokenizer that remembers the ids of word parts.

    Texts are cut where a pre-token of such a tokenizer ends whatever stands around that place, so the ids of
    the parts, put together, are those of the text. New parts that are one pre-token are merged by the library's
    model; all others go through the whole tokenizer.
    """
    one = re.compile(r" ?(?:[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]+|[!-&(-/:-@\[-`{-~]+)|[\t-\r]").fullmatch

    def __init__(self, path: str, width: int):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.kind, self.code = f"<u{width}", {2: "H", 4: "I"}[width]
        # parts met lately and before that
        self.words, self.older = {}, {}
        self.merge = self.tokenizer.model.tokenize
        # printable bytes stand for themselves, the others for characters from 256 on
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = iter(range(256, 512))
        self.shown = {b: b if b in printable else next(others) for b in range(256)}
        self.blank = chr(self.shown[32])
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        # added tokens are found before pre-tokens
        self.uncut = "|".join([_WIDE_BLANKS, *(re.escape(t["content"]) for t in spec["added_tokens"])])
        self.split = (spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex")
                      and not pre.get("add_prefix_space") and not any(
                          " " in t["content"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]))
        if self.tokenizer.get_vocab_size() > 1 << 8 * width:
            raise ValueError(f"ids need more than {width} bytes")

    def plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def merged(self, word: str) -> bytes:
        """Ids of one pre-token."""
        if word.isascii() and word >= " ":
            shown = self.blank + word[1:] if word[0] == " " else word
        else:
            shown = word.encode().decode("latin-1").translate(self.shown)
        return array(self.code, [t.id for t in self.merge(shown)]).tobytes()

    def part(self, part: str) -> bytes:
        made = self.older.get(part)
        if made is None:
            made = self.merged(part) if self.one(part) else self.plain(part)
        if len(part) <= LONGEST_CACHED:
            if len(self.words) >= CACHED:  # forget what was not met since the last time
                self.words, self.older = {}, self.words
            self.words[part] = made
        return made

    def parts(self, parts: list[str]) -> list[bytes]:
        found = list(map(self.words.get, parts))
        if None in found:
            for i, f in enumerate(found):
                if f is None:
                    found[i] = self.part(parts[i])
        return found

    def encode(self, text: str) -> bytes:
        return self.encode_all(pa.array([text], pa.string()))[0].as_py()

    def encode_all(self, texts: pa.Array) -> pa.Array:
        """The ids of each text, null like empty; a part that many of the texts hold is looked up once."""
        texts = texts.fill_null("")
        whole = pc.match_substring_regex(texts, self.uncut).to_numpy(zero_copy_only=False)
        if not self.split:
            whole[:] = True
        if whole.any():
            rest = iter(self.encode_all(texts.filter(pa.array(~whole))) if not whole.all() else [])
            made = [self.plain(t.as_py()) if w else next(rest).as_py() for t, w in zip(texts, whole)]
            return pa.array(made, pa.binary())
        ends = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]
        ends = ends - ends[0]
        at = np.append(np.flatnonzero(_cuts(data, ends)) if len(data) else [], len(data)).astype(np.int32)
        parts = pa.Array.from_buffers(pa.string(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)]).dictionary_encode()
        found = self.parts(parts.dictionary.to_numpy(zero_copy_only=False).tolist())
        ids = pa.array(found, pa.binary()).take(parts.indices)
        starts = np.frombuffer(ids.buffers()[1], np.int32, len(ids) + 1)[np.searchsorted(at, ends)]
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(starts), ids.buffers()[2]])


@lru_cache(maxsize=2)
def encoder(path: str, width: int) -> Encoder:
    return Encoder(path, width)


def _rows(batches: Iterator[pa.RecordBatch], path: str, width: int, end_id: int) -> Iterator[pa.RecordBatch]:
    work, keys, counts = encoder(path, width), [], []
    names = ["value"]
    for batch in batches:
        sizes = np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        ends = np.flatnonzero(np.diff(sizes // SLICE_BYTES, append=-1))
        for start, end in zip([0, *(ends + 1)], ends + 1):
            part = batch.slice(start, end - start)
            made = work.encode_all(part.column(1))
            keys.append(part.column(0).fill_null(NULL_KEY).to_numpy(zero_copy_only=False))
            counts.append(pc.binary_length(made).to_numpy(zero_copy_only=False) // width + 1)
            yield pa.RecordBatch.from_arrays([made], names=names)
    if keys:
        index = _index(np.concatenate(keys), np.concatenate(counts), TaskContext.get().partitionId(), width, end_id)
        yield pa.RecordBatch.from_arrays([pa.array([index], pa.binary())], names=names)


def write_shards(df: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 0,
                 width: int | None = None) -> None:
    """Encode a text column and write shards in key order below ``path``.

    Keys are whole numbers, null first. Null and empty texts hold the end id alone; rows with equal keys stay
    together, by text hash. Texts go through one range shuffle by key; ids are never shuffled. ``tokenizer`` is a file on
    every executor. ``width``: bytes an id takes, 2 where the vocabulary allows it.
    """
    if width is None:
        width = 2 if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 else 4
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    dealt = rows.repartitionByRange("key").sortWithinPartitions("key", F.xxhash64("text"))
    made = dealt.mapInArrow(partial(_rows, path=tokenizer, width=width, end_id=end_id), "value binary")
    end = end_id.to_bytes(width, "little").decode("latin-1")
    made.select(F.col("value").cast("string")).write.option("lineSep", end).option("encoding", "ISO-8859-1") \
        .option("maxRecordsPerFile", 0).text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    # one file is one value: far smaller than this by the width of the shuffle
    return files.select(F.when(F.col("length") <= MAX_SHARD, F.col("content")).otherwise(
        F.raise_error(F.concat(F.lit("shard too large, use more shuffle partitions: "), F.col("path")))).alias("content"))


def _read(batches: Iterator[pa.RecordBatch], payload: bool) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), *([pa.list_(pa.int32())] if payload else [])]
    names = ["shard", "key", "offset", "n_tokens", "ids_crc32", *(["ids"] if payload else [])]
    for batch in batches:
        for data in batch.column(0):
            shard = Shard(data.as_buffer().to_pybytes())
            if shard.head is None:
                continue
            own = shard.keys[np.r_[True, shard.keys[1:] != shard.keys[:-1]]] if len(shard.keys) else shard.keys
            docs = [i for found in shard.lookup(own) for i in found]
            if docs != list(range(shard.head["docs"])):
                raise ValueError("the index does not lead to every document")
            for start in range(0, len(docs), SLICE):
                part = docs[start:start + SLICE]
                ids = [shard.document(i) for i in part]
                columns = [[shard.head["shard"]] * len(part),
                           [None if shard.keys[i] == NULL_KEY else int(shard.keys[i]) for i in part],
                           [int(shard.offsets[i]) for i in part], [int(shard.counts[i]) for i in part],
                           [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]]
                columns += [[x.astype(np.int32) for x in ids]] if payload else []
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def read_shards(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """One row per stored document: shard, key, offset and n_tokens in its shard, ids_crc32 and, on request, ids.

    Every document is found through its shard's index.
    """
    schema = "shard int, key long, offset long, n_tokens long, ids_crc32 long" + (", ids array<int>" if payload else "")
    return _files(spark, path).mapInArrow(partial(_read, payload=payload), schema)


def _looked_up(batches: Iterator[pa.RecordBatch], keys: list[int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column(0):
            shard = Shard(data.as_buffer().to_pybytes())
            if shard.head is None:
                continue
            found = [(k, i) for k, docs in zip(keys, shard.lookup(np.array(keys, np.int64))) for i in docs]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in found], pa.int64()),
                 pa.array([shard.document(i).astype(np.int32) for _, i in found], pa.list_(pa.int32()))], names=["key", "ids"])


def lookup(spark: SparkSession, path: str, keys: list[int]) -> DataFrame:
    """(key, ids) of the stored documents with one of the given keys."""
    return _files(spark, path).mapInArrow(partial(_looked_up, keys=list(keys)), "key long, ids array<int>")


def token_ids(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 0,
              path: str | None = None) -> DataFrame:
    """Write shards, read them back: key, start, n_tokens, ids_crc32 per row of ``df``.

    ``start`` counts the ids of all documents before, over all shards.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, "token-shards")
    write_shards(df, path, tokenizer, key, text, end_id)
    docs = read_shards(spark, path, payload=False)
    docs = materialize(docs, "shard-index")
    return _started(docs, key)


def _started(docs: DataFrame, key: str) -> DataFrame:
    """Global starts: one row per shard is summed up in shard order, narrow rows are joined to it."""
    totals = docs.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = F.sum("total").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    bases = totals.select("shard", F.coalesce(before, F.lit(0)).alias("base"))
    return docs.join(bases, "shard").select(
        F.col("key").alias(key), (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
