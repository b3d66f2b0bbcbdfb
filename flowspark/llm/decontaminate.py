"""Benchmark decontamination: prefix-filtered join of word shingles, exact windows of the items."""

from __future__ import annotations

from collections import defaultdict
from functools import partial
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F, types as T

from flowspark.llm.common import add_columns, word_slabs
from flowspark.session import materialize

WINDOW = 13
SHINGLE = 3
# bytes of item texts handled at once; a word takes two bytes or more, so its number stays below 2 ** 21
BLOCK_BYTES = 4_000_000
_BASE = 1 << 21
# A-Z to a-z, all other ASCII but digits and a-z to blanks, the rest as it is
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
               for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Shingles:
    """Numbered words and shingles of a bounded block of items."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW, shingle: int = SHINGLE):
        self.words: dict[bytes, int] = {}
        for _, words in items:
            for w in words:
                self.words.setdefault(w, len(self.words) + 1)
        if len(self.words) >= _BASE:
            raise ValueError("a block of items has too many different words")
        spans: dict[tuple[int, ...], set] = defaultdict(set)
        for item, words in items:
            ids = [self.words[w] for w in words]
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1 if size else 0):
                spans[tuple(ids[i:i + size])].add(item)
        keyed = [(self._keys(np.array(s, np.int64), k := min(shingle, len(s))), k, len(s), items)
                 for s, items in spans.items()]
        self.sizes = sorted({k for _, k, _, _ in keyed})
        self.shortest = min((len(keys) for keys, k, _, _ in keyed if k == shingle), default=1)
        self.keys = np.unique(np.concatenate([x[0] for x in keyed])) if keyed else np.zeros(0, np.int64)
        self.shingle = shingle
        # (shingle numbers, words, items) of each different window
        self.windows = [(np.searchsorted(self.keys, keys).tolist(), n, sorted(x for x in items if x is not None))
                        for keys, _, n, items in keyed]

    @staticmethod
    def _keys(ids: np.ndarray, k: int) -> np.ndarray:
        """One number per run of k word numbers; runs of other lengths get other numbers."""
        key = ids[:len(ids) - k + 1].copy()
        for j in range(1, SHINGLE):
            key = key * _BASE + (ids[j:len(ids) - k + 1 + j] if j < k else 0)
        return key

    def find(self, text: str | None) -> tuple[int, list[tuple[int, list[int]]], list[int]]:
        """Number of words, runs of adjacent known shingles long enough for a window, and all known shingles."""
        parts = [np.fromiter(map(self.words.get, w, repeat(0)), np.int64, len(w)) for w in
                 word_slabs((text or "").encode("utf-8", "surrogatepass").translate(_TABLE))]
        ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        runs, seen = [], []
        for k in self.sizes:
            if len(ids) < k:
                continue
            known = ids[:len(ids) - k + 1] > 0
            for j in range(1, k):
                known &= ids[j:len(ids) - k + 1 + j] > 0
            at = np.flatnonzero(known)
            if not len(at):
                continue
            key = ids[at]
            for j in range(1, SHINGLE):
                key = key * _BASE + (ids[at + j] if j < k else 0)
            no = np.searchsorted(self.keys, key)
            hit = self.keys[np.minimum(no, len(self.keys) - 1)] == key
            at, no = at[hit], no[hit]
            if not len(at):
                continue
            seen += np.unique(no).tolist()
            least = self.shortest if k == self.shingle else 1
            for run in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) != 1) + 1):
                if len(run) >= least:
                    runs.append((int(at[run[0]]), no[run].tolist()))
        return len(ids), runs, seen


def _found(shingles: Shingles):
    def work(texts):
        made = [shingles.find(t) for t in texts]
        return [[m[0] for m in made], [[{"start": s, "shingles": x} for s, x in m[1]] for m in made],
                [m[2] for m in made]]
    return work


def _blocks(items: DataFrame, key: str, text: str, block_bytes: int):
    """Items with text, as local lists of bounded size."""
    rows = items.select(F.col(key).cast("string").alias("item"), F.col(text).alias("text")).dropna(subset=["text"])
    sized = rows.withColumn("bytes", F.octet_length("text"))
    total = sized.agg(F.sum("bytes").alias("b"), F.max("bytes").alias("m")).first()
    if (total.m or 0) > block_bytes:
        raise ValueError(f"an item has more than {block_bytes} bytes")
    # half full on average; the check holds the bound for uneven hashes
    n = max(1, -(-2 * (total.b or 0) // block_bytes)) if (total.b or 0) > block_bytes else 1
    for i in range(n):
        block = sized if n == 1 else sized.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i)
        if n > 1 and (block.agg(F.sum("bytes")).first()[0] or 0) > block_bytes:
            raise ValueError("items repeat too often to be dealt into blocks")
        yield [(r.item, words_of(r.text)) for r in block.select("item", "text").collect()]


def _rarest(windows: DataFrame, rows: DataFrame) -> DataFrame:
    """Windows with their necessary prefix: all shingles must occur, so the rarest alone is enough."""
    counts = rows.select(F.explode("seen").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("docs"))
    each = windows.select("window", F.posexplode("shingles").alias("place", "shingle"))
    best = each.join(counts, "shingle", "left").groupBy("window").agg(
        F.min(F.struct(F.coalesce("docs", F.lit(0)).alias("docs"), "shingle", "place")).alias("p"))
    return windows.join(best, "window").select(
        F.col("p.shingle").alias("prefix"), F.col("p.place").alias("place"), "window", "shingles", "n", "items")


def _occurrences(rows: DataFrame, prefixes: DataFrame, longest: int) -> DataFrame:
    """(doc_id, version, start, end, items) of windows that occur."""
    runs = rows.select("doc_id", "version", F.explode("runs").alias("run")).select(
        "doc_id", "version", F.col("run.start").alias("start"), F.col("run.shingles").alias("around"))
    at = runs.select("doc_id", "version", "start", "around", F.posexplode("around").alias("i", "prefix"))
    first = F.greatest(F.col("i") - longest, F.lit(0))
    at = at.select("doc_id", "version", "start", "i", "prefix", first.alias("first"),
                   F.size("around").alias("length"), F.slice("around", first + 1, 2 * longest).alias("near"))
    begin = F.col("i") - F.col("place")
    # position and length bounds first, then the window itself
    fits = (begin >= 0) & (begin + F.size("shingles") <= F.col("length"))
    same = F.slice("near", F.greatest(begin - F.col("first"), F.lit(0)) + 1, F.size("shingles")) == F.col("shingles")
    return at.join(F.broadcast(prefixes), "prefix").filter(fits).filter(same).select(
        "doc_id", "version", (F.col("start") + begin).alias("start"), (F.col("start") + begin + F.col("n")).alias("end"),
        "items")


def overlaps(df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
             item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``df``: doc_id, version (hash of the text), n_words, n_hit, n_items, items.

    ``n_hit`` counts words inside any occurrence of an item's window; ``items`` are the ids, as sorted
    strings, of items with such windows. Item ids that are null count hits but are not listed. Null and
    empty texts have no words and no hits, items without words no windows; repeated rows each give a row.
    Items are a stated query set: they are held by every task, in blocks of ``block_bytes`` at most, and the
    documents are read once per block.
    """
    docs = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    docs = docs.withColumn("version", F.xxhash64("text"))
    added = "n_words long, runs array<struct<start: int, shingles: array<int>>>, seen array<int>"
    found, counted = None, None
    for block in _blocks(items, item_key, item_text, block_bytes):
        shingles = Shingles(block, window)
        rows = materialize(add_columns(docs, "text", added, partial(_found, shingles)).drop("text"), "shingles")
        counted = counted or rows.select("doc_id", "version", "n_words")
        schema = T._parse_datatype_string("window int, shingles array<int>, n int, items array<string>")
        windows = df.sparkSession.createDataFrame(
            [(i, s, n, x) for i, (s, n, x) in enumerate(shingles.windows)], schema)
        longest = max((len(s) for s, _, _ in shingles.windows), default=1)
        hits = _occurrences(rows, _rarest(windows, rows), longest)
        found = hits if found is None else found.unionByName(hits)
    found = materialize(found, "windows")
    row = ["doc_id", "version"]
    reach = F.max("end").over(Window.partitionBy(*row).orderBy("start", "end")
                              .rowsBetween(Window.unboundedPreceding, -1))
    spans = found.select(*row, "start", "end").distinct().withColumn("reach", F.coalesce(reach, F.lit(0)))
    hit = spans.groupBy(*row).agg(
        F.sum(F.greatest(F.col("end") - F.greatest("start", "reach"), F.lit(0))).alias("n_hit"))
    named = found.select(*row, F.explode("items").alias("item")).groupBy(*row).agg(
        F.array_sort(F.collect_set("item")).alias("items"))
    same = [F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & F.col("a.version").eqNullSafe(F.col("b.version"))]
    merged = hit.alias("a").join(named.alias("b"), same, "left").select("a.doc_id", "a.version", "n_hit", "items")
    out = counted.alias("a").join(merged.alias("b"), same, "left")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("a.doc_id", "a.version", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                      F.size(listed).cast("long").alias("n_items"), listed.alias("items"))


def contaminated(share: int = 20):
    """Whether hits are at least one in ``share`` words."""
    return (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))


def keep_uncontaminated(df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", share: int = 20,
                        **options) -> DataFrame:
    """Rows of ``df``, with all columns, that are not contaminated."""
    bad = overlaps(df, items, key, text, **options).filter(contaminated(share)).select(
        F.col("doc_id").alias("__doc"), F.col("version").alias("__version")).distinct()
    return df.join(bad, df[key].eqNullSafe(F.col("__doc")) & (F.xxhash64(df[text]) == F.col("__version")), "left_anti")
