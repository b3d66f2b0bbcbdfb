"""SimHash near-duplicates: pigeonhole blocks, verified Hamming distance, linked groups."""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from flowspark.llm.common import add_columns, word_slabs
from flowspark.llm.components import connected
from flowspark.session import materialize

SEED = 42
BITS = 64
# a bucket of up to this many different fingerprints is compared within itself; larger ones are split by more bits
BUCKET = 256


def fingerprint(text: str | None, words: int = 3) -> int:
    """Bits set in over half of the hashes of all word shingles, repeats included.

    Fewer words than a shingle has: the whole sequence is one. No words (or null): 0.
    """
    counts, total, tail = np.zeros(BITS, np.int64), 0, []
    digest = partial(xxhash.xxh64_intdigest, seed=SEED)
    for part in word_slabs((text or "").encode("utf-8", "surrogatepass").lower()):
        seq = tail + part
        if len(seq) >= words:
            # zip of shifted lists: shingles without copies of the text
            hashes = np.fromiter(map(digest, map(b" ".join, zip(*(seq[i:] for i in range(words))))),
                                 np.uint64, len(seq) - words + 1)
            bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            counts += bits.sum(axis=0, dtype=np.int64)
            total += len(hashes)
        tail = seq[len(seq) - words + 1:] if words > 1 and len(seq) >= words else ([] if words == 1 else seq)
    if not total:
        return digest(b" ".join(tail)) if tail else 0
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big")


def _fingerprints(words: int):
    def work(texts):
        made = np.array([fingerprint(t, words) for t in texts], np.uint64)
        return [made.view(np.int64).tolist()]
    return work


def simhash(df: DataFrame, text: str = "text", words: int = 3, name: str = "fp") -> DataFrame:
    """``df`` with the 64-bit fingerprint of a text column, as a signed long."""
    return add_columns(df, text, f"`{name}` long", partial(_fingerprints, words))


def block_masks(distance: int, blocks: int) -> list[int]:
    """Masks of all choices of blocks that must hold an equal choice: at most ``distance`` blocks can differ."""
    if not distance < blocks <= BITS:
        raise ValueError("more blocks than differing bits are needed, and at most 64")
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(parts, blocks - distance)]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _keyed(fps: DataFrame, masks: list[int]) -> DataFrame:
    keys = F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("block"))
                     for i, m in enumerate(masks)])
    return fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.part", "k.block")


def _compared(keyed: DataFrame, distance: int) -> DataFrame:
    """Pairs within one bucket of bounded size, verified."""
    found = keyed.groupBy("part", "block").agg(F.collect_list("fp").alias("fps")).filter("size(fps) > 1")
    pairs = F.expr(f"""flatten(transform(fps, (a, i) -> transform(
        filter(slice(fps, i + 2, greatest(size(fps) - i - 1, 0)), b -> bit_count(a ^ b) <= {int(distance)}),
        b -> struct(least(a, b) as a, greatest(a, b) as b))))""")
    return found.select(F.explode(pairs).alias("p")).select("p.a", "p.b")


def links(fps: DataFrame, distance: int = 3, blocks: int = 6, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that join every two different fingerprints at ``distance`` bits or fewer, at least indirectly.

    Pigeonhole: of ``blocks`` parts of a fingerprint at most ``distance`` can differ, so a close pair agrees
    on some choice of the others and meets in that choice's bucket. Buckets of at most ``bucket``
    different fingerprints are compared pair by pair. A larger bucket is never compared as a whole: its
    members meet again under keys that drop only the bits that may differ. Those keys leave out
    ``distance`` single bits outside the agreed part, so equal keys prove the distance, and
    each key is linked to its smallest member instead of pair by pair: cost linear in the bucket.
    """
    if distance == 0:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).filter("false")
    masks = block_masks(distance, blocks)
    keyed = materialize(_keyed(fps, masks), "blocks")
    sizes = keyed.groupBy("part", "block").agg(F.count("*").alias("n"))
    large = materialize(sizes.filter(F.col("n") > bucket).select("part", "block"), "large")
    if large.isEmpty():
        return _compared(keyed, distance).distinct()
    small = keyed.join(large, ["part", "block"], "left_anti")
    crowded = keyed.join(large, ["part", "block"])
    free = F.create_map(*[c for i, m in enumerate(masks) for c in (
        F.lit(i), F.array(*[F.lit(b) for b in range(BITS) if not m >> b & 1]))])
    # one row per member and choice of bits left out; an equal rest means at most `distance` differing bits
    rest = crowded.select("fp", free[F.col("part")].alias("spots")).select(
        "fp", F.explode(F.expr(_choices(distance))).alias("mask")).select(
        "fp", "mask", F.expr("fp & ~mask").alias("rest"))
    centres = rest.groupBy("mask", "rest").agg(F.collect_set("fp").alias("members")).filter("size(members) > 1")
    stars = centres.select(F.array_min("members").alias("a"), F.explode("members").alias("b")).filter("a < b")
    return _compared(small, distance).unionByName(stars).distinct()


def _choices(left: int, start: str = "0", mask: str = "0L") -> str:
    """SQL for the masks of all choices of ``left`` entries of the array ``spots``."""
    bit = f"({mask} | shiftleft(1L, s{left}))"
    rest = f"slice(spots, {start} + 1, {BITS})"
    if left == 1:
        return f"transform({rest}, s{left} -> {bit})"
    return f"flatten(transform({rest}, (s{left}, i{left}) -> {_choices(left - 1, f'{start} + i{left} + 1', bit)}))"


def _grouped(df: DataFrame, key: str, text: str, words: int, distance: int, blocks: int) -> DataFrame:
    """(key, version, fp, root, component_id) per row: text hash, fingerprint, group, smallest key of the group."""
    texts = df.select(F.col(key).alias("key"), F.col(text).alias("text")).withColumn("version", F.xxhash64("text"))
    rows = materialize(simhash(texts, "text", words).select("key", "version", "fp"), "fingerprints")
    nodes = materialize(rows.groupBy("fp").agg(F.min("key").alias("first")), "nodes")
    roots = connected(materialize(links(nodes.select("fp"), distance, blocks), "links"))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    least = materialize(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    classes = materialize(rooted.join(least, "root").select("fp", "root", "component_id"), "classes")
    return rows.join(classes, "fp")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, distance: int = 3,
                    blocks: int = 6) -> DataFrame:
    """One row per row of ``df``: ``key``, ``fp`` (signed long) and ``component_id``.

    ``component_id`` is the smallest key reachable over links of at most ``distance`` bits. Equal
    fingerprints are one node, so copies cost one row. Null and empty texts have fingerprint 0 and link
    like any other. Repeated rows each give a row; rows with a null key take part, their component is the
    smallest known key in it, or null. An empty table gives no rows; other columns are not read.
    """
    return _grouped(df, key, text, words, distance, blocks).select(F.col("key").alias(key), "fp", "component_id")


def _identity(key: Column, version: Column) -> dict[str, Column]:
    """Columns without nulls that tell rows apart, up to repeated rows."""
    return {"__known": key.isNotNull(), "__key": F.coalesce(key, F.lit(0)), "__version": version}


def representatives(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, distance: int = 3,
                    blocks: int = 6) -> DataFrame:
    """Rows of ``df``, all columns, that stay: of each group one row with the smallest key.

    A row without key stays only if its whole group has none. Of rows of one group with the same key the
    one with the smallest text hash stays, and of repeated rows one.
    """
    grouped = _grouped(df, key, text, words, distance, blocks)
    best = grouped.groupBy("root").agg(F.min(F.struct(F.col("key").isNull().alias("unknown"), "key", "version")).alias("b"))
    same = ["__known", "__key", "__version"]
    kept = best.select(*[c.alias(n) for n, c in _identity(F.col("b.key"), F.col("b.version")).items()])
    rows = df.withColumns(_identity(F.col(key), F.xxhash64(text))).join(kept, same)
    # the join has brought equal rows together already
    order = Window.partitionBy(*same).orderBy("__key")
    return rows.withColumn("__no", F.row_number().over(order)).filter("__no = 1").select(*df.columns)
