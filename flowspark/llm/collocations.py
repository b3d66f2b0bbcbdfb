"""Phrase collocations: Rabin-Karp fingerprints of word n-grams, recounted by text where they are frequent."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window, functions as F

from flowspark.session import materialize

LONGEST = 4
MIN_COUNT = 30
TOP = 2000
# bytes of text that a task hashes at once, and rows it hands on at once
SLICE_BYTES = 4 << 20
OUT_ROWS = 1 << 15
# phrases whose texts are put together at once
TEXT_ROWS = 1 << 13
# a longer word is hashed and compared by its SHA-256
WORD_BYTES = 1 << 20
# words that are compared with others of their fingerprint at once
CHECKED_WORDS = 1 << 16
# between a phrase and its language; no word holds it
KEY_CUT = "\t"
# the first count keeps this much of a fingerprint, with its count in the bits below it
FP_BITS = 40
COUNT_BITS = 64 - FP_BITS
# fingerprints that a task counts before it hands them on, and packed rows it reads at once
HELD = 1 << 22
PACKED_ROWS = 1 << 10
# bits of the set that lets n-grams through whose parts are frequent; a full set lets more through, never less
FILTER_BITS = 1 << 26
# every separator of pieces becomes this one; no word holds it
SEPARATOR = b"."
_PIECES = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", SEPARATOR * 10)
_BLANK = np.isin(np.arange(256), list(b" \t"))
_CUT = ord(SEPARATOR)
# an odd base has an inverse modulo 2 ** 64, so a window's polynomial can be shifted to power zero
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread all bits of a 64-bit polynomial value."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Polynomials:
    """Fingerprints of all n-grams of a word sequence from prefix sums of word hash times power of the base."""

    def __init__(self, room: int):
        self.up, self.down = _powers(_BASE, room), _powers(_INVERSE, room)

    def prefixes(self, hashes: np.ndarray) -> np.ndarray:
        if len(hashes) > len(self.up):
            self.up, self.down = _powers(_BASE, len(hashes)), _powers(_INVERSE, len(hashes))
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * self.up[:len(hashes)], dtype=np.uint64)])

    def grams(self, prefixes: np.ndarray, size: int) -> np.ndarray:
        """Fingerprint of the n-gram that starts at each place."""
        n = max(0, len(prefixes) - size)
        return _mixed((prefixes[size:] - prefixes[:n]) * self.down[:n] + np.uint64(size))


def _cells(fps: np.ndarray, bits: int) -> list[np.ndarray]:
    """Two cells of a bit set per fingerprint."""
    mask = np.uint64(bits - 1)
    return [fps & mask, (fps >> np.uint64(32)) & mask]


def _known(bitmap: np.ndarray, fps: np.ndarray) -> np.ndarray:
    out, fps = np.ones(len(fps), bool), _mixed(fps >> np.uint64(COUNT_BITS))
    for cell in _cells(fps, 8 * len(bitmap)):
        out &= (bitmap[(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out


class _Slice(NamedTuple):
    """Texts of one language: their bytes, where each begins, and words repeated from the slice before."""

    lang: str
    data: bytes
    starts: list[int]
    docs: list[int | None]
    lead: int


def _shortened(data: bytes, names: dict[bytes, bytes]) -> bytes:
    """The text with each word that is too long for a slice replaced by a name; ``names`` keeps the word."""
    def name(match):
        short = b"\x00" + hashlib.sha256(match[0]).hexdigest().encode()
        names[short] = match[0]
        return short
    return re.sub(rb"[^ \t.]{%d,}" % WORD_BYTES, name, data) if len(data) > WORD_BYTES else data


def _slices(batches: Iterator[pa.RecordBatch], names: dict[bytes, bytes]) -> Iterator[_Slice]:
    """The texts of (doc, lang, text) rows, a bounded number of bytes of a language at a time."""
    held: dict[str, tuple[list, list, list]] = {}
    size = 0

    def full():
        for lang, (parts, docs, starts) in held.items():
            yield _Slice(lang, SEPARATOR.join(parts), starts, docs, 0)
        held.clear()

    for batch in batches:
        columns = (batch.column(i).to_pylist() for i in range(3))
        for doc, lang, text in zip(*columns):
            data = (text or "").encode("utf-8", "surrogatepass").lower().translate(_PIECES)
            data = _shortened(data, names)
            if len(data) > SLICE_BYTES:
                yield from _cut(lang, doc, data)
                continue
            parts, docs, starts = held.setdefault(lang, ([], [], []))
            starts.append(starts[-1] + len(parts[-1]) + 1 if starts else 0)
            parts.append(data)
            docs.append(doc)
            size += len(data) + 1
            if size >= SLICE_BYTES:
                yield from full()
                size = 0
    yield from full()


def _cut(lang: str, doc: int | None, data: bytes) -> Iterator[_Slice]:
    """Slices of a long text, cut between words; each repeats the last words of the piece that is cut."""
    at, lead = 0, []
    while at < len(data):
        end = len(data)
        if end - at > SLICE_BYTES:
            end = 1 + max(data.rfind(x, at, at + SLICE_BYTES) for x in (b" ", b"\t", SEPARATOR))
        part = b" ".join([*lead, data[at:end]])
        yield _Slice(lang, part, [0], [doc], len(lead))
        lead = part.rpartition(SEPARATOR)[2].split()[1 - LONGEST:]
        at = end


class _Grams:
    """One slice's n-grams: words by polynomials over their bytes, n-grams by polynomials over their words."""

    def __init__(self, s: _Slice, polynomials: Polynomials):
        self.slice = s
        self.bytes = np.frombuffer(s.data, np.uint8)
        inside = ~(_BLANK[self.bytes] | (self.bytes == _CUT))
        edges = np.diff(inside.astype(np.int8), prepend=0, append=0)
        self.begin, self.end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        self.polynomials = polynomials
        sums = polynomials.prefixes(self.bytes.astype(np.uint64) + np.uint64(1))
        # a language has hashes of its own, so a fingerprint says which language it is of
        seed = np.uint64(xxhash.xxh64_intdigest(s.lang.encode("utf-8", "surrogatepass")))
        self.words = _mixed(((sums[self.end] - sums[self.begin]) * polynomials.down[self.begin]) ^ seed)
        self.prefixes = polynomials.prefixes(self.words)
        self.piece = np.cumsum(self.bytes == _CUT)[self.begin]
        self.starts = np.array(s.starts, np.int64)
        self.docs = np.array([0 if d is None else d for d in s.docs], np.int64)
        self.nameless = np.array([d is None for d in s.docs])
        self.found: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def of(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprint at each place, whether an n-gram of this size within a piece stands there)."""
        if size not in self.found:
            n = max(0, len(self.piece) - size + 1)
            whole = self.piece[:n] == self.piece[size - 1:]
            self.found[size] = self.polynomials.grams(self.prefixes, size), whole
        return self.found[size]

    def places(self, size: int, known: np.ndarray | None, parts: int) -> np.ndarray:
        """Places of n-grams whose contiguous parts of ``parts`` words are all in the set ``known`` (none: all)."""
        ok = self.of(size)[1].copy()
        if known is not None:
            fps, whole = self.of(parts)
            passed = np.zeros(len(fps), bool)
            passed[whole] = _known(known, fps[whole])
            for j in range(size - parts + 1):
                ok &= passed[j:j + len(ok)]
        # an n-gram that ends in the repeated words was counted with the slice before
        ok[:max(0, self.slice.lead - size + 1)] = False
        return np.flatnonzero(ok)

    def grouped(self, size: int, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places with equal fingerprints together, where each group begins, its size)."""
        fps = self.of(size)[0][places]
        order = np.argsort(fps)
        fps = fps[order]
        first = np.flatnonzero(np.append(True, fps[1:] != fps[:-1])) if len(fps) else np.zeros(0, np.int64)
        return places[order], first, np.diff(np.append(first, len(fps)))

    def doc_of(self, places: np.ndarray) -> pa.Array:
        at = np.searchsorted(self.starts, self.begin[places], "right") - 1
        return pa.array(self.docs[at], pa.int64(), mask=self.nameless[at])

    def numbers(self) -> np.ndarray:
        """A number for each word, the same for equal words only: fingerprints, checked byte by byte."""
        order = np.argsort(self.words, kind="stable")
        hashes = self.words[order]
        new = np.append(True, hashes[1:] != hashes[:-1]) if len(hashes) else np.zeros(0, bool)
        group = np.cumsum(new) - 1
        out = np.empty(len(hashes), np.int64)
        out[order] = group
        shown = order[np.flatnonzero(new)][group] if len(hashes) else order
        length = (self.end - self.begin)[order]
        other = length != (self.end - self.begin)[shown]
        for i in range(0, len(order), CHECKED_WORDS):
            part = slice(i, i + CHECKED_WORDS)
            sizes = np.where(other[part], 0, length[part])
            within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            differs = self.bytes[np.repeat(self.begin[order[part]], sizes) + within] != \
                self.bytes[np.repeat(self.begin[shown[part]], sizes) + within]
            other[part] |= np.bincount(np.repeat(np.arange(len(sizes)), sizes)[differs], minlength=len(sizes)) > 0
        # words whose fingerprint is that of another word
        extra: dict[bytes, int] = {}
        for w in order[other].tolist():
            text = self.slice.data[self.begin[w]:self.end[w]]
            out[w] = extra.setdefault(text, len(hashes) + len(extra))
        return out

    def text(self, place: int, size: int, names: dict[bytes, bytes]) -> str:
        words = [self.slice.data[b:e] for b, e in zip(self.begin[place:place + size].tolist(),
                                                      self.end[place:place + size].tolist())]
        return b" ".join([names.get(w, w) for w in words]).decode("utf-8", "surrogatepass")

    def texts(self, places: np.ndarray, size: int, tail: str, names: dict[bytes, bytes]) -> list[str]:
        """The words of each phrase, a blank between them, and ``tail`` behind them."""
        if names:
            return [self.text(p, size, names) + tail for p in places.tolist()]
        more, out = b" " + tail.encode(), []
        source = np.append(self.bytes, np.frombuffer(more, np.uint8))
        for i in range(0, len(places), TEXT_ROWS):
            words = places[i:i + TEXT_ROWS, None] + np.arange(size)
            begins = np.full((len(words), 2 * size), len(self.bytes))
            sizes = np.ones_like(begins)
            begins[:, ::2], sizes[:, ::2] = self.begin[words], self.end[words] - self.begin[words]
            begins[:, -1], sizes[:, -1] = len(self.bytes) + 1, len(more) - 1
            ends = np.cumsum(sizes)
            at = np.arange(ends[-1]) + np.repeat(begins.ravel() - ends + sizes.ravel(), sizes.ravel())
            bounds = np.append(0, ends[2 * size - 1::2 * size]).astype(np.int32)
            made = pa.Array.from_buffers(pa.string(), len(words), [None, pa.py_buffer(bounds), pa.py_buffer(source[at])])
            out += made.to_numpy(zero_copy_only=False).tolist()
        return out


def _tallied(tallies: np.ndarray, cap: int) -> np.ndarray:
    """Add up (fingerprint, count) pairs, each in one number, to one per fingerprint in order; counts end at ``cap``."""
    if not len(tallies):
        return tallies
    tallies, low = np.sort(tallies), np.uint64((1 << COUNT_BITS) - 1)
    fps = tallies & ~low
    first = np.flatnonzero(np.append(True, fps[1:] != fps[:-1]))
    return fps[first] | np.minimum(np.add.reduceat(tallies & low, first), np.uint64(cap))


_PACKED = pa.schema([("bucket", pa.int32()), ("width", pa.int32()), ("steps", pa.binary()), ("counts", pa.binary())])


def _packed(tallies: np.ndarray, bits: int, cap: int) -> Iterator[pa.RecordBatch]:
    """Rows of the tallies with equal leading ``bits``: steps between fingerprints, each with a bit that says
    whether a count over 1 follows in ``counts``. A row's steps all take ``width`` bytes."""
    bounds = np.searchsorted(tallies, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
    sizes = np.diff(bounds, append=len(tallies))
    buckets = np.flatnonzero(sizes)
    bounds, sizes = bounds[buckets], sizes[buckets]
    fps, n = tallies >> np.uint64(COUNT_BITS), tallies & np.uint64((1 << COUNT_BITS) - 1)
    steps = np.diff(fps, prepend=np.uint64(0))
    steps[bounds] = fps[bounds] & np.uint64((1 << FP_BITS - bits) - 1)
    steps = steps << np.uint64(1) | (n > 1).astype(np.uint64)
    widths = 1 + np.searchsorted([1 << 8 * k for k in range(1, 6)], np.maximum.reduceat(steps, bounds), "right")
    kind = np.min_scalar_type(cap)
    for width in np.unique(widths).tolist():
        rows = widths == width
        own = np.repeat(rows, sizes)
        shown, counts = steps[own], n[own]
        data = np.ascontiguousarray(shown.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])
        ends = np.append(0, np.cumsum(sizes[rows]))
        more = np.append(0, np.cumsum(counts > 1))[ends] * kind.itemsize
        columns = [pa.array(buckets[rows], pa.int32()), pa.array(np.full(rows.sum(), width), pa.int32())] + [
            pa.Array.from_buffers(pa.binary(), len(e) - 1, [None, pa.py_buffer(e.astype(np.int32)), pa.py_buffer(d)])
            for e, d in ((ends * width, data), (more, counts[counts > 1].astype(kind)))]
        yield pa.RecordBatch.from_arrays(columns, schema=_PACKED)


def _unpacked(rows: pa.RecordBatch, bits: int, cap: int) -> np.ndarray:
    """The tallies of packed rows."""
    kind, out = np.min_scalar_type(cap), []
    widths = rows.column(1).to_numpy()
    for width in np.unique(widths).tolist():
        buckets, _, steps, counts = rows.filter(pa.array(widths == width)).columns
        ends = [np.frombuffer(c.buffers()[1], np.int32, len(c) + 1, 4 * c.offset) for c in (steps, counts)]
        data, more = (np.frombuffer(c.buffers()[2] or b"", np.uint8)[e[0]:e[-1]] for c, e in zip((steps, counts), ends))
        sizes = np.diff(ends[0]) // width
        wide = np.zeros((len(data) // width, 8), np.uint8)
        wide[:, :width] = data.reshape(-1, width)
        shown = wide.view("<u8").ravel()
        sums = np.cumsum(shown >> np.uint64(1), dtype=np.uint64)
        before = np.append(np.zeros(1, np.uint64), sums)[np.cumsum(sizes) - sizes]
        base = (buckets.to_numpy().astype(np.uint64) << np.uint64(FP_BITS - bits)) - before
        n = np.ones(len(shown), np.uint64)
        n[shown & np.uint64(1) == 1] = np.frombuffer(more.tobytes(), kind)
        out.append((sums + np.repeat(base, sizes)) << np.uint64(COUNT_BITS) | n)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _count(batches: Iterator[pa.RecordBatch], sizes: tuple[int, ...], known: Broadcast | None, bits: int,
           cap: int) -> Iterator[pa.RecordBatch]:
    """Packed tallies of the n-grams of (doc, lang, text) rows whose parts are frequent."""
    bitmap = None if known is None else np.frombuffer(known.value, np.uint8)
    polynomials = Polynomials(SLICE_BYTES + (1 << 16))
    held, n = [], 0
    for s in _slices(batches, {}):
        grams = _Grams(s, polynomials)
        for size in sizes:
            fps = grams.of(size)[0][grams.places(size, bitmap, min(2, size))]
            held.append(_tallied(fps >> np.uint64(COUNT_BITS) << np.uint64(COUNT_BITS) | np.uint64(1), cap))
            n += len(held[-1])
        if n >= HELD:
            held = [_tallied(np.concatenate(held), cap)]
            n = len(held[0])
            # where many were the same, there is room for more
            if n > HELD // 4 * 3:
                yield from _packed(held[0], bits, cap)
                held, n = [], 0
    if n:
        yield from _packed(_tallied(np.concatenate(held), cap), bits, cap)


def _add_up(batches: Iterator[pa.RecordBatch], bits: int, cap: int) -> Iterator[pa.RecordBatch]:
    """Fingerprints with a count of ``cap``, of packed rows in order of their buckets."""
    held, at = [], 0

    def frequent(tallies: np.ndarray) -> pa.RecordBatch:
        reached = tallies[tallies & np.uint64((1 << COUNT_BITS) - 1) == cap] >> np.uint64(COUNT_BITS)
        return pa.RecordBatch.from_arrays([pa.array(_mixed(reached).view(np.int64))], names=["fp"])

    for batch in batches:
        for start in range(0, batch.num_rows, PACKED_ROWS):
            rows = batch.slice(start, PACKED_ROWS)
            held.append(_unpacked(rows, bits, cap))
            last = rows.column(0)[-1].as_py()
            if last > at:
                tallies = _tallied(np.concatenate(held), cap)
                whole = int(np.searchsorted(tallies, np.uint64(last << 64 - bits)))
                yield frequent(tallies[:whole])
                held, at = [tallies[whole:]], last
    if held:
        yield frequent(_tallied(np.concatenate(held), cap))


def _recounted(grams: _Grams, sizes: tuple[int, ...], known: np.ndarray | None, names: dict[bytes, bytes]):
    """(phrase and language, count, document) of n-grams with a frequent fingerprint, told apart by their words.

    A fingerprint's places point into the text: there its phrase is read, and every other place compared with it.
    An empty phrase counts all words.
    """
    tail, ids = KEY_CUT + grams.slice.lang, grams.numbers()
    yield [tail], [len(grams.words) - grams.slice.lead], [None]
    for size in sizes:
        places, first, n = grams.grouped(size, grams.places(size, known, size))
        # an occurrence whose words differ from those of its fingerprint's first one here is a collision
        shown = np.repeat(places[first], n)
        other = np.zeros(len(places), bool)
        for j in range(size):
            other |= ids[places + j] != ids[shown + j]
        if len(first):
            n = n - np.add.reduceat(other.astype(np.int64), first)
        at, counts = np.append(places[first], places[other]), np.append(n, np.ones(other.sum(), np.int64))
        yield grams.texts(at, size, tail, names), counts, grams.doc_of(at)


_RECOUNTED = pa.schema([("key", pa.string()), ("n", pa.int64()), ("doc", pa.int64())])


def _recount(batches: Iterator[pa.RecordBatch], sizes: tuple[int, ...], known: Broadcast) -> Iterator[pa.RecordBatch]:
    """Counts of the frequent n-grams of (doc, lang, text) rows by their text, a slice of texts at a time."""
    bitmap = np.frombuffer(known.value, np.uint8)
    polynomials = Polynomials(SLICE_BYTES + (1 << 16))
    names: dict[bytes, bytes] = {}
    for s in _slices(batches, names):
        for columns in _recounted(_Grams(s, polynomials), sizes, bitmap, names):
            for i in range(0, len(columns[0]), OUT_ROWS):
                parts = [c[i:i + OUT_ROWS] for c in columns]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type)
                                                  for c, f in zip(parts, _RECOUNTED)], schema=_RECOUNTED)


def _frequent(texts: DataFrame, sizes: tuple[int, ...], known: Broadcast | None, least: int) -> DataFrame:
    """(fp): fingerprints that occur ``least`` times or more, shortened to ``FP_BITS`` and mixed.

    Two n-grams that share a fingerprint count together, so more may pass, but none is lost. A task hands its
    counts on packed, one row for all fingerprints with equal leading bits: by these, rows meet.
    """
    cap = max(1, min(least, (1 << COUNT_BITS) - 1))
    # a task adds up one bucket at a time, so wider shuffles of more data have more of them
    bits = min(20, max(12, (16 * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))).bit_length()))
    rows = texts.mapInArrow(partial(_count, sizes=sizes, known=known, bits=bits, cap=cap),
                            "bucket int, width int, steps binary, counts binary")
    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(partial(_add_up, bits=bits, cap=cap), "fp long")


def _bitmap(frequent: DataFrame, bits: int) -> np.ndarray:
    """A bit set of fixed size that holds fingerprints, built where they are."""
    mask = F.lit(bits - 1)
    cells = F.explode(F.array(F.col("fp").bitwiseAND(mask), F.shiftrightunsigned("fp", 32).bitwiseAND(mask)))
    words = frequent.select(cells.alias("cell")).groupBy(F.shiftright("cell", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(cell & 63 as int))")).alias("set"))
    # at most bits / 64 rows, whatever the number of fingerprints
    made = words.toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[made["word"].to_numpy()] = made["set"].to_numpy()
    return out


def phrase_counts(df: DataFrame, key: str = "doc_id", lang: str = "lang", text: str = "text", least: int = MIN_COUNT,
                  filter_bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """(lang, size, phrase, f, doc) of phrases of one to four words that occur ``least`` times, and (lang, n).

    A phrase of ``size`` words lies within a piece; ``f`` counts all its occurrences, ``doc`` is the smallest key
    of a document that a counting task saw it in, and ``n`` all word occurrences of the language. A null
    language is ``und``; a null or empty text has no words; repeated rows each count; null keys never become
    ``doc``. Fingerprints are counted first, longer n-grams only if all their pairs are frequent (an n-gram cannot
    be more frequent than its parts). Frequent ones are counted again by their text, so two phrases with one
    fingerprint cannot be mistaken for each other.
    """
    spark = df.sparkSession
    texts = df.select(F.col(key).cast("long").alias("doc"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"),
                      F.col(text).alias("text"))

    def shared(bits: np.ndarray) -> Broadcast:
        return spark.sparkContext.broadcast(bits.astype("<i8").tobytes())

    short = _bitmap(_frequent(texts, (1, 2), None, least), filter_bits)
    longer = _bitmap(_frequent(texts, (3, 4), shared(short), least), filter_bits)
    again = texts.mapInArrow(partial(_recount, sizes=(1, 2, 3, 4), known=shared(short | longer)),
                             "key string, n long, doc long")
    # one text per language and phrase: narrower rows than two
    counted = again.groupBy("key").agg(F.sum("n").alias("f"), F.min("doc").alias("doc"))
    found = counted.select(F.expr(f"substring(key, instr(key, '{KEY_CUT}') + 1)").alias("lang"),
                           F.substring_index("key", KEY_CUT, 1).alias("phrase"), "f", "doc")
    found = found.filter((F.col("f") >= least) | (F.col("phrase") == "")).withColumn(
        "size", F.when(F.col("phrase") != "", F.size(F.split("phrase", " ", -1))).otherwise(0))
    kept = materialize(found, "phrases")
    return kept.filter("size > 0"), kept.filter("size = 0").select("lang", F.col("f").alias("n"))


def _scored(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, a, doc, l, r, score) of the lowest-scoring cut of each candidate."""
    words = F.split("phrase", " ", -1)
    cuts = phrases.filter("size > 1").select("lang", "phrase", F.col("f").alias("a"), "doc", words.alias("w"), F.explode(
        F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    parts = cuts.select("lang", "phrase", "a", "doc", "k", F.posexplode(F.array(
        F.array_join(F.expr("slice(w, 1, k)"), " "),
        F.array_join(F.expr("slice(w, k + 1, size(w) - k)"), " "))).alias("side", "part"))
    known = phrases.select("lang", F.col("phrase").alias("part"), F.col("f"))
    # one grouping for all cuts of a phrase
    sides = parts.join(known, ["lang", "part"]).groupBy("lang", "phrase").agg(
        F.max("a").alias("a"), F.max("doc").alias("doc"), *[
            F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("f"))).alias(f"{name}{k}")
            for k in range(1, LONGEST) for side, name in enumerate("lr")])
    wide = "decimal(38,0)"
    cut = ", ".join(f"struct((cast(2000000 as {wide}) * cast(a as decimal(20,0))) div (cast(l{k} as {wide}) + cast(r{k} as {wide})) "
                    f"AS score, {k} AS k, l{k} AS l, r{k} AS r)" for k in range(1, LONGEST))
    return sides.withColumn("c", F.expr(f"array_min(filter(array({cut}), c -> c.score IS NOT NULL))")).select(
        "lang", "phrase", "a", "doc", "c.l", "c.r", "c.score")


def _covered(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, cover): the largest count of a longer candidate that holds the phrase's words in a row."""
    longer = phrases.filter("size > 2").select("lang", "size", "f", F.split("phrase", " ", -1).alias("w"))
    inner = F.expr("""flatten(transform(sequence(2, size - 1), m ->
        transform(sequence(1, size - m + 1), i -> array_join(slice(w, i, m), ' '))))""")
    return longer.select("lang", F.explode(inner).alias("phrase"), "f").groupBy("lang", "phrase").agg(
        F.max("f").alias("cover"))


def collocations(df: DataFrame, key: str = "doc_id", lang: str = "lang", text: str = "text", least: int = MIN_COUNT,
                 top: int = TOP, **options) -> DataFrame:
    """The ``top`` collocations of each language: lang, rank, phrase, a, l, r, n, score, doc.

    A candidate is a phrase of two to four words that occurs ``a >= least`` times. Of its cuts into two parts
    with counts ``l`` and ``r`` the one with the lowest ``2000000 a div (l + r)`` counts, of equal ones the first.
    Candidates inside a longer candidate that is at least 80 % as frequent are dropped. Ranked by score, then
    ``a``, both descending, then phrase in byte order. Nulls, empty texts and repeated rows: see ``phrase_counts``.
    An empty table gives no rows; other columns are not read.
    """
    phrases, totals = phrase_counts(df, key, lang, text, least, **options)
    scored = _scored(phrases).join(_covered(phrases), ["lang", "phrase"], "left")
    wide = "decimal(20,0)"
    kept = scored.filter(F.expr(f"cover is null or 100 * cast(cover as {wide}) < 80 * cast(a as {wide})"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    # one row per language
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "doc")
