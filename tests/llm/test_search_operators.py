"""Ranked search, collocations and nearest neighbours against brute force, with nulls, ties, repeats and empty tables."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowspark.llm import collocations, cross_polytope, lexical_search, queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    return pd.read_parquet(f"{SF_DIR}/documents.parquet")


# ---- ranked lexical search ----

def _terms(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", lowered)


def _ranking(docs, items, top=10):
    """{item: [(doc, score)]}; docs and items are lists of (id, text)."""
    bags = [(k, Counter(_terms(t))) for k, t in docs]
    bags = [(k, b, sum(b.values())) for k, b in bags if b]
    n, length = len(bags), sum(size for _, _, size in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    wanted: dict = {}
    for k, t in items:
        wanted.setdefault(k, set()).update(_terms(t))
    out = {}
    for item, terms in wanted.items():
        scores = []
        for k, b, size in bags:
            m = 10 + 90 * size * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10 ** 9 * b[t] // (1000 * b[t] + 8 * m))
                    for t in terms if t in b)
            if s > 0:
                scores.append((-s, k is None, k or 0, k))
        out[item] = [(k, -s) for s, _, _, k in sorted(scores)[:top]]
    return {k: v for k, v in out.items() if v}


def _got(found, item="item_id", key="doc_id"):
    out: dict = {}
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        out.setdefault(r[item], []).append((r[key], r["score"]))
        assert r["rank"] == len(out[r[item]])
    return out


DOCS = [(1, "alpha beta gamma"), (2, "Alpha BETA gamma"), (2, "alpha beta gamma"), (None, "alpha beta gamma"), (3, None),
        (4, ""), (5, "!!! ..."), (6, "beta beta beta É é 😀 x1"), (7, "delta " * 40_000), (8, "delta epsilon zeta " * 3),
        (9, " ".join(f"w{i}" for i in range(3000)))]
ITEMS = [(1, "alpha gamma"), (1, "alpha gamma"), (1, "delta"), (None, "beta é"), (2, None), (3, ""), (4, "unknown"),
         (5, " ".join(f"w{i}" for i in range(0, 3000, 7))), (6, "w1500 zeta alpha")]


@pytest.mark.parametrize("options", [{}, {"block_pairs": 100, "block_docs": 1}, {"top": 2, "seed_docs": 0}])
def test_search_of_odd_rows(spark, options):
    docs = spark.createDataFrame([(*r, 1, "s", "t") for r in DOCS], "doc_id long, text string, n int, segment string, terms string")
    items = spark.createDataFrame([(*r, "x") for r in ITEMS], "item_id long, text string, doc string")
    assert _got(lexical_search.search(docs, items, **options)) == _ranking(DOCS, ITEMS, options.get("top", 10))


def test_search_with_string_items_and_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame([("q", "alpha")], "item_id string, text string")
    assert set(_got(lexical_search.search(docs, items))) == {"q"}
    assert lexical_search.search(docs.limit(0), items).count() == 0
    none = lexical_search.search(docs, items.limit(0))
    assert none.count() == 0 and none.columns == ["item_id", "rank", "doc_id", "score"]
    assert lexical_search.search(docs.filter("doc_id in (3, 4, 5)"), items).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_small_segments_and_seeds_change_nothing(spark, monkeypatch, seed):
    monkeypatch.setattr(lexical_search, "SEGMENT_POSTINGS", 70)
    rng = random.Random(seed)
    words = [f"v{i}" for i in range(30)]
    docs = [(i, " ".join(rng.choices(words, [1 / (j + 1) for j in range(30)], k=rng.randint(0, 25)))) for i in range(400)]
    docs += [(1000 + i, docs[5][1]) for i in range(50)]
    items = [(i, " ".join(rng.sample(words, rng.randint(1, 8)))) for i in range(12)]
    found = lexical_search.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
                                  spark.createDataFrame(items, "item_id long, text string"), seed_docs=100)
    assert _got(found) == _ranking(docs, items)


def test_blocks_are_passed_over_and_bounds_hold(monkeypatch):
    """Summaries bound every member's score, and a search of one segment scores few of its documents."""
    monkeypatch.setattr(lexical_search, "FIRST_BLOCKS", 2)
    rng = np.random.default_rng(3)
    weights = rng.integers(1, 8000, 300)
    segment = lexical_search._Segment()
    # twenty topics of fifteen terms, in each ten kinds of documents that differ in little
    kinds = [(np.unique(rng.integers(0, 15, 5)) + 15 * (k % 20)) for k in range(200)]
    strength = [rng.integers(1000, 900_000, len(t)) for t in kinds]
    for i in range(2000):
        terms = kinds[i % 200]
        segment.add(i, terms, strength[i % 200] + rng.integers(0, 1000, len(terms)), len(terms))
    items = lexical_search._Items([np.arange(15 * t, 15 * t + 6) for t in range(20)], weights, 1, 1, 10)
    signs = rng.integers(0, 2, (300, lexical_search.SKETCH)).astype(np.float32) * 2 - 1
    rows = lexical_search.segment_rows(segment, 0, items, signs, 16)
    vectors = [dict(zip(t.tolist(), x.tolist())) for t, x in zip(segment.terms, segment.impacts)]
    wanted = {t for terms in items.terms for t in terms.tolist()}
    postings: Counter = Counter()
    for row in rows.to_pylist()[2000:]:
        expected: dict = {}
        for d in row["members"]:
            assert row["term"] in vectors[d]
            postings[row["term"], d] += 1
            for t, x in vectors[d].items():
                if t // 15 == row["term"] // 15 and t in wanted:
                    expected[t] = max(expected.get(t, 0), x)
        assert dict(zip(row["terms"], row["impacts"])) == expected
    assert postings == Counter((t, d) for d, v in enumerate(vectors) for t in v if t in wanted)
    searcher, scored, weight_of = lexical_search.Searcher(rows), 0, np.zeros(300, np.int64)
    for terms in items.terms:
        weight_of[:] = 0
        weight_of[terms] = weights[terms]
        searcher.scored = 0
        score, docs = searcher.best(terms, terms, weights[terms], weight_of, 10, 0)
        every = sorted(((-sum(int(weights[t]) * v.get(t, 0) for t in terms.tolist()), d) for d, v in enumerate(vectors)))[:10]
        assert list(zip((-score).tolist(), docs.tolist())) == every
        scored += searcher.scored
    holders = sum(any(t in v for t in terms.tolist()) for terms in items.terms for v in vectors)
    assert scored < 0.6 * holders


def test_lists_that_cannot_reach_the_score_are_left_out():
    items = lexical_search._Items([np.array([0, 1, 2, 3])], np.array([1, 5, 20, 100, 7]), 1, 1, 10)
    items.reach({0: 120}, np.array([10, 10, 5, 1, 1]))
    assert items.lists[0].tolist() == [2, 3]
    items.reach({}, np.array([10, 10, 5, 1, 1]))
    assert items.lists[0].tolist() == [0, 1, 2, 3]


# ---- collocations ----

def _collocations(docs, least, top=2000):
    """Brute force over (lang, text)."""
    f: dict = {}
    n: Counter = Counter()
    for lang, text in docs:
        count = f.setdefault(lang or "und", Counter())
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            count.update(tuple(w[i:i + k]) for k in (1, 2, 3, 4) for i in range(len(w) - k + 1))
    out = []
    for lang, count in f.items():
        some = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in some.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i:i + len(p)] == p for i in range(len(q)))
                   for q, b in some.items()):
                continue
            score, k = min((2_000_000 * a // (count[p[:k]] + count[p[k:]]), k) for k in range(1, len(p)))
            rows.append((" ".join(p), a, count[p[:k]], count[p[k:]], n[lang], score))
        rows.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        out += [(lang, i + 1, *r) for i, r in enumerate(rows[:top])]
    return sorted(out)


def _mined(df, **options):
    rows = collocations.collocations(df, **options).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    return sorted(tuple(r) for r in rows)


TEXTS = [(1, "New York, new york. NEW\tYORK\nnew  york city", "en"), (1, "New York, new york. NEW\tYORK\nnew  york city", "en"),
         (2, None, "en"), (3, "", None), (None, "a b c d e a b c d e", None), (4, "é é é. É x\x00y x\x00y", "fr"),
         (5, "one " * 30_000, "de"), (6, "...", "de"), (6, "a b a b", "x\ty"), (7, "x" * 100_000 + " tail tail", "de")]


@pytest.mark.parametrize("size", [256, 4096, 4 << 20])
def test_collocations_of_odd_rows(spark, monkeypatch, size):
    monkeypatch.setattr(collocations, "SLICE_BYTES", size)
    monkeypatch.setattr(collocations, "WORD_BYTES", min(size // 4, 50_000))
    rows = [(*r, "x", 1) for r in TEXTS if size > 256 or len(r[1] or "") < 1000]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, phrase string, n int").coalesce(1)
    # tasks read the module anew, so the slices are made here as well
    names: dict = {}
    made = list(collocations._slices(iter(df.select("doc_id", F.coalesce("lang", F.lit("und")).alias("lang"), "text")
                                          .toArrow().to_batches()), names))
    assert all(len(s.data) < size + 2 * max(len(r[1] or "") for r in rows if len(r[1] or "") <= size) + 200 for s in made)
    assert _sliced(made, names, (1, 2, 3, 4)) == _all_grams(rows)
    assert _mined(df, least=2) == _collocations([(r[2], r[1]) for r in rows], 2)
    assert _mined(df.limit(0), least=2) == []
    assert _mined(df, least=2, top=1) == _collocations([(r[2], r[1]) for r in rows], 2, 1)


def _all_grams(rows):
    out: Counter = Counter()
    for _, text, lang, *_ in rows:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            w = re.findall("[^\x20\x09]+", piece)
            out.update((lang or "und", " ".join(w[i:i + k])) for k in (1, 2, 3, 4) for i in range(len(w) - k + 1))
    return out


def _sliced(slices, names, sizes):
    out: Counter = Counter()
    polynomials = collocations.Polynomials(16)
    for s in slices:
        for keys, counts, _ in collocations._recounted(collocations._Grams(s, polynomials), sizes, None, names):
            for key, n in zip(keys, counts):
                text, _, lang = key.partition(collocations.KEY_CUT)
                if text:
                    out[lang, text] += int(n)
    return out


def test_long_texts_and_words_in_slices(monkeypatch):
    monkeypatch.setattr(collocations, "SLICE_BYTES", 128)
    monkeypatch.setattr(collocations, "WORD_BYTES", 16)
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices("ab cd ef gh. ij kl\tmn é aslightlylongerword.".split(" "), k=300)), "en") for i in range(5)]
    names: dict = {}
    batch = pa.RecordBatch.from_pydict({"doc": [r[0] for r in rows], "lang": ["en"] * 5, "text": [r[1] for r in rows]})
    slices = list(collocations._slices(iter([batch]), names))
    assert len(slices) > 20 and list(names.values()) == [b"aslightlylongerword"]
    assert _sliced(slices, names, (1, 2, 3, 4)) == _all_grams(rows)


def test_a_full_filter_lets_more_through_but_changes_nothing(spark, documents):
    df = spark.createDataFrame(documents[["doc_id", "text", "lang"]])
    assert _mined(df, least=5, filter_bits=64) == _mined(df, least=5)


def test_equal_fingerprints_of_different_phrases_are_told_apart(monkeypatch):
    monkeypatch.setattr(collocations, "_mixed", lambda x: x % np.uint64(3))
    monkeypatch.setattr(collocations, "CHECKED_WORDS", 2)
    s = collocations._Slice("en", b"a b a b c a.bb", [0], [9], 0)
    made: Counter = Counter()
    for keys, counts, docs in collocations._recounted(
            collocations._Grams(s, collocations.Polynomials(16)), (1, 2), None, {}):
        for key, c, d in zip(keys, counts, docs if isinstance(docs, list) else docs.to_pylist()):
            p = key.partition(collocations.KEY_CUT)[0]
            assert d == (9 if p else None)
            made[p] += int(c)
    assert made == {"": 7, "a": 3, "b": 2, "c": 1, "bb": 1, "a b": 2, "b a": 1, "b c": 1, "c a": 1}


def _word_rows(words, lines):
    rng = np.random.default_rng(5)
    made = [" ".join(f"w{int(x * x * words)}" for x in rng.random(200)) + "." for _ in range(lines)]
    return pa.RecordBatch.from_pydict({"doc": list(range(lines)), "lang": ["en", "fr"] * (lines // 2), "text": made})


@pytest.mark.parametrize("cap", [1, 3, 300])
@pytest.mark.parametrize("held, rows", [(1 << 21, 1 << 10), (2000, 3), (50, 1 << 10)])
def test_packed_counts_are_those_of_brute_force(monkeypatch, held, rows, cap):
    for name, value in (("HELD", held), ("PACKED_ROWS", rows), ("SLICE_BYTES", 20_000)):
        monkeypatch.setattr(collocations, name, value)
    batch, mark = _word_rows(500, 60), np.uint64(collocations.COUNT_BITS)
    tasks = [batch.slice(0, 25), batch.slice(25), batch.slice(0, 0)]
    packed = [b for t in tasks for b in collocations._count(iter([t]), (1, 2), None, 12, cap)]
    table = pa.Table.from_batches(packed).sort_by("bucket")
    made = [b.column(0).to_numpy() for b in collocations._add_up(iter(table.to_batches(max_chunksize=1000)), 12, cap)]
    grams = [collocations._Grams(s, collocations.Polynomials(16)) for s in collocations._slices(iter([batch]), {})]
    fps, n = np.unique(np.concatenate([g.of(k)[0][g.places(k, None, 1)] for g in grams for k in (1, 2)]) >> mark, return_counts=True)
    assert sorted(np.concatenate(made)) == sorted(collocations._mixed(fps[n >= cap]).view(np.int64))
    assert list(collocations._add_up(iter([]), 12, cap)) == []


def test_counts_are_handed_on_in_few_bytes():
    batch = _word_rows(100_000, 2000)
    packed = list(collocations._count(iter([batch]), (1, 2), None, 12, 30))
    tallies = [collocations._unpacked(b, 12, 30) for b in packed]
    # a row of (fingerprint, count) alone took 11 bytes in the shuffle
    assert sum(len(t) for t in tallies) > 300_000
    assert sum(b.nbytes for b in packed) < 5 * sum(len(t) for t in tallies)


def test_polynomials_do_not_depend_on_the_place():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    words[3000:3100] = words[100:200]
    made = collocations.Polynomials(10)
    prefixes = made.prefixes(words)
    for size in (1, 2, 3, 4):
        fps = made.grams(prefixes, size)
        assert (fps[3000:3100 - size] == fps[100:200 - size]).all() and len(np.unique(fps)) == len(fps) - 100 + size - 1


# ---- nearest neighbours ----

def _nearest(rows, wanted, top=10):
    """{query: [(key, distance)]} by brute force over (key, vector)."""
    good = [(k, np.array(v, float)) for k, v in rows if k is not None and v and None not in v
            and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    out = {}
    for k, v in good:
        if wanted(k):
            best = out.setdefault(k, {})
            for other, x in good:
                if other != k and len(x) == len(v):
                    d = float(np.sqrt(((x - v) ** 2).sum()))
                    best[other] = min(d, best.get(other, d))
    return {k: [(o, d) for d, o in sorted((d, o) for o, d in v.items())[:top]] for k, v in out.items() if v}


def test_nearest_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0]), (2, [0.0, 2.0, 0.0]), (2, [1.0, 0.1, 0.0]),
            (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [nan, 1.0, 1.0]), (7, [inf, 1.0, 1.0]), (8, [1.0, None, 1.0]),
            (None, [1.0, 0.0, 0.0]), (9, [1.0, 2.0]), (10, [-1.0, 0.0, 0.0]), (11, [1e300, 1e-300, 0.0]), (12, [5.0])]
    df = spark.createDataFrame([(*r, [1], 2) for r in rows], "vec_id long, embedding array<double>, codes array<int>, rank int")
    found = cross_polytope.nearest(df, queries=F.col("vec_id") % 2 == 0, top=4)
    got: dict = {}
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query"], []).append((r["key"], r["distance"]))
    want = _nearest(rows, lambda k: k % 2 == 0, 4)
    assert {k: [o for o, _ in v] for k, v in got.items()} == {k: [o for o, _ in v] for k, v in want.items()}
    assert cross_polytope.nearest(df.limit(0)).count() == 0
    assert cross_polytope.nearest(df, queries=F.col("vec_id") < 0).count() == 0


def test_many_copies_do_not_push_others_out(spark):
    rows = [(i, [1.0, 0.0, 0.0, 0.0]) for i in range(100, 400)] + [(5, [0.9, 0.1, 0.0, 0.0])] * 30 + [(7, [0.8, 0.2, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = cross_polytope.nearest(df, queries=F.col("vec_id").isin(5, 250), top=10).collect()
    assert [r["key"] for r in sorted(found, key=lambda r: (r["query"], r["rank"]))] == \
        [7, *range(100, 109), *range(100, 110)]


def test_blocks_of_queries_change_nothing(spark):
    df = spark.read.parquet(f"{SF_DIR}/embeddings.parquet")
    once = cross_polytope.nearest(df, queries=F.col("vec_id") % 20 == 0).collect()
    dealt = cross_polytope.nearest(df, queries=F.col("vec_id") % 20 == 0, block_bytes=4 * 64 * 8).collect()
    assert sorted(once) == sorted(dealt) and len(once) == 250


def test_hadamard_rotation_keeps_lengths_and_angles():
    x = np.random.default_rng(5).normal(size=(50, 48))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    r = cross_polytope.rotated(x, 3)
    assert r.shape == (50, 64) and np.allclose(r @ r.T, u @ u.T)
    made = cross_polytope.codes(x, 2)
    assert (cross_polytope.probes(x, 2, 3)[:, :, 0] == made).all()
    assert (made[:, 1] == cross_polytope.codes(1000 * x, 2)[:, 1]).all()


@pytest.mark.parametrize("sf", ["0.001", "0.1"])
def test_recall_against_brute_force(spark, sf):
    folder = f"/root/testdata/sf{sf}"
    table = pd.read_parquet(f"{folder}/embeddings.parquet")
    x = np.array(table.embedding.tolist(), np.float64)
    found: dict = {}
    for r in queries.QUERIES["op13_cross_polytope"](spark, folder).collect():
        found.setdefault(r.query_id, {})[r.vec_id] = r.score
    hits = 0
    assert set(found) == set(table.vec_id[table.vec_id % 100 == 0])
    for q, near in found.items():
        d = np.sqrt(((x - x[table.vec_id == q]) ** 2).sum(axis=1))
        order = [(v, k) for v, k in sorted(zip(d, table.vec_id)) if k != q][:10]
        hits += len({k for _, k in order} & set(near))
        assert all(near[k] == pytest.approx(v, rel=1e-12) for v, k in order if k in near)
    assert hits >= 0.9 * 10 * len(found)
