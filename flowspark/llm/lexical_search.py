"""Ranked lexical search: posting lists cut into blocks of similar documents, skipped by exact summary bounds."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from flowspark.llm.common import add_columns, word_slabs
from flowspark.session import materialize

TOP = 10
# (item, term) pairs searched for at once; more items are dealt into blocks, each a pass over the documents
BLOCK_PAIRS = 50_000
# documents a block of a posting list aims at
BLOCK_DOCS = 16
# a segment of the index is full at so many documents times searched terms, or so many postings
SEGMENT_CELLS = 1 << 24
SEGMENT_POSTINGS = 1 << 19
# about so many documents are scored first, for scores that an item's best documents must reach
SEED_DOCS = 20_000
# random projections that tell how alike two documents are
SKETCH = 32
# blocks scored before the rest are judged by the scores found
FIRST_BLOCKS = 16
# impacts stay below 2 ** 20: a million is their limit for many occurrences
_IMPACT_BITS = 20
# A-Z to a-z, all other ASCII but digits and a-z to blanks, the rest as it is
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
               for c in range(256))


def terms_of(text: str | None) -> Iterator[list[bytes]]:
    """Terms of a text with repeats, a bounded number of bytes at a time."""
    return word_slabs((text or "").encode("utf-8", "surrogatepass").translate(_TABLE))


def _distinct_terms(texts):
    return [[sorted({t for part in terms_of(x) for t in part}) for x in texts]]


# ---- documents as searched terms ----

def _forward(batches: Iterator[pa.RecordBatch], vocabulary: Broadcast) -> Iterator[pa.RecordBatch]:
    number = {t: i for i, t in enumerate(vocabulary.value)}
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            sizes, terms, counts = [], [], []
            for text in part.column(1).to_pylist():
                n, ids, tfs = 0, [], []
                for words in terms_of(text):
                    n += len(words)
                    found = np.fromiter(map(number.get, words, repeat(-1)), np.int64, len(words))
                    t, c = np.unique(found[found >= 0], return_counts=True)
                    ids.append(t)
                    tfs.append(c)
                if len(ids) > 1:
                    t, at = np.unique(np.concatenate(ids), return_inverse=True)
                    c = np.zeros(len(t), np.int64)
                    np.add.at(c, at, np.concatenate(tfs))
                    ids, tfs = [t], [c]
                sizes.append(n)
                terms.append(ids[0] if ids else [])
                counts.append(tfs[0] if tfs else [])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())),
                 pa.array(counts, pa.list_(pa.int64()))], names=["doc", "n", "terms", "tfs"])


def _impact(tfs, n, documents: int, length: int):
    """Impact of a term that occurs ``tfs`` times in a document of ``n`` terms."""
    m = 100 - 90 + 90 * n * documents // length
    return (1_000_000_000 * tfs) // (1000 * tfs + 8 * m)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(doc, n, terms, tfs) of documents with searched terms."""
    for batch in batches:
        cuts = batch.column(2).offsets.to_numpy()
        terms, tfs = (batch.column(i).values.to_numpy() for i in (2, 3))
        for i, (doc, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            if cuts[i + 1] > cuts[i]:
                s = slice(cuts[i], cuts[i + 1])
                yield doc, n, terms[s].astype(np.int64), tfs[s]


def _term_stats(batches: Iterator[pa.RecordBatch], n_terms: int) -> Iterator[pa.RecordBatch]:
    """Per task and term: documents, most occurrences in one, fewest terms of one."""
    df, most = np.zeros(n_terms, np.int64), np.zeros(n_terms, np.int64)
    fewest = np.full(n_terms, np.iinfo(np.int64).max)
    for _, n, terms, tfs in _rows(batches):
        df[terms] += 1
        most[terms] = np.maximum(most[terms], tfs)
        fewest[terms] = np.minimum(fewest[terms], n)
    held = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(df[held]), pa.array(most[held]), pa.array(fewest[held])],
                                     names=["term", "df", "most", "fewest"])


# ---- what the search of a block of items knows ----

class _Items:
    """Terms and weights of a block of items, and scores that their best documents are known to reach."""

    def __init__(self, terms: list[np.ndarray], weights: np.ndarray, documents: int, length: int, top: int):
        self.terms, self.weights, self.documents, self.length, self.top = terms, weights, documents, length, top
        self._read(terms, [0] * len(terms))

    def reach(self, least: dict[int, int], ceiling: np.ndarray) -> None:
        """Note scores to reach, and leave out lists that cannot reach them even together.

        ``ceiling`` is an upper bound of the impacts of each term.
        """
        scores, lists = [least.get(i, 0) for i in range(len(self.terms))], []
        for terms, score in zip(self.terms, scores):
            most = self.weights[terms] * ceiling[terms]
            order = np.argsort(most, kind="stable")
            lists.append(np.sort(terms[order[np.cumsum(most[order]) >= max(score, 1)]]))
        self._read(lists, scores)

    def _read(self, lists: list[np.ndarray], least: list[int]) -> None:
        """Lists and scores of the items, and for each list the terms that items read it for."""
        self.lists, self.least = lists, least
        n = len(self.weights)
        self.read = np.zeros(n, bool)
        self.read[np.concatenate([np.zeros(0, np.int64), *lists])] = True
        pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *[
            (some[:, None] * n + terms).ravel() for some, terms in zip(lists, self.terms)]]))
        self.beside, self.beside_cuts = pairs % n, np.searchsorted(pairs // n, np.arange(n + 1))


def _seed_scores(batches: Iterator[pa.RecordBatch], items: Broadcast) -> Iterator[pa.RecordBatch]:
    """The best scores of a task's documents for each item, by scoring all of them."""
    known: _Items = items.value
    weight_of = np.zeros(len(known.weights), np.int64)
    best = [np.zeros(0, np.int64)] * len(known.terms)

    def scored(rows):
        sizes = np.array([len(t) for _, _, t, _ in rows])
        starts = np.cumsum(sizes) - sizes
        terms = np.concatenate([t for _, _, t, _ in rows])
        impacts = np.concatenate([_impact(x, n, known.documents, known.length) for _, n, _, x in rows])
        for i, wanted in enumerate(known.terms):
            weight_of[wanted] = known.weights[wanted]
            found = np.append(best[i], np.add.reduceat(weight_of[terms] * impacts, starts))
            weight_of[wanted] = 0
            best[i] = np.sort(found[found > 0])[-known.top:]

    rows = []
    for row in _rows(batches):
        rows.append(row)
        if len(rows) == 1024:
            scored(rows)
            rows = []
    if rows:
        scored(rows)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.repeat(np.arange(len(best)), [len(x) for x in best]), pa.int32()),
         pa.array(np.concatenate([np.zeros(0, np.int64), *best]))], names=["item", "score"])


# ---- index ----

class _Segment:
    """Documents gathered until the segment is full."""

    def __init__(self):
        self.keys, self.terms, self.impacts, self.postings = [], [], [], 0

    def add(self, key, terms: np.ndarray, impacts: np.ndarray, lists: int) -> None:
        self.keys.append(key)
        self.terms.append(terms)
        self.impacts.append(impacts)
        self.postings += lists

    def full(self, n_terms: int) -> bool:
        return (len(self.keys) + 1) * n_terms > SEGMENT_CELLS or self.postings >= SEGMENT_POSTINGS


def _alike(list_docs: np.ndarray, sketches: np.ndarray, block_docs: int) -> np.ndarray:
    """Block of each document of a posting list: its most similar one of evenly chosen members."""
    n = -(-len(list_docs) // block_docs)
    if n == 1:
        return np.zeros(len(list_docs), np.int64)
    centres = list_docs[np.arange(n) * len(list_docs) // n]
    return np.unique(np.argmax(sketches[list_docs] @ sketches[centres].T, axis=1), return_inverse=True)[1]


def _blocked(segment: _Segment, items: _Items, signs: np.ndarray, block_docs: int):
    """Blocks of the posting lists of a segment: list, sizes and members, sizes, summary terms and summary maxima."""
    sizes = np.array([len(t) for t in segment.terms])
    terms, impacts = np.concatenate(segment.terms), np.concatenate(segment.impacts)
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(sizes)), sizes)
    dense = np.zeros((len(sizes), len(items.weights)), np.int32)
    dense[owner, terms] = impacts
    sketches = np.add.reduceat((items.weights[terms] * impacts).astype(np.float32)[:, None] * signs[terms], starts)
    sketches /= np.maximum(np.linalg.norm(sketches, axis=1, keepdims=True), 1e-20)
    postings = np.flatnonzero(items.read[terms])
    postings = postings[np.argsort(terms[postings], kind="stable")]
    list_terms, begins = np.unique(terms[postings], return_index=True)
    made = [[], [], [], [], [], []]
    for term, docs in zip(list_terms.tolist(), np.split(owner[postings], begins[1:])):
        label = _alike(docs, sketches, block_docs)
        order = np.argsort(label, kind="stable")
        docs, cuts = docs[order], np.flatnonzero(np.append(True, np.diff(label[order]) != 0))
        # of a list only those terms count that some item has together with the list's own
        beside = items.beside[items.beside_cuts[term]:items.beside_cuts[term + 1]]
        largest = np.maximum.reduceat(dense[np.ix_(docs, beside)], cuts)
        block, place = np.nonzero(largest)
        for column, part in zip(made, (np.full(len(cuts), term), np.diff(np.append(cuts, len(docs))), docs,
                                       np.bincount(block, minlength=len(cuts)), beside[place], largest[block, place])):
            column.append(part)
    return [np.concatenate([np.zeros(0, np.int64), *c]) for c in made]


_INDEX = pa.schema([("segment", pa.int64()), ("no", pa.int32()), ("key", pa.int64()), ("term", pa.int32()),
                    ("members", pa.list_(pa.int32())), ("terms", pa.list_(pa.int32())), ("impacts", pa.list_(pa.int32()))])
_INDEX_DDL = "segment long, no int, key long, term int, members array<int>, terms array<int>, impacts array<int>"


def _lists_of(sizes: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(values, pa.int32()))


def segment_rows(segment: _Segment, no: int, items: _Items, signs: np.ndarray, block_docs: int) -> pa.Table:
    """A segment as rows: one per document (numbered within the segment), one per block of a posting list."""
    docs = len(segment.keys)
    term, member_sizes, members, sizes, terms, largest = _blocked(segment, items, signs, block_docs)
    own_sizes = [len(t) for t in segment.terms]
    first = pa.table([pa.array(np.full(docs, no)), pa.array(np.arange(docs), pa.int32()), pa.array(segment.keys, pa.int64()),
                      pa.nulls(docs, pa.int32()), pa.nulls(docs, pa.list_(pa.int32())),
                      _lists_of(own_sizes, np.concatenate(segment.terms)),
                      _lists_of(own_sizes, np.concatenate(segment.impacts))], schema=_INDEX)
    n = len(term)
    second = pa.table([pa.array(np.full(n, no)), pa.array(np.arange(docs, docs + n), pa.int32()), pa.nulls(n, pa.int64()),
                       pa.array(term, pa.int32()), _lists_of(member_sizes, members), _lists_of(sizes, terms),
                       _lists_of(sizes, largest)], schema=_INDEX)
    return pa.concat_tables([first, second])


def _indexed(batches: Iterator[pa.RecordBatch], items: Broadcast, block_docs: int) -> Iterator[pa.RecordBatch]:
    """The segments of a task; documents in none of the lists that are read stay out."""
    known: _Items = items.value
    n_terms = len(known.weights)
    signs = np.random.default_rng(7).integers(0, 2, (n_terms, SKETCH)).astype(np.float32) * 2 - 1
    segment, made, first = _Segment(), 0, TaskContext.get().partitionId() << 24
    for doc, n, terms, tfs in _rows(batches):
        if lists := int(known.read[terms].sum()):
            segment.add(doc, terms, _impact(tfs, n, known.documents, known.length), lists)
            if segment.full(n_terms):
                yield from segment_rows(segment, first + made, known, signs, block_docs).to_batches(4096)
                segment, made = _Segment(), made + 1
    if segment.keys:
        yield from segment_rows(segment, first + made, known, signs, block_docs).to_batches(4096)


# ---- search ----

def _ranges(cuts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges ``cuts[a]:cuts[a + 1]``, and the sizes of the ranges."""
    sizes = cuts[at + 1] - cuts[at]
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(cuts[at], sizes), sizes


class Searcher:
    """One segment of the index in memory."""

    def __init__(self, table: pa.Table):
        table = table.sort_by("no")
        is_doc = table["term"].is_null()
        docs, blocks = table.filter(is_doc), table.filter(pc.invert(is_doc))
        self.known = docs["key"].is_valid().to_numpy()
        self.keys = docs["key"].fill_null(0).to_numpy()
        self.cuts, self.terms, self.impacts = self._lists(docs, "terms", "impacts")
        self.block_term = blocks["term"].to_numpy().astype(np.int64)
        self.member_cuts, self.members = self._lists(blocks, "members")
        cuts, terms, largest = self._lists(blocks, "terms", "impacts")
        order = np.argsort(terms, kind="stable")
        # summaries by term: which blocks hold it, and how much at most
        self.held_terms, begin = np.unique(terms[order], return_index=True)
        self.held_cuts = np.append(begin, len(terms))
        self.held_blocks = np.repeat(np.arange(len(blocks)), np.diff(cuts))[order]
        self.held_largest = largest[order]
        self.scored = 0

    @staticmethod
    def _lists(table: pa.Table, *names: str):
        columns = [table[n].combine_chunks() for n in names]
        sizes = pc.list_value_length(columns[0]).to_numpy(zero_copy_only=False)
        return np.append(0, np.cumsum(sizes)).astype(np.int64), *[
            c.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in columns]

    def bounds(self, terms: np.ndarray, lists: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Upper bound of the score of any member, per block; 0 for blocks of other lists."""
        at = np.searchsorted(self.held_terms, terms)
        here = self.held_terms[np.minimum(at, len(self.held_terms) - 1)] == terms if len(self.held_terms) else \
            np.zeros(len(terms), bool)
        places, sizes = _ranges(self.held_cuts, at[here])
        out = np.zeros(len(self.block_term), np.int64)
        np.add.at(out, self.held_blocks[places], np.repeat(weights[here], sizes) * self.held_largest[places])
        out[~np.isin(self.block_term, lists)] = 0
        return out

    def scores(self, docs: np.ndarray, weight_of: np.ndarray) -> np.ndarray:
        """Exact scores; every document here has a term."""
        self.scored += len(docs)
        places, sizes = _ranges(self.cuts, docs)
        parts = weight_of[self.terms[places]] * self.impacts[places]
        return np.add.reduceat(parts, np.cumsum(sizes) - sizes) if len(docs) else np.zeros(0, np.int64)

    def best(self, terms: np.ndarray, lists: np.ndarray, weights: np.ndarray, weight_of: np.ndarray, top: int, least: int):
        """(score, document) of the segment's best documents in ``lists`` that reach ``least``; ties at the end by key."""
        bounds = self.bounds(terms, lists, weights)
        blocks = np.flatnonzero(bounds >= max(least, 1))
        blocks = blocks[np.argsort(-bounds[blocks], kind="stable")]
        docs, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for part in (blocks[:FIRST_BLOCKS], blocks[FIRST_BLOCKS:]):
            if len(score) >= top:
                least = max(least, int(np.partition(score, len(score) - top)[len(score) - top]))
                part = part[bounds[part] >= least]
            new = np.setdiff1d(self.members[_ranges(self.member_cuts, part)[0]], docs)
            docs, score = np.append(docs, new), np.append(score, self.scores(new, weight_of))
        kept = np.flatnonzero(score >= max(least, 1))
        docs, score = docs[kept], score[kept]
        order = np.lexsort((self.keys[docs], ~self.known[docs], -score))[:top]
        return score[order], docs[order]


_FOUND = pa.schema([("item", pa.int32()), ("doc", pa.int64()), ("score", pa.int64())])


def _search(segment: pa.Table, items: _Items) -> pa.Table:
    """The best documents of one segment for every item of the block."""
    searcher, weights = Searcher(segment), items.weights
    weight_of = np.zeros(len(weights), np.int64)
    columns = [[], [], []]
    for no, (terms, lists, least) in enumerate(zip(items.terms, items.lists, items.least)):
        weight_of[terms] = weights[terms]
        score, docs = searcher.best(terms, lists, weights[terms], weight_of, items.top, least)
        weight_of[terms] = 0
        columns[0] += [no] * len(docs)
        columns[1] += [k if known else None for k, known in zip(
            searcher.keys[docs].tolist(), searcher.known[docs].tolist())]
        columns[2] += score.tolist()
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, _FOUND)], schema=_FOUND)


def _ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def _blocks(pairs: DataFrame, block_pairs: int) -> Iterator[list[tuple]]:
    """(item, its distinct terms) of a block of items at a time."""
    n = max(1, -(-pairs.count() // block_pairs))
    for i in range(n):
        part = pairs if n == 1 else pairs.filter(F.pmod(F.xxhash64("item"), F.lit(n)) == i)
        items: dict = {}
        for row in part.collect():
            items.setdefault(row.item, []).append(bytes(row.term))
        if items:
            yield list(items.items())


def _of_block(docs: DataFrame, items: list[tuple], top: int, block_docs: int, seed_docs: int) -> DataFrame | None:
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast
    vocabulary = sorted({t for _, terms in items for t in terms})
    number = {t: i for i, t in enumerate(vocabulary)}
    forward = materialize(docs.mapInArrow(partial(_forward, vocabulary=shared(vocabulary)),
                                          "doc long, n long, terms array<int>, tfs array<long>"), "forward")
    total = forward.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("length")).first()
    if not total.length:
        return None
    # one row per searched term
    stats = forward.mapInArrow(partial(_term_stats, n_terms=len(vocabulary)), "term long, df long, most long, fewest long") \
        .groupBy("term").agg(F.sum("df").alias("df"), F.max("most").alias("most"), F.min("fewest").alias("fewest")).collect()
    frequency, ceiling = np.zeros(len(vocabulary), np.int64), np.zeros(len(vocabulary), np.int64)
    for r in stats:
        frequency[r.term], ceiling[r.term] = r.df, _impact(r.most, r.fewest, total.documents, total.length)
    weights = np.array([math.floor(1000 * math.log((2 * total.documents + 2) / (2 * int(f) + 1))) for f in frequency],
                       np.int64)
    known = _Items([np.array(sorted(number[t] for t in terms), np.int64) for _, terms in items], weights,
                   total.documents, total.length, top)
    if seed_docs:
        share = F.pmod(F.xxhash64("doc", "n", "tfs"), F.lit(1 << 20)) * total.documents < seed_docs << 20
        reached = forward.filter(share).mapInArrow(partial(_seed_scores, items=shared(known)), "item int, score long")
        order = Window.partitionBy("item").orderBy(F.desc("score"))
        reached = reached.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") == top)
        known.reach({r.item: r.score for r in reached.collect()}, ceiling)
    held = shared(known)
    index = materialize(forward.mapInArrow(partial(_indexed, items=held, block_docs=block_docs), _INDEX_DDL), "postings")
    found = index.groupBy("segment").applyInArrow(lambda segment: _search(segment, held.value),
                                                  "item int, doc long, score long")
    names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(items)], "item int, name string")
    return _ranked(found, top).join(F.broadcast(names), "item").select(F.col("name").alias("item"), "rank", "doc", "score")


def search(df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
           item_text: str = "text", top: int = TOP, block_pairs: int = BLOCK_PAIRS, block_docs: int = BLOCK_DOCS,
           seed_docs: int = SEED_DOCS) -> DataFrame:
    """The ``top`` documents of each item: item_key (as in ``items``), rank, key (long), score.

    Exact: about ``seed_docs`` documents are scored first, which gives each item a score that ``top`` documents
    reach; lists whose terms cannot reach it even together are not read, so documents only in those cannot
    be among the best. The other documents go into segments of bounded size. A segment's posting list of each
    term is cut into blocks of similar documents, and a block is passed over only if the sum of weight times
    the largest impact of its members is below the score to reach, or below one that the segment has reached.

    Rows with one item id are one item with the terms of all of them, also the rows without id. Null and empty
    texts have no terms; documents without terms do not count, items without terms give no rows. Repeated rows
    are documents of their own; equal scores go by ascending key, null keys last. An empty table gives no
    rows; other columns are not read. Items are a stated query set: ``block_pairs`` bounds the terms of
    the items that one pass over the documents searches for (one item at least).
    """
    words = add_columns(items.select(F.col(item_key).alias("item"), F.col(item_text).alias("text")), "text",
                        "found array<binary>", lambda: _distinct_terms)
    pairs = materialize(words.select("item", F.explode("found").alias("term")).distinct(), "pairs")
    docs = df.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    kind = items.schema[item_key].dataType
    out = None
    for block in _blocks(pairs.withColumn("item", F.col("item").cast("string")), block_pairs):
        found = _of_block(docs, block, top, block_docs, seed_docs)
        if found is not None:
            out = found if out is None else out.unionByName(found)
    if out is None:
        out = df.sparkSession.createDataFrame([], "item string, rank int, doc long, score long")
    return out.select(F.col("item").cast(kind).alias(item_key), "rank", F.col("doc").alias(key), "score")
