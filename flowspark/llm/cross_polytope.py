"""Approximate nearest neighbours: cross-polytope hashing by Hadamard rotations, multiprobe tables, exact reranking."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window, functions as F

from flowspark.session import materialize

TOP = 10
# rotations, each a table of twice as many buckets as (padded) components, and buckets a query looks into
TABLES = 32
PROBES = 4
SEED = 11
# bytes of query vectors that a pass over the index searches for
QUERY_BYTES = 16 << 20
# vectors of the index searched at once
CHUNK = 8192


def usable(key: Column, vector: Column) -> Column:
    """Whether a row takes part: a key, and finite components of which one is not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return key.isNotNull() & vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, orthonormal; the width is a power of two."""
    width, half = x.shape[1], 1
    while half < width:
        pairs = x.reshape(-1, width // (2 * half), 2, half)
        x = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], axis=2)
        x = x.reshape(-1, width)
        half *= 2
    return x / np.sqrt(width)


def rotated(x: np.ndarray, table: int, seed: int = SEED) -> np.ndarray:
    """Pseudo-random rotation of unit vectors: three rounds of random signs and a Hadamard transform."""
    width = 1 << max(1, int(x.shape[1] - 1).bit_length())
    out = np.zeros((len(x), width))
    # dividing by the largest component first keeps squares of tiny and huge ones finite
    scaled = x / np.abs(x).max(axis=1, keepdims=True)
    out[:, :x.shape[1]] = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
    signs = np.random.default_rng([seed, table, width]).integers(0, 2, (3, width)) * 2.0 - 1
    for s in signs:
        out = hadamard(out * s)
    return out


def codes(x: np.ndarray, tables: int) -> np.ndarray:
    """Nearest signed axis of each vector in each table: twice the axis, plus one on its negative side."""
    out = np.empty((len(x), tables), np.int32)
    for t in range(tables):
        r = rotated(x, t)
        axis = np.argmax(np.abs(r), axis=1)
        out[:, t] = 2 * axis + (r[np.arange(len(x)), axis] < 0)
    return out


def probes(x: np.ndarray, tables: int, n: int) -> np.ndarray:
    """(vector, table, probe): the ``n`` nearest signed axes, nearest first; the next best ones hold near vectors too."""
    made = []
    for t in range(tables):
        r = rotated(x, t)
        near = np.stack([r, -r], axis=2).reshape(len(x), -1)
        made.append(np.argsort(-near, axis=1, kind="stable")[:, :n])
    return np.stack(made, axis=1)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, pa.RecordBatch]]:
    """Keys and vectors of one length at a time."""
    lengths = pc.list_value_length(batch.column(1))
    for n in pc.unique(lengths).to_pylist():
        part = batch.filter(pc.equal(lengths, n))
        flat = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        yield part.column(0), flat.reshape(-1, n), part


def _indexed(batches: Iterator[pa.RecordBatch], tables: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, CHUNK):
            for _, x, part in _by_length(batch.slice(start, CHUNK)):
                flat = pa.array(codes(x, tables).ravel())
                cuts = pa.array(np.arange(len(x) + 1) * tables, pa.int32())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(cuts, flat)],
                                                 names=["key", "vector", "codes"])


def index(df: DataFrame, key: str, vector: str, tables: int = TABLES) -> DataFrame:
    """(key, vector, codes): every usable row with its bucket in each table, stored."""
    rows = df.filter(usable(F.col(key), F.col(vector))).select(
        F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    made = rows.mapInArrow(partial(_indexed, tables=tables), "key long, vector array<double>, codes array<int>")
    return materialize(made, "codes")


class _Nearest:
    """The nearest candidates so far of each query of a block, for vectors of one length."""

    def __init__(self, keys: np.ndarray, x: np.ndarray, tables: int, n_probes: int | None, top: int):
        self.keys, self.x, self.top = keys, x, top
        self.probes = None if n_probes is None else probes(x, tables, n_probes)
        self.best = [(np.zeros(0), np.zeros(0, np.int64))] * len(keys)

    def candidates(self, table_codes: np.ndarray) -> Iterator[np.ndarray]:
        """Per query, the rows of a chunk that share a probed bucket (without probes: all rows)."""
        if self.probes is None:
            yield from (np.arange(len(table_codes)) for _ in self.keys)
            return
        tables = table_codes.shape[1]
        order = np.argsort(table_codes, axis=0, kind="stable")
        buckets = np.arange(2 * (1 << max(1, int(self.x.shape[1] - 1).bit_length())) + 1)
        cuts = [np.searchsorted(table_codes[order[:, t], t], buckets) for t in range(tables)]
        for wanted in self.probes:
            seen = np.zeros(len(table_codes), bool)
            for t in range(tables):
                for b in wanted[t]:
                    seen[order[cuts[t][b]:cuts[t][b + 1], t]] = True
            yield np.flatnonzero(seen)

    def add(self, keys: np.ndarray, x: np.ndarray, table_codes: np.ndarray) -> None:
        for q, rows in enumerate(self.candidates(table_codes)):
            rows = rows[keys[rows] != self.keys[q]]
            away = x[rows] - self.x[q]
            distance = np.sqrt(np.einsum("ij,ij->i", away, away))
            # an id with several rows counts once; more of them than needed must not push others out
            if len(distance) > self.top and len(self.best[q][0]) == self.top:
                near = distance <= self.best[q][0][-1]
                rows, distance = rows[near], distance[near]
            d, k = np.append(self.best[q][0], distance), np.append(self.best[q][1], keys[rows])
            order = np.lexsort((k, d))
            first = np.sort(np.unique(k[order], return_index=True)[1])[:self.top]
            self.best[q] = d[order][first], k[order][first]


def _found(batches: Iterator[pa.RecordBatch], queries: Broadcast, tables: int, n_probes: int | None,
           top: int) -> Iterator[pa.RecordBatch]:
    """The nearest rows of a task's part of the index, per query."""
    searched = {n: _Nearest(keys, x, tables, n_probes, top) for n, (keys, x) in queries.value.items()}
    for batch in batches:
        for start in range(0, batch.num_rows, CHUNK):
            for keys, x, part in _by_length(batch.slice(start, CHUNK)):
                if x.shape[1] in searched:
                    flat = part.column(2).flatten().to_numpy()
                    searched[x.shape[1]].add(keys.to_numpy(), x, flat.reshape(len(x), tables))
    for block in searched.values():
        sizes = [len(d) for d, _ in block.best]
        if sum(sizes):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(block.keys, sizes)), pa.array(np.concatenate([k for _, k in block.best])),
                 pa.array(np.concatenate([d for d, _ in block.best]))], names=["query", "key", "distance"])


def _blocks(queries: DataFrame, block_bytes: int) -> Iterator[dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Query keys and vectors by length, of a bounded block of queries at a time."""
    total = queries.agg(F.sum(8 * F.size("vector").cast("long")).alias("bytes")).first().bytes or 0
    n = max(1, -(-total // block_bytes))
    for i in range(n):
        part = queries if n == 1 else queries.filter(F.pmod(F.xxhash64("key"), F.lit(n)) == i)
        by_length: dict[int, list] = {}
        for batch in part.select("key", "vector").toArrow().to_batches():
            for keys, x, _ in _by_length(batch):
                by_length.setdefault(x.shape[1], []).append((keys.to_numpy(), x))
        if by_length:
            yield {n: (np.concatenate([k for k, _ in v]), np.concatenate([x for _, x in v])) for n, v in by_length.items()}


def _searched(indexed: DataFrame, queries: DataFrame, tables: int, n_probes: int | None, top: int,
              block_bytes: int) -> DataFrame | None:
    """(query, key, distance): of each query the nearest candidates, one row per candidate."""
    spark, out = indexed.sparkSession, None
    for block in _blocks(queries, block_bytes):
        found = indexed.mapInArrow(partial(_found, queries=spark.sparkContext.broadcast(block), tables=tables,
                                           n_probes=n_probes, top=top), "query long, key long, distance double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return None
    # an id may stand in several tasks, also as a query with several vectors
    once = out.groupBy("query", "key").agg(F.min("distance").alias("distance"))
    order = Window.partitionBy("query").orderBy("distance", "key")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def nearest(df: DataFrame, key: str = "vec_id", vector: str = "embedding", queries: Column | None = None,
            top: int = TOP, tables: int = TABLES, n_probes: int = PROBES, block_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query, rank, key, distance): the ``top`` nearest rows found for each row that ``queries`` selects (null: all).

    Every row is hashed in every table; a query looks into the ``n_probes`` nearest buckets of each, and all
    rows there are ranked by Euclidean distance of the original vectors, in double precision, ties by key.
    A query that finds fewer than ``top`` rows so is compared with all rows. A row with a null key, a null,
    empty or zero vector, or a null or non-finite component takes no part; vectors of different lengths have
    no distance. A query's own key is never its candidate; rows with one key count as that key once, at the
    smallest distance. An empty table gives no rows; other columns are not read. Queries are a stated set:
    the index is read once per ``block_bytes`` of their vectors.
    """
    indexed = index(df, key, vector, tables)
    chosen = df.filter(queries) if queries is not None else df
    wanted = chosen.filter(usable(F.col(key), F.col(vector))).select(
        F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    near = _searched(indexed, wanted, tables, n_probes, top, block_bytes)
    if near is None:
        return df.sparkSession.createDataFrame([], "query long, rank int, key long, distance double")
    near = materialize(near, "near")
    full = near.filter(F.col("rank") == top).select(F.col("query").alias("key"))
    short = materialize(wanted.join(full, "key", "left_anti"), "short")
    if not short.isEmpty():
        rest = _searched(indexed, short, tables, None, top, block_bytes)
        near = near.join(full.withColumnRenamed("key", "query"), "query").select(*rest.columns).unionByName(rest)
    return near.select("query", "rank", "key", "distance")
