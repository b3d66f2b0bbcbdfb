"""Helpers that several text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

# rows a Python task handles at once; bounds what one task holds beside Spark's own batch
SLICE_ROWS = 256
# bytes of one text that are cut into words at once
SLAB_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_sample(df: DataFrame, columns: list[str], rows: int) -> DataFrame:
    """At most ``rows`` rows, those with the smallest hash of ``columns``.

    Rows above a hash that about 1.2 times as many rows stay below are dropped where they are read, so
    the ordered rest is bounded whatever the size of ``df``.
    """
    mark = F.pmod(F.xxhash64(*columns), F.lit(1 << 40)) / float(1 << 40)
    n = df.count()
    kept = df.filter(mark < 1.2 * rows / n) if n > rows else df
    return kept.orderBy(mark, *columns).limit(rows)


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning: crc32 of the id as text leaves 0 mod 5 (null: text '')."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def _added(batches: Iterator[pa.RecordBatch], column: str, kept: list[str], fields: list[pa.Field],
           make: Callable, rows: int) -> Iterator[pa.RecordBatch]:
    work = make()
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            made = work(part.column(column).to_pylist())
            arrays = [part.column(k) for k in kept] + [
                a if isinstance(a, pa.Array) else pa.array(a, f.type) for a, f in zip(made, fields)]
            names = kept + [f.name for f in fields]
            yield pa.RecordBatch.from_arrays(arrays, names=names)


def add_columns(df: DataFrame, column: str, added: str, make: Callable[[], Callable],
                rows: int = SLICE_ROWS) -> DataFrame:
    """Append columns computed from one text column, in Arrow batches, without a shuffle.

    ``make`` runs once per task and returns a function from a list of texts to one list per added
    column (DDL in ``added``), called with ``rows`` texts at most. A column of ``df`` with an added column's name is replaced.
    """
    new = T._parse_datatype_string(added)
    names = {f.name.lower() for f in new.fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in names]
    fields = [pa.field(f.name, to_arrow_type(f.dataType)) for f in new.fields]
    work = partial(_added, column=column, kept=[f.name for f in kept], fields=fields, make=make, rows=rows)
    return df.mapInArrow(work, T.StructType(kept + new.fields))


def _passed(batches: Iterator[pa.RecordBatch], column: str, make: Callable) -> Iterator[pa.RecordBatch]:
    work = make()
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(start, SLICE_ROWS)
            yield part.filter(pa.array(work(part.column(column).to_pylist()), pa.bool_()))


def keep_where(df: DataFrame, column: str, make: Callable[[], Callable]) -> DataFrame:
    """Rows, with all their columns, for which the function that ``make`` returns gives true."""
    return df.mapInArrow(partial(_passed, column=column, make=make), df.schema)


def word_slabs(data: bytes, size: int = SLAB_BYTES) -> Iterator[list[bytes]]:
    """Words between ASCII white space, a bounded number of bytes at a time, never cutting a word."""
    if len(data) <= size:
        if words := data.split():
            yield words
        return
    rest = b""
    for start in range(0, len(data), size):
        words = (piece := rest + data[start:start + size]).split()
        rest = b""
        if words and not piece[-1:].isspace():
            rest = words.pop()
        if words:
            yield words
    if rest:
        yield [rest]
