"""A growing CSV file as a stream that notices when the file starts over.

Spark's file streams read a file once. A live capture appends to one file, and a new capture begins by
truncating it. This source's offsets are (run, bytes): a file that has become shorter than what was
read belongs to the next run and is read from its start.
"""

from __future__ import annotations

import csv
import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from flowspark.operators.schema import normalize_columns
from flowspark.sources.flow_csv import unique_headers

# bytes of a file that one task reads, and that are looked through at once for a line's end
SPLIT_BYTES = 32 << 20
_BLOCK = 1 << 16
LINES_DDL = "run_id long, row_index long, value string"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _last_line_end(files: fs.FileSystem, path: str, size: int) -> int:
    """Bytes up to the last line feed of the first ``size`` bytes."""
    with files.open_input_file(path) as f:
        end = size
        while end > 0:
            begin = max(0, end - _BLOCK)
            f.seek(begin)
            at = f.read(end - begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            end = begin
    return 0


def first_line(path: str) -> str:
    """The header of a file, without its line end; '' for a file without a whole line."""
    files, name = _open(path)
    line = b""
    with files.open_input_file(name) as f:
        while block := f.read(_BLOCK):
            at = block.find(b"\n")
            if at >= 0:
                return (line + block[:at]).decode("utf-8-sig").rstrip("\r")
            line += block
    return ""


class _Range(InputPartition):
    def __init__(self, run: int, begin: int, end: int, skip: int):
        super().__init__((run, begin, end, skip))


class GrowingLines(DataSource):
    """Lines of one growing text file: number of the run, byte offset of the line, line.

    Options: ``path``; ``state``, a file that holds the run and size seen last (keep it beside the query's
    checkpoint); ``header``, the first line that every run must have (none: the first line is a line like
    others). A line counts once its line feed is there. What a run had not given when the file was
    truncated is lost with it.
    """

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return LINES_DDL

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _LinesReader(self.options)


class _LinesReader(DataSourceStreamReader):
    def __init__(self, options):
        self.path, self.state, self.header = options["path"], options["state"], options.get("header")

    def initialOffset(self) -> dict:
        return {"run": 0, "bytes": 0}

    def latestOffset(self) -> dict:
        files, name = _open(self.path)
        info = files.get_file_info(name)
        size = _last_line_end(files, name, info.size) if info.type == fs.FileType.File else 0
        states, state = _open(self.state)
        last = {"run": 0, "bytes": 0}
        if states.get_file_info(state).type == fs.FileType.File:
            with states.open_input_stream(state) as f:
                last = json.loads(f.read())
        now = {"run": last["run"] + (size < last["bytes"]), "bytes": size}
        if now != last:
            with states.open_output_stream(state) as f:
                f.write(json.dumps(now).encode())
        return now

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        begin = start["bytes"] if start["run"] == end["run"] else 0
        cuts = [*range(begin, end["bytes"], SPLIT_BYTES), end["bytes"]]
        # bytes before the first row of this batch are known to end a line
        return [_Range(end["run"], a, b, int(a > begin)) for a, b in zip(cuts, cuts[1:])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        run, begin, end, skip = partition.value
        files, name = _open(self.path)
        if self.header is not None and first_line(self.path) != self.header:
            raise ValueError(f"run {run} of {self.path} has another header")
        with files.open_input_file(name) as f:
            at, rest = begin, b""
            f.seek(begin)
            if skip:
                # a line that began before this range belongs to the range before
                f.seek(begin - 1)
                at, rest = self._after_feed(f, begin - 1)
            # lines that begin before the end, the last one to its line feed
            while at < end:
                block = f.read(_BLOCK)
                if not block:
                    raise ValueError(f"{self.path} became shorter while it was read")
                lines = (rest + block).split(b"\n")
                rest = lines.pop()
                offsets = []
                for line in lines:
                    offsets.append(at)
                    at += len(line) + 1
                kept = [(o, x) for o, x in zip(offsets, lines) if o < end and not (o == 0 and self.header is not None)]
                if kept:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([run] * len(kept), pa.int64()), pa.array([o for o, _ in kept], pa.int64()),
                         pa.array([x.rstrip(b"\r").decode("utf-8", "replace") for _, x in kept])],
                        names=["run_id", "row_index", "value"])

    @staticmethod
    def _after_feed(f, at: int) -> tuple[int, bytes]:
        while block := f.read(_BLOCK):
            found = block.find(b"\n")
            if found >= 0:
                return at + found + 1, block[found + 1:]
            at += len(block)
        return at, b""


def stream_growing_csv(spark: SparkSession, path: str, schema: T.StructType, state: str) -> DataFrame:
    """Rows of a growing CSV file: ``run_id``, ``row_index``, then the columns of ``schema``, found by header.

    ``row_index`` is the byte offset of the row, so it grows within a run. Values are cast as in the batch
    reader: an unreadable number is NULL, a short row is padded, a row with more fields than the header
    fails. A column that the header lacks fails at once, a run with another header when it is read.
    Fields do not hold line feeds.
    """
    spark.dataSource.register(GrowingLines)
    header = first_line(path)
    names = [x.strip().lower() for x in unique_headers(next(csv.reader([header]), []))]
    lines = spark.readStream.format("growing_lines").option("path", path).option("state", state) \
        .option("header", header).load()
    width = len(names)
    ddl = ", ".join(f"c{i} string" for i in range(width + 1))
    fields = F.from_csv("value", ddl, {"mode": "PERMISSIVE", "nullValue": "\u0001", "emptyValue": "",
                                       "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"})
    rows = lines.filter(F.trim("value") != "").withColumn("f", fields)
    surplus = F.raise_error(F.concat(F.lit(f"more than {width} fields at byte "), F.col("row_index")))
    rows = rows.filter(F.when(F.col(f"f.c{width}").isNotNull(), surplus.cast("boolean")).otherwise(True))
    out = []
    for field in normalize_columns(spark.createDataFrame([], schema)).schema.fields:
        if field.name not in names:
            raise ValueError(f"{path} has no column {field.name}")
        text = F.col(f"f.c{names.index(field.name)}")
        out.append((text if isinstance(field.dataType, T.StringType) else text.try_cast(field.dataType)).alias(field.name))
    return rows.select("run_id", "row_index", *out)
