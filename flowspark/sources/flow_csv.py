"""Flow tables as CSV: encodings, headers, labelled file sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.contract import FEATURES
from flowspark.functions.scalar import c, quoted
from flowspark.operators.schema import (
    cast_if_numeric, cast_numeric, normalize_columns, unify_label,
)

# --- fixed values: Windows-1252 characters of the bytes 80-9F that have one ---
CP1252_BYTES = (
    "80 82 83 84 85 86 87 88 89 8a 8b 8c 8e 91 92 93 94 95 96 97 98 99 9a 9b 9c 9e 9f"
)
CP1252_CHARS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
CP1252_UNDEFINED = "81 8d 8f 90 9d"


def _chars(hex_bytes: str) -> str:
    return bytes.fromhex(hex_bytes).decode("latin-1")


def file_layouts(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Encoding and header line per file (``path, encoding, header``), from one text scan.

    Encoding: utf-8 if every line is valid, else cp1252, else latin1. Lines are tested in
    parallel and combined map-side to one row per file.
    """
    raw = F.col("value").cast("binary")
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("path"), "value",
        F.decode(raw, "ISO-8859-1").alias("latin"),
        # ids grow within a task, and the first block of a file is read by one task
        F.when(F.col("_metadata.file_block_start") == 0, F.monotonically_increasing_id()).alias("at"))
    undefined = F.col("latin").rlike("[" + _chars(CP1252_UNDEFINED) + "]")
    # at most four kinds of lines; a collected set lets Spark keep one hashed row per file instead of sorting the lines
    kinds = F.collect_set(F.struct(F.is_valid_utf8("value").alias("utf8"), undefined.alias("undefined")))
    tested = lines.groupBy("path").agg(kinds.alias("kinds"), F.min_by("latin", "at").alias("header"))
    return tested.select("path", F.when(F.forall("kinds", lambda k: k["utf8"]), F.lit("utf-8"))
                         .when(F.exists("kinds", lambda k: k["undefined"]), F.lit("latin1"))
                         .otherwise(F.lit("cp1252")).alias("encoding"), "header")


def unique_headers(names: Sequence[str | None]) -> list[str]:
    """Header names with repeats numbered ``name``, ``name.1``, ``name.2``."""
    out, seen = [], {}
    for i, name in enumerate(names):
        base = name if name is not None and name.strip() else f"unnamed: {i}"
        n = seen.get(base.strip(), 0)
        seen[base.strip()] = n + 1
        out.append(base if n == 0 else f"{base.strip()}.{n}")
    return out


def text_rows(reader, width: int, names: Sequence[str] = ()):
    """A CSV reader (batch or stream) of ``width`` text columns that keeps every row.

    With ``names``, a file whose header has other names, or the same in another order, fails the read;
    case and blanks around a name do not matter.
    """
    schema = ", ".join(f"{quoted(x)} string" for x in names or [f"c{i}" for i in range(width)]) + ", __bad string"
    return reader.schema(schema).option("header", True).option("mode", "PERMISSIVE") \
        .option("enforceSchema", not names) \
        .option("columnNameOfCorruptRecord", "__bad").option("columnPruning", False) \
        .option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)


def checked_rows(df: DataFrame, width: int) -> DataFrame:
    """Short rows are padded with NULL; a row with more fields than the header fails the read.

    The check is a filter, so it holds whatever columns are used later.
    """
    names = ", ".join(f"c{i} string" for i in range(width + 1))
    # an empty field is '' here, only an absent one is NULL
    parsed = F.from_csv("__bad", names, {"nullValue": "\u0001", "emptyValue": "", "mode": "PERMISSIVE"})
    long = F.col("__bad").isNotNull() & parsed[f"c{width}"].isNotNull()
    # the message names the first field too: Spark refuses plans that read the kept line alone
    problem = F.raise_error(F.concat(F.lit(f"more than {width} fields after "), F.coalesce("c0", F.lit("")),
                                     F.lit(": "), F.substring("__bad", 1, 200)))
    return df.filter(F.when(long, problem.cast("boolean")).otherwise(True)).drop("__bad")


def _scan(spark: SparkSession, paths: Sequence[str], encoding: str,
          features: Sequence[str]) -> DataFrame:
    """One scan over files of equal header and encoding, with ``__source_file`` last."""
    charset = "UTF-8" if encoding == "utf-8" else "ISO-8859-1"
    # the header as data: Spark renames repeated names by position when it reads a header
    first = spark.read.option("encoding", charset).csv(paths[0]).first()
    names = unique_headers(list(first))
    reader = text_rows(spark.read, len(names)).option("encoding", charset)
    df = checked_rows(reader.csv(list(paths)).select(
        "*", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("__source_file")), len(names)) \
        .toDF(*names, "__source_file")
    if encoding == "cp1252":
        table = str.maketrans(_chars(CP1252_BYTES), CP1252_CHARS)
        df = df.select(*[F.translate(c(x), _chars(CP1252_BYTES), CP1252_CHARS)
                         .alias(x.translate(table)) for x in df.columns])
    # a byte-order mark read as latin1 shows as these three characters
    df = normalize_columns(df.toDF(*[x.removeprefix("\u00ef\u00bb\u00bf") for x in df.columns]))
    return cast_numeric(df, [x for x in df.columns if x in set(features)])


def _scans(spark: SparkSession, paths: str | Sequence[str],
           features: Sequence[str]) -> list[DataFrame]:
    """Files grouped by (encoding, header). Only this file list reaches the driver."""
    groups: dict[tuple[str, str], list[str]] = {}
    for row in file_layouts(spark, paths).orderBy("path").toLocalIterator():
        groups.setdefault((row["encoding"], row["header"]), []).append(row["path"])
    return [_scan(spark, files, enc, features) for (enc, _), files in groups.items()]


def union_parts(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def read_flow_csv(spark: SparkSession, paths: str | Sequence[str],
                  features: Sequence[str] = FEATURES, encoding: str | None = None,
                  strict: bool = False) -> DataFrame:
    """Flow CSV files; contract columns become numbers, the rest stays text.

    With ``strict`` a contract column that holds any other text stays text too, so that scoring refuses it.

    Values are read as text and cast, so ``inf``, ``Infinity`` and ``NaN`` read alike and an
    unreadable number is NULL. With ``encoding`` given, all files must share one header.
    """
    read_as = [] if strict else features
    if encoding:
        files = [paths] if isinstance(paths, str) else list(paths)
        rows = _scan(spark, files, encoding, read_as).drop("__source_file")
    else:
        rows = union_parts(_scans(spark, paths, read_as)).drop("__source_file")
    return cast_if_numeric(rows, [x for x in rows.columns if x in set(features)]) if strict else rows


# --- fixed values: labelled file name patterns, in order of preference ---
LABELLED_PATTERNS = ["TrafficLabelling_*.csv", "TrafficLabelling-*.csv", "*pcap_ISCX.csv", "*.csv"]


def discover_files(spark: SparkSession, folder: str,
                   patterns: Sequence[str] = LABELLED_PATTERNS) -> list[str]:
    """CSV files of a folder by pattern preference, then name; first of equal names wins."""
    found: dict[str, str] = {}
    listing = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder) \
        .select("path").orderBy("path")
    from fnmatch import fnmatchcase
    paths = [row["path"] for row in listing.toLocalIterator()]
    for pattern in patterns:
        for path in paths:
            name = path.rsplit("/", 1)[-1]
            if fnmatchcase(name, pattern):
                found.setdefault(name, path)
    return list(found.values())


def discover_and_union(spark: SparkSession, folder: str,
                       files: Sequence[str] | None = None) -> DataFrame:
    """All labelled CSV files of a folder as one table, columns missing in a file NULL.

    Files with equal headers are read by one scan, so a folder of many rotated files
    stays a small plan.
    """
    paths = [f"{folder}/{f}" for f in files] if files else discover_files(spark, folder)
    if not paths:
        raise FileNotFoundError(f"{folder} has no .csv file")
    parts = []
    for part in _scans(spark, paths, FEATURES):
        parts.append(unify_label(part, "train"))
    return union_parts(parts)
