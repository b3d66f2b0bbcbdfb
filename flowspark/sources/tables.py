"""Parameter tables, address lists, benchmark run folders and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.contract import ALWAYS_ALLOWED, FEATURES, FLOW_METADATA
from flowspark.functions.scalar import c
from flowspark.operators.actions import ip_list
from flowspark.sources.flow_csv import file_layouts, union_parts

# flags of a fitted scaler are stored with each feature; NULL means that nothing was stored
PARAMS_SCHEMA = ("idx int, feature string, mean double, scale double, with_mean boolean, with_std boolean, "
                 "n_features_in int")


def read_ip_list(spark: SparkSession, path: str,
                 defaults: Sequence[str] = ALWAYS_ALLOWED) -> DataFrame:
    """Address list file (``ip``): one per line, ``#`` comments, loopback always included."""
    return ip_list(spark.read.text(path), "value", defaults)


def write_params(params: DataFrame, path: str) -> None:
    """Parameters and, where the table has them, the flags ``with_mean``, ``with_std``, ``n_features_in``."""
    wanted = T._parse_datatype_string(PARAMS_SCHEMA)
    params.select(*[(F.col(f.name) if f.name in params.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                    for f in wanted.fields]).write.mode("overwrite").parquet(path)


def read_params(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Fitted scaler parameters, one row per feature."""
    return spark.read.format(fmt).schema(PARAMS_SCHEMA).load(path)


def with_row_index(spark: SparkSession, path: str, out: str = "row_index") -> DataFrame:
    """Parquet rows with their position: files in name order, rows in file order.

    Positions come from file metadata plus one offset per file, so nothing is sorted and
    the number of a row never changes between runs.
    """
    df = spark.read.parquet(path)
    located = df.select("*", F.col("_metadata.file_path").alias("__file"),
                        F.col("_metadata.row_index").alias("__at"))
    before = Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)
    sizes = located.groupBy("__file").agg(F.count(F.lit(1)).alias("__n"))
    offsets = sizes.select("__file", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    from flowspark.operators.lookups import lookup
    return lookup(located, offsets, ["__file"], "inner") \
        .select(*[c(x) for x in df.columns], (F.col("__off") + F.col("__at")).alias(out))


def read_bench_runs(spark: SparkSession, root: str, kind: str = "timing") -> DataFrame:
    """All run files of a benchmark folder with ``batch_size`` and ``variant`` from their path.

    Both layouts are found: ``batch_<n>/<kind>_<variant>.csv`` and ``<kind>_<variant>_b<n>.csv``.
    """
    path = F.col("_metadata.file_path")
    size = F.coalesce(F.regexp_extract(path, r"/batch_(\d+)/", 1).try_cast("int"),
                      F.regexp_extract(path, r"_b(\d+)\.csv", 1).try_cast("int"))
    variant = F.regexp_extract(path, kind + r"_([A-Za-z0-9]+?)(_b\d+)?\.csv", 1)
    found = f"{root}/{{batch_*/{kind}_*.csv,{kind}_*_b*.csv}}"
    # files with equal header lines are one scan; headers are few, whatever the number of runs
    groups: dict[str, list[str]] = {}
    for row in file_layouts(spark, found).toLocalIterator():
        groups.setdefault(row["header"], []).append(row["path"])
    text, parts = {"variant", "ts_iso"}, []
    for files in groups.values():
        df = spark.read.option("header", True).csv(files)
        parts.append(df.select(*[c(x) if x in text else c(x).try_cast("double").alias(x)
                                 for x in df.columns if x != "variant"],
                               size.alias("batch_size"), variant.alias("variant")))
    return union_parts(parts)


def write_flows(flows: DataFrame, path: str, fmt: str = "csv",
                columns: Sequence[str] = (*FLOW_METADATA, *FEATURES)) -> None:
    """Flow table in contract order; CSV parts carry a header."""
    df = flows.select(*[c(x) for x in columns])
    writer = df.write.mode("overwrite")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def write_predictions(scored: DataFrame, path: str, fmt: str = "csv") -> None:
    """All input columns plus the predictions."""
    writer = scored.write.mode("overwrite")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def append_lines(records: DataFrame, path: str) -> None:
    """Append JSON lines (one text column) to a log folder."""
    records.write.mode("append").text(path)


def write_report_json(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").text(path)
