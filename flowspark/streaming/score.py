"""Continuous scoring and alerts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from flowspark.contract import DEFAULT_THRESHOLD, FEATURES
from flowspark.functions.scalar import json_record
from flowspark.operators.actions import attack_rows
from flowspark.operators.schema import normalize_columns
from flowspark.operators.scoring import Layer, prepare_features, score_binary
from flowspark.sources.flow_csv import checked_rows, text_rows


def stream_flow_csv(spark: SparkSession, folder: str, schema: T.StructType,
                    max_files: int | None = None) -> DataFrame:
    """New CSV files of a folder as a stream. Offsets live in the query's checkpoint.

    As in the batch reader, every value is read as text and cast: an unreadable number is NULL, a
    short row is padded, a long one fails, and names are normalised. A file whose header has other names than
    the schema, or another order, fails the stream instead of being misread; case and blanks do not matter.
    """
    width = len(schema.fields)
    reader = text_rows(spark.readStream, width, [x.strip() for x in schema.names])
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    rows = checked_rows(reader.csv(folder).toDF(*[f"c{i}" for i in range(width)], "__bad"), width)
    return normalize_columns(rows.select(*[
        F.col(f"c{i}").alias(f.name) if isinstance(f.dataType, T.StringType)
        else F.col(f"c{i}").try_cast(f.dataType).alias(f.name) for i, f in enumerate(schema.fields)]))


def stream_parquet(spark: SparkSession, path: str, schema: T.StructType,
                   max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def stream_score(rows: DataFrame, params: DataFrame, medians: DataFrame, layers: Sequence[Layer],
                 features: Sequence[str] = FEATURES,
                 threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Clean, impute with fixed medians, scale and score each arriving row; no state."""
    ready = prepare_features(rows, params, features, mode="fixed", fixed=medians)
    return score_binary(ready, "x", layers, threshold).drop("x")


def stream_alerts(scored: DataFrame, ts: Column, prob: str = "prob",
                  row_index: str = "row_index",
                  threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """One JSON line per attack row of a stream."""
    return attack_rows(scored, prob, threshold).select(
        json_record(ts=ts, prob=F.col(prob), row_index=F.col(row_index)).alias("value"))


def write_stream(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet",
                 poll_seconds: int | None = None, name: str | None = None) -> StreamingQuery:
    """Append to files exactly once; ``poll_seconds=None`` drains what is there and stops."""
    writer = df.writeStream.outputMode("append").format(fmt) \
        .option("path", path).option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    if poll_seconds is None:
        writer = writer.trigger(availableNow=True)
    else:
        writer = writer.trigger(processingTime=f"{poll_seconds} seconds")
    return writer.start()
