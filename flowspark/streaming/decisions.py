"""Block decisions on a stream of scored rows, in batches that can be repeated."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowspark.contract import DEFAULT_THRESHOLD
from flowspark.operators.actions import decide_actions

# runs of one batch by which the stored addresses are pruned when they are read
PRUNED_RUNS = 1000


def _batches(spark: SparkSession, path: str, schema) -> DataFrame:
    """Stored batches with their number; a folder without batches is an empty table."""
    return spark.read.schema(schema).option("basePath", path).parquet(path)


def seen_before(batch: DataFrame, path: str, number: int, run: Sequence[str]) -> DataFrame | None:
    """(run, src_ip) used up by batches before ``number``; None for the first batch.

    Only rows of runs that occur in ``batch`` are read: files of ended runs are skipped by their statistics.
    """
    if number == 0:
        return None
    spark = batch.sparkSession
    fields = [f for f in batch.schema.fields if f.name in run]
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["src_ip string", "batch long"])
    stored = _batches(spark, f"{path}/seen", ddl).filter(F.col("batch") < number)
    for x in run:
        values = [r[0] for r in batch.select(x).distinct().limit(PRUNED_RUNS + 1).collect()]
        if len(values) <= PRUNED_RUNS and None not in values:
            stored = stored.filter(F.col(x).isin(values))
    return stored.select(*run, "src_ip")


def decide_batch(batch: DataFrame, number: int, allowed: DataFrame, blocked: DataFrame, path: str,
                 run: Sequence[str] = ("run_id",), **options) -> None:
    """Write the decisions of one batch and the addresses it uses up.

    Both go to folders of the batch's number that are overwritten, and only earlier batches are read, so a
    batch that is repeated after a failure writes the same rows to the same place.
    """
    decided = decide_actions(batch, allowed, blocked, run=run, seen=seen_before(batch, path, number, run), **options)
    target = f"{path}/decisions/batch={number}"
    decided.write.mode("overwrite").parquet(target)
    written = batch.sparkSession.read.schema(decided.schema).parquet(target)
    # the first eligible row of an address is blocked, or was found blocked
    used = written.filter(F.col("reason").isNull() | (F.col("reason") == "already_blocked"))
    used.select(*run, "src_ip").write.mode("overwrite").parquet(f"{path}/seen/batch={number}")


def stream_decisions(scored: DataFrame, allowed: DataFrame, blocked: DataFrame, path: str, checkpoint: str,
                     run: Sequence[str] = ("run_id",), threshold: float = DEFAULT_THRESHOLD,
                     poll_seconds: int | None = None, before: Callable[[int], None] | None = None,
                     **options) -> StreamingQuery:
    """Decide the rows of a stream, with the reasons that one batch over all rows would give.

    Rows of a run must arrive in the order of ``row_index`` across batches; within a batch any order will do.
    ``path`` holds ``decisions`` and ``seen``, one folder per batch. Start the same ``checkpoint`` again to go
    on where a stream stopped. ``before`` is called with each batch's number. ``poll_seconds=None`` drains what
    is there and stops.
    """
    def each(batch: DataFrame, number: int) -> None:
        if before:
            before(number)
        decide_batch(batch, number, allowed, blocked, path, run, threshold=threshold, **options)

    writer = scored.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    if poll_seconds is None:
        writer = writer.trigger(availableNow=True)
    else:
        writer = writer.trigger(processingTime=f"{poll_seconds} seconds")
    return writer.start()


def decisions(spark: SparkSession, path: str, schema) -> DataFrame:
    """All decisions that a stream has written, with the number of their batch."""
    return _batches(spark, f"{path}/decisions", schema)
