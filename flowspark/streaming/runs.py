"""First-seen addresses of runs, with state that ends with the run."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from flowspark.contract import DEFAULT_THRESHOLD
from flowspark.functions.scalar import valid_ip_text
from flowspark.operators.lookups import flag_members
from flowspark.streaming.flows import use_keyed_state

# parts of a run's state, so that one busy run is spread over tasks
SHARDS = 16


def _with_signs_of_life(batches: Iterator[pa.RecordBatch], run: list[str], shards: int) -> Iterator[pa.RecordBatch]:
    """Rows with an address, and for each run of a batch one row without address for each shard."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        kept = table.filter(pc.is_valid(table["ip"]))
        yield from kept.to_batches()
        alive = table.group_by(run).aggregate([("ts_ms", "max")])
        n = alive.num_rows
        for shard in range(shards if n else 0):
            columns = [alive["ts_ms_max"] if x == "ts_ms" else alive[x] if x in run else
                       pa.array([shard] * n, pa.int32()) if x == "shard" else pa.nulls(n, batch.schema.field(x).type)
                       for x in batch.schema.names]
            yield from pa.table(columns, schema=batch.schema).to_batches()


class RunState(StatefulProcessor):
    """Addresses of one shard of a run, until the run has been silent for ``idle_ms`` of event time."""

    def __init__(self, run: list[str], idle_ms: int):
        self.run, self.idle_ms = run, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "ip string", "row_index long")
        self.ends = handle.getValueState("ends", "ms long")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first, last = {}, 0
        for part in rows:
            last = max(last, int(part["ts_ms"].max()))
            for ip, row in zip(part["ip"], part["row_index"]):
                if isinstance(ip, str):
                    first[ip] = min(int(row), first.get(ip, int(row)))
        new = [(ip, row) for ip, row in sorted(first.items()) if not self.seen.containsKey((ip,))]
        for ip, row in new:
            self.seen.updateValue((ip,), (row,))
        ends, old = last + self.idle_ms, self.ends.get() if self.ends.exists() else None
        if old is None or old[0] < ends:
            if old is not None:
                self.handle.deleteTimer(old[0])
            self.handle.registerTimer(ends)
            self.ends.update((ends,))
        if new:
            yield pd.DataFrame([(*key[:-1], ip, row) for ip, row in new], columns=[*self.run, "ip", "row_index"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        self.ends.clear()
        return iter(())


def stream_run_addresses(scored: DataFrame, allowed: DataFrame, ts: Column, idle_ms: int, late_ms: int = 0,
                         run: Sequence[str] = ("run_id",), ip: str = "src_ip", prob: str = "prob",
                         row_index: str = "row_index", threshold: float = DEFAULT_THRESHOLD,
                         shards: int = SHARDS) -> DataFrame:
    """``run, ip, row_index``: each attacking, valid, not allowed address once per run, with its first row.

    ``ts`` is the event time of a row. A run ends when no row of it, attack or not, has come for ``idle_ms`` of
    event time; then its state is removed. All rows of a run keep its state alive, in all of its ``shards``,
    so an address that is silent for long within a run is not shown twice. Rows of a run that has ended
    begin it anew. The first row is the smallest number in the batch that first holds the address.
    """
    run = list(run)
    use_keyed_state(scored.sparkSession)
    text = F.trim(F.coalesce(F.col(ip), F.lit("nan")))
    wanted = (F.col(prob) >= threshold) & valid_ip_text(text)
    rows = scored.withColumn("__ts", ts.cast("timestamp")).withWatermark("__ts", f"{late_ms} milliseconds").select(
        *run, F.when(wanted, text).alias("ip"), F.col(row_index).cast("long").alias("row_index"),
        F.unix_millis("__ts").alias("ts_ms"))
    # an allowed address becomes a row without address, which still keeps its run alive
    both = flag_members(rows, allowed, "ip", "__member").withColumn(
        "ip", F.when(~F.col("__member"), F.col("ip"))).drop("__member")
    both = both.withColumn("shard", F.pmod(F.xxhash64("ip"), F.lit(shards)).cast("int"))
    spread = both.mapInArrow(partial(_with_signs_of_life, run=run, shards=shards), both.schema)
    kept = T.StructType([f for f in both.schema.fields if f.name in run])
    schema = T.StructType([*kept.fields, T.StructField("ip", T.StringType()), T.StructField("row_index", T.LongType())])
    return spread.groupBy(*run, "shard").transformWithStateInPandas(RunState(run, idle_ms), schema, "append", "eventTime")
