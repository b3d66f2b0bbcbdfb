"""Where the time of a stream goes: rows of stage times, appended while the query runs."""

from __future__ import annotations

import threading
import time
from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener

from flowspark.contract import DEFAULT_THRESHOLD
from flowspark.functions.scalar import sigmoid
from flowspark.operators.scoring import Layer, threshold_predict, usable_vector

# Wall times of a micro-batch as Spark reports them; what is left of the total is ``other``. Upstream and inference
# are task times inside the execution: the wait of all tasks for prepared rows, and their forward passes.
TIMING_DDL = ("timestamp string, variant string, batch_idx long, n_rows long, n_scored long, n_attacks long, "
              "t_offsets_ms double, t_planning_ms double, t_execution_ms double, t_commit_ms double, t_other_ms double, "
              "t_total_ms double, t_upstream_ms double, t_inference_ms double")
_PARTS = {"offsets": ("latestOffset", "getOffset", "setOffsetRange", "getEndOffset", "getBatch"), "planning": ("queryPlanning",),
          "execution": ("addBatch",), "commit": ("walCommit", "commitOffsets")}
METRICS = "stages"


def _timed(batches: Iterator[pa.RecordBatch], model: list) -> Iterator[pa.RecordBatch]:
    """Forward pass with its time and the wait for each batch, noted on the batch's first row."""
    asked = time.perf_counter()
    for batch in batches:
        got = time.perf_counter()
        column = batch.column(batch.num_columns - 1)
        z = np.asarray(column.flatten(), float).reshape(len(column), model[0][0].shape[0])
        for k, (w, b) in enumerate(model):
            z = z @ w + b
            if k < len(model) - 1:
                z = np.maximum(z, 0.0)
        done = time.perf_counter()
        spent = [np.zeros(batch.num_rows, np.int64) for _ in range(2)]
        if batch.num_rows:
            spent[0][0], spent[1][0] = round(1e6 * (got - asked)), round(1e6 * (done - got))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(z[:, 0]), *map(pa.array, spent)],
            names=[*batch.schema.names[:-1], "__raw", "__upstream_us", "__inference_us"])
        asked = time.perf_counter()


def score_timed(df: DataFrame, x: str, layers: Sequence[Layer], threshold: float = DEFAULT_THRESHOLD,
                logits: bool = True, metrics: str = METRICS) -> DataFrame:
    """``score_binary`` in Arrow batches, with its times and counts as observed metrics of every micro-batch."""
    model = [(np.asarray(l.weights, float).T, np.asarray(l.bias, float)) for l in layers]
    width = model[0][0].shape[0]
    good = F.expr(usable_vector(x, width))
    sent = df.withColumn("__good", good).withColumn("__sent", F.when(
        F.col("__good"), F.col(x).cast("array<double>")).otherwise(F.array_repeat(F.lit(0.0), width)))
    schema = T.StructType([*sent.schema.fields[:-1], T.StructField("__raw", T.DoubleType()),
                           T.StructField("__upstream_us", T.LongType()), T.StructField("__inference_us", T.LongType())])
    made = sent.mapInArrow(partial(_timed, model=model), schema)
    raw = F.when(F.col("__good"), F.col("__raw"))
    scored = threshold_predict(made.withColumn("pred_attack_proba", sigmoid(raw) if logits else raw),
                               "pred_attack_proba", threshold)
    return scored.observe(
        metrics, F.count(F.lit(1)).alias("n_scored"), F.count_if(F.col("pred") == 1).alias("n_attacks"),
        F.sum("__upstream_us").alias("upstream_us"), F.sum("__inference_us").alias("inference_us")) \
        .drop("__good", "__raw", "__upstream_us", "__inference_us")


class StageTimes(StreamingQueryListener):
    """Appends one timing row per micro-batch of the query ``name`` to a parquet folder, while the query runs.

    Register it with ``spark.streams.addListener`` before the query starts. Rows are written ``rows`` at a
    time and at the end; no progress event has to be kept or polled. Batches without input have a row too.
    """

    def __init__(self, spark: SparkSession, path: str, name: str, variant: str = "spark", rows: int = 50,
                 metrics: str = METRICS):
        self.spark, self.path, self.name, self.variant, self.rows, self.metrics = spark, path, name, variant, rows, metrics
        self.held: list[tuple] = []
        self.ids: set = set()
        self.ended = threading.Event()
        self.lock = threading.Lock()

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self.ids.add(str(event.id))
            self.ended.clear()

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.name != self.name:
            return
        ms = {k: float(v) for k, v in p.durationMs.items()}
        total = ms.get("triggerExecution", 0.0)
        parts = {k: sum(ms.get(x, 0.0) for x in names) for k, names in _PARTS.items()}
        seen = p.observedMetrics.get(self.metrics)
        seen = seen.asDict() if seen is not None else {}
        row = (str(p.timestamp), self.variant, int(p.batchId), int(p.numInputRows), seen.get("n_scored"),
               seen.get("n_attacks"), *[parts[k] for k in _PARTS], max(0.0, total - sum(parts.values())), total,
               *[seen[k] / 1000 if seen.get(k) is not None else None for k in ("upstream_us", "inference_us")])
        with self.lock:
            self.held.append(row)
        if len(self.held) >= self.rows:
            self.flush()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if str(event.id) in self.ids:
            self.flush()
            self.ended.set()

    def flush(self) -> None:
        with self.lock:
            rows, self.held = self.held, []
        if rows:
            self.spark.createDataFrame(rows, TIMING_DDL).coalesce(1).write.mode("append").parquet(self.path)

    def wait(self, seconds: float = 60) -> None:
        """Wait until the last rows of an ended query are written; events come a moment after its end."""
        if not self.ended.wait(seconds):
            raise TimeoutError(f"no end of query {self.name} was reported")
