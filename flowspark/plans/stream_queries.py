"""Streaming, capture and training queries."""

from __future__ import annotations

from pyspark.sql import Window, functions as F, types as T

from flowspark.contract import FEATURES
from flowspark.operators import clean as cl
from flowspark.operators import training as tr
from flowspark.plans.feature_queries import BINARY_NET, _BINARY_SQL, _net_sql
from flowspark.plans.fixtures import DIRTY, table, view, with_views
from flowspark.plans.decision_queries import _DECIDE
from flowspark.plans.packet_queries import _FID, _K, _KEYED, _SQL, DIGITS, _flow_ctes, _segments_sql, shown
from flowspark.plans.registry import b, query, rounded
from flowspark.session import materialize, scratch_path
from flowspark.sources import growing
from flowspark.sources.captures import decode_captures
from flowspark.streaming import decisions as sdecisions
from flowspark.streaming import flows as sflows
from flowspark.streaming import runs as sruns
from flowspark.streaming import score as sscore
from flowspark.streaming import timing as stiming


def _drain(spark, df, folder, fmt="parquet", name=None):
    """Run a stream over everything that is there, then return where it wrote."""
    path = scratch_path(spark, folder)
    q = sscore.write_stream(df, path, scratch_path(spark, f"{folder}-checkpoint"), fmt, name=name)
    q.awaitTermination()
    return path, q


def _staged(spark, df, name, parts=4):
    path = scratch_path(spark, name)
    df.repartition(parts).write.parquet(path)
    return sscore.stream_parquet(spark, path, df.schema, max_files=2)


_ROW_GROUP = 4 << 20


def _in_order(spark, df, order, name, parts=4, last=None):
    """A stream of files that arrive in the order of a column, one per batch; ``last`` comes after them.

    The rows of a file are made by many tasks and written by one, in row groups that are small enough for many to read.
    """
    path = scratch_path(spark, name)
    ends = df.agg(F.min(order).alias("a"), F.max(order).alias("b")).first()
    width = (ends.b - ends.a) // parts + 1
    for i in range(parts):
        part = df.filter((F.col(order) >= ends.a + i * width) & (F.col(order) < ends.a + (i + 1) * width))
        part.repartition(1).write.mode("append").option("parquet.block.size", _ROW_GROUP).parquet(path)
    if last is not None:
        last.coalesce(1).write.mode("append").parquet(path)
    return sscore.stream_parquet(spark, path, df.schema, max_files=1)


@query("stream_flow_csv", with_views("scored", "SELECT row_index, run_id, prob, nullif(trim(src_ip), '') AS src_ip FROM scored"))
def stream_flow_csv(spark, sf):
    rows = view(spark, sf, "scored").select("row_index", "run_id", "prob", "src_ip")
    folder = scratch_path(spark, "live")
    rows.repartition(3).write.option("header", True).csv(folder)
    path, _ = _drain(spark, sscore.stream_flow_csv(spark, folder, rows.schema, 1), "tail")
    return spark.read.schema(rows.schema).parquet(path)


@query("stream_growing_csv", with_views("scored", """
SELECT CAST(0 AS BIGINT) AS run_id, row_index, prob, nullif(trim(src_ip), '') AS src_ip FROM scored"""))
def stream_growing_csv(spark, sf):
    """One file as a stream of lines, columns found by its header."""
    rows = view(spark, sf, "scored").select("prob", "src_ip", F.col("row_index").alias("row"))
    folder = scratch_path(spark, "growing")
    rows.coalesce(1).write.option("header", True).csv(folder)
    file = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder).select("path").first().path
    wanted = T.StructType.fromDDL("row long, prob double, src_ip string")
    stream = growing.stream_growing_csv(spark, file, wanted, scratch_path(spark, "growing-state"))
    path, _ = _drain(spark, stream, "grown")
    return spark.read.parquet(path).select("run_id", F.col("row").alias("row_index"), "prob",
                                           F.nullif("src_ip", F.lit("")).alias("src_ip"))


@query("stream_alerts", with_views("scored", "SELECT 7 AS ts, prob, row_index FROM scored WHERE prob >= 0.5"))
def stream_alerts(spark, sf):
    stream = _staged(spark, view(spark, sf, "scored"), "scored")
    path, _ = _drain(spark, sscore.stream_alerts(stream, F.lit(7)), "alerts", "text")
    return spark.read.schema("ts long, prob double, row_index long").json(path)


@query("stream_first_seen", with_views("scored allowed", """
SELECT DISTINCT run_id, trim(coalesce(src_ip, 'nan')) AS ip FROM scored
WHERE prob >= 0.5 AND trim(coalesce(src_ip, 'nan')) NOT IN ('', 'nan')
  AND src_ip NOT IN (SELECT ip FROM allowed)"""))
def stream_first_seen(spark, sf):
    """Rows a second apart; a run that is silent for half an hour of event time has ended."""
    rows = view(spark, sf, "scored").select("row_index", "run_id", "prob", "src_ip")
    seen = sruns.stream_run_addresses(_in_order(spark, rows, "row_index", "scored", 4), view(spark, sf, "allowed"),
                                      F.timestamp_seconds("row_index"), idle_ms=1_800_000)
    path, _ = _drain(spark, seen, "seen")
    return spark.read.schema("run_id long, ip string").parquet(path).select("run_id", "ip")


_FEATS = [f"f{i}" for i in range(64)]


def _wide(spark, sf):
    return view(spark, sf, "vectors").selectExpr("vec_id", *[
        f"CAST(get(embedding, {i}) AS DOUBLE) AS {x}" for i, x in enumerate(_FEATS)])


_SCALED_SQL = """
WITH st AS (SELECT i, avg(v) AS m, if(stddev_pop(v) = 0, 1, stddev_pop(v)) AS s FROM
  (SELECT unnest(embedding)::DOUBLE AS v, unnest(range(1, len(embedding) + 1)) AS i FROM vectors) GROUP BY i),
pars AS (SELECT list(m ORDER BY i) AS m, list(s ORDER BY i) AS s FROM st),
scaled AS (SELECT vec_id, label, list_transform(range(1, len(embedding) + 1), lambda i: (embedding[i]::DOUBLE - m[i]) / s[i])
  AS embedding FROM vectors, pars), """ + _BINARY_SQL.strip().removeprefix("WITH ").replace("FROM vectors", "FROM scaled")


@query("stream_score", with_views("vectors", _SCALED_SQL))
def stream_score(spark, sf):
    """Scores a stream with stored medians and fitted scaling; equal to batch scoring."""
    wide = _wide(spark, sf)
    params = materialize(cl.fit_scaler(wide, _FEATS), "scaler")
    medians = wide.agg(*[F.percentile_approx(x, 0.5).alias(x) for x in _FEATS])
    stream = _staged(spark, wide, "rows")
    scored = sscore.stream_score(stream, params, medians, BINARY_NET, _FEATS) \
        .select("vec_id", "pred_attack_proba", "pred", "pred_label")
    path, _ = _drain(spark, scored, "scores")
    return rounded(spark.read.parquet(path), 6, "pred_attack_proba")


@query("stage_timing", with_views("vectors", f"""
WITH {_net_sql(BINARY_NET)}
SELECT count(*) AS n_rows, count(*) AS n_scored, count(*) FILTER (z[1] >= 0) AS n_attacks, true AS timed FROM net"""))
def stage_timing(spark, sf):
    """Totals of the timing rows that a listener wrote while a stream was scored."""
    stream = _staged(spark, view(spark, sf, "vectors"), "vectors")
    path, name = scratch_path(spark, "timing"), scratch_path(spark, "query").rsplit("/", 1)[-1]
    times = stiming.StageTimes(spark, path, name)
    spark.streams.addListener(times)
    try:
        _drain(spark, stiming.score_timed(stream, "embedding", BINARY_NET).select("vec_id", "pred"), "timed", name=name)
        times.wait()
    finally:
        spark.streams.removeListener(times)
    rows = spark.read.schema(stiming.TIMING_DDL).parquet(path)
    spent = F.least(F.min("t_total_ms"), F.sum("t_execution_ms"), F.sum("t_inference_ms"), F.sum("t_upstream_ms"))
    return rows.agg(F.sum("n_rows").alias("n_rows"), F.sum("n_scored").alias("n_scored"),
                    F.sum("n_attacks").alias("n_attacks"), (spent > 0).alias("timed"))


_STREAM_GAP = 10_000_000


@query("stream_flows", with_views("packets", f"""
WITH {_KEYED}, {_segments_sql(_STREAM_GAP)}, {_flow_ctes(_K + ", segment", "split")}
SELECT {_FID} AS "flow id", f_ip AS "source ip", d_ip AS "destination ip",
       strftime(make_timestamp(t0), '%Y-%m-%d %H:%M:%S') AS "timestamp", '' AS label, t0 AS first_ts, n AS n_packets,
       {", ".join(f'round(CAST(coalesce({_SQL[x]}, 0) AS DOUBLE), {DIGITS}) AS "{x}"' for x in FEATURES)}
FROM flows"""))
def stream_flows(spark, sf):
    """All flows of a drained packet stream; a last far packet moves the watermark past them."""
    packets = view(spark, sf, "packets")
    last = packets.orderBy(F.desc("seq")).limit(1).withColumns({
        "ts_us": F.col("ts_us") + F.lit(10**12), "src_ip": F.lit("flush"), "dst_ip": F.lit("flush")})
    stream = sflows.stream_flows(_in_order(spark, packets, "seq", "packets", 4, last), _STREAM_GAP)
    path, _ = _drain(spark, stream, "flows")
    closed = spark.read.parquet(path).filter("kind = 'flow'")
    return shown(closed, FEATURES, "source ip", "destination ip", "timestamp", "label", "first_ts", "n_packets")


@query("stream_decisions", with_views("scored allowed blocked", f"WITH {_DECIDE} SELECT * FROM decisions"))
def stream_decisions(spark, sf):
    """Decisions made batch by batch are those of one batch over all rows."""
    rows = view(spark, sf, "scored").select("row_index", "run_id", "prob", "src_ip")
    path = scratch_path(spark, "decided")
    sdecisions.stream_decisions(
        _in_order(spark, rows, "row_index", "scored", 5), view(spark, sf, "allowed"), view(spark, sf, "blocked"), path,
        scratch_path(spark, "decided-checkpoint")).awaitTermination()
    shape = "run_id long, row_index long, prob double, src_ip string, action string, reason string, cmd string"
    return sdecisions.decisions(spark, path, shape).drop("batch")


# ---- captures --------------------------------------------------------------------------------

def _hex(x, digits):
    return F.lpad(F.hex(x.cast("bigint")), digits, "0")


def _ip_hex(ip):
    parts = F.split(ip, r"\.")
    return F.concat(*[_hex(F.get(parts, F.lit(i)), 2) for i in range(4)])


def capture_files(packets, per_file=1000):
    """Capture files as bytes, built in SQL from packet rows: ``file_no, content``."""
    l4 = F.when(F.col("proto") == 6, F.concat(
        _hex(F.col("src_port"), 4), _hex(F.col("dst_port"), 4), F.lit("0" * 16), F.lit("50"),
        _hex(F.col("tcp_flags"), 2), _hex(F.col("tcp_window"), 4), F.lit("0" * 8))) \
        .when(F.col("proto") == 17, F.concat(
            _hex(F.col("src_port"), 4), _hex(F.col("dst_port"), 4), F.lit("0" * 8))) \
        .otherwise(F.lit(""))
    ip = F.concat(F.lit("4500"), _hex(F.col("total_len"), 4), F.lit("0" * 8), F.lit("40"),
                  _hex(F.col("proto"), 2), F.lit("0000"), _ip_hex(F.col("src_ip")),
                  _ip_hex(F.col("dst_ip")))
    frame = F.concat(F.lit("0" * 24 + "0800"), ip, l4)
    size = _hex(F.length(frame) / 2, 8)
    head = F.concat(_hex(F.floor(F.col("ts_us") / 1_000_000), 8),
                    _hex(F.col("ts_us") % 1_000_000, 8), size, size)
    start = F.lit("a1b2c3d4" + "00020004" + "0" * 16 + "0000ffff" + "00000001")
    # at most per_file packets are gathered: numbers of one file are consecutive
    return packets.select(F.floor(F.col("seq") / per_file).alias("file_no"), "seq",
                          F.concat(head, frame).alias("record")) \
        .groupBy("file_no").agg(F.array_sort(F.collect_list(F.struct("seq", "record"))).alias("r")) \
        .select("file_no", F.unhex(F.concat(start, F.array_join(F.col("r.record"), ""))).alias("content"))


@query("read_captures", with_views("packets", """
SELECT (seq // 1000) * 4294967296 + seq % 1000 AS seq, ts_us, src_ip, src_port, dst_ip, dst_port, proto,
       total_len, ip_hdr_len, l4_hdr_len, tcp_flags, tcp_window FROM packets"""))
def read_captures(spark, sf):
    return decode_captures(capture_files(view(spark, sf, "packets")))


# ---- training --------------------------------------------------------------------------------

def _examples(spark, sf):
    v = table(spark, sf, "embeddings")
    label = F.when(F.col("label") < 4, "BENIGN").when(F.col("label") < 7, "DDoS") \
        .otherwise("Web Attack - XSS")
    return v.withColumn("class", label).selectExpr("vec_id", "class AS label", *[
        f"CAST(get(embedding, {i}) AS DOUBLE) AS {x}" for i, x in enumerate(_FEATS)])


def _fitted(spark, sf, target, hidden, n_classes):
    rows = _examples(spark, sf)
    ready, names = tr.prepare_training(rows, F.col("vec_id"), "vec_id", features=_FEATS)
    parts = tr.split_examples(ready, target)
    trained = tr.train_network(parts["train"], parts["validation"], len(names), n_classes, hidden,
                               rounds=2, steps=8)
    return trained, parts


# Positions of the parts, and the classes, have an exact twin; of a fitted network SQL can say what must hold.
_PARTS = """parts AS (SELECT *, CASE WHEN vec_id < CAST(floor(0.7::DOUBLE * n) AS BIGINT) THEN 'train'
  WHEN vec_id < CAST(floor(0.85::DOUBLE * n) AS BIGINT) THEN 'validation' ELSE 'test' END AS part
  FROM embeddings, (SELECT count(*) AS n FROM embeddings))"""
_BINARY_Y, _CLASS_Y = "CAST(label >= 4 AS INT)", "CASE WHEN label < 4 THEN 0 WHEN label < 7 THEN 1 ELSE 2 END"


def _trained_sql(y):
    return f"""WITH {_PARTS} SELECT CAST({y} AS VARCHAR) AS class, count(*) FILTER (part = 'train') AS n_train,
count(*) FILTER (part = 'validation') AS n_validation, count(*) FILTER (part = 'test') AS support, true AS learned
FROM parts GROUP BY 1"""


def _judged(trained, parts):
    """Per class: rows of each part, and whether the chosen network fits its training rows better than class shares do."""
    counts = None
    for part, name in (("train", "n_train"), ("validation", "n_validation"), ("test", "support")):
        one = parts[part].groupBy(F.col("label").cast("int").cast("string").alias("class")).agg(F.count(F.lit(1)).alias(name))
        counts = one if counts is None else counts.join(one, "class", "full")
    share = F.col("n_train") / F.sum("n_train").over(Window.partitionBy())
    prior = counts.select((-F.col("n_train") * F.log(share)).alias("l"), "n_train").agg(
        (F.sum("l") / F.sum("n_train")).alias("prior")).first().prior
    return counts.fillna(0).withColumn("learned", F.lit(tr.validation_loss(trained.model, parts["train"]) < prior))


@query("train_binary", _trained_sql(_BINARY_Y))
def train_binary(spark, sf):
    return _judged(*_fitted(spark, sf, "y_binary", (16, 8), 2))


@query("train_multiclass", _trained_sql(_CLASS_Y))
def train_multiclass(spark, sf):
    return _judged(*_fitted(spark, sf, "y_class", (16, 8), 3))


@query("select_best", """
SELECT CAST(3 AS BIGINT) AS n_models, CAST(1 AS BIGINT) AS n_chosen, true AS least_loss""")
def select_best(spark, sf):
    """Two networks and the baseline by validation loss; the least loss is chosen."""
    trained, parts = _fitted(spark, sf, "y_binary", (8,), 2)
    models = {"network": trained.model, "small network": tr.train_network(
        parts["train"], parts["validation"], len(_FEATS), 2, (2,), rounds=1, steps=3).model,
        "logistic": tr.train_baseline(parts["train"], 10)}
    name, losses = tr.choose_model(models, parts["validation"])
    rows = spark.createDataFrame([(n, x, n == name) for n, x in losses.items()], "model string, loss double, chosen boolean")
    return rows.agg(F.count(F.lit(1)).alias("n_models"), F.count_if("chosen").alias("n_chosen"),
                    (F.min("loss") == F.min(F.when(F.col("chosen"), F.col("loss")))).alias("least_loss"))


@query("training_pipeline", f"""
WITH {_PARTS}, t AS (SELECT CAST({_BINARY_Y} AS VARCHAR) AS class, count(*) AS support FROM parts WHERE part = 'test' GROUP BY 1)
SELECT class, support FROM t UNION ALL
SELECT unnest(['accuracy', 'macro avg', 'weighted avg']), (SELECT CAST(sum(support) AS BIGINT) FROM t)""")
def training_pipeline(spark, sf):
    report = tr.training_pipeline(_examples(spark, sf), F.col("vec_id"), "vec_id", features=_FEATS,
                                  hidden=(8,), rounds=2, steps=5)
    return report.select("class", b(F.col("support")).alias("support"))


# the split and the scaling parameters of training have an exact twin
@query("prepare_training", f"""
WITH {_PARTS},
st AS (SELECT i, avg(v) AS m, if(stddev_pop(v) = 0, 1, stddev_pop(v)) AS s FROM
  (SELECT unnest(embedding)::DOUBLE AS v, unnest(range(1, len(embedding) + 1)) AS i FROM parts WHERE part = 'train') GROUP BY i),
p AS (SELECT list(m ORDER BY i) AS m, list(s ORDER BY i) AS s FROM st)
SELECT vec_id, part, {", ".join(f"round((embedding[{i + 1}]::DOUBLE - m[{i + 1}]) / s[{i + 1}], 6) AS x{i}" for i in range(64))}
FROM parts, p""")
def prepare_training(spark, sf):
    ready, _ = tr.prepare_training(_examples(spark, sf), F.col("vec_id"), "vec_id", features=_FEATS)
    return ready.select("vec_id", "part", *[F.round(F.get("x", F.lit(i)), 6).alias(f"x{i}") for i in range(len(_FEATS))])
