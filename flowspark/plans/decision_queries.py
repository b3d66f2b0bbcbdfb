"""Evaluation, alert and action queries over scored rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowspark.contract import ALWAYS_ALLOWED, SWEEP_THRESHOLDS
from flowspark.functions import scalar as sc
from flowspark.operators import actions as ac
from flowspark.operators import evaluate as ev
from flowspark.operators import lookups as lk
from flowspark.operators import schema as sm
from flowspark.operators.reports import best_per_group
from flowspark.operators.scoring import threshold_predict
from flowspark.plans.fixtures import table, view, with_views
from flowspark.plans.registry import b, query, rounded
from flowspark.session import scratch_path
from flowspark.sources import tables as src

TS = 1_700_000_000


def scored(spark, sf):
    return view(spark, sf, "scored")


def predicted(spark, sf, threshold: float = 0.5):
    return threshold_predict(scored(spark, sf), "prob", threshold)


# ---- evaluation ------------------------------------------------------------------------

_COUNTS = """
count(*) FILTER (prob >= {t} AND y_true = 1) AS tp, count(*) FILTER (prob >= {t} AND y_true = 0) AS fp,
count(*) FILTER (prob < {t} AND y_true = 0) AS tn, count(*) FILTER (prob < {t} AND y_true = 1) AS fn"""
_METRICS = """
round((tp + tn) / greatest(tp + fp + tn + fn, 1), 4) AS accuracy, round(pr, 4) AS "precision",
round(re, 4) AS recall, round(2 * pr * re / greatest(pr + re, 1e-9), 4) AS f1"""
_WITH_PR = """pr AS (SELECT *, tp / greatest(tp + fp, 1) AS pr, tp / greatest(tp + fn, 1) AS re
FROM counts)"""


@query("confusion", with_views("scored", f"SELECT {_COUNTS.format(t=0.5)} FROM scored"))
def confusion(spark, sf):
    return ev.confusion(predicted(spark, sf))


@query("metrics", with_views("scored", f"""
WITH counts AS (SELECT {_COUNTS.format(t=0.5)} FROM scored), {_WITH_PR}
SELECT tp, fp, tn, fn, {_METRICS} FROM pr"""))
def metrics(spark, sf):
    return ev.metrics(ev.confusion(predicted(spark, sf)))


_SWEEP = f"""cuts AS (SELECT unnest([{", ".join(map(str, SWEEP_THRESHOLDS))}]::DOUBLE[]) AS threshold),
counts AS (SELECT threshold, {_COUNTS.format(t="threshold")} FROM scored, cuts GROUP BY threshold),
{_WITH_PR}, sweep AS (SELECT threshold, tp, fp, tn, fn, {_METRICS}, tp + fp AS detected FROM pr)"""


@query("threshold_sweep", with_views("scored", f"WITH {_SWEEP} SELECT * FROM sweep"))
def threshold_sweep(spark, sf):
    return ev.threshold_sweep(scored(spark, sf))


@query("best_threshold", with_views("scored", f"""
WITH {_SWEEP} SELECT threshold AS best_threshold, f1 AS best_f1 FROM sweep
ORDER BY f1 DESC, threshold LIMIT 1"""))
def best_threshold(spark, sf):
    return ev.best_threshold(ev.threshold_sweep(scored(spark, sf)))


@query("mark_best_threshold", with_views("scored", f"""
WITH {_SWEEP} SELECT threshold, f1,
  row_number() OVER (ORDER BY f1 DESC, threshold) = 1 AS is_best FROM sweep"""))
def mark_best(spark, sf):
    return ev.mark_best(ev.threshold_sweep(scored(spark, sf))).select("threshold", "f1", "is_best")


@query("best_per_group", with_views("scored", """
SELECT run_id, row_index, prob,
  row_number() OVER (PARTITION BY run_id ORDER BY prob DESC, row_index) = 1 AS is_best FROM scored"""))
def best_in_run(spark, sf):
    rows = scored(spark, sf).select("run_id", "row_index", "prob")
    return best_per_group(rows, ["run_id"], "prob", "row_index")


def _report_sql(truth: str, pred: str, source: str) -> str:
    return f"""
m AS (SELECT {truth} AS t, {pred} AS p, count(*) AS n FROM {source} GROUP BY 1, 2),
classes AS (SELECT t AS class FROM m UNION SELECT p FROM m),
k AS (SELECT class, coalesce(sum(n) FILTER (t = class AND p = class), 0) AS tp,
             coalesce(sum(n) FILTER (t = class), 0) AS support,
             coalesce(sum(n) FILTER (p = class), 0) AS predicted FROM classes, m GROUP BY class),
r AS (SELECT *, CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted END AS pr,
             CASE WHEN support = 0 THEN 0 ELSE tp / support END AS re FROM k),
f AS (SELECT *, CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END AS f1 FROM r),
s AS (SELECT sum(tp) / sum(support) AS acc, CAST(sum(support) AS BIGINT) AS n, avg(pr) AS mp, avg(re) AS mr,
             avg(f1) AS mf, sum(pr * support) / sum(support) AS wp,
             sum(re * support) / sum(support) AS wr, sum(f1 * support) / sum(support) AS wf FROM f)
SELECT class, round(pr, 4) AS "precision", round(re, 4) AS recall, round(f1, 4) AS f1,
       CAST(support AS BIGINT) AS support FROM f
UNION ALL SELECT 'accuracy', round(acc, 4), round(acc, 4), round(acc, 4), n FROM s
UNION ALL SELECT 'macro avg', round(mp, 4), round(mr, 4), round(mf, 4), n FROM s
UNION ALL SELECT 'weighted avg', round(wp, 4), round(wr, 4), round(wf, 4), n FROM s"""


# predicted class: the true one where the score agrees, else what the score suggests
_GUESS = """guess AS (SELECT label, CASE WHEN prob >= 0.9 THEN 'DDoS' WHEN prob >= 0.5 THEN 'Bot'
ELSE 'BENIGN' END AS pred FROM scored)"""


@query("classification_report", with_views(
    "scored", f"WITH {_GUESS}, {_report_sql('label', 'pred', 'guess')}"))
def classification_report(spark, sf):
    guess = F.when(F.col("prob") >= 0.9, "DDoS").when(F.col("prob") >= 0.5, "Bot").otherwise("BENIGN")
    return ev.classification_report(scored(spark, sf).withColumn("pred", guess), "label", "pred")


@query("binary_report", with_views("scored", f"""
WITH g AS (SELECT CAST(y_true AS VARCHAR) AS t, CASE WHEN prob >= 0.5 THEN '1' ELSE '0' END AS p FROM scored),
{_report_sql('t', 'p', 'g').strip()}"""))
def binary_report(spark, sf):
    return ev.classification_report(predicted(spark, sf), "y_true", "pred")


@query("distinct_union", with_views("scored", f"""
WITH {_GUESS} SELECT label AS class FROM guess UNION SELECT pred FROM guess"""))
def distinct_union(spark, sf):
    guess = F.when(F.col("prob") >= 0.9, "DDoS").when(F.col("prob") >= 0.5, "Bot").otherwise("BENIGN")
    return ev.distinct_classes(scored(spark, sf).withColumn("pred", guess), "label", "pred")


@query("raw_score_stats", with_views("scored", """
SELECT round(min(logit), 6) AS "min", round(max(logit), 6) AS "max", round(avg(logit), 6) AS mean,
       round(stddev_pop(logit), 6) AS std,
       CASE WHEN min(logit) < 0 OR max(logit) > 1 THEN 'LOGITS' ELSE 'PROBABILITIES' END AS kind
FROM scored"""))
def raw_score_stats(spark, sf):
    return rounded(ev.raw_score_stats(scored(spark, sf), "logit"), 6)


@query("alert_summary", with_views("scored", """
SELECT run_id, row_index // 500 AS batch_id, count(*) AS n_rows,
       count(*) FILTER (prob >= 0.5) AS n_attacks, max(prob) FILTER (prob >= 0.5) AS top_prob
FROM scored GROUP BY 1, 2"""))
def alert_summary(spark, sf):
    batched = ac.batch_id(predicted(spark, sf), 500)
    return ev.alert_summary(batched, ["run_id", "batch_id"])


@query("detected_count", with_views("scored", """
SELECT count(*) FILTER (prob >= 0.2) AS detected, count(*) AS n_rows FROM scored"""))
def detected_count(spark, sf):
    return ev.detected_count(scored(spark, sf), threshold=0.2)


_LN = "CASE WHEN {p} > 0 THEN greatest(-100, ln({p})) ELSE -100 END"


@query("log_loss", with_views("scored", f"""
SELECT run_id, round(avg(-(y_true * {_LN.format(p="prob")}
       + (1 - y_true) * {_LN.format(p="(1 - prob)")})), 6) AS log_loss, count(*) AS n_rows
FROM scored GROUP BY run_id"""))
def log_loss(spark, sf):
    return rounded(ev.log_loss(scored(spark, sf), keys=["run_id"]), 6)


@query("cross_entropy", with_views("scored", f"""
SELECT round(avg(-({_LN.format(p="CASE WHEN y_true = 1 THEN prob ELSE 1 - prob END")})), 6)
       AS cross_entropy, count(*) AS n_rows FROM scored"""))
def cross_entropy(spark, sf):
    rows = scored(spark, sf).withColumn("probs", F.array(1 - F.col("prob"), F.col("prob")))
    return rounded(ev.cross_entropy(rows, "probs", "y_true"), 6)


@query("agreement", with_views("scored", """
SELECT count(*) AS n_rows, count(*) FILTER ((prob >= 0.3) = (prob2 >= 0.5)) AS agree,
       round(100.0::DOUBLE * count(*) FILTER ((prob >= 0.3) = (prob2 >= 0.5)) / count(*), 2) AS agree_pct
FROM scored"""))
def agreement(spark, sf):
    s = scored(spark, sf)
    joined = lk.align_by_row(s.select("row_index", "prob"), s.select("row_index", "prob2"))
    return lk.agreement(joined, "prob", "prob2", 0.3)


@query("label_prediction_align", with_views("scored", """
SELECT row_index, y_true, CAST(prob2 >= 0.5 AS INT) AS pred FROM scored"""))
def label_prediction_align(spark, sf):
    s = scored(spark, sf)
    return lk.align_by_row(s.select("row_index", "y_true"), s.select(
        "row_index", (F.col("prob2") >= 0.5).cast("int").alias("pred")))


@query("threshold_predict", with_views("scored", """
SELECT row_index, CAST(prob >= 0.119203 AS INT) AS pred,
       CASE WHEN prob >= 0.119203 THEN 'ATTACK' ELSE 'BENIGN' END AS pred_label FROM scored"""))
def threshold_prediction(spark, sf):
    return predicted(spark, sf, 0.119203).select("row_index", "pred", "pred_label")


@query("write_report_json", with_views("scored", f"""
WITH {_SWEEP}, c AS (SELECT {_COUNTS.format(t=0.5)} FROM scored),
best AS (SELECT threshold FROM sweep ORDER BY f1 DESC, threshold LIMIT 1)
SELECT (SELECT count(*) FROM scored) AS n_rows, tp, fp, tn, fn, (SELECT threshold FROM best) AS best_threshold,
       (SELECT count(*) FROM sweep) AS n_sweep, round((SELECT max(prob) FROM scored), 6) AS max_prob FROM c"""))
def write_report_json(spark, sf):
    path = scratch_path(spark, "report")
    src.write_report_json(ev.validation_report(scored(spark, sf)), path)
    shape = ("n_rows long, threshold double, raw_out struct<max: double>, metrics struct<tp: long, "
             "fp: long, tn: long, fn: long>, sweep array<struct<threshold: double>>, best_threshold double")
    r = spark.read.schema(shape).json(path)
    return r.select("n_rows", "metrics.*", "best_threshold", b(F.size("sweep")).alias("n_sweep"),
                    F.round("raw_out.max", 6).alias("max_prob"))


_TWO = f"""two AS (SELECT 'first' AS model, y_true, logit AS raw, 1 / (1 + exp(-logit)) AS prob FROM scored
  UNION ALL SELECT 'second', y_true, prob2, prob2 FROM scored),
cuts AS (SELECT unnest([{", ".join(map(str, SWEEP_THRESHOLDS))}]::DOUBLE[]) AS threshold),
counts AS (SELECT model, threshold, {_COUNTS.format(t="threshold")} FROM two, cuts GROUP BY model, threshold),
{_WITH_PR}, sweep AS (SELECT model, threshold, tp, fp, tn, fn, {_METRICS} FROM pr)"""


@query("models_report", with_views("scored", f"""
WITH {_TWO},
best AS (SELECT model, threshold FROM sweep QUALIFY row_number() OVER (PARTITION BY model ORDER BY f1 DESC, threshold) = 1),
r AS (SELECT model, min(raw) < 0 OR max(raw) > 1 AS logits, round(avg(raw), 6) AS mean, round(stddev_pop(raw), 6) AS std
      FROM two GROUP BY model),
j AS (SELECT count(*) AS n_rows, count(*) FILTER ((1 / (1 + exp(-logit)) >= 0.4) = (prob2 >= 0.5)) AS agreement FROM scored)
SELECT s.model, s.threshold, s.tp, s.fp, s.tn, s.fn, s.f1, best.threshold AS best_threshold, logits, mean, std, n_rows, agreement,
       round(100.0 * agreement / n_rows, 2) AS agreement_pct, c.tp AS tp_at, c.fn AS fn_at
FROM sweep s JOIN best USING (model) JOIN r USING (model), j,
     LATERAL (SELECT count(*) FILTER (y_true = 1 AND prob >= t) AS tp, count(*) FILTER (y_true = 1 AND NOT prob >= t) AS fn
              FROM two, (SELECT CASE WHEN s.model = 'first' THEN 0.4 ELSE 0.5 END AS t) WHERE two.model = s.model) c"""))
def models_report(spark, sf):
    """Two models in one document: raw outputs, metrics, sweeps, best thresholds, agreement."""
    path = scratch_path(spark, "report")
    report = ev.models_report(scored(spark, sf), {"first": ("logit", True), "second": ("prob2", False)},
                              threshold=0.4, other_threshold=0.5)
    src.write_report_json(report, path)
    point = "threshold: double, tp: long, fp: long, tn: long, fn: long, f1: double"
    shape = (f"n_rows long, agreement long, agreement_pct double, models array<struct<model: string, logits: boolean, "
             f"raw_out: struct<mean: double, std: double>, best_threshold: double, "
             f"metrics: struct<tp: long, fn: long>, sweep: array<struct<{point}>>>>")
    r = spark.read.schema(shape).json(path).select("n_rows", "agreement", "agreement_pct", F.explode("models").alias("m"))
    return r.select("n_rows", "agreement", "agreement_pct", "m.model", "m.logits", F.round("m.raw_out.mean", 6).alias("mean"),
                    F.round("m.raw_out.std", 6).alias("std"), "m.best_threshold", F.col("m.metrics.tp").alias("tp_at"),
                    F.col("m.metrics.fn").alias("fn_at"), F.explode("m.sweep").alias("s")).select("*", "s.*").drop("s")


# ---- lists and membership --------------------------------------------------------------

_IP = "trim(coalesce(src_ip, 'nan'))"
_VALID = f"({_IP} <> '' AND lower({_IP}) <> 'nan')"


def _list_lines(spark, sf):
    """Text of an address list, derived from the customers: comments, blanks, padding."""
    key = F.col("c_custkey")
    ip = F.concat(F.lit("10.0."), (key % 256).cast("string"), F.lit("."), (key % 7).cast("string"))
    line = F.when(key % 5 == 0, F.concat(F.lit("# "), ip)).when(key % 5 == 1, F.lit("   ")) \
        .otherwise(F.concat(F.lit("  "), ip, F.lit(" ")))
    return table(spark, sf, "customer").select(line.alias("value"))


@query("read_ip_list", f"""
SELECT DISTINCT concat('10.0.', c_custkey % 256, '.', c_custkey % 7) AS ip FROM customer
WHERE c_custkey % 5 >= 2
UNION SELECT unnest([{", ".join(f"'{x}'" for x in ALWAYS_ALLOWED)}])""")
def read_ip_list(spark, sf):
    path = scratch_path(spark, "allow")
    _list_lines(spark, sf).write.text(path)
    return src.read_ip_list(spark, path)


@query("whitelist_anti", with_views("scored allowed", """
SELECT row_index, src_ip FROM scored WHERE src_ip IS NULL OR src_ip NOT IN (SELECT ip FROM allowed)"""))
def whitelist_anti(spark, sf):
    return lk.exclude_members(scored(spark, sf).select("row_index", "src_ip"),
                              view(spark, sf, "allowed"), "src_ip").select("row_index", "src_ip")


@query("blocked_lookup", with_views("scored blocked", """
SELECT row_index, coalesce(src_ip IN (SELECT ip FROM blocked), false) AS is_blocked FROM scored"""))
def blocked_lookup(spark, sf):
    return lk.flag_members(scored(spark, sf).select("row_index", "src_ip"),
                           view(spark, sf, "blocked"), "src_ip", "is_blocked") \
        .select("row_index", "is_blocked")


@query("valid_src_ip", with_views("scored", f"SELECT row_index, {_VALID} AS valid FROM scored"))
def valid_src_ip(spark, sf):
    return scored(spark, sf).select("row_index", sc.valid_ip_text(F.col("src_ip")).alias("valid"))


@query("ip_in_cidr", with_views("scored", """
SELECT row_index, CASE WHEN src_ip LIKE '10.%' THEN
  CAST(split_part(src_ip, '.', 3) AS INT) * 256 + CAST(split_part(src_ip, '.', 4) AS INT) BETWEEN 64 AND 127
  AND split_part(src_ip, '.', 2) = '0' ELSE false END AS inside FROM scored"""))
def ip_in_cidr(spark, sf):
    return scored(spark, sf).select(
        "row_index", sc.ipv4_in_network(F.col("src_ip"), "10.0.0.64/26").alias("inside"))


@query("pick_src_ip", with_views("scored", "SELECT row_index, src_ip FROM scored"))
def pick_src_ip(spark, sf):
    renamed = scored(spark, sf).select("row_index", F.col("src_ip").alias("source ip"))
    return renamed.select("row_index", sm.src_ip_column(renamed).alias("src_ip"))


@query("attack_rows", with_views("scored", "SELECT row_index, prob FROM scored WHERE prob >= 0.5"))
def attack_rows(spark, sf):
    return ac.attack_rows(scored(spark, sf)).select("row_index", "prob")


# ---- runs, batches, first occurrence ----------------------------------------------------

@query("row_index", "SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS row_index FROM events")
def row_index(spark, sf):
    return src.with_row_index(spark, f"{sf}/events.parquet").select("event_id", "row_index")


@query("batch_id", with_views("scored", """
SELECT row_index, (row_index - run_id * 4000) // 1024 AS batch_id FROM scored"""))
def batch_ids(spark, sf):
    return ac.batch_id(scored(spark, sf), 1024, first=F.col("run_id") * 4000) \
        .select("row_index", "batch_id")


@query("first_occurrence", with_views("scored", f"""
SELECT run_id, row_index, src_ip FROM scored WHERE prob >= 0.5
QUALIFY row_number() OVER (PARTITION BY run_id, src_ip ORDER BY row_index) = 1"""))
def first_occurrence(spark, sf):
    return ac.first_occurrence(ac.attack_rows(scored(spark, sf)), ["src_ip"], "row_index", ["run_id"]) \
        .select("run_id", "row_index", "src_ip")


# row counts seen by the polls of eight files: growing, now and then starting over
_POLLS = "SELECT event_id AS poll, user_id % 8 AS file, event_id % 1013 AS n_rows FROM events"


def _polls(spark, sf):
    return table(spark, sf, "events").select(
        F.col("event_id").alias("poll"), (F.col("user_id") % 8).alias("file"),
        (F.col("event_id") % 1013).alias("n_rows"))


@query("run_epoch", f"""
WITH polls AS ({_POLLS}),
steps AS (SELECT *, n_rows < lag(n_rows) OVER (PARTITION BY file ORDER BY poll) AS shrank FROM polls)
SELECT file, poll, n_rows, CAST(sum(CASE WHEN shrank THEN 1 ELSE 0 END) OVER
  (PARTITION BY file ORDER BY poll ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run_id FROM steps""")
def run_epoch(spark, sf):
    return ac.run_epoch(_polls(spark, sf), ["file"], "poll", "n_rows") \
        .select("file", "poll", "n_rows", "run_id")


@query("run_reset", f"""
WITH polls AS ({_POLLS}),
steps AS (SELECT *, n_rows < lag(n_rows) OVER (PARTITION BY file ORDER BY poll) AS shrank FROM polls),
runs AS (SELECT file, poll, n_rows, sum(CASE WHEN shrank THEN 1 ELSE 0 END) OVER
  (PARTITION BY file ORDER BY poll ROWS UNBOUNDED PRECEDING) AS run_id FROM steps)
SELECT file, CAST(run_id AS BIGINT) AS run_id, n_rows % 10 AS ip, min(poll) AS poll FROM runs GROUP BY ALL""")
def run_reset(spark, sf):
    """The seen set starts empty in every run: one first row per (file, run, address)."""
    runs = ac.run_epoch(_polls(spark, sf), ["file"], "poll", "n_rows") \
        .withColumn("ip", F.col("n_rows") % 10)
    return ac.first_occurrence(runs, ["ip"], "poll", ["file", "run_id"]) \
        .select("file", "run_id", "ip", "poll")


# ---- decisions ---------------------------------------------------------------------------

_DECIDE = f"""
a AS (SELECT run_id, row_index, prob, {_IP} AS ip, {_VALID} AS valid FROM scored WHERE prob >= 0.5),
e AS (SELECT *, ip IN (SELECT ip FROM allowed) AS ok, ip IN (SELECT ip FROM blocked) AS held FROM a),
s AS (SELECT *, row_number() OVER (PARTITION BY run_id, ip, valid AND NOT ok ORDER BY row_index) AS rn FROM e),
d AS (SELECT run_id, row_index, prob, ip AS src_ip,
        CASE WHEN NOT valid THEN 'invalid_src_ip' WHEN ok THEN 'whitelisted'
             WHEN rn > 1 THEN 'already_seen_this_run' WHEN held THEN 'already_blocked' END AS reason FROM s),
decisions AS (SELECT run_id, row_index, prob, src_ip,
        CASE WHEN reason IS NULL THEN 'dry-run' ELSE 'skip' END AS action, reason,
        CASE WHEN reason IS NULL THEN concat('sudo iptables -A INPUT -s ', src_ip, ' -j DROP') END AS cmd FROM d)"""


def decisions(spark, sf):
    return ac.decide_actions(scored(spark, sf), view(spark, sf, "allowed"), view(spark, sf, "blocked"))


@query("decide_actions", with_views("scored allowed blocked", f"WITH {_DECIDE} SELECT * FROM decisions"))
def decide_actions(spark, sf):
    return decisions(spark, sf)


@query("append_actions", with_views("scored allowed blocked", f"WITH {_DECIDE} SELECT * FROM decisions"))
def append_actions(spark, sf):
    path = scratch_path(spark, "actions")
    src.append_lines(ac.action_records(decisions(spark, sf), F.lit(TS), run=["run_id"]), path)
    shape = "run_id long, row_index long, prob double, src_ip string, action string, reason string, cmd string"
    return spark.read.schema(shape).json(path)


@query("to_json_record", with_views("scored allowed blocked", f"""
WITH {_DECIDE} SELECT row_index, concat('{{"ts":{TS},"row_index":', row_index, ',"src_ip":"', src_ip,
  '","action":"', action, '"', CASE WHEN reason IS NULL THEN '' ELSE concat(',"reason":"', reason, '"') END,
  CASE WHEN cmd IS NULL THEN '' ELSE concat(',"cmd":"', cmd, '"') END, '}}') AS value FROM decisions"""))
def to_json_record(spark, sf):
    d = decisions(spark, sf)
    return d.select("row_index", sc.json_record(
        ts=F.lit(TS), row_index=F.col("row_index"), src_ip=F.col("src_ip"), action=F.col("action"),
        reason=F.col("reason"), cmd=F.col("cmd")).alias("value"))


@query("append_alerts", with_views("scored", f"""
SELECT {TS} AS ts, prob, row_index FROM scored WHERE prob >= 0.5"""))
def append_alerts(spark, sf):
    path = scratch_path(spark, "alerts")
    src.append_lines(ac.alert_records(scored(spark, sf), F.lit(TS)), path)
    return spark.read.schema("ts long, prob double, row_index long").json(path)


@query("block_command", with_views("scored", f"""
SELECT row_index, concat('sudo iptables -A INPUT -s ', src_ip, ' -j DROP') AS cmd FROM scored
WHERE {_VALID}"""))
def block_command(spark, sf):
    return scored(spark, sf).filter(sc.valid_ip_text(F.col("src_ip"))) \
        .select("row_index", sc.block_command(F.col("src_ip")).alias("cmd"))


@query("epoch_seconds", "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts FROM events")
def epoch_seconds(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", sc.epoch_seconds(F.col("ts").cast("timestamp")).alias("ts"))


@query("text_functions", with_views("scored", """
SELECT row_index, lower(trim(concat('  ', label, ' '))) AS low, upper(label) AS up,
       regexp_replace(label, '[^A-Za-z]+', '_', 'g') AS safe FROM scored"""))
def text_functions(spark, sf):
    label = F.col("label")
    return scored(spark, sf).select(
        "row_index", F.lower(F.trim(F.concat(F.lit("  "), label, F.lit(" ")))).alias("low"),
        F.upper(label).alias("up"), F.regexp_replace(label, "[^A-Za-z]+", "_").alias("safe"))


@query("write_predictions", with_views("scored", """
SELECT row_index, prob, CASE WHEN prob >= 0.5 THEN 'ATTACK' ELSE 'BENIGN' END AS pred_label FROM scored"""))
def write_predictions(spark, sf):
    path = scratch_path(spark, "predictions")
    src.write_predictions(predicted(spark, sf), path)
    shape = predicted(spark, sf).schema
    return spark.read.schema(shape).option("header", True).csv(path) \
        .select("row_index", "prob", "pred_label")
