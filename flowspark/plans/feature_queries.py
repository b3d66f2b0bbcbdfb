"""Schema, cleaning, imputation, scaling and scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowspark.contract import JAVA_METER_RENAMES, PY_METER_COLUMNS
from flowspark.functions import scalar as sc
from flowspark.functions.scalar import c
from flowspark.operators import clean as cl
from flowspark.operators import schema as sm
from flowspark.operators import scoring
from flowspark.operators.lookups import with_single_row
from flowspark.operators.sampling import head_rows, sample_rows
from flowspark.plans.fixtures import DIRTY, table, view, with_views
from flowspark.plans.registry import b, query, rounded
from flowspark.sources.tables import read_params, write_params
from flowspark.session import materialize, scratch_path

_Q = [f'"{x}"' for x in DIRTY]
_LIST = ", ".join(_Q)


def _finite(x: str) -> str:
    return f"CASE WHEN isnan({x}) OR isinf({x}) THEN NULL ELSE {x} END"


def _clean(x: str) -> str:
    return f"greatest(-1e12, least(1e12, {_finite(x)}))" if x else x


def _clipped(x: str) -> str:
    return f"CASE WHEN {_finite(x)} IS NOT NULL THEN greatest(-1e12, least(1e12, {x})) END"


_CLEAN = "clean AS (SELECT row_id, batch_id, " + ", ".join(
    f"{_clipped(x)} AS {x}" for x in _Q) + " FROM flows_raw)"
_MED = "med AS (SELECT " + ", ".join(f"median({x}) AS m{i}" for i, x in enumerate(_Q)) + " FROM clean)"
_FILLED = "filled AS (SELECT row_id, batch_id, " + ", ".join(
    f"coalesce({x}, m{i}, 0) AS {x}" for i, x in enumerate(_Q)) + " FROM clean, med)"
# parameters are fitted on the filled rows, as training does
_PARAMS = "params AS (SELECT " + ", ".join(
    f"avg({x}) AS a{i}, CASE WHEN stddev_pop({x}) = 0 THEN 1 ELSE stddev_pop({x}) END AS s{i}"
    for i, x in enumerate(_Q)) + " FROM filled)"


def raw(spark, sf):
    return view(spark, sf, "flows_raw")


def cleaned(spark, sf):
    return cl.clean_columns(raw(spark, sf), DIRTY)


def filled(spark, sf):
    return cl.impute_median(cleaned(spark, sf), DIRTY)


# ---- names and alignment ---------------------------------------------------------------

@query("normalize_columns", with_views("flows_raw", f"SELECT row_id, {_LIST} FROM flows_raw"))
def normalize_columns(spark, sf):
    dirty = raw(spark, sf).select("row_id", *[c(x).alias(f"﻿ {x.title()}  ") for x in DIRTY])
    return sm.normalize_columns(dirty)


@query("normalize_columns_ws", with_views("flows_raw", f"SELECT row_id, {_LIST} FROM flows_raw"))
def normalize_columns_ws(spark, sf):
    dirty = raw(spark, sf).select("row_id", *[
        c(x).alias("  " + x.upper().replace(" ", " \t  ")) for x in DIRTY])
    return sm.normalize_columns_ws(dirty)


@query("map_flowmeter_java", with_views("java_meter", "SELECT row_id, l_linenumber, " + ", ".join(
    f'"{a}" AS "{t}"' for a, t in JAVA_METER_RENAMES.items()) + " FROM java_meter"))
def map_flowmeter_java(spark, sf):
    return sm.map_java_meter(view(spark, sf, "java_meter"))


_PY_SQL = ", ".join(
    f'{"0.0::DOUBLE" if a in ("idle_min", "fwd_urg_flags") else a} AS "{t}"'
    for a, t in PY_METER_COLUMNS.items())


@query("map_flowmeter_py", with_views("py_meter", f"""
SELECT CAST(src_ip AS VARCHAR) AS "source ip", CAST(dst_ip AS VARCHAR) AS "destination ip",
       {_PY_SQL} FROM py_meter"""))
def map_flowmeter_py(spark, sf):
    out = sm.map_python_meter(view(spark, sf, "py_meter"))
    return out.select(c("source ip").cast("string").alias("source ip"),
                      c("destination ip").cast("string").alias("destination ip"),
                      *[c(x).cast("double").alias(x) for x in PY_METER_COLUMNS.values()])


@query("dup_feature", with_views("flows_raw", """
SELECT row_id, "fwd header length", "fwd header length" AS "fwd header length.1" FROM flows_raw"""))
def dup_feature(spark, sf):
    return sm.duplicate_feature(raw(spark, sf).select("row_id", c("fwd header length")))


@query("fill_missing_columns", with_views("flows_raw", """
SELECT row_id, "flow duration", 0 AS "idle max", 0 AS protocol FROM flows_raw"""))
def fill_missing_columns(spark, sf):
    return sm.fill_missing_columns(raw(spark, sf).select("row_id", c("flow duration")),
                                   ["flow duration", "idle max", "protocol"])


@query("align_to_contract", with_views("java_meter", """
SELECT "src ip" AS "source ip", "src port" AS "source port", "dst port" AS "destination port",
       "dst ip" AS "destination ip", "fwd init win bytes" AS "init_win_bytes_forward",
       "total fwd packet" AS "total fwd packets", 0 AS "idle min" FROM java_meter"""))
def align_to_contract(spark, sf):
    wanted = ["init_win_bytes_forward", "source port", "total fwd packets", "idle min"]
    mapped = sm.map_java_meter(view(spark, sf, "java_meter"))
    return sm.align_to_contract(sm.fill_missing_columns(mapped, wanted), wanted)


@query("scale_time_units", with_views("flows_raw", """
SELECT row_id, "flow duration" * 1000000 AS "flow duration", "flow bytes/s" FROM flows_raw"""))
def scale_time_units(spark, sf):
    return sm.scale_time_units(raw(spark, sf).select("row_id", c("flow duration"), c("flow bytes/s")))


@query("select_numeric", with_views("flows_raw", f"SELECT row_id, batch_id, {_LIST} FROM flows_raw"))
def select_numeric(spark, sf):
    return sm.select_numeric(raw(spark, sf))


@query("castable_columns", """
SELECT 'value_text' AS name, true AS "numeric" UNION ALL
SELECT 'props', count(*) FILTER (try_cast(props AS DOUBLE) IS NULL) = 0 FROM events""")
def castable_columns(spark, sf):
    from flowspark.plans.fixtures import table
    ev = table(spark, sf, "events").select(F.col("value").cast("string").alias("value_text"), "props")
    return sm.castable_columns(ev)


@query("assert_contract", with_views("flows_raw", f"SELECT {_LIST} FROM flows_raw"))
def assert_contract(spark, sf):
    return sm.assert_contract(raw(spark, sf).select(*[c(x) for x in DIRTY]), DIRTY, len(DIRTY))


@query("default_label", with_views("flows_raw", "SELECT row_id, 'BENIGN' AS label FROM flows_raw"))
def default_label(spark, sf):
    return sm.default_label(raw(spark, sf).select("row_id"))


@query("to_float32", with_views("flows_raw", """
SELECT row_id, round(CAST(CASE WHEN NOT isnan("total fwd packets") AND NOT isinf("total fwd packets")
       THEN "total fwd packets" END AS FLOAT)::DOUBLE, 3) AS x FROM flows_raw"""))
def to_float32(spark, sf):
    one = cl.nonfinite_to_null(raw(spark, sf), ["total fwd packets"]) \
        .select("row_id", c("total fwd packets").alias("x"))
    return sm.to_float32(one, ["x"]).select("row_id", F.round(F.col("x").cast("double"), 3).alias("x"))


_WANT = ["flow duration", "flow bytes/s", "total fwd packets", "idle max", "protocol"]


@query("contract_diff", with_views("flows_raw", f"""
SELECT n_rows, n_duration, 2 AS n_missing, 3 AS n_extra, 'idle max, protocol' AS missing,
       'row_id, batch_id, fwd header length' AS extra, false AS same_order
FROM (SELECT count(*) AS n_rows, count("flow duration") AS n_duration FROM flows_raw)"""))
def contract_diff(spark, sf):
    """Difference to the contract next to the number of rows and values it concerns."""
    rows = raw(spark, sf)
    sizes = rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count(c("flow duration")).alias("n_duration"))
    return with_single_row(sizes, sm.contract_diff_table(rows, _WANT))


@query("column_except", """
WITH want AS (SELECT unnest(['click', 'view', 'purchase', 'error', 'signup', 'refund']) AS t),
users AS (SELECT DISTINCT user_id FROM events),
gone AS (SELECT user_id, t FROM users, want EXCEPT SELECT user_id, event_type FROM events)
SELECT user_id, count(*) AS n_missing, string_agg(t, ',' ORDER BY t) AS missing FROM gone GROUP BY user_id""")
def column_except(spark, sf):
    """Wanted names a user's events do not have; the set per user holds type names only."""
    want = F.array(*[F.lit(x) for x in ("click", "view", "purchase", "error", "signup", "refund")])
    from flowspark.plans.fixtures import table
    missing = F.array_sort(F.array_except(want, F.col("have")))
    return table(spark, sf, "events").groupBy("user_id") \
        .agg(F.collect_set("event_type").alias("have")) \
        .select("user_id", b(F.size(missing)).alias("n_missing"),
                F.array_join(missing, ",").alias("missing"))


@query("convert_java_meter", with_views("java_meter", """
SELECT "src ip" AS "source ip", "total fwd packet" AS "total fwd packets", 0 AS "flow duration",
       "cwr flag count" AS "cwe flag count" FROM java_meter"""))
def convert_java_meter(spark, sf):
    return sm.convert_java_meter(view(spark, sf, "java_meter")).select(
        c("source ip"), c("total fwd packets"), c("flow duration"), c("cwe flag count"))


@query("convert_python_meter", with_views("py_meter", """
SELECT CAST(src_ip AS VARCHAR) AS "source ip", flow_duration * 1000000 AS "flow duration",
       flow_byts_s AS "flow bytes/s", 0.0::DOUBLE AS "idle min", fwd_header_len AS "fwd header length.1",
       'BENIGN' AS label FROM py_meter"""))
def convert_python_meter(spark, sf):
    return sm.convert_python_meter(view(spark, sf, "py_meter")).select(
        c("source ip").cast("string").alias("source ip"), c("flow duration"), c("flow bytes/s"),
        c("idle min"), c("fwd header length.1"), c("label"))


# ---- cleaning --------------------------------------------------------------------------

@query("nonfinite_to_null", with_views("flows_raw", "SELECT row_id, " + ", ".join(
    f"{_finite(x)} AS {x}" for x in _Q) + " FROM flows_raw"))
def nonfinite_to_null(spark, sf):
    return cl.nonfinite_to_null(raw(spark, sf), DIRTY).select("row_id", *[c(x) for x in DIRTY])


@query("clip", with_views("flows_raw", "SELECT row_id, " + ", ".join(
    f"CASE WHEN {x} IS NULL OR isnan({x}) THEN NULL ELSE greatest(-1e12, least(1e12, {x})) END AS {x}"
    for x in _Q) + " FROM flows_raw"))
def clip(spark, sf):
    some = raw(spark, sf).withColumns({x: F.when(~F.isnan(c(x)), c(x)) for x in DIRTY})
    return cl.clip_columns(some, DIRTY).select("row_id", *[c(x) for x in DIRTY])


@query("impute_median", with_views(
    "flows_raw", f"WITH {_CLEAN}, {_MED}, {_FILLED} SELECT row_id, {_LIST} FROM filled"))
def impute_median(spark, sf):
    return filled(spark, sf).select("row_id", *[c(x) for x in DIRTY])


@query("impute_median_batch", with_views("flows_raw", f"WITH {_CLEAN} SELECT row_id, " + ", ".join(
    f"coalesce({x}, median({x}) OVER (PARTITION BY batch_id), 0) AS {x}" for x in _Q)
    + " FROM clean"))
def impute_median_batch(spark, sf):
    return cl.impute_median(cleaned(spark, sf), DIRTY, "per_batch", ["batch_id"]) \
        .select("row_id", *[c(x) for x in DIRTY])


@query("impute_median_fixed", with_views(
    "flows_raw", f"WITH {_CLEAN}, {_MED}, {_FILLED} SELECT row_id, {_LIST} FROM filled"))
def impute_median_fixed(spark, sf):
    table = cl.column_medians(raw(spark, sf), DIRTY)
    return cl.impute_median(cleaned(spark, sf), DIRTY, "fixed", fixed=table) \
        .select("row_id", *[c(x) for x in DIRTY])


@query("impute_median_train", with_views("flows_raw", f"""
WITH fin AS (SELECT row_id, {", ".join(f"{_finite(x)} AS {x}" for x in _Q)} FROM flows_raw),
med AS (SELECT {", ".join(f"median({x}) AS m{i}" for i, x in enumerate(_Q))} FROM fin)
SELECT row_id, {", ".join(f"coalesce({x}, m{i}, 0) AS {x}" for i, x in enumerate(_Q))}
FROM fin, med"""))
def impute_median_train(spark, sf):
    return cl.impute_median(cl.clean_columns(raw(spark, sf), DIRTY, limit=None), DIRTY) \
        .select("row_id", *[c(x) for x in DIRTY])


@query("nonfinite_to_zero", with_views("flows_raw", "SELECT row_id, " + ", ".join(
    f"coalesce({_finite(x)}, 0) AS {x}" for x in _Q) + " FROM flows_raw"))
def nonfinite_to_zero(spark, sf):
    return cl.nonfinite_to_zero(raw(spark, sf), DIRTY).select("row_id", *[c(x) for x in DIRTY])


@query("invalid_value_profile", with_views("flows_raw", " UNION ALL ".join(
    f"""SELECT '{x}' AS name, count(*) FILTER ("{x}" IS NULL OR isnan("{x}")) AS n_nan,
count(*) FILTER ("{x}" = 'infinity'::DOUBLE) AS n_pos_inf,
count(*) FILTER ("{x}" = '-infinity'::DOUBLE) AS n_neg_inf,
count(*) FILTER ("{x}" IS NULL OR isnan("{x}") OR isinf("{x}")) > 0 AS bad FROM flows_raw"""
    for x in DIRTY)))
def invalid_value_profile(spark, sf):
    return cl.invalid_value_profile(raw(spark, sf), DIRTY)


@query("all_finite", with_views("flows_raw", f"""
WITH {_CLEAN}, {_MED}, {_FILLED}
SELECT bool_and({" AND ".join(f"isfinite({x})" for x in _Q)}) AS all_finite, count(*) AS n_rows
FROM filled"""))
def all_finite(spark, sf):
    return cl.all_finite(filled(spark, sf), DIRTY)


@query("coerce_time", """
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL
       ELSE strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') END AS t FROM events""")
def coerce_time(spark, sf):
    from flowspark.plans.fixtures import table
    text = F.when(F.col("event_id") % 5 == 0, F.lit("n/a")) \
        .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    df = table(spark, sf, "events").select("event_id", text.alias("t"))
    return cl.coerce_time(df, "t").withColumn("t", F.date_format("t", "yyyy-MM-dd HH:mm:ss"))


# ---- parameters, scaling ---------------------------------------------------------------

@query("column_medians", with_views("flows_raw", f"WITH {_CLEAN} SELECT " + ", ".join(
    f"median({x}) AS {x}" for x in _Q) + " FROM clean"))
def column_medians(spark, sf):
    return cl.column_medians(raw(spark, sf), DIRTY)


_FIT_SQL = f"WITH {_CLEAN}, {_MED}, {_FILLED}, {_PARAMS} " + " UNION ALL ".join(
    f"""SELECT {i} AS idx, '{x}' AS feature, round(a{i} / 1e6, 3) AS mean,
round(s{i} / 1e6, 3) AS scale FROM params""" for i, x in enumerate(DIRTY))


def _rounded_params(params):
    return params.select("idx", "feature", F.round(F.col("mean") / 1e6, 3).alias("mean"),
                         F.round(F.col("scale") / 1e6, 3).alias("scale"))


@query("fit_scaler", with_views("flows_raw", _FIT_SQL))
def fit_scaler(spark, sf):
    return _rounded_params(cl.fit_scaler(filled(spark, sf), DIRTY))


@query("read_params", with_views("flows_raw", _FIT_SQL))
def params_round_trip(spark, sf):
    path = scratch_path(spark, "params")
    write_params(cl.fit_scaler(filled(spark, sf), DIRTY), path)
    return _rounded_params(read_params(spark, path))


_SCALED = ", ".join(f"round(({x} - a{i}) / s{i}, 6) AS {x}" for i, x in enumerate(_Q))


@query("apply_params", with_views("flows_raw", f"""
WITH {_CLEAN}, {_MED}, {_FILLED}, {_PARAMS} SELECT row_id, {_SCALED} FROM filled, params"""))
def apply_params(spark, sf):
    """Stored parameters, in an order other than the features', applied by name."""
    rows = filled(spark, sf).select("row_id", *[c(x) for x in DIRTY])
    path = scratch_path(spark, "params")
    write_params(cl.fit_scaler(rows, DIRTY).orderBy(F.desc("idx")), path)
    return rounded(cl.apply_scaler(rows, DIRTY, read_params(spark, path)), 6, *DIRTY)


@query("standard_scale", with_views("flows_raw", f"""
WITH {_CLEAN}, {_MED}, {_FILLED}, {_PARAMS} SELECT row_id, {_SCALED} FROM filled, params"""))
def standard_scale(spark, sf):
    rows = filled(spark, sf).select("row_id", *[c(x) for x in DIRTY])
    return rounded(cl.apply_scaler(rows, DIRTY, cl.fit_scaler(rows, DIRTY)), 6, *DIRTY)


@query("prepare_features", with_views("flows_raw", f"""
WITH {_CLEAN}, {_MED}, {_FILLED}, {_PARAMS} SELECT row_id, {_SCALED} FROM filled, params"""))
def prepare_features(spark, sf):
    params = cl.fit_scaler(filled(spark, sf), DIRTY)
    ready = scoring.prepare_features(raw(spark, sf), params, DIRTY)
    return ready.select("row_id", *[F.round(F.get("x", F.lit(i)), 6).alias(x)
                                    for i, x in enumerate(DIRTY)])


_CALIB_N = 500
_SAMPLE_SQL = f"""
rows AS (SELECT event_id, value, event_id * 0.5::DOUBLE AS half FROM events
         ORDER BY md5(concat_ws(':', '42', event_id)), event_id LIMIT {_CALIB_N})"""


def _calibration(spark, sf):
    from flowspark.plans.fixtures import table
    ev = table(spark, sf, "events").select("event_id", "value", (F.col("event_id") * 0.5).alias("half"))
    return sample_rows(ev, "event_id", _CALIB_N, 42)


@query("calibration_sample", f"WITH {_SAMPLE_SQL} SELECT * FROM rows")
def calibration_sample(spark, sf):
    return _calibration(spark, sf).withColumn("half", F.col("half").cast("double"))


@query("calibration_stats", f"""
WITH {_SAMPLE_SQL}, v AS (SELECT value AS v FROM rows UNION ALL SELECT half FROM rows)
SELECT count(*) // 2 AS n_rows, 2 AS n_features, min(v) AS "min", max(v) AS "max",
       round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std FROM v""")
def calibration_stats(spark, sf):
    return rounded(cl.calibration_stats(_calibration(spark, sf), ["value", "half"]), 4, "mean", "std")


@query("head_rows", "SELECT event_id, value FROM events ORDER BY value, event_id LIMIT 20")
def head(spark, sf):
    from flowspark.plans.fixtures import table
    return head_rows(table(spark, sf, "events").select("event_id", "value"), ["value", "event_id"], 20)


# ---- networks --------------------------------------------------------------------------

N_IN, N_HIDDEN = 64, 8


def _weight(i: int, j: int) -> float:
    return ((7 * i + 13 * j) % 11 - 5) / 10


def layer(n_in: int, n_out: int) -> scoring.Layer:
    return scoring.Layer([[_weight(i, j) for i in range(n_in)] for j in range(n_out)],
                         [0.1 * (j % 3) for j in range(n_out)])


BINARY_NET = [layer(N_IN, N_HIDDEN), layer(N_HIDDEN, 1)]
CLASS_NET = [layer(N_IN, N_HIDDEN), layer(N_HIDDEN, 10)]
CLASS_NAMES = ["BENIGN", "Bot", "DDoS", "DoS Hulk", "WebAttack"]


def _unit_sql(x: str, l: scoring.Layer, j: int) -> str:
    w = "[" + ", ".join(f"{v}::DOUBLE" for v in l.weights[j]) + "]"
    return f"list_dot_product({x}, {w}) + {l.bias[j]}"


def _net_sql(net: list[scoring.Layer]) -> str:
    hidden = ", ".join(f"greatest(0.0::DOUBLE, {_unit_sql('e', net[0], j)})"
                       for j in range(len(net[0].bias)))
    outs = ", ".join(_unit_sql("h", net[1], j) for j in range(len(net[1].bias)))
    return f"""
hid AS (SELECT vec_id, label, [{hidden}] AS h FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM vectors)),
net AS (SELECT vec_id, label, [{outs}] AS z FROM hid)"""


@query("sigmoid", with_views("scored", """
SELECT row_index, round(1 / (1 + exp(-greatest(-40.0::DOUBLE, least(40.0::DOUBLE, logit * 20)))), 8) AS p
FROM scored"""))
def sigmoid(spark, sf):
    return view(spark, sf, "scored").select(
        "row_index", F.round(sc.sigmoid(F.col("logit") * 20), 8).alias("p"))


@query("dense_layer", with_views("vectors", f"""
WITH {_net_sql(BINARY_NET)} SELECT vec_id, {", ".join(f"round(h[{j + 1}], 6) AS h{j}" for j in range(N_HIDDEN))}
FROM hid"""))
def dense_layer(spark, sf):
    hidden = sc.dense(F.col("embedding"), BINARY_NET[0].weights, BINARY_NET[0].bias, sc.relu)
    return view(spark, sf, "vectors").select("vec_id", hidden.alias("h")).select(
        "vec_id", *[F.round(F.get("h", F.lit(j)), 6).alias(f"h{j}") for j in range(N_HIDDEN)])


_BINARY_SQL = f"""
WITH {_net_sql(BINARY_NET)},
p AS (SELECT vec_id, 1 / (1 + exp(-greatest(-40.0::DOUBLE, least(40.0::DOUBLE, z[1])))) AS p FROM net)
SELECT vec_id, round(p, 6) AS pred_attack_proba, CAST(p >= 0.5 AS INT) AS pred,
       CASE WHEN p >= 0.5 THEN 'ATTACK' ELSE 'BENIGN' END AS pred_label FROM p"""


@query("score_binary", with_views("vectors", _BINARY_SQL))
def score_binary(spark, sf):
    scored = scoring.score_binary(view(spark, sf, "vectors"), "embedding", BINARY_NET)
    return rounded(scored, 6, "pred_attack_proba") \
        .select("vec_id", "pred_attack_proba", "pred", "pred_label")


@query("score_binary_arrow", with_views("vectors", _BINARY_SQL))
def score_binary_arrow(spark, sf):
    raw_scores = scoring.forward_arrow(view(spark, sf, "vectors"), "embedding", BINARY_NET, "z")
    prob = raw_scores.withColumn("pred_attack_proba", sc.sigmoid(F.get("z", F.lit(0))))
    return rounded(scoring.threshold_predict(prob), 6, "pred_attack_proba") \
        .select("vec_id", "pred_attack_proba", "pred", "pred_label")


# a table of many rows: throughput of scoring without fixed costs
_ROW_NET = [layer(4, 8), layer(8, 1)]
_ROW_INPUT = ["CAST(l_quantity AS DOUBLE) / 50", "CAST(l_extendedprice AS DOUBLE) / 100000",
              "CAST(l_discount AS DOUBLE) * 10", "CAST(l_tax AS DOUBLE) * 10"]


@query("score_rows", f"""
WITH x AS (SELECT l_orderkey, l_linenumber, [{", ".join(_ROW_INPUT)}] AS e FROM lineitem),
h AS (SELECT l_orderkey, l_linenumber, [{", ".join(f"greatest(0.0::DOUBLE, {_unit_sql('e', _ROW_NET[0], j)})" for j in range(8))}] AS h FROM x),
p AS (SELECT l_orderkey, l_linenumber, 1 / (1 + exp(-({_unit_sql('h', _ROW_NET[1], 0)}))) AS p FROM h)
SELECT l_orderkey, l_linenumber, round(p, 6) AS pred_attack_proba, CAST(round(p, 6) >= 0.5 AS INT) AS pred FROM p""")
def score_rows(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", f"array({', '.join(_ROW_INPUT)}) AS x")
    scored = rounded(scoring.score_binary(rows, "x", _ROW_NET), 6, "pred_attack_proba")
    return scoring.threshold_predict(scored).select("l_orderkey", "l_linenumber", "pred_attack_proba", "pred")


_NAMES_SQL = "[" + ", ".join(f"'{x}'" for x in CLASS_NAMES) + "]"
_CLASS_SQL = f"""
WITH {_net_sql(CLASS_NET)},
best AS (SELECT vec_id, list_position(z, list_max(z)) - 1 AS i FROM net)
SELECT vec_id, CAST(i AS INT) AS pred_class_idx,
       coalesce({_NAMES_SQL}[i + 1], concat('class_', i)) AS pred_class FROM best"""


@query("score_multiclass", with_views("vectors", _CLASS_SQL))
def score_multiclass(spark, sf):
    scored = scoring.score_multiclass(view(spark, sf, "vectors"), "embedding", CLASS_NET, CLASS_NAMES)
    return scored.select("vec_id", "pred_class_idx", "pred_class")


@query("argmax_class", "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INT)"
       " AS i FROM embeddings")
def argmax_class(spark, sf):
    return view(spark, sf, "vectors").select("vec_id", sc.argmax(F.col("embedding")).alias("i"))


@query("class_name_lookup", f"""
SELECT vec_id, label AS i, coalesce({_NAMES_SQL}[label + 1], concat('class_', label)) AS name
FROM embeddings""")
def class_name_lookup(spark, sf):
    from flowspark.operators.lookups import class_names
    return class_names(view(spark, sf, "vectors").select("vec_id", F.col("label").alias("i")),
                       CLASS_NAMES, "i", "name", 10)


@query("offline_inference", with_views("flows_raw", f"""
WITH {_CLEAN}, {_MED}, {_FILLED}, {_PARAMS},
x AS (SELECT row_id, [{", ".join(f"({x} - a{i}) / s{i}" for i, x in enumerate(_Q))}] AS e FROM filled, params),
h AS (SELECT row_id, [{", ".join(f"greatest(0.0::DOUBLE, {_unit_sql('e', layer(4, 8), j)})" for j in range(8))}] AS h FROM x),
p AS (SELECT row_id, 1 / (1 + exp(-({_unit_sql('h', layer(8, 1), 0)}))) AS p FROM h)
SELECT row_id, round(p, 5) AS pred_attack_proba,
       CASE WHEN p >= 0.5 THEN 'ATTACK' ELSE 'BENIGN' END AS pred_label FROM p"""))
def offline_inference(spark, sf):
    """Fitted medians and parameters are stored once, then one pass scores the rows."""
    rows = raw(spark, sf)
    center = materialize(cl.column_medians(rows, DIRTY), "medians")
    full = cl.impute_median(cl.clean_columns(rows, DIRTY), DIRTY, "fixed", fixed=center)
    params = materialize(cl.fit_scaler(full, DIRTY), "scaler")
    ready = scoring.prepare_features(rows, params, DIRTY, mode="fixed", fixed=center)
    scored = scoring.score_binary(ready, "x", [layer(4, 8), layer(8, 1)])
    return rounded(scored, 5, "pred_attack_proba").select("row_id", "pred_attack_proba", "pred_label")
