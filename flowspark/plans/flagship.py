"""End to end: packets -> flows -> scores -> sources of predicted attacks, over all 80 features."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowspark.contract import FEATURES
from flowspark.functions.scalar import c
from flowspark.operators import scoring
from flowspark.operators.flows import flow_table, top_sources
from flowspark.operators.offline import score_csv
from flowspark.plans.feature_queries import _unit_sql, layer
from flowspark.plans.fixtures import view, with_views
from flowspark.plans.packet_queries import _FID, _KEYED, _SQL, _flow_ctes
from flowspark.plans.registry import query
from flowspark.session import scratch_path
from flowspark.sources.tables import PARAMS_SCHEMA, read_params, write_flows, write_params


def unit(feature: str) -> float:
    """What a feature is measured in for the demonstration network: times, rates, ports, all others."""
    if any(t in feature for t in ("iat", "duration", "active ", "idle ")):
        return 1e8
    return 1e5 if "/s" in feature or "port" in feature or "variance" in feature else 1e3


NET = [layer(len(FEATURES), 8), layer(8, 1)]
THRESHOLD = 0.695

_INPUT = "[" + ", ".join(f"coalesce({_SQL[x]}, 0) / {unit(x)!r}::DOUBLE" for x in FEATURES) + "]::DOUBLE[]"


def scored_flows(packets):
    scaled = flow_table(packets).selectExpr(
        "*", "array(" + ", ".join(f"`{x}` / {unit(x)!r}D" for x in FEATURES) + ") AS x")
    return scoring.score_binary(scaled, "x", NET, THRESHOLD).drop("x")


_SCORED = f"""{_KEYED}, {_flow_ctes()},
x AS (SELECT {_FID} AS id, f_ip, {_INPUT} AS e FROM flows),
h AS (SELECT id, f_ip, [{", ".join(f"greatest(0.0::DOUBLE, {_unit_sql('e', NET[0], j)})" for j in range(8))}] AS h FROM x),
p AS (SELECT id, f_ip, 1 / (1 + exp(-({_unit_sql('h', NET[1], 0)}))) AS p FROM h)"""


@query("flagship", with_views("packets", f"""
WITH {_SCORED}
SELECT f_ip AS "source ip", count(*) AS n_flows FROM p WHERE p >= {THRESHOLD} GROUP BY f_ip
ORDER BY n_flows DESC, f_ip LIMIT 10"""))
def flagship(spark, sf):
    return top_sources(scored_flows(view(spark, sf, "packets")).filter("pred = 1"), 10)


@query("offline_inference_csv", with_views("packets", f"""
WITH {_SCORED} SELECT id AS "flow id", f_ip AS "source ip", round(p, 5) AS pred_attack_proba,
CASE WHEN p >= {THRESHOLD} THEN 'ATTACK' ELSE 'BENIGN' END AS pred_label FROM p"""))
def offline_inference_csv(spark, sf):
    """A flow file with all features, scored to another file with stored parameters and medians."""
    source, target, stored = (scratch_path(spark, x) for x in ("flows", "predictions", "params"))
    write_flows(flow_table(view(spark, sf, "packets")), source)
    params = [(i, x, 7.0, unit(x), False, True, len(FEATURES)) for i, x in enumerate(FEATURES)]
    write_params(spark.createDataFrame(params, PARAMS_SCHEMA), stored)
    medians = spark.range(1).select(*[F.lit(0.0).alias(x) for x in FEATURES])
    score_csv(spark, source, target, read_params(spark, stored), medians, NET, threshold=THRESHOLD)
    found = spark.read.option("header", True).csv(target)
    return found.select(c("flow id"), c("source ip"), F.round(c("pred_attack_proba").cast("double"), 5)
                        .alias("pred_attack_proba"), "pred_label")
