"""Feature preparation and neural-network scoring."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.contract import DEFAULT_THRESHOLD, FEATURES
from flowspark.functions.scalar import argmax, c, quoted, sigmoid, sql_clean
from flowspark.operators.clean import impute_median, median_array, params_row, sql_scaled
from flowspark.operators.lookups import class_names, lookup, with_single_row
from flowspark.operators.schema import assert_contract, numeric_columns

# Networks up to this many multiplications run as SQL expressions, wider ones in Arrow
# batches: much longer generated methods are no longer compiled by the JVM.
NATIVE_LIMIT = 200


@dataclass(frozen=True)
class Layer:
    """``weights[j][i]`` connects input i to unit j."""

    weights: Sequence[Sequence[float]]
    bias: Sequence[float]

    @property
    def size(self) -> int:
        return len(self.bias) * len(self.weights[0])


def prepare_features(df: DataFrame, params: DataFrame, features: Sequence[str] = FEATURES,
                     mode: str = "global", batch: Sequence[str] = (),
                     fixed: DataFrame | None = None, out: str = "x") -> DataFrame:
    """Check the contract, clean, impute and scale; adds the matrix row as array ``out``.

    Parameters belong to features by name; a feature without parameters, or parameters without a
    feature, fail. No feature list means all numeric columns.
    """
    if not features:
        features = numeric_columns(df)
    assert_contract(df, features)
    kept = [quoted(x) for x in df.columns]
    if mode == "fixed":
        # streams and large tables: everything in one projection, one broadcast row each
        filled = with_single_row(df, median_array(fixed, features))
        values = [f"coalesce({sql_clean(x)}, get(__medians, {i}), 0D)"
                  for i, x in enumerate(features)]
    else:
        names = [f"__x{i}" for i in range(len(features))]
        work = df.selectExpr(*kept, *[f"{sql_clean(x)} AS {n}" for x, n in zip(features, names)])
        filled, values = impute_median(work, names, mode, batch), names
    scaled = ", ".join(sql_scaled(v, i) for i, v in enumerate(values))
    return with_single_row(filled, params_row(params, features)) \
        .selectExpr(*kept, f"array({scaled}) AS {quoted(out)}")


def usable_vector(x: str, width: int) -> str:
    """SQL text: a complete vector. NULL vectors and vectors with a NULL or NaN are not scored; a wrong length fails."""
    v = quoted(x)
    return (f"CASE WHEN size({v}) <> {width} THEN CAST(raise_error(concat('a vector of ', size({v}), "
            f"' values, the network takes {width}')) AS BOOLEAN) "
            f"ELSE {v} IS NOT NULL AND NOT exists({v}, e -> e IS NULL OR isnan(CAST(e AS DOUBLE))) END")


def forward_native(df: DataFrame, x: str, layers: Sequence[Layer], out: str) -> DataFrame:
    """Forward pass as unrolled arithmetic, compiled with the rest of the stage.

    Each layer is its own projection, so a layer is computed once however many units read it.
    """
    source = x
    for k, layer in enumerate(layers):
        last = k == len(layers) - 1
        units = []
        for weights, bias in zip(layer.weights, layer.bias):
            terms = [f"{float(bias)!r}D"] + [
                f"{float(w)!r}D * CAST(get({quoted(source)}, {i}) AS DOUBLE)"
                for i, w in enumerate(weights) if w]
            z = " + ".join(terms)
            units.append(z if last else f"greatest(0D, {z})")
        target = out if last else f"__layer_{k}"
        made = f"array({', '.join(units)})"
        if k == 0:
            made = f"CASE WHEN {usable_vector(source, len(layer.weights[0]))} THEN {made} END"
        else:
            made = f"CASE WHEN {quoted(source)} IS NOT NULL THEN {made} END"
        df = df.withColumn(target, F.expr(made))
        source = target
    return df.drop(*[f"__layer_{k}" for k in range(len(layers) - 1)])


def forward_arrow(df: DataFrame, x: str, layers: Sequence[Layer], out: str) -> DataFrame:
    """Forward pass over Arrow batches with the weights broadcast once."""
    import numpy as np
    import pyarrow as pa

    shared = df.sparkSession.sparkContext.broadcast(
        [(np.asarray(l.weights, dtype=float).T, np.asarray(l.bias, dtype=float)) for l in layers])

    def forward(column: pa.Array) -> pa.Array:
        model = shared.value
        z = np.asarray(column.flatten(), dtype=float).reshape(len(column), model[0][0].shape[0])
        for k, (w, b) in enumerate(model):
            z = z @ w + b
            if k < len(model) - 1:
                z = np.maximum(z, 0.0)
        offsets = np.arange(len(column) + 1, dtype=np.int32) * z.shape[1]
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(z.reshape(-1)))

    # typed here because postponed annotations hide the types from the UDF factory
    forward.__annotations__ = {"column": pa.Array, "return": pa.Array}
    udf = F.arrow_udf(forward, "array<double>")
    width = len(layers[0].weights[0])
    # unusable vectors travel as zeros, and their result is dropped again
    good = F.expr(usable_vector(x, width))
    sent = F.when(good, F.col(x).cast("array<double>")).otherwise(F.array_repeat(F.lit(0.0), width))
    return df.withColumn(out, F.when(good, udf(sent)))


def forward(df: DataFrame, x: str, layers: Sequence[Layer], out: str = "raw") -> DataFrame:
    """Output activations as array ``out``; small networks stay in the JVM."""
    if sum(l.size for l in layers) <= NATIVE_LIMIT:
        return forward_native(df, x, layers, out)
    return forward_arrow(df, x, layers, out)


def threshold_predict(df: DataFrame, prob: str = "pred_attack_proba",
                      threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """0/1 decision and its name; the threshold itself counts as an attack, no probability gives no decision."""
    hit = F.nanvl(F.col(prob).cast("double"), F.lit(None).cast("double")) >= threshold
    return df.withColumns({
        "pred": hit.cast("int"),
        "pred_label": F.when(hit, F.lit("ATTACK")).when(~hit, F.lit("BENIGN"))})


def score_binary(df: DataFrame, x: str, layers: Sequence[Layer],
                 threshold: float = DEFAULT_THRESHOLD, logits: bool = True) -> DataFrame:
    """Attack probability and decision from a one-output network."""
    raw = forward(df, x, layers, "__raw")
    z = F.get("__raw", F.lit(0))
    prob = raw.withColumn("pred_attack_proba", sigmoid(z) if logits else z).drop("__raw")
    return threshold_predict(prob, "pred_attack_proba", threshold)


def score_multiclass(df: DataFrame, x: str, layers: Sequence[Layer],
                     names: Sequence[str] | None = None) -> DataFrame:
    """Class index (first maximum) and name from a k-output network."""
    raw = forward(df, x, layers, "__raw")
    picked = raw.withColumn("pred_class_idx", argmax(F.col("__raw"))).drop("__raw")
    return class_names(picked, names, "pred_class_idx", "pred_class", len(layers[-1].bias))


def label_index(df: DataFrame, label: str = "label") -> DataFrame:
    """Distinct labels numbered from 0 in text order (``label, class_idx``).

    The one array holds the class names, not the rows.
    """
    names = df.agg(F.array_sort(F.collect_set(c(label))).alias("names"))
    return names.select(F.posexplode("names").alias("class_idx", label)) \
        .select(c(label), "class_idx")


def with_label_index(df: DataFrame, label: str = "label") -> DataFrame:
    return lookup(df, label_index(df, label), [label], small=True)
