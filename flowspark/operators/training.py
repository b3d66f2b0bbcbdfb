"""Training on Spark ML: network with early stopping by validation loss, baseline, pipeline."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import (
    LogisticRegression, MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.contract import TRAIN_FRACTION, VALIDATION_FRACTION
from flowspark.functions.scalar import (
    argmax, c, canonical_label, is_attack_label, quoted,
)
from flowspark.operators.clean import clean_columns, fit_scaler, impute_median, params_row, sql_scaled
from flowspark.operators.evaluate import classification_report, cross_entropy
from flowspark.operators.lookups import lookup, with_single_row
from flowspark.operators.quantiles import medians
from flowspark.operators.sampling import time_cuts, time_split
from flowspark.operators.schema import numeric_columns
from flowspark.operators.scoring import label_index
from flowspark.session import materialize

# --- fixed values: hidden layer widths ---
BINARY_HIDDEN = (256, 128)
MULTICLASS_HIDDEN = (512, 256)


@dataclass
class Trained:
    model: MultilayerPerceptronClassificationModel
    best_round: int
    validation_loss: float


def to_examples(df: DataFrame, x: str, y: str) -> DataFrame:
    """Vector and label columns as Spark ML names them."""
    return df.select(array_to_vector(F.col(x).cast("array<double>")).alias("features"),
                     F.col(y).cast("double").alias("label"))


def split_examples(ready: DataFrame, target: str) -> dict[str, DataFrame]:
    """Train, validation and test examples from one prepared table, written once.

    Training passes over its rows many times; the prepared table is read back from the
    shared folder instead of being derived again.
    """
    stored = materialize(ready.select("x", F.col(target).alias("y"), "part"), "examples")
    return {p: to_examples(stored.filter(F.col("part") == p), "x", "y")
            for p in ("train", "validation", "test")}


def predict(model, examples: DataFrame) -> DataFrame:
    """``label, probs, pred`` per example."""
    probs = vector_to_array("probability")
    return model.transform(examples).select(
        "label", probs.alias("probs"), argmax(probs).alias("pred"))


def validation_loss(model, examples: DataFrame) -> float:
    """Mean negative log probability of the true class."""
    return cross_entropy(predict(model, examples), "probs", "label").first()["cross_entropy"]


def train_network(train: DataFrame, validation: DataFrame, n_inputs: int, n_classes: int,
                  hidden: Sequence[int] = BINARY_HIDDEN, rounds: int = 12, steps: int = 10,
                  seed: int = 42) -> Trained:
    """Fit in rounds and keep the model with the lowest validation loss.

    Each round continues from the weights of the last one. Gradients are summed over the
    partitions of ``train``; only weights and one loss value per round reach the driver.
    """
    best, weights = None, None
    for i in range(1, rounds + 1):
        learner = MultilayerPerceptronClassifier(
            layers=[n_inputs, *hidden, n_classes], maxIter=steps, seed=seed, blockSize=128)
        if weights is not None:
            learner = learner.setInitialWeights(weights)
        model = learner.fit(train)
        weights = model.weights
        loss = validation_loss(model, validation)
        if best is None or loss < best.validation_loss:
            best = Trained(model, i, loss)
    return best


def choose_model(models: dict, validation: DataFrame) -> tuple[str, dict[str, float]]:
    """Name of the model with the lowest validation loss (the first on ties), and all losses."""
    losses = {name: validation_loss(model, validation) for name, model in models.items()}
    return min(losses, key=losses.get), losses


def train_baseline(train: DataFrame, max_iter: int = 50):
    """Logistic regression on the same examples."""
    return LogisticRegression(maxIter=max_iter).fit(train)


def prepare_training(rows: DataFrame, ts_us, row_index: str, label: str = "label",
                     features: Sequence[str] | None = None,
                     train: float = TRAIN_FRACTION,
                     validation: float = VALIDATION_FRACTION) -> tuple[DataFrame, list[str]]:
    """Clean (no clip), impute over all rows, split by time, scale with training rows only.

    Returns rows with ``x``, ``y_binary``, ``y_class`` and ``part``, and the feature names,
    which are all numeric columns in table order unless given.
    """
    skip = {row_index, label}
    names = list(features or [x for x in numeric_columns(rows) if x not in skip])
    cleaned = clean_columns(rows, names, limit=None)
    # three small fitted tables, stored so that later steps read them instead of refitting
    center = materialize(medians(cleaned, names), "medians")
    cuts = materialize(time_cuts(rows, ts_us, row_index, train, validation), "cuts")
    filled = impute_median(time_split(cleaned, ts_us, row_index, cuts=cuts), names, "fixed",
                           fixed=center)
    params = materialize(fit_scaler(filled.filter("part = 'train'"), names), "scaler")
    scaled = ", ".join(sql_scaled(quoted(x), i) for i, x in enumerate(names))
    text = F.trim(F.coalesce(c(label).cast("string"), F.lit("nan")))
    ready = with_single_row(filled, params_row(params, names)).select(
        *[c(x) for x in filled.columns if x not in set(names)], F.expr(f"array({scaled})").alias("x"),
        is_attack_label(text).alias("y_binary"), canonical_label(text).alias("class"))
    classes = materialize(label_index(rows.select(canonical_label(text).alias("class")), "class"),
                          "classes")
    indexed = lookup(ready, classes.withColumnRenamed("class_idx", "y_class"), ["class"], "inner", small=True)
    return indexed, names


def training_pipeline(rows: DataFrame, ts_us, row_index: str, label: str = "label",
                      features: Sequence[str] | None = None, hidden: Sequence[int] = BINARY_HIDDEN,
                      rounds: int = 12, steps: int = 10, target: str = "y_binary") -> DataFrame:
    """Prepare, train on the first part, choose by the second, report on the last."""
    ready, names = prepare_training(rows, ts_us, row_index, label, features)
    parts = split_examples(ready, target)
    n_classes = 2
    if target != "y_binary":
        n_classes = label_index(ready, target).count()
    trained = train_network(parts["train"], parts["validation"], len(names), n_classes, hidden,
                            rounds, steps)
    scored = predict(trained.model, parts["test"])
    return classification_report(scored.withColumn("label", F.col("label").cast("int")),
                                 "label", "pred")
