"""Scoring of flow files: CSV in, the same rows with predictions out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from flowspark.contract import DEFAULT_THRESHOLD, FEATURES
from flowspark.operators.scoring import Layer, prepare_features, score_binary, score_multiclass
from flowspark.sources.flow_csv import read_flow_csv
from flowspark.sources.tables import write_predictions


def score_csv(spark: SparkSession, source: str | Sequence[str], target: str, params: DataFrame, medians: DataFrame,
              layers: Sequence[Layer], features: Sequence[str] = FEATURES, multiclass: bool = False,
              names: Sequence[str] | None = None, threshold: float = DEFAULT_THRESHOLD) -> None:
    """Read flow CSV files, clean, impute with ``medians``, scale with ``params``, score, and write CSV.

    All columns of the files are kept, under their normalised names; a binary network adds ``pred_attack_proba``
    and ``pred_label``, one with several outputs ``pred_class_idx`` and ``pred_class``. A feature that the files
    lack, or that holds other text than numbers, fails.
    """
    rows = read_flow_csv(spark, source, features, strict=True)
    ready = prepare_features(rows, params, features, mode="fixed", fixed=medians)
    if multiclass:
        scored = score_multiclass(ready, "x", layers, names)
    else:
        scored = score_binary(ready, "x", layers, threshold).drop("pred")
    write_predictions(scored.drop("x"), target)
