"""Document quality by Bradley-Terry ranking: pairwise preferences on text features, cut at a score quantile."""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import DataFrame, functions as F

from flowspark.llm.common import add_columns, bounded_sample, held_out
from flowspark.session import materialize

FEATURES = ("log_words", "mean_word", "symbols", "capitals", "distinct", "repeated_lines", "repeated_triples",
            "stutter", "digits", "ends", "bars", "shouts")
CUT = 0.3
_SYMBOLS = re.compile(r"[#*$%&|<>{}\[\]\\^~_=+@]")
_DIGIT = re.compile(r"\d")
_WORDS = 1 << 18  # words looked at together; ratios of longer texts are means over such parts


def features(text: str | None) -> list[float]:
    """Shares between 0 and 1 (and two bounded lengths) of a whole text; null counts as empty."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    distinct = triples = stutter = 0.0
    for start in range(0, n, _WORDS):
        part = words[start:start + _WORDS]
        distinct += len(set(part))
        stutter += sum(map(str.__eq__, part, part[1:]))
        seen = set(zip(part, part[1:], part[2:]))
        triples += max(len(part) - 2, 0) - len(seen)
    return [
        min(math.log1p(n) / 10, 1.0),
        min(sum(map(len, words)) / n / 20, 1.0),
        min(len(_SYMBOLS.findall(text)) / n, 1.0),
        sum(map(str.isupper, words)) / n,
        distinct / n,
        1 - len(set(lines)) / max(len(lines), 1),
        triples / n,
        stutter / n,
        min(len(_DIGIT.findall(text)) / n, 1.0),
        min(sum(map(text.count, ".?!。")) / n, 1.0),
        min(text.count("|") / n, 1.0),
        min((text.count("!!") + text.count("??")) / n, 1.0),
    ]


def _features():
    return lambda texts: [[features(t) for t in texts]]


def with_features(df: DataFrame, text: str = "text") -> DataFrame:
    return add_columns(df, text, "x array<double>", _features)


def fit_pairs(x: np.ndarray, y: np.ndarray, rivals: int = 8, ridge: float = 1e-3) -> np.ndarray:
    """Bradley-Terry weights: logistic loss on differences between a preferred and another document.

    Every row of the rarer class meets ``rivals`` rows of the other one, at fixed strides. Without both
    classes there is no preference, and all weights are 0.
    """
    good, bad = x[y > 0], x[y <= 0]
    if not len(good) or not len(bad):
        return np.zeros(x.shape[1])
    n = max(len(good), len(bad)) if min(len(good), len(bad)) * rivals < max(len(good), len(bad)) \
        else min(len(good), len(bad)) * rivals
    # co-prime strides pair every row with several others
    i = np.arange(n)
    diff = good[i % len(good)] - bad[(i + i // len(bad) * 7) % len(bad)]
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -60, 60)))  # chance of the wrong order
        grad = -(p @ diff) / n + ridge * w
        hess = (diff.T * (p * (1 - p))) @ diff / n + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


def quality(df: DataFrame, labels: DataFrame, rows: int = 20_000, rivals: int = 8, cut: float = CUT) -> DataFrame:
    """One row per row of ``df``: doc_id, held_out, score, predicted, margin.

    Weights come from preference pairs among at most ``rows`` labelled rows that are not held out, taken
    by hash of their ids. The cut is a quantile of the margins of all documents: as many pass as have
    label 1 among all labelled rows that are not held out. Scores are logistic in the margin, with
    the cut at ``cut``; ``predicted`` is 1 from there on. Null and empty texts have all features 0 and a
    score like any other. Rows without id count as held out. Without labels of both classes every
    document gets the same score, and passes.
    """
    seen = materialize(with_features(df.select("doc_id", "text")).select("doc_id", "x"), "features")
    train = labels.select("doc_id", F.col("quality").alias("y")).dropna().filter(~held_out(F.col("doc_id")))
    train = train.groupBy("doc_id").agg(F.max("y").alias("y"))
    share = train.agg(F.avg("y").alias("p")).first().p
    chosen = bounded_sample(train, ["doc_id"], rows)
    sample = seen.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id").toPandas()
    if len(sample):
        x, y = np.array(sample["x"].tolist(), float), sample["y"].to_numpy(float)
    else:
        x, y = np.zeros((0, len(FEATURES))), np.zeros(0)
    weights = fit_pairs(x, y, rivals)
    margin = sum((F.lit(float(w)) * F.col("x")[i] for i, w in enumerate(weights)), F.lit(0.0))
    ranked = seen.select("doc_id", margin.alias("margin"))
    return _cut(ranked, 1 - (1.0 if share is None else float(share)), cut, bool(weights.any()))


def _cut(ranked: DataFrame, level: float, cut: float, told_apart: bool) -> DataFrame:
    """Scores from margins. The quantile is read where margins are sparse: the widest gap near it.

    Labels fix the share of low documents only up to sampling error, so the cut is put in the middle of
    the widest gap between neighbouring quantiles within a fifth of that share.
    """
    held = held_out(F.col("doc_id")).alias("held_out")
    if not told_apart:
        return ranked.select("doc_id", held, F.lit(1.0).alias("score"), F.lit(1).alias("predicted"), "margin")
    steps = np.unique(np.clip(level * np.linspace(0.8, 1.2, 41), 0.0, 1.0))
    points = ranked.agg(F.percentile_approx("margin", [float(s) for s in steps], 100_000).alias("q")).first().q
    if not points:
        return ranked.select("doc_id", held, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), "margin")
    gaps = np.diff(points)
    k = int(np.argmax(gaps)) if len(gaps) and gaps.max() > 0 else 0
    at = (points[k] + points[k + 1]) / 2 if len(gaps) and gaps.max() > 0 else points[0]
    odds = math.log(cut / (1 - cut))
    scored = 1 / (1 + F.exp(-(F.col("margin") - F.lit(float(at)) + F.lit(odds))))
    return ranked.select("doc_id", held, scored.alias("score"), "margin").select(
        "doc_id", "held_out", "score", (F.col("score") >= cut).cast("int").alias("predicted"), "margin")

