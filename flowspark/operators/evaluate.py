"""Model quality: confusion counts, sweeps, class reports, losses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowspark.contract import DEFAULT_THRESHOLD, SWEEP_THRESHOLDS
from flowspark.functions.scalar import c, log_floor, safe_div, sigmoid
from flowspark.operators.quantiles import quantile_row
from flowspark.session import materialize


def confusion(df: DataFrame, truth: str = "y_true", pred: str = "pred",
              keys: Sequence[str] = ()) -> DataFrame:
    t, p = F.col(truth), F.col(pred)
    return df.groupBy(*keys).agg(
        F.count_if((p == 1) & (t == 1)).alias("tp"), F.count_if((p == 1) & (t == 0)).alias("fp"),
        F.count_if((p == 0) & (t == 0)).alias("tn"), F.count_if((p == 0) & (t == 1)).alias("fn"))


def metrics(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 beside the counts, 4 decimals, empty classes as 0."""
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    one = F.lit(1)
    prec = tp / F.greatest(tp + fp, one)
    rec = tp / F.greatest(tp + fn, one)
    f1 = 2 * prec * rec / F.greatest(prec + rec, F.lit(1e-9))
    acc = (tp + tn) / F.greatest(tp + fp + tn + fn, one)
    return counts.select("*", *[F.round(e, 4).alias(n) for n, e in (
        ("accuracy", acc), ("precision", prec), ("recall", rec), ("f1", f1))])


def threshold_sweep(df: DataFrame, prob: str = "prob", truth: str = "y_true",
                    thresholds: Sequence[float] = SWEEP_THRESHOLDS) -> DataFrame:
    """Metrics at every threshold from one pass.

    Rows are reduced map-side to (number of thresholds reached, truth); the counts per
    threshold are cumulative sums over those few groups, so rows are never multiplied.
    """
    cuts = sorted(float(t) for t in thresholds)
    p = F.col(prob).cast("double")
    reached = sum(((~F.isnan(p)) & (p >= t)).cast("int") for t in cuts)
    grouped = df.groupBy(F.coalesce(reached, F.lit(0)).alias("reached"),
                         F.col(truth).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    return _sweep_of(grouped, cuts)


def _sweep_of(grouped: DataFrame, cuts: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Metrics per threshold from counts ``n`` of (thresholds reached, truth ``y``) per key."""
    def total(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))

    aggs = []
    for i in range(len(cuts)):
        hit = F.col("reached") > i
        aggs += [total(hit & (F.col("y") == y)).alias(f"{name}{i}")
                 for name, y in (("tp", 1), ("fp", 0))]
        aggs += [total(~hit & (F.col("y") == y)).alias(f"{name}{i}")
                 for name, y in (("fn", 1), ("tn", 0))]
    rows = F.array(*[F.struct(F.lit(t).alias("threshold"),
                              *[F.col(f"{x}{i}").alias(x) for x in ("tp", "fp", "tn", "fn")])
                     for i, t in enumerate(cuts)])
    flat = grouped.groupBy(*keys).agg(*aggs).select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")
    return metrics(flat).withColumn("detected", F.col("tp") + F.col("fp"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """Threshold with the highest F1; the lowest threshold wins ties."""
    rank = F.struct(F.col("f1"), -F.col("threshold"))
    return sweep.agg(F.max_by("threshold", rank).alias("best_threshold"),
                     F.max("f1").alias("best_f1"))


def mark_best(sweep: DataFrame) -> DataFrame:
    """The sweep with its best row marked."""
    whole = Window.partitionBy(F.lit(1))
    best = F.max_by("threshold", F.struct(F.col("f1"), -F.col("threshold"))).over(whole)
    return sweep.withColumn("is_best", F.col("threshold") == best)


def classification_report(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Per class precision, recall, F1 and support, then accuracy, macro and weighted rows.

    Rows are first reduced to the confusion matrix, so later steps depend on the number
    of classes only.
    """
    matrix = df.groupBy(c(truth).cast("string").alias("t"), c(pred).cast("string").alias("p")) \
        .agg(F.count(F.lit(1)).alias("n"))
    roles = F.array(F.struct(F.col("t").alias("class"), F.lit("t").alias("role")),
                    F.struct(F.col("p").alias("class"), F.lit("p").alias("role")))
    hit = F.col("t") == F.col("p")
    per_class = matrix.select(F.explode(roles).alias("r"), "n", hit.alias("hit")) \
        .groupBy("r.class").agg(
            F.sum(F.when((F.col("r.role") == "t") & F.col("hit"), F.col("n")).otherwise(0)).alias("tp"),
            F.sum(F.when(F.col("r.role") == "t", F.col("n")).otherwise(0)).alias("support"),
            F.sum(F.when(F.col("r.role") == "p", F.col("n")).otherwise(0)).alias("predicted"))
    prec = safe_div(F.col("tp"), F.col("predicted"))
    rec = safe_div(F.col("tp"), F.col("support"))
    scored = per_class.withColumns({"precision": prec, "recall": rec}).withColumn(
        "f1", safe_div(2 * F.col("precision") * F.col("recall"),
                       F.col("precision") + F.col("recall")))
    names = ("precision", "recall", "f1")
    support = F.sum("support")
    accuracy = safe_div(F.sum("tp"), support)
    summary = scored.agg(
        support.alias("support"), accuracy.alias("accuracy"),
        *[F.avg(x).alias(f"macro_{x}") for x in names],
        *[safe_div(F.sum(F.col(x) * F.col("support")), support).alias(f"weighted_{x}")
          for x in names])
    extra = F.array(
        F.struct(F.lit("accuracy").alias("class"),
                 *[F.col("accuracy").alias(x) for x in names], F.col("support")),
        *[F.struct(F.lit(f"{kind} avg").alias("class"),
                   *[F.col(f"{kind}_{x}").alias(x) for x in names], F.col("support"))
          for kind in ("macro", "weighted")])
    totals = summary.select(F.explode(extra).alias("r")).select("r.*")
    return scored.select("class", *names, "support").unionByName(totals) \
        .select("class", *[F.round(x, 4).alias(x) for x in names], "support")


def distinct_classes(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Every class seen as truth or prediction."""
    return df.select(c(truth).alias("class")).union(df.select(c(pred).alias("class"))).distinct()


def raw_score_stats(df: DataFrame, score: str) -> DataFrame:
    """Range, mean and population deviation; logits if any value lies outside [0, 1]."""
    s = F.col(score)
    return df.agg(F.min(s).alias("min"), F.max(s).alias("max"), F.avg(s).alias("mean"),
                  F.stddev_pop(s).alias("std")) \
        .withColumn("kind", F.when((F.col("min") < 0) | (F.col("max") > 1), F.lit("LOGITS"))
                    .otherwise(F.lit("PROBABILITIES")))


def alert_summary(df: DataFrame, batch: Sequence[str], prob: str = "prob",
                  pred: str = "pred") -> DataFrame:
    """Attacks and their top probability per batch."""
    hit = F.col(pred) == 1
    return df.groupBy(*batch).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(hit).alias("n_attacks"),
        F.max(F.when(hit, F.col(prob))).alias("top_prob"))


def label_counts(df: DataFrame, keys: Sequence[str] = (), label: str = "label") -> DataFrame:
    return df.groupBy(*keys, c(label)).agg(F.count(F.lit(1)).alias("n"))


def detected_count(df: DataFrame, prob: str = "prob",
                   threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Rows at or above the threshold, for unlabelled tables."""
    return df.agg(F.count_if(F.col(prob) >= threshold).alias("detected"),
                  F.count(F.lit(1)).alias("n_rows"))


def duration_summary(flows: DataFrame, column: str = "flow duration") -> DataFrame:
    """Shortest, exact median and longest duration."""
    work = flows.select(c(column).cast("double").alias("d"))
    return quantile_row(work, {"min": ("d", 0.0), "median": ("d", 0.5), "max": ("d", 1.0)})


def log_loss(df: DataFrame, prob: str = "prob", truth: str = "y_true",
             keys: Sequence[str] = ()) -> DataFrame:
    """Mean binary cross-entropy; logarithms are bounded below by -100."""
    p, y = F.col(prob).cast("double"), F.col(truth).cast("double")
    loss = -(y * log_floor(p) + (1 - y) * log_floor(1 - p))
    return df.groupBy(*keys).agg(F.avg(loss).alias("log_loss"), F.count(F.lit(1)).alias("n_rows"))


def cross_entropy(df: DataFrame, probs: str, truth: str) -> DataFrame:
    """Mean negative log probability of the true class (0-based index into an array)."""
    p = F.get(F.col(probs), F.col(truth).cast("int"))
    return df.agg(F.avg(-log_floor(p)).alias("cross_entropy"), F.count(F.lit(1)).alias("n_rows"))


def validation_report(df: DataFrame, prob: str = "prob", truth: str = "y_true",
                      threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """One JSON document: score statistics, metrics, the sweep and its best threshold."""
    hit = F.coalesce(F.col(prob) >= threshold, F.lit(False)).cast("int")
    counted = metrics(confusion(df.withColumn("__hit", hit), truth, "__hit"))
    sweep = threshold_sweep(df, prob, truth)
    points = sweep.agg(F.array_sort(F.collect_list(F.struct(
        "threshold", "tp", "fp", "tn", "fn", "accuracy", "precision", "recall", "f1")))
        .alias("sweep"))
    report = counted.select(F.struct("*").alias("metrics")) \
        .crossJoin(F.broadcast(points)).crossJoin(F.broadcast(best_threshold(sweep))) \
        .crossJoin(F.broadcast(raw_score_stats(df, prob).select(
            F.struct("min", "max", "mean", "std").alias("raw_out"))))
    n = F.col("metrics.tp") + F.col("metrics.fp") + F.col("metrics.tn") + F.col("metrics.fn")
    return report.select(F.to_json(F.struct(
        n.alias("n_rows"), F.lit(threshold).alias("threshold"), "raw_out", "metrics", "sweep",
        "best_threshold")).alias("report"))


def models_report(df: DataFrame, models: dict[str, tuple[str, bool]], truth: str = "y_true",
                  threshold: float = DEFAULT_THRESHOLD, other_threshold: float = DEFAULT_THRESHOLD,
                  thresholds: Sequence[float] = SWEEP_THRESHOLDS) -> DataFrame:
    """One JSON document that compares models on the same labelled rows, from one aggregate over them.

    ``models`` maps a name to (column of raw outputs, whether the logistic function is applied to them). Per
    model: range, mean and deviation of the raw outputs, ``logits`` (some of them lie outside 0 to 1), counts and
    metrics, the sweep and its best threshold. The first model is cut at ``threshold``, the others at
    ``other_threshold``. With two models or more: how many rows the first two decide alike, and the percentage.
    A missing output reaches no threshold.
    """
    cuts = sorted(float(t) for t in thresholds)
    names = list(models)
    entries = []
    for i, (name, (raw, logistic)) in enumerate(models.items()):
        x = F.col(raw).cast("double")
        p = sigmoid(x) if logistic else x
        p = F.nanvl(p, F.lit(None).cast("double"))
        hit = F.coalesce(p >= (threshold if i == 0 else other_threshold), F.lit(False))
        reached = sum(F.coalesce((p >= t).cast("int"), F.lit(0)) for t in cuts)
        entries.append((name, hit, F.struct(F.lit(name).alias("model"), reached.alias("reached"), hit.alias("hit"), x.alias("raw"))))
    alike = entries[0][1] == entries[1][1] if len(names) > 1 else F.lit(True)
    # rows that agree are counted with the first model's entry
    rows = df.select(F.col(truth).alias("y"), alike.alias("alike"), F.explode(F.array(*[e for _, _, e in entries])).alias("e"))
    groups = rows.select("y", "alike", "e.*").groupBy("model", "reached", "y", "hit").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("alike").alias("agree"), F.min("raw").alias("min"), F.max("raw").alias("max"),
        F.count("raw").alias("m"), F.avg("raw").alias("mean"), F.var_pop("raw").alias("var"))
    # a few rows per model from here on
    groups = materialize(groups, "counts")
    mean = F.sum(F.col("m") * F.col("mean")) / F.sum("m")
    square = F.sum(F.col("m") * (F.col("var") + F.col("mean") * F.col("mean"))) / F.sum("m")
    raw_out = groups.groupBy("model").agg(
        F.sum("n").alias("n_rows"), F.sum("agree").alias("agree"), F.min("min").alias("min"), F.max("max").alias("max"),
        mean.alias("mean"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("std"))

    def counted(hit: int, y: int) -> Column:
        return F.coalesce(F.sum(F.when((F.col("hit") == bool(hit)) & (F.col("y") == y), F.col("n"))), F.lit(0))

    quality = metrics(groups.groupBy("model").agg(
        *[counted(*v).alias(k) for k, v in {"tp": (1, 1), "fp": (1, 0), "tn": (0, 0), "fn": (0, 1)}.items()]))
    sweep = _sweep_of(groups, cuts, ["model"])
    best = sweep.groupBy("model").agg(
        F.array_sort(F.collect_list(F.struct("threshold", "tp", "fp", "tn", "fn", "accuracy", "precision", "recall", "f1",
                                             "detected"))).alias("sweep"),
        F.max_by("threshold", F.struct(F.col("f1"), -F.col("threshold"))).alias("best_threshold"))
    whole = quality.select("model", F.struct(*[x for x in quality.columns if x != "model"]).alias("metrics")) \
        .join(raw_out, "model").join(best, "model")
    place = F.array_position(F.array(*[F.lit(x) for x in names]), F.col("model"))
    logits = (F.col("min") < 0) | (F.col("max") > 1)
    model = F.struct(place.alias("place"), "model", F.struct("min", "max", "mean", "std").alias("raw_out"), logits.alias("logits"),
                     F.element_at(F.array(*[F.lit(v) for _, v in models.values()]), place.cast("int")).alias("sigmoid_applied"),
                     "metrics", "sweep", "best_threshold")
    one = whole.agg(F.max("n_rows").alias("n_rows"), F.array_sort(F.collect_list(model)).alias("models"),
                    F.max(F.when(F.col("model") == names[0], F.col("agree"))).alias("agree"))
    pair = [F.col("agree").alias("agreement"),
            F.round(100 * F.col("agree") / F.greatest("n_rows", F.lit(1)), 2).alias("agreement_pct")] if len(names) > 1 else []
    return one.select(F.to_json(F.struct("n_rows", F.lit(threshold).alias("threshold"), "models", *pair)).alias("report"))
