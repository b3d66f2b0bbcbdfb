"""URL filter: host and path rules, and gradient-boosted trees on lexical features for all other URLs."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from flowspark.llm.common import bounded_sample
from flowspark.session import materialize

# (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
FEATURES = ("url_length", "host_length", "path_length", "depth", "labels", "hyphens", "digit_ratio", "host_digits", "entropy",
            "params", "fragment", "longest_segment", "top_rate", "top_count", "site_rate", "site_count")
# suffixes up to which their table is broadcast
BROADCAST_ROWS = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; '' for null and without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _SPLIT, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _SPLIT, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, or null. A rule fits its host and all hosts below it."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def lexical(df: DataFrame, url: str = "url") -> DataFrame:
    """``df`` with lexical features of its host, path and url columns, and the suffixes ``top`` and ``site``."""
    whole = F.coalesce(F.col(url), F.lit(""))
    n = F.greatest(F.char_length(whole), F.lit(1))
    counts = F.transform(F.array_distinct(F.split(F.lower(whole), "")),
                         lambda c: F.char_length(whole) - F.char_length(F.replace(F.lower(whole), c, F.lit(""))))
    entropy = F.aggregate(counts, F.lit(0.0), lambda s, k: s + F.when(k > 0, -(k / n) * F.log2(k / n)).otherwise(0.0))
    segments = F.split("path", "/")
    count = lambda c, pattern: F.regexp_count(c, F.lit(pattern)).cast("double")
    host = F.col("host")
    return df.withColumns({
        "url_length": F.char_length(whole).cast("double"), "host_length": F.char_length(host).cast("double"),
        "path_length": F.char_length("path").cast("double"), "depth": count(F.col("path"), "/"),
        "labels": count(host, r"\."), "hyphens": count(host, "-"), "digit_ratio": count(whole, "[0-9]") / n,
        "host_digits": count(host, "[0-9]"), "entropy": entropy, "params": count(whole, "="),
        "fragment": F.contains(whole, F.lit("#")).cast("double"),
        "longest_segment": F.array_max(F.transform(segments, F.char_length)).cast("double"),
        "top": F.substring_index(host, ".", -1), "site": F.substring_index(host, ".", -2)})


def _suffix_rates(labelled: DataFrame, column: str, prior: float, weight: float = 10.0) -> DataFrame:
    """Smoothed share of blocked labelled urls, and how many there are, per suffix; ``n`` is how often a row occurs."""
    return labelled.groupBy(column).agg(
        ((F.sum(F.col("label") * F.col("n")) + prior * weight) / (F.sum("n") + weight)).alias(f"{column}_rate"),
        F.log1p(F.sum("n").cast("double")).alias(f"{column}_count"))


def _sample(known: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` of the distinct labelled urls by hash; if they miss a class that ``known`` has, a tenth is of that one."""
    sample = materialize(bounded_sample(known, ["url", "label"], rows), "labelled")
    classes = [r.label for r in sample.select("label").distinct().collect()]
    if len(classes) != 1:
        return sample
    other = bounded_sample(known.filter(F.col("label") != classes[0]), ["url", "label"], max(rows // 10, 1))
    return materialize(sample.limit(rows - max(rows // 10, 1)).unionByName(other), "labelled")


def judge(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES, key: str = "page_id", url: str = "url",
          rows: int = 20_000, trees: int = 20, depth: int = 4) -> DataFrame:
    """One row per row of ``pages``: key, host, path, rule, verdict, score (chance of block by the trees).

    Rules decide first. The trees decide the rest; they learn from ``labelled`` (url, label: 1 is block), by
    default from the pages that a rule decides. Rates of suffixes are counted over all of them; the trees are fitted
    on at most ``rows`` distinct ones, by hash of their url. If the labels have one class only, that is the trees' verdict; without any, it is allow. Null urls and urls without ://
    have empty host and path and are judged by the trees. Repeated rows each give a row.
    """
    urls = pages.select(F.col(key).alias("key"), F.col(url).alias("url")).select(
        "key", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = urls.withColumns({"rule": name, "by_rule": verdict})
    if labelled is None:
        known = ruled.filter("by_rule is not null").select("url", "host", "path", (F.col("by_rule") == "block").cast("double").alias("label"))
    else:
        known = labelled.dropna(subset=["label"]).select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("label").cast("double").alias("label"))
    known = materialize(known.groupBy("url", "host", "path", "label").agg(F.count("*").alias("n")), "known")
    size = known.agg(F.sum("n").alias("n"), (F.sum(F.col("label") * F.col("n")) / F.sum("n")).alias("p")).first()
    if not size.n or size.p in (0.0, 1.0):
        only = "block" if size.n and size.p == 1.0 else "allow"
        return ruled.select(F.col("key").alias(key), "host", "path", "rule", F.coalesce("by_rule", F.lit(only)).alias("verdict"),
                            F.lit(1.0 if only == "block" else 0.0).alias("score"))
    rates = {c: materialize(_suffix_rates(lexical(known), c, size.p), "suffixes") for c in ("top", "site")}
    # counted, not estimated: a table of few suffixes is broadcast
    rates = {c: F.broadcast(table) if table.count() <= BROADCAST_ROWS else table for c, table in rates.items()}

    def featured(df: DataFrame) -> DataFrame:
        out = lexical(df)
        for c, table in rates.items():
            out = out.join(table, c, "left").fillna({f"{c}_rate": float(size.p), f"{c}_count": 0.0})
        return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(out)
    training = materialize(featured(_sample(known, rows)).select("features", "label").coalesce(4), "features")
    model = GBTClassifier(labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.2, seed=7, maxBins=64).fit(training)
    scored = model.transform(featured(ruled)).withColumn("score", vector_to_array("probability")[1])
    return scored.select(F.col("key").alias(key), "host", "path", "rule", F.coalesce(
        "by_rule", F.when(F.col("score") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "score")
