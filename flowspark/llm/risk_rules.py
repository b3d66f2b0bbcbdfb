"""Quality rules whose cutoffs are certified on labelled documents, per stratum."""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from flowspark.llm.common import SLAB_BYTES, add_columns, word_slabs
from flowspark.session import materialize

SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 3
MIN_WORDS = 50
# rule -> (measure, whether large values fail, cutoffs from lenient to strict)
RULES = {
    "symbols": ("n_symbols / greatest(n_words, 1)", True, (2.0, 1.0, 0.7, 0.5, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03)),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", True, (0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.07)),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", True, (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2)),
    "long_words": ("word_chars / greatest(n_words, 1)", True, (20.0, 15.0, 12.0, 10.0, 9.0, 8.5, 8.0, 7.5, 7.0)),
    "short_words": ("word_chars / greatest(n_words, 1)", False, (1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0)),
    "capitals": ("n_capitals / greatest(word_chars, 1)", True, (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1)),
}
COUNTS = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, n_capitals long"


def _repeated(words: list[bytes], size: int) -> int:
    windows = list(zip(*(words[i:] for i in range(size))))
    if len(set(windows)) == len(windows):
        return 0
    first: dict = {}
    inside = bytearray(len(words))
    mark = b"\1" * size
    for i, w in enumerate(windows):
        j = first.setdefault(w, i)
        if j != i:
            inside[i:i + size] = mark
            inside[j:j + size] = mark
    return inside.count(1)


def _repeated_long(hashes: np.ndarray, size: int) -> int:
    """The same for very long texts, over 64-bit hashes of words and windows: 8 bytes a word."""
    n = len(hashes) - size + 1
    if n < 2:
        return 0
    window = np.zeros(n, np.uint64)
    for i in range(size):
        window = window * np.uint64(0x9E3779B97F4A7C15) ^ (hashes[i:n + i] * np.uint64(2 * i + 0xBF58476D1CE4E5B9))
    _, where, counts = np.unique(window, return_inverse=True, return_counts=True)
    at = np.flatnonzero(counts[where] > 1)
    inside = np.zeros(len(hashes), bool)
    for i in range(size):
        inside[at + i] = True
    return int(inside.sum())


def measure(text: str | None, window: int = WINDOW) -> tuple[int, ...]:
    """The counts in COUNTS of a whole text; null has none."""
    if not text:
        return (0,) * 7
    data = text.encode("utf-8", "surrogatepass")
    if len(data) <= SLAB_BYTES:
        words = data.split()
        n, repeated = len(words), _repeated(words, window)
    else:
        parts = [np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w)) for w in word_slabs(data)]
        hashes = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        n, repeated = len(hashes), _repeated_long(hashes, window)
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    capitals = sum(data.count(c) for c in range(65, 91)) if not data.islower() else 0
    return (n, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines),
            len(lines) - len(set(lines)), repeated, capitals)


def _measures():
    return lambda texts: list(zip(*map(measure, texts))) or [()] * 7


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial, exact: the regularised incomplete beta function as a continued fraction."""
    if k >= n:
        return 1.0
    a, b, x = n - k, k + 1, 1 - p
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - front * _fraction(b, a, 1 - x) / b
    return front * _fraction(a, b, x) / a


def _fraction(a: float, b: float, x: float) -> float:
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > 1e-300 else 1e-300)
    value = d
    for m in range(1, 100_000):
        for part in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                     -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + part * d
            c = 1 + part / c
            d = 1 / (d if abs(d) > 1e-300 else 1e-300)
            c = c if abs(c) > 1e-300 else 1e-300
            value *= c * d
        if abs(c * d - 1) < 1e-13:
            break
    return value


def certified(rejected: list[int], n: int, limit: float, level: float) -> int:
    """How many leading rungs of a ladder of ever stricter rule sets are certified.

    ``rejected[i]`` of ``n`` good documents fail the rules up to rung i. Rungs are tested in order and testing ends
    with the first whose exact upper bound on false rejection, at confidence 1 - ``level``, is above ``limit``; so
    the whole series errs with at most ``level``.
    """
    for i, k in enumerate(rejected):
        if n == 0 or binomial_cdf(k, n, limit) > level:
            return i
    return len(rejected)


def _fails(rule: str, cut: str) -> str:
    value, above, _ = RULES[rule]
    return f"{value} {'>' if above else '<'} {cut}"


def _over(rule: str, cut: Column) -> Column:
    value, above, _ = RULES[rule]
    return F.expr(value) > cut if above else F.expr(value) < cut


def tally(rows: DataFrame, most: int = 10_000) -> dict[str, dict[str, list[list[int]]]]:
    """stratum -> rule -> per cutoff [bad, good] documents that fail it, of (stratum, good, measures)."""
    steps = F.array(*[F.struct(F.lit(rule).alias("rule"), sum(
        (F.expr(_fails(rule, f"{cut}D")).cast("int") for cut in cuts), F.lit(0)).alias("step"))
        for rule, (_, _, cuts) in RULES.items()])
    # a document fails the strictest cutoffs, the last `step` of them
    most *= 2 * sum(len(cuts) for _, _, cuts in RULES.values())
    counts = rows.select("stratum", "good", F.explode(steps).alias("s")).filter("s.step > 0").groupBy(
        "stratum", "good", "s.rule", "s.step").count().limit(most + 1).collect()
    if len(counts) > most:
        raise ValueError("too many strata")
    found: dict = {}
    for r in counts:
        own = found.setdefault(r.stratum, {}).setdefault(r.rule, [[0, 0] for _ in RULES[r.rule][2]])
        for failed in own[len(own) - r.step:]:
            failed[r.good] += r["count"]
    return found


def _values(tallied: dict, rule: str) -> list[int]:
    """Bad documents rejected, each good one counts tenfold; per cutoff of the rule."""
    return [bad - 10 * good for bad, good in tallied.get(rule, [[0, 0]] * len(RULES[rule][2]))]


def _pooled(tallies: dict) -> dict[str, list[list[int]]]:
    return {rule: [[sum(x) for x in zip(*same)] for same in zip(*(t[rule] for t in tallies.values() if rule in t))]
            for rule in {rule for t in tallies.values() for rule in t}}


def proposed(own: dict, pooled: dict) -> list[tuple[str, list[float]]]:
    """(rule, cutoffs from lenient to strict) of a stratum, most useful rule first.

    A rule's last cutoff is the one with the highest value in the stratum; where several are equal there, the
    strictest that is no stricter than the best of all strata pooled. Cutoffs are left out that reject no more bad
    documents of any stratum than a milder one; so are rules without a positive value in the stratum or pooled.
    """
    found = []
    for rule, (_, _, cuts) in RULES.items():
        mine, every = _values(own, rule), _values(pooled, rule)
        if max(mine) < 0 or max(*mine, *every) <= 0:
            continue
        first, best = mine.index(max(mine)), every.index(max(every)) if max(every) > 0 else 0
        last = max(i for i in range(len(cuts)) if mine[i] == max(mine) and i <= max(first, best))
        bad = [0] + [x[0] for x in pooled.get(rule, [])]
        rungs = [cuts[i] for i in range(last + 1) if bad[i + 1] > bad[i]]
        if rungs:
            found.append((max(mine), max(every), rule, rungs))
    return [(rule, rungs) for *_, rule, rungs in sorted(found, key=lambda x: (-x[0], -x[1]))]


def ladder(rows: DataFrame) -> list[tuple[str, float]]:
    """(rule, strictest proposed cutoff) from most to least useful on (good, measures) as one stratum."""
    own = tally(rows.withColumn("stratum", F.lit(""))).get("", {})
    return [(rule, rungs[-1]) for rule, rungs in proposed(own, own)]


def share(level: float, rungs: list[int], at: int, whole: bool) -> float:
    """The level for testing the rule at place ``at``; ``rungs`` has how many cutoffs each rule has.

    Half goes to the one series in which no test has failed. The other half is shared out over the later rules and,
    for each, over all sets of cutoffs that earlier rules can have left after a failure.
    """
    if whole:
        return level / 2
    return level / 2 / (len(rungs) - 1) / (math.prod(n + 1 for n in rungs[:at]) - 1)


def _failed() -> Column:
    """Rules whose cutoff in the map ``cuts`` a row passes."""
    return F.array_compact(F.array(*[F.when(F.expr(_fails(rule, f"cuts['{rule}']")), F.lit(rule)) for rule in RULES]))


def cutoffs(measured: DataFrame, labels: DataFrame, limit: float = 0.05, level: float = 0.05,
            max_strata: int = 10_000) -> list[tuple[str, str, float]]:
    """(stratum, rule, cutoff): per stratum the rules together reject at most ``limit`` of good documents.

    Half of the labelled rows (odd crc32 of the id) propose rules and cutoffs per stratum. On the other half, held out,
    the rules of each stratum are tested in turn, each from its most lenient cutoff to the first that is not
    certified together with those taken before; the next rule goes on from the last that was. The guarantee holds
    with probability 1 - ``level`` for all strata at once: each gets an equal share (Bonferroni), see ``share``. A stratum
    with too few held-out labels gets no cutoff, and rejects nothing. At most ``max_strata`` strata are accepted.
    """
    known = labels.select("doc_id", F.col("quality").alias("label")).dropna().groupBy("doc_id").agg(
        F.max("label").alias("label"))
    rows = materialize(measured.filter("not base_failed").join(known, "doc_id").withColumns({
        "good": F.col("label") > 0, "held": F.crc32(F.col("doc_id").cast("string")) % 2 == 0}), "labelled")
    tallies = tally(rows.filter("not held"), max_strata)
    good = rows.filter("held and good")
    sizes = {r.stratum: r["count"] for r in good.groupBy("stratum").count().limit(max_strata + 1).collect()}
    if len(sizes) > max_strata:
        raise ValueError(f"more than {max_strata} strata")
    pooled = _pooled(tallies)
    ladders = {s: proposed(tallies.get(s, {}), pooled) for s in sorted(sizes)}
    taken: dict[str, dict[str, float]] = {s: {} for s in ladders}
    whole = dict.fromkeys(ladders, True)
    for at in range(max(map(len, ladders.values()), default=0)):
        # one row per stratum: at most max_strata rows are broadcast
        tested = rows.sparkSession.createDataFrame(
            [(s, taken[s], *steps[at]) for s, steps in ladders.items() if at < len(steps)],
            "stratum string, cuts map<string, double>, rule string, rungs array<double>")
        below = F.coalesce(*[F.when(F.col("rule") == rule, F.size(F.filter("rungs", partial(_over, rule)))) for rule in RULES])
        step = F.when(F.size(_failed()) > 0, F.size("rungs") + 1).otherwise(below)
        counts = good.join(F.broadcast(tested), "stratum").groupBy("stratum", step.alias("step")).count().collect()
        own: dict[str, dict[int, int]] = {}
        for r in counts:
            own.setdefault(r.stratum, {})[r.step] = r["count"]
        for s, steps in own.items():
            rule, rungs = ladders[s][at]
            # the last `step` cutoffs reject a document, one step more: rules taken before do
            rejected = [sum(n for k, n in steps.items() if k >= len(rungs) - i) for i in range(len(rungs))]
            passed = certified(rejected, sizes[s], limit, share(
                level / len(sizes), [len(x) for _, x in ladders[s]], at, whole[s]))
            whole[s] = whole[s] and passed == len(rungs)
            if passed:
                taken[s][rule] = rungs[passed - 1]
    return [(s, rule, cut) for s, cuts in taken.items() for rule, cut in cuts.items()]


def quality_rules(df: DataFrame, labels: DataFrame, stratum: str = "lang", **options) -> DataFrame:
    """One row per row of ``df``: doc_id, stratum, the counts, base_failed, failed_rules and kept.

    Fixed base rules: fewer than 50 words, or over half of the words in repeated windows. Beyond them a
    document fails a rule whose certified cutoff in its stratum it passes. Null texts have no words and
    fail; a null stratum is the stratum ''. Without labels only the base rules count. Repeated rows each
    give a row.
    """
    rows = df.select("doc_id", F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), "text")
    counted = add_columns(rows, "text", COUNTS, partial(_measures)).drop("text")
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    measured = materialize(counted.withColumn("base_failed", base), "measures")
    chosen = cutoffs(measured, labels, **options)
    # one row per stratum: at most max_strata rows are broadcast
    cuts = df.sparkSession.createDataFrame(
        [(s, {r: c for t, r, c in chosen if t == s}) for s in sorted({x[0] for x in chosen})],
        "stratum string, cuts map<string, double>")
    judged = measured.join(F.broadcast(cuts), "stratum", "left").withColumn(
        "failed_rules", F.when(F.col("base_failed"), F.lit("base")).otherwise(F.array_join(_failed(), ",")))
    return judged.withColumn("kept", F.col("failed_rules") == "").drop("cuts")
