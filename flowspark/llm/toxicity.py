"""Toxicity: a weighted lexicon, matched by Aho-Corasick on folded text, normalised by length."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import partial

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame, functions as F

from flowspark.llm import simhash
from flowspark.llm.common import add_columns, bounded_sample, held_out, keep_where
from flowspark.session import materialize

# look-alike letters and digits used in place of letters, and what they stand for (fixed values)
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h",
    "о": "o", "р": "p", "с": "c", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ɡ": "g", "ո": "n",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u",
    "χ": "x", "ı": "i", "ł": "l", "ø": "o",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
}
INVISIBLE = "­​‌‍⁠﻿"
# phrases in which a listed word is harmless
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "class clown", "idiot proof", "pond scum",
              "sore loser", "stupid question")
PREFIXES = range(3, 13)

_FOLD = str.maketrans({**LOOKALIKES, **dict.fromkeys(INVISIBLE),
                       **{chr(0xFF21 + i): chr(97 + i) for i in range(26)},
                       **{chr(0xFF41 + i): chr(97 + i) for i in range(26)}})
_OTHER = re.compile(r"[\W_]+")
_PIECE = 1 << 20


def fold(text: str) -> str:
    """Lower case, look-alikes and digits as the letters they stand for, one blank around each word."""
    return " " + _OTHER.sub(" ", text.lower().translate(_FOLD)).strip() + " "


@dataclass(frozen=True)
class Lexicon:
    """Terms of folded text (" word " or, for words that begin so, " word") with weights.

    ``slope``, ``length`` and ``shift`` turn log(1 + weight of all matches) and log(1 + words / 100) into a
    score; ``length`` is never positive, so a longer text needs more.
    """
    terms: tuple[tuple[str, float], ...]
    exceptions: tuple[str, ...] = EXCEPTIONS
    slope: float = 2.0
    length: float = -0.5
    shift: float = -2.0

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for term, weight in self.terms:
            if term.strip():
                found.add_word(term, (len(term), weight))
        for phrase in self.exceptions:
            if phrase.strip():
                found.add_word(fold(phrase), (len(fold(phrase)), None))
        if len(found):
            found.make_automaton()
        return found


def _pieces(folded: str):
    """A long folded text cut at blanks, each piece with a blank at both ends."""
    start = 0
    while start < len(folded) - 1:
        end = folded.find(" ", start + _PIECE) if len(folded) - start > _PIECE else len(folded) - 1
        end = len(folded) - 1 if end < 0 else end
        yield start, folded[start:end + 1]
        start = end


def matched(folded: str, automaton: ahocorasick.Automaton) -> list[tuple[int, int, float]]:
    """(start, end, weight) of terms in folded text; of terms that begin at one place the heaviest,
    and none that lies within an exception phrase."""
    if not len(automaton):
        return []
    best: dict[int, tuple[int, float]] = {}
    safe: list[tuple[int, int]] = []
    for last, (size, weight) in automaton.iter(folded):
        start = last - size + 1
        if weight is None:
            safe.append((start, last + 1))
        elif start not in best or weight > best[start][1]:
            best[start] = (last + 1, weight)
    return [(s, e, w) for s, (e, w) in best.items()
            if not any(a <= s and s < b - 1 for a, b in safe)]


def burden(text: str | None, automaton: ahocorasick.Automaton) -> tuple[float, float]:
    """log(1 + weight of all matched terms) and log(1 + words / 100); both 0 for null or empty text."""
    folded = fold(text or "")
    total = sum(w for _, piece in _pieces(folded) for _, _, w in matched(piece, automaton))
    return math.log1p(total), math.log1p(max(folded.count(" ") - 1, 0) / 100)


def probability(found: tuple[float, float], lexicon: Lexicon) -> float:
    z = lexicon.slope * found[0] + lexicon.length * found[1] + lexicon.shift
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def scores(texts, lexicon: Lexicon, automaton: ahocorasick.Automaton) -> list[float]:
    return [probability(burden(t, automaton), lexicon) for t in texts]


def _scores(lexicon: Lexicon):
    automaton = lexicon.automaton()
    return lambda texts: [scores(texts, lexicon, automaton)]


def _clean(lexicon: Lexicon, limit: float):
    automaton = lexicon.automaton()
    return lambda texts: [s < limit for s in scores(texts, lexicon, automaton)]


def score(df: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """``df`` with ``score`` between 0 and 1. Null and empty texts get the score of a text without matches."""
    return add_columns(df, text, "score double", partial(_scores, lexicon))


def keep_clean(df: DataFrame, lexicon: Lexicon, text: str = "text", limit: float = 0.5) -> DataFrame:
    """Rows whose score is below ``limit``, with all their columns."""
    return keep_where(df, text, partial(_clean, lexicon, limit))


def _starts(texts):
    found = []
    for t in texts:
        terms = set()
        for word in set(fold(t or "").split()):
            terms.add(f" {word} ")
            terms.update(" " + word[:n] for n in PREFIXES if n <= len(word))
        found.append(sorted(terms))
    return [found]


def labelled_sample(df: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """Stored (text, label) of at most ``rows`` labelled rows that may be learned from, by hash of their ids.

    Rows without id, label or text give nothing; a document with several labels counts as its largest.
    """
    chosen = labels.select("doc_id", F.col(label).alias("label")).dropna().filter(~held_out(F.col("doc_id")))
    chosen = chosen.groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = bounded_sample(chosen, ["doc_id"], rows)
    # at most `rows` narrow rows are broadcast
    texts = df.select("doc_id", "text").dropna().join(F.broadcast(chosen), "doc_id")
    return materialize(texts.dropDuplicates(["text"]).select("text", "label"), "sample")


def _grouped(sample: DataFrame) -> DataFrame:
    """Stored (text, label, group): near copies of one label share a group; it is null where there is one text."""
    keyed = sample.withColumn("doc_id", F.xxhash64("text"))
    found = materialize(simhash.near_duplicates(keyed).select("doc_id", F.col("component_id").alias("group")).distinct(), "copies")
    grouped = keyed.join(found, "doc_id")
    # at most half as many narrow rows as the sample has are broadcast
    several = keyed.select("doc_id", "label").join(found, "doc_id").groupBy("group", "label").agg(
        F.count("*").alias("copies")).filter("copies > 1")
    marked = grouped.join(F.broadcast(several), ["group", "label"], "left")
    return materialize(marked.select("text", "label", F.expr("if(copies > 1, group, null)").alias("group")), "grouped")


def _counted(grouped: DataFrame) -> DataFrame:
    """(term, t, n): groups of near copies with the term that have label 1, and all."""
    def terms(df: DataFrame) -> DataFrame:
        return add_columns(df, "text", "terms array<string>", lambda: _starts, rows=16).select(
            "label", "group", F.explode("terms").alias("term"))
    once = terms(grouped.filter("group is not null")).dropDuplicates(["group", "label", "term"])
    return terms(grouped.filter("group is null")).unionByName(once).groupBy("term").agg(
        F.sum("label").alias("t"), F.count("*").alias("n"))


def _without_nested(found: DataFrame) -> DataFrame:
    """Of nested beginnings with nearly the same support the longest."""
    longest = F.least(F.length("term") - 1, F.lit(PREFIXES[-1] + 1))
    starts = F.when(longest > PREFIXES[0], F.sequence(F.lit(PREFIXES[0] + 1), longest))
    longer = found.select("t", "term", F.explode(starts).alias("size")).groupBy(
        F.expr("substring(term, 1, size)").alias("term")).agg(F.max("t").alias("longer"))
    return found.join(longer, "term", "left").filter("longer is null or longer < 0.8D * t").drop("longer")


def learn(sample: DataFrame, evidence: float = 20.0, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """Learn a lexicon from (text, label): words and word beginnings that mark label 1.

    Support is counted in groups of near copies, each group of a label once. A term is taken if its log-likelihood
    ratio is ``evidence`` or more and at most one group with it in eleven has label 0; of a word's beginnings only the
    longest that covers nearly the same groups stays. Its weight is its log odds. All such terms reach the
    driver; the sample bounds them. A sample with one class, or none, gives an empty lexicon that finds every text
    clean.
    """
    grouped = _grouped(sample)
    sizes = {r.label: r.n for r in grouped.groupBy("label").agg(
        (F.count_distinct("group") + F.count_if(F.col("group").isNull())).alias("n")).collect()}
    ones, zeros = int(sizes.get(1, 0)), int(sizes.get(0, 0))
    if not ones or not zeros:
        return Lexicon((), exceptions)
    rate = ones / (ones + zeros)
    ratio = (F.col("t") * F.log(F.col("t") / F.col("n") / rate)
             + F.when(F.col("n") > F.col("t"), (F.col("n") - F.col("t"))
                      * F.log((F.col("n") - F.col("t")) / F.col("n") / (1 - rate))).otherwise(0.0)) * 2
    found = materialize(_counted(grouped).filter("t >= 3 and 10 * (n - t) <= t").filter(ratio >= evidence), "terms")
    texts = {r.term: (int(r.t), int(r.n)) for r in sorted(_without_nested(found).collect())}
    weighted = tuple((term, round(math.log(((t + 0.5) / (ones + 1)) / ((n - t + 0.5) / (zeros + 1))), 6))
                     for term, (t, n) in texts.items())
    plain = Lexicon(weighted, exceptions)
    # at most as many rows as the sample has, three numbers each
    seen = add_columns(sample, "text", "total double, length double", partial(_burdens, plain)).select(
        "total", "length", "label").toPandas()
    total, length, y = (seen[c].to_numpy(float) for c in ("total", "length", "label"))
    slope, per_length, shift = _logistic(np.stack([total, length]), y)
    if per_length > 0:
        per_length, (slope, shift) = 0.0, _logistic(total[None], y)
    # a text without matches is never toxic
    return Lexicon(weighted, exceptions, max(slope, 0.0), per_length, min(shift, -0.05))


def _burdens(lexicon: Lexicon):
    automaton = lexicon.automaton()
    return lambda texts: [list(x) for x in zip(*(burden(t, automaton) for t in texts))] or [[], []]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, ...]:
    """Newton steps of a logistic fit: slopes of the rows of ``x``, then the shift."""
    weight = 100 / max(len(y), 1)
    design = np.vstack([x, np.ones(x.shape[1])])
    w, damp = np.zeros(len(design)), np.diag([ridge] * len(x) + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(w @ design, -60, 60)))
        step = np.linalg.solve((design * (weight * p * (1 - p))) @ design.T + damp, design @ (weight * (p - y)) + damp @ w)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def toxicity(df: DataFrame, labels: DataFrame, rows: int = 20_000) -> Lexicon:
    """The lexicon learned from ``labels.toxic``; ``rows`` bounds the labelled rows that are looked at."""
    return learn(labelled_sample(df, labels, "toxic", rows))
