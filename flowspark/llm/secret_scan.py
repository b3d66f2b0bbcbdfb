"""Secret scan with a trigram index: Boolean trigram queries from patterns, postings, verified candidates.

Everything on rows is a Spark SQL expression; Python only reads the patterns, once, on the driver.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from flowspark.session import materialize

MASK = "[REDACTED]"


@dataclass(frozen=True)
class Rule:
    """A pattern; a match counts if the given group has at least ``least`` characters."""
    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# base kinds first, in the order in which equal starts are listed (fixed values)
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    # every run of at least 24 is a whole match of [0-9a-f]+
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[rs]k_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
)
RULES = BASE + MORE

# ---- trigram queries ----

_MOST = 64  # alternatives of one place followed at once


def _grams(text: str) -> frozenset[str]:
    return frozenset(text[i:i + 3] for i in range(len(text) - 2))


class _Query:
    """Walks a parsed pattern: the strings that can stand at the current place, and what must occur for sure."""

    def __init__(self):
        self.strings, self.needs = {""}, []

    def flush(self):
        if all(len(s) >= 3 for s in self.strings):
            sets = {_grams(s) for s in self.strings}
            # a set that holds another one adds nothing
            self.needs.append(sorted((x for x in sets if not any(y < x for y in sets)), key=sorted))
        self.strings = {""}

    def add(self, choices: set[str]):
        if len(self.strings) * len(choices) > _MOST:
            self.flush()
        self.strings = {a + b for a in self.strings for b in choices}

    def walk(self, items):
        for op, value in items:
            if op is sre.LITERAL:
                self.add({chr(value).lower()})
            elif op is sre.IN and (chars := _chars(value)) and len(chars) <= 8:
                self.add(chars)
            elif op is sre.SUBPATTERN:
                self.walk(value[3])
            elif op is sre.BRANCH:
                exact = [_exact(x) for x in value[1]]
                if all(exact) and sum(map(len, exact)) <= _MOST:
                    self.add(set().union(*exact))
                else:
                    self.flush()
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
                low, high, inner = value
                exact = _exact(inner)
                if exact and high == 1:
                    self.add(exact | ({""} if low == 0 else set()))
                elif exact and low == high and low <= 8 and len(exact) == 1:
                    self.add({next(iter(exact)) * low})
                else:
                    self.flush()
                    if low:
                        self.walk(inner)
                        self.flush()
            else:
                self.flush()


def _chars(value) -> set[str] | None:
    """The characters of a small class."""
    found = set()
    for op, x in value:
        if op is sre.LITERAL:
            found.add(chr(x).lower())
        elif op is sre.RANGE and x[1] - x[0] < 8:
            found |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
        else:
            return None
    return found


def _exact(items) -> set[str] | None:
    """All strings of a pattern part, if they are few."""
    query = _Query()
    query.walk(items)
    return query.strings if not query.needs and _finite(items) else None


def _finite(items) -> bool:
    for op, value in items:
        if op is sre.LITERAL or op is sre.IN and (c := _chars(value)) and len(c) <= 8:
            continue
        if op is sre.SUBPATTERN and _finite(value[3]):
            continue
        if op is sre.BRANCH and all(map(_finite, value[1])):
            continue
        if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[1] == 1 and _finite(value[2]):
            continue
        return False
    return True


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """What lower-cased text with a match must hold: all of the list, of each entry one of its sets, whole.

    Empty if the pattern has no mandatory trigram.
    """
    query = _Query()
    query.walk(parser.parse(pattern))
    query.flush()
    return query.needs


# ---- index ----

def _text(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def build_index(df: DataFrame, rules: tuple[Rule, ...], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Stored postings (gram, key, version) of all trigrams that the rules' queries name.

    Rows are ordered by gram within each file, so a reader of few grams skips most of it.
    """
    grams = sorted({g for r in rules for need in trigram_query(r.pattern) for some in need for g in some})
    if not grams:
        return df.sparkSession.createDataFrame([], "gram string, key long, version long")
    low = F.lower(_text(text))
    rows = df.select(F.col(key).alias("key"), F.xxhash64(_text(text)).alias("version"), low.alias("low"))
    # a comparison per trigram of the rules, so its cost is the text's length times their number
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams]))
    # an inner explode would be filtered by its array's size first, and so compare everything twice
    postings = rows.select("key", "version", held.alias("grams")).select(
        F.explode_outer("grams").alias("gram"), "key", "version").filter("gram is not null")
    return materialize(postings.sortWithinPartitions("gram"), "postings")


def candidates(postings: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(key, version, kinds): documents whose postings meet the trigram query of a rule."""
    wanted = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    grams = sorted({g for q in wanted.values() for need in q for some in need for g in some})
    # a document has at most as many postings here as the rules have trigrams
    met = postings.filter(F.col("gram").isin(grams)).groupBy("key", "version").agg(F.collect_set("gram").alias("grams"))
    kinds = []
    for kind, query in wanted.items():
        every = F.lit(True)
        for need in query:
            some = F.lit(False)
            for held in need:
                known = F.array(*[F.lit(g) for g in sorted(held)])
                some = some | (F.size(F.array_intersect(F.col("grams"), known)) == len(held))
            every = every & some
        kinds.append(F.when(every, F.lit(kind)))
    found = met.select("key", "version", F.array_compact(F.array(*kinds) if kinds else F.array().cast("array<string>"))
                       .alias("kinds"))
    return found.filter("size(kinds) > 0")


# ---- verification ----

def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _running(values: str) -> str:
    """SQL for running sums of an int array, in blocks, so that long arrays stay cheap."""
    block = 256
    blocks = f"transform(sequence(0, greatest(size({values}) - 1, 0) div {block}), b -> slice({values}, b * {block} + 1, {block}))"
    total = "aggregate(x, 0, (s, v) -> s + v)"
    sums = f"transform({blocks}, x -> {total})"
    return (f"flatten(transform({blocks}, (x, b) -> transform(x, (v, i) -> "
            f"aggregate(slice({sums}, 1, b), 0, (s, v) -> s + v) + aggregate(slice(x, 1, i + 1), 0, (s, v) -> s + v))))")


def _verified(df: DataFrame, rules: tuple[Rule, ...], key: str, text: str) -> DataFrame:
    """``df`` with, for each rule, the texts between matches, the matches and the values that are checked."""
    found = candidates(build_index(df, rules, key, text), rules)
    rows = df.withColumn("__body", _text(text)).withColumn("__version", F.xxhash64("__body"))
    found = found.withColumnsRenamed({"key": "__key", "version": "__v", "kinds": "__kinds"})
    rows = rows.join(found, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__version") == F.col("__v")), "left")
    added = {}
    for r in rules:
        may = f"array_contains(__kinds, '{r.kind}')" if trigram_query(r.pattern) else f"rlike(__body, {_quoted(r.pattern)})"
        # text between matches and matches take turns
        added[f"__gaps_{r.kind}"] = F.expr(f"CASE WHEN {may} THEN split(__body, {_quoted(r.pattern)}, -1) END")
        added[f"__hits_{r.kind}"] = F.expr(f"CASE WHEN {may} THEN regexp_extract_all(__body, {_quoted(r.pattern)}, 0) END")
        added[f"__checked_{r.kind}"] = F.expr(
            f"CASE WHEN {may} THEN regexp_extract_all(__body, {_quoted(r.pattern)}, {r.group}) END")
    return rows.withColumns(added)


def _spans(rule: Rule, place: int) -> Column:
    gaps, hits, checked = (f"__{n}_{rule.kind}" for n in ("gaps", "hits", "checked"))
    steps = f"__steps_{rule.kind}"
    return F.expr(
        f"""CASE WHEN size({hits}) > 0 THEN filter(transform({hits}, (h, i) -> named_struct(
        'start', {steps}[i] - char_length(h), 'place', {place}, 'kind', '{rule.kind}', 'end', {steps}[i],
        'ok', char_length({checked}[i]) >= {rule.least})), s -> s.ok) END""")


def scan(df: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: ``key`` and ``spans``, array<struct<start, place, kind, end, ok>>.

    Spans are code points, end exclusive, ordered by start, then by the order of the rules. Null and empty
    texts have none. Repeated rows, and rows without key, are found by key and text together, and each
    give a row.
    """
    rows = _verified(df.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), rules, "doc_id", "text")
    narrow = rows.select("doc_id", *[c for c in rows.columns if c.startswith(("__gaps", "__hits", "__checked"))])
    sums = {}
    for r in rules:
        lengths = (f"transform(__hits_{r.kind}, (h, i) -> char_length(__gaps_{r.kind}[i]) + char_length(h))")
        sums[f"__lengths_{r.kind}"] = F.expr(f"CASE WHEN size(__hits_{r.kind}) > 0 THEN {lengths} END")
    summed = narrow.withColumns(sums).withColumns(
        {f"__steps_{r.kind}": F.expr(f"CASE WHEN size(__hits_{r.kind}) > 0 THEN {_running(f'__lengths_{r.kind}')} END")
         for r in rules})
    every = F.array_sort(F.flatten(F.array_compact(F.array(*[_spans(r, i) for i, r in enumerate(rules)]))))
    return summed.select(F.col("doc_id").alias(key), every.alias("spans"))


def joined(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(df: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text",
           mask: str = MASK) -> DataFrame:
    """``df`` with every found secret of its text replaced by ``mask``; other columns and null texts stay.

    Rules take turns: each looks for its pattern in what those before it have left. Only documents that are
    candidates are changed.
    """
    columns = df.columns
    found = candidates(build_index(df, rules, key, text), rules).withColumnsRenamed(
        {"key": "__key", "version": "__v", "kinds": "__kinds"})
    rows = df.withColumn("__version", F.xxhash64(_text(text))).join(
        found, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__version") == F.col("__v")), "left")
    for r in rules:
        quoted, col = _quoted(r.pattern), f"`{text}`"
        may = f"array_contains(__kinds, '{r.kind}')" if trigram_query(r.pattern) else f"rlike({col}, {quoted})"
        rows = rows.withColumn("__gaps", F.expr(f"CASE WHEN {may} THEN split({col}, {quoted}, -1) END")) \
            .withColumn("__hits", F.expr(f"CASE WHEN {may} THEN regexp_extract_all({col}, {quoted}, 0) END")) \
            .withColumn("__checked", F.expr(f"CASE WHEN {may} THEN regexp_extract_all({col}, {quoted}, {r.group}) END"))
        changed = (f"array_join(transform(__gaps, (g, i) -> concat(g, CASE WHEN i >= size(__hits) THEN '' "
                   f"WHEN char_length(__checked[i]) >= {r.least} THEN {_quoted(mask)} ELSE __hits[i] END)), '')")
        rows = rows.withColumn(text, F.expr(f"CASE WHEN size(__hits) > 0 THEN {changed} ELSE {col} END"))
    return rows.select(*columns)
