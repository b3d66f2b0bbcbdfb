"""Exact quantiles by distributed selection.

``percentile`` and ``median`` keep every distinct value of a group in one task. Here one scan makes a quantile sketch per
group and column, which gives each wanted quantile a bracket: two values around it with a few of 10,000 values between
them. A second scan counts exactly: values inside a bracket one by one, equal ones merged map-side, the others as one
number per gap between brackets. Sums of these counts give the ranks. Groups of at most ``LEFT`` values are
counted whole. So any number of columns and probabilities takes two scans; a rank that a bracket misses is
found by one more scan that counts all values of its group and column, so results never depend on the sketch.

The scans run when the function is called, since each decides what the next one counts; their few result rows
are written to the session's shared folder.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowspark import session
from flowspark.functions.scalar import quoted, sql_text
from flowspark.operators.lookups import FEW_ROWS
from flowspark.session import materialize

# groups of at most so many values are counted without brackets
LEFT = 1 << 18
# ranks of the sketch are right to this share; brackets begin and end two shares from the wanted one
ACCURACY = 10_000
_MANTISSA = 1 << 52
_LEAST_NORMAL = "2.2250738585072014E-308D"


def sql_order_key(x: str) -> str:
    """SQL text: a BIGINT that sorts like the DOUBLE ``x``; NULL for NULL. NaN must be gone.

    Size and fraction are taken apart exactly: powers of two and divisions by them do not round.
    """
    a = f"abs({x})"
    # the logarithm may be off by one next to a power of two
    e = f"floor(log2({a}))"
    e = f"({e} + CASE WHEN {a} < pow(2D, {e}) THEN -1 WHEN {a} >= 2D * pow(2D, {e}) THEN 1 ELSE 0 END)"
    size = (f"CASE WHEN {a} = double('Infinity') THEN {2047 * _MANTISSA}L "
            f"WHEN {a} >= {_LEAST_NORMAL} THEN CAST({e} + 1023 AS BIGINT) * {_MANTISSA}L + "
            f"CAST(({a} / pow(2D, {e}) - 1D) * {_MANTISSA}D AS BIGINT) "
            f"ELSE CAST({a} / {_LEAST_NORMAL} * {_MANTISSA}D AS BIGINT) END")
    return f"CASE WHEN {x} = 0D THEN 0L WHEN {x} > 0D THEN {size} WHEN {x} < 0D THEN -({size}) END"


def sql_from_key(k: str) -> str:
    """SQL text: the DOUBLE of an order key."""
    a = f"abs({k})"
    size = (f"CASE WHEN {a} = {2047 * _MANTISSA}L THEN double('Infinity') WHEN {a} >= {_MANTISSA}L "
            f"THEN pow(2D, CAST(shiftright({a}, 52) - 1023 AS DOUBLE)) * (1D + CAST({a} % {_MANTISSA}L AS DOUBLE) / {_MANTISSA}D) "
            f"ELSE CAST({a} AS DOUBLE) / {_MANTISSA}D * {_LEAST_NORMAL} END")
    return f"CASE WHEN {k} < 0 THEN -({size}) ELSE {size} END"


def _values(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """(groups, v0, v1, ..): the columns as numbers without NaN; the keys under names of their own."""
    groups = [f"g{i}" for i in range(len(keys))]
    return df.selectExpr(*[f"{quoted(x)} AS {g}" for x, g in zip(keys, groups)], *[
        f"nanvl(CAST({quoted(x)} AS DOUBLE), NULL) AS v{i}" for i, x in enumerate(columns)]), groups


def _brackets(values: DataFrame, columns: int, keys: list[str], probs: list[float], left: int) -> DataFrame:
    """(keys, ci, n, lo0, hi0, lo1, ..) after one scan: per group and column a bracket for each of the sorted probabilities."""
    near = 2 / ACCURACY
    ends = ", ".join(f"{max(p - near, 0.0)!r}D, {min(p + near, 1.0)!r}D" for p in probs)
    rows = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.array(*[F.expr(
        f"struct({i} AS ci, count(v{i}) AS n, percentile_approx(v{i}, array({ends}), {ACCURACY}) AS at)")
        for i in range(columns)]).alias("e"))
    each = rows.filter("rows > 0").select(*keys, F.explode("e").alias("e")).select(*keys, "e.*")
    whole = F.col("n") <= left

    def bound(j: int, p: float, low: bool):
        # from the first to the last they never fall
        side = [F.col("at")[2 * i + (not low)] for i in (range(j, len(probs)) if low else range(j + 1))]
        value = side[0] if len(side) == 1 else F.least(*side) if low else F.greatest(*side)
        beyond = p <= near if low else p >= 1 - near
        return F.when(whole | F.lit(beyond), F.lit(-math.inf if low else math.inf)).otherwise(value)

    return each.select(*keys, "ci", "n", *[x for j, p in enumerate(probs) for x in (
        bound(j, p, True).alias(f"lo{j}"), bound(j, p, False).alias(f"hi{j}"))])


def _counted(values: DataFrame, columns: int, brackets: DataFrame, keys: list[str], probs: list[float]) -> DataFrame:
    """(keys, ci, v, ids) after one scan: values at the wanted ranks; ``v`` is NULL for a rank outside its bracket.

    Probability j has the ranks 2 * j below and 2 * j + 1 above its position.
    """
    each = ", ".join(f"struct({i} AS ci, v{i} AS v)" for i in range(columns))
    entries = values.selectExpr(*keys, f"explode(array({each})) AS e").select(*keys, "e.*").filter("v IS NOT NULL")
    ranges = brackets.withColumnsRenamed({x: f"__on_{x}" for x in [*keys, "ci"]})
    # a row per group and column; with many groups a plain join
    if ranges.count() <= FEW_ROWS:
        ranges = F.broadcast(ranges)
    same = [entries[f"`{k}`"].eqNullSafe(ranges[f"`__on_{k}`"]) for k in keys]
    placed = entries.join(ranges, [*same, entries["ci"] == ranges["__on_ci"]])
    gap = " + ".join(f"if(v > hi{j}, 1, 0)" for j in range(len(probs)))
    inside = " OR ".join(f"(v >= lo{j} AND v <= hi{j})" for j in range(len(probs)))
    # values of one gap outside all brackets lie before those inside
    counts = placed.groupBy(*keys, "ci", "n", F.expr(gap).alias("gap"), F.expr(f"if({inside}, v, NULL)").alias("v")) \
        .agg(F.count(F.lit(1)).alias("m"))
    upto = F.sum("m").over(Window.partitionBy(*keys, "ci").orderBy("gap", F.asc_nulls_first("v"))
                           .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranks = ", ".join(f"struct({2 * j} AS id, CAST(floor({p!r}D * (n - 1)) AS BIGINT) AS rank), "
                      f"struct({2 * j + 1} AS id, CAST(ceil({p!r}D * (n - 1)) AS BIGINT) AS rank)"
                      for j, p in enumerate(probs))
    ids = F.expr(f"transform(filter(array({ranks}), t -> t.rank >= upto - m AND t.rank < upto), t -> t.id)")
    return counts.withColumn("upto", upto).withColumn("ids", ids).filter("size(ids) > 0").select(*keys, "ci", "v", "ids")


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
                    keys: Sequence[str] = (), left: int = LEFT) -> DataFrame:
    """Exact quantiles (linear interpolation), one row per (key, column, probability).

    Result columns: ``keys``, ``name``, ``prob``, ``value``. NULL and NaN are left out; a column without values
    gets a NULL value; NULL is a group key like any other. Reads ``df`` two or three times.
    """
    names, columns, probs = list(keys), list(columns), sorted(float(p) for p in probs)
    values, keys = _values(df, columns, names)
    groups = session.materialize(_brackets(values, len(columns), keys, probs, left), "brackets")
    found = materialize(_counted(values, len(columns), groups, keys, probs), "found")
    on = [*keys, "ci"]
    missed = found.filter("v IS NULL").select(*[F.col(x).alias(f"__on_{x}") for x in on]).distinct()
    if not missed.isEmpty():
        again = groups.join(missed, [groups[f"`{x}`"].eqNullSafe(missed[f"`__on_{x}`"]) for x in on], "left_semi").withColumns(
            {f"{side}{j}": F.lit(end) for j in range(len(probs)) for side, end in (("lo", -math.inf), ("hi", math.inf))})
        again = session.materialize(again, "brackets")
        more = materialize(_counted(values, len(columns), again, keys, probs), "found")
        found = found.join(missed, [found[f"`{x}`"].eqNullSafe(missed[f"`__on_{x}`"]) for x in on], "left_anti").unionByName(more)
    picks = found.select(*on, "v", F.explode("ids").alias("id"))
    sides = picks.groupBy(*on).agg(F.map_from_entries(F.collect_list(F.struct("id", "v"))).alias("at"))
    # one row per group and column, with or without values
    renamed = sides.withColumnsRenamed({x: f"__on_{x}" for x in on})
    joined = groups.select(*on, "n").join(
        renamed, [groups[f"`{x}`"].eqNullSafe(renamed[f"`__on_{x}`"]) for x in on], "left")

    def value(j: int, p: float):
        lower, upper = F.col("at")[2 * j], F.col("at")[2 * j + 1]
        position = F.lit(p) * (F.col("n") - 1)
        return lower + F.when(upper == lower, F.lit(0.0)).otherwise((upper - lower) * (position - F.floor(position)))

    results = [F.struct(F.lit(p).alias("prob"), value(j, p).alias("value")) for j, p in enumerate(probs)]
    name = F.element_at(F.array(*[F.lit(x) for x in columns]), F.col("ci") + 1)
    return joined.select(*keys, name.alias("name"), F.explode(F.array(*results)).alias("q")).select(
        *[F.col(g).alias(x) for g, x in zip(keys, names)], "name", "q.prob", "q.value")


def quantile_row(df: DataFrame, outputs: dict[str, tuple[str, float]], keys: Sequence[str] = (),
                 left: int = LEFT) -> DataFrame:
    """Exact quantiles side by side: ``outputs`` maps a name to (column, probability)."""
    columns = list(dict.fromkeys(x for x, _ in outputs.values()))
    probs = list(dict.fromkeys(p for _, p in outputs.values()))
    long = exact_quantiles(df, columns, probs, keys, left)
    return long.groupBy(*keys).agg(*[F.expr(
        f"max(CASE WHEN name = {sql_text(x)} AND prob = {float(p)!r}D THEN value END) "
        f"AS {quoted(out)}") for out, (x, p) in outputs.items()])


def medians(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (),
            left: int = LEFT) -> DataFrame:
    """Exact median of every column, named like the column."""
    return quantile_row(df, {x: (x, 0.5) for x in columns}, keys, left)
