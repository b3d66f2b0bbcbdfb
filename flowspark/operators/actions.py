"""Alerts and block decisions. Commands are produced as text and never executed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.contract import ALWAYS_ALLOWED, DEFAULT_THRESHOLD
from flowspark.functions.scalar import block_command, json_record, valid_ip_text
from flowspark.operators.lookups import lookup
from flowspark.operators.ordered import lag_in_order, running


def ip_list(lines: DataFrame, column: str = "value",
            defaults: Sequence[str] = ALWAYS_ALLOWED) -> DataFrame:
    """Addresses of a list file: comment and blank lines dropped, loopback always included."""
    ip = F.trim(F.col(column))
    listed = lines.select(ip.alias("ip")).filter((F.col("ip") != "") & ~F.col("ip").startswith("#"))
    always = lines.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(x) for x in defaults])).alias("ip"))
    return listed.union(always).distinct()


def attack_rows(scored: DataFrame, prob: str = "prob",
                threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    return scored.filter(F.col(prob) >= threshold)


def batch_id(df: DataFrame, size: int, row_index: str = "row_index", first: int | Column = 0,
             out: str = "batch_id") -> DataFrame:
    """Number of the chunk of ``size`` consecutive rows, counted from row ``first``."""
    start = first if isinstance(first, Column) else F.lit(first)
    return df.withColumn(out, F.floor((F.col(row_index) - start) / size).cast("bigint"))


def run_epoch(polls: DataFrame, keys: Sequence[str], order_col: str, n_rows: str,
              out: str = "run_id") -> DataFrame:
    """Number the runs of each stream: a new one starts whenever its row count shrinks.

    Both steps work in bounded chunks of the poll order, so one busy stream is no bottleneck.
    """
    lagged = lag_in_order(polls, keys, order_col, n_rows, "__before")
    shrank = F.coalesce(F.col(n_rows) < F.col("__before"), F.lit(False)).cast("int")
    return running(lagged, keys, order_col, {out: ("sum", shrank)}) \
        .select(*polls.columns, out)


def first_occurrence(rows: DataFrame, keys: Sequence[str], row_index: str,
                     run: Sequence[str] = ()) -> DataFrame:
    """The first row of every key per run.

    Finds the smallest row number map-side combined, then keeps rows by (run, row number):
    that pair is unique, so an address with many rows is never gathered in one task.
    """
    on = [*run, row_index]
    firsts = rows.groupBy(*run, *keys).agg(F.min(row_index).alias(row_index)) \
        .select(*[F.col(x).alias(f"__on_{x}") for x in on])
    same = [rows[f"`{x}`"].eqNullSafe(firsts[f"`__on_{x}`"]) for x in on]
    return rows.join(firsts, same, "left_semi")


def alert_records(scored: DataFrame, ts: Column, prob: str = "prob", row_index: str = "row_index",
                  threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """One JSON line per attack row, allowed source or not."""
    return attack_rows(scored, prob, threshold).select(
        json_record(ts=ts, prob=F.col(prob), row_index=F.col(row_index)).alias("value"))


def decide_actions(scored: DataFrame, allowed: DataFrame, blocked: DataFrame,
                   ip: str = "src_ip", prob: str = "prob", row_index: str = "row_index",
                   run: Sequence[str] = ("run_id",),
                   threshold: float = DEFAULT_THRESHOLD, seen: DataFrame | None = None) -> DataFrame:
    """Decision per attack row: ``run, row_index, prob, src_ip, action, reason, cmd``.

    Order of reasons: invalid address, allowed, already seen in this run, already blocked; the
    first eligible row of an address that is not blocked yet becomes a dry-run block.
    ``row_index`` must be unique within a run. ``seen`` (run, ``src_ip``) holds addresses that earlier rows of
    a run have used up; without it all rows of a run are here.
    """
    run = list(run)
    text = F.trim(F.coalesce(F.col(ip), F.lit("nan")))
    attacks = attack_rows(scored, prob, threshold).select(
        *run, F.col(row_index), F.col(prob), text.alias("__ip"))
    status = allowed.select(F.col("ip").alias("__ip"), F.lit(1).alias("w"), F.lit(0).alias("b")) \
        .union(blocked.select(F.col("ip").alias("__ip"), F.lit(0).alias("w"), F.lit(1).alias("b"))) \
        .groupBy("__ip").agg((F.max("w") == 1).alias("__allowed"), (F.max("b") == 1).alias("__blocked"))
    rows = lookup(attacks, status, ["__ip"]).select(
        *run, row_index, prob, "__ip", valid_ip_text(F.col("__ip")).alias("__valid"),
        F.coalesce("__allowed", F.lit(False)).alias("__allowed"),
        F.coalesce("__blocked", F.lit(False)).alias("__blocked"))
    firsts = rows.filter(F.col("__valid") & ~F.col("__allowed")) \
        .groupBy(*run, "__ip").agg(F.min(row_index).alias(row_index))
    if seen is not None:
        # at most one row per (run, address) on either side
        known = seen.select(*[F.col(x).alias(f"__on_{x}") for x in run], F.col("src_ip").alias("__on_ip")).distinct()
        same = [firsts[f"`{x}`"].eqNullSafe(known[f"`__on_{x}`"]) for x in run]
        firsts = firsts.join(known, [*same, firsts["__ip"] == known["__on_ip"]], "left_anti")
    firsts = firsts.select(*run, row_index, F.lit(True).alias("__first"))
    decided = lookup(rows, firsts, [*run, row_index])
    first = F.coalesce("__first", F.lit(False))
    reason = (F.when(~F.col("__valid"), F.lit("invalid_src_ip"))
              .when(F.col("__allowed"), F.lit("whitelisted"))
              .when(~first, F.lit("already_seen_this_run"))
              .when(F.col("__blocked"), F.lit("already_blocked")))
    return decided.withColumn("reason", reason).select(
        *run, row_index, prob, F.col("__ip").alias("src_ip"),
        F.when(F.col("reason").isNull(), F.lit("dry-run")).otherwise(F.lit("skip")).alias("action"),
        "reason", F.when(F.col("reason").isNull(), block_command(F.col("__ip"))).alias("cmd"))


def action_records(decisions: DataFrame, ts: Column, prob: str = "prob",
                   row_index: str = "row_index", run: Sequence[str] = ()) -> DataFrame:
    """One JSON line per decision, with the columns ``run``; absent fields are left out."""
    return decisions.select(json_record(
        ts=ts, **{x: F.col(x) for x in run}, row_index=F.col(row_index), prob=F.col(prob), src_ip=F.col("src_ip"),
        action=F.col("action"), reason=F.col("reason"), cmd=F.col("cmd")).alias("value"))


def relative_time(df: DataFrame, keys: Sequence[str], ts: str, out: str = "t_rel") -> DataFrame:
    """Time since the start of the run: one combined minimum per run, looked up by the rows."""
    starts = df.groupBy(*keys).agg(F.min(ts).alias("__start"))
    return lookup(df, starts, keys, "inner", small=True).withColumn(out, F.col(ts) - F.col("__start")) \
        .drop("__start")
