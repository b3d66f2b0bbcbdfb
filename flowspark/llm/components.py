"""Connected components of a link table, as rounds of Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flowspark.session import materialize


def _least(links: DataFrame) -> DataFrame:
    """Per node of directed links (u, v), the smallest of it and its neighbours."""
    return materialize(links.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "least")


def _large_star(links: DataFrame) -> DataFrame:
    both = materialize(links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))), "both")
    moved = both.filter("v > u").join(_least(both), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return materialize(moved.filter("u > v").distinct(), "large-star")


def _small_star(links: DataFrame) -> DataFrame:
    least = _least(links)
    moved = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
    own = least.select("u", F.col("m").alias("v"))
    return materialize(moved.unionByName(own).distinct(), "small-star")


def _state(links: DataFrame):
    return links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b); root is the smallest node of its component.

    Alternates two steps that hang each node's larger (smaller) neighbours on its smallest neighbour,
    until nothing changes. Every step is written to the shared folder, so lost executors redo one step
    at most, and joins of stored tables let Spark split crowded nodes.
    """
    now = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                      .filter("u > v").distinct(), "edges")
    before = _state(now)
    while True:
        now = _small_star(_large_star(now))
        state = _state(now)
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = state
