"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridspark.llm.store import Scratch


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Every larger neighbour of a node is tied to the least node of the neighbourhood.

    The least nodes are stored, so that the join reads two plain shuffles and Spark can split a hub.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = scratch.keep(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{name}-least")
    return both.filter("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of them. Edges run from larger to smaller."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, component) of every node that has an edge; `edges` has two columns, the component is its least id.

    Rounds are stored one after the other and stop when the edges no longer change, after a number of
    rounds that grows with the logarithm of the longest path. Only counts reach the driver.
    """
    a, b = edges.columns
    current = scratch.keep(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), f"{name}-0")
    seen, turn = _fingerprint(current), 0
    while True:
        turn += 1
        after = scratch.keep(_small_star(_large_star(current, scratch, f"{name}-{turn}")), f"{name}-{turn}")
        now = _fingerprint(after)
        scratch.drop(f"{name}-{turn - 1}")
        if now == seen:
            break
        current, seen = after, now
    tied = after.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return tied.unionByName(tied.select(F.col("component").alias("id"), "component").distinct())
