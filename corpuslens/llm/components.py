"""Connected components by alternating large and small stars, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import discard, materialize


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component: the smallest node reachable, for every node that has an edge to another.

    Stars are joined, never gathered: a node with very many neighbours is a skewed join key, which can be split.
    """
    ordered = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = materialize(ordered.select(F.least(a, b).alias("low"), F.greatest(a, b).alias("high")).distinct())
    before = _state(now)
    while before[0]:
        # Large star: each node sends its larger neighbours to the smallest of its neighbourhood.
        both = now.select(F.col("low").alias("u"), F.col("high").alias("v")).unionByName(now.select(F.col("high").alias("u"), F.col("low").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = materialize(both.join(least, "u").where("v > u and v != m").select(F.col("m").alias("low"), F.col("v").alias("high")).distinct())
        # Small star: each node and its smaller neighbours go to the smallest of them.
        under = large.groupBy("high").agg(F.min("low").alias("m"))
        small = large.join(under, "high").where("low != m").select(F.col("m").alias("low"), F.col("low").alias("high")).unionByName(under.select(F.col("m").alias("low"), "high"))
        after = materialize(small.distinct())
        discard(now)
        discard(large)
        now, state = after, _state(after)
        if state == before:
            break
        before = state
    leaves = now.select(F.col("high").alias("node"), F.col("low").alias("component"))
    return leaves.unionByName(now.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct())
