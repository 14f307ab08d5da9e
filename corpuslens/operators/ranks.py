"""Exact order statistics of whole numbers, with plain aggregates: no sort or buffer holds all values of a group.

A rank is looked for in rounds. Each splits the interval that holds it into BINS equal bins, adds up the weights by bin
(in parallel, with partial sums), and goes on in the bin where the sum from below reaches the rank. ROUNDS rounds are
exact for values from 0 to BINS ** ROUNDS - 1. All ranks of all groups go through the same rounds together. Values come
as cells (a value of a group and its weights), which are aggregated once; the rounds read that exchange again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS, ROUNDS = 1 << 16, 3


def search(cells: DataFrame, ranks: DataFrame, group: list[str]) -> DataFrame:
    """group, rank, value: for each rank the smallest value up to which the weights reach `goal`.

    cells: group, key (long, from 0), and one column for each kind of weight. ranks: group, rank (a name), kind (the
    weight's column), goal; a few rows for each group. A group without cells has no value.
    """
    kinds = [c for c in cells.columns if c not in (*group, "key")]
    weight = F.coalesce(*(F.when(F.col("kind") == k, F.col(k).cast("decimal(38,0)")) for k in kinds))
    state = ranks.select(*group, "rank", "kind", F.col("goal").cast("decimal(38,1)").alias("goal"), F.lit(0).cast("long").alias("low"), F.lit(0).cast("decimal(38,0)").alias("below"))
    for turn in range(ROUNDS):
        width = BINS ** (ROUNDS - 1 - turn)
        inside = cells.join(F.broadcast(state), group or None, "inner" if group else "cross")
        inside = inside.where((F.col("key") >= F.col("low")) & (F.col("key") < F.col("low") + F.lit(width * BINS)))
        bins = inside.groupBy(*group, "rank", "kind", "goal", "low", "below", ((F.col("key") - F.col("low")) / width).cast("long").alias("bin")).agg(F.sum(weight).alias("own"))
        # At most BINS rows for each rank.
        order = Window.partitionBy(*group, "rank").orderBy("bin")
        run = bins.withColumn("reach", F.col("below") + F.sum("own").over(order))
        first = F.min_by(F.struct("kind", "goal", (F.col("low") + F.col("bin") * width).alias("low"), (F.col("reach") - F.col("own")).cast("decimal(38,0)").alias("below")), "bin")
        state = run.where("reach >= goal").groupBy(*group, "rank").agg(first.alias("s")).select(*group, "rank", "s.*")
    return state.select(*group, "rank", F.col("low").alias("value"))


def place(many: Column, share: float) -> tuple[Column, Column, Column]:
    """M3. Of a percentile of so many values: the two places (from 1) that it lies between, and how far it is past the first."""
    at = (many - 1) * F.lit(share)
    return F.floor(at) + 1, F.ceil(at) + 1, at - F.floor(at)


def between(low: Column, high: Column, past: Column) -> Column:
    """Linear interpolation."""
    return low + (high - low) * past
