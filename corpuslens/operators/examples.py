"""The notes behind figures: three of each phrase, pair of tags, bridge tag and side of a regime shift.

Notes come in order of their day (the UTC day of their time, Q-7) and path. Tags are met through the exploded tags of the
notes, an equal join with the few rows that are to be shown; a task keeps three notes of each before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions import timestamps as T
from corpuslens.functions.order import named
from corpuslens.operators import bodytext as B
from corpuslens.functions import text as X

SHOWN, NOTES = 25, 3


def _first(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("rank", turn).where(F.col("rank") <= k).select(*keys, "rank", "path")


def _dated(entries: DataFrame) -> DataFrame:
    return entries.where("created is not null").withColumn("day", T.instant_day(F.col("created")))


def pair_examples(entries: DataFrame, pairs: DataFrame, k: int = NOTES, shown: int = SHOWN) -> DataFrame:
    """J14. left, right, rank, path: the first notes that have both tags of each of the strongest pairs (see pair_lift)."""
    best = pairs.orderBy(F.desc("lift"), F.desc("support"), *named("left", "right")).limit(shown).select("left", "right")
    tags = _dated(entries).select("path", "day", "tags", F.explode(F.array_distinct("tags")).alias("left"))
    found = tags.join(F.broadcast(best), "left").where(F.array_contains("tags", F.col("right")))  # `shown` rows at most
    return _first(found, ["left", "right"], [F.col("day"), *named("path")], k)


def bridge_examples(entries: DataFrame, bridges: DataFrame, k: int = NOTES, shown: int = SHOWN) -> DataFrame:
    """J14. tag, rank, path: the first notes that have each of the strongest bridge tags (see bridge_tags)."""
    best = bridges.orderBy(F.desc("score"), F.desc("degree"), *named("tag")).limit(shown).select("tag")
    tags = _dated(entries).select("path", "day", F.explode(F.array_distinct("tags")).alias("tag"))
    return _first(tags.join(F.broadcast(best), "tag"), ["tag"], [F.col("day"), *named("path")], k)


def phrase_examples(rows: DataFrame, phrases: int = 10, k: int = NOTES, scoped: DataFrame | None = None) -> DataFrame:
    """G13, O9. The first notes of all rows that hold each of the top phrases (of the scoped rows, if there are such)."""
    top = B.recurring_phrases(rows if scoped is None else scoped).orderBy(F.desc("score"), *named("phrase")).limit(phrases)
    found = _dated(rows).select("path", "day", F.explode(X.phrases(F.col("tokens"))).alias("phrase"))
    return _first(found.join(F.broadcast(top.select("phrase")), "phrase"), ["phrase"], [F.col("day"), *named("path")], k)


def shift_examples(notes: DataFrame, shifts: DataFrame, k: int = NOTES) -> DataFrame:
    """G13. Notes on either side of each regime shift: the last days of the year before, the first of the year after."""
    own = _dated(notes).select("path", "day", F.year("created").alias("year"))
    years = F.broadcast(shifts.select("from_year", "to_year"))  # one row a year at most
    keys = ["from_year", "to_year"]
    before = _first(years.join(own, F.col("from_year") == F.col("year")), keys, [F.desc("day"), *named("path")], k)
    after = _first(years.join(own, F.col("to_year") == F.col("year")), keys, [F.asc("day"), *named("path")], k)
    side = lambda df, name: df.select(*keys, F.lit(name).alias("side"), "rank", "path")
    return side(before, "before").unionByName(side(after, "after"))
