"""How tags go together: lift, bridges, weekday bias, return, persistence, length coupling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions import timestamps as T
from corpuslens.functions.order import named, sorted_texts

TOP = 10


def qualified(entries: DataFrame, least: int = 1) -> DataFrame:
    """A28. Entries that keep a qualifying tag, with those tags only."""
    if least <= 1:  # every tag qualifies
        return entries.where(F.size("tags") > 0)
    rows = entries.withColumn("tag", F.explode("tags"))
    good = rows.groupBy("tag").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("tag")
    kept = rows.join(good, "tag").groupBy("path").agg(sorted_texts(F.collect_set("tag")).alias("tags"))
    return entries.drop("tags").join(kept, "path")


def tag_counts(entries: DataFrame) -> DataFrame:
    return entries.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def _pairs(tags: Column) -> Column:
    """Pairs of sorted tags, by place."""
    return F.flatten(F.transform(tags, lambda a, i: F.transform(F.filter(tags, lambda b, j: j > i), lambda b: F.struct(a.alias("left"), b.alias("right")))))


def pair_counts(entries: DataFrame) -> DataFrame:
    """J3. Unordered pairs of tags of one entry, left before right."""
    return entries.select(F.explode(_pairs(F.col("tags"))).alias("p")).groupBy("p.left", "p.right").agg(F.count("*").alias("support"))


def tag_grain(entries: DataFrame) -> DataFrame:
    """left, right, kind, support in one pass: all entries (kind 0, both empty), single tags (1, right empty), pairs of tags (2).

    The kind is an aggregate and the names are never null, so that no filter goes below the exchange, which the branches
    of a plan then share.
    """
    none = F.lit("")
    cell = lambda a, b, kind: F.struct(F.coalesce(a, none).alias("left"), F.coalesce(b, none).alias("right"), F.lit(kind).alias("kind"))
    pairs = F.transform(_pairs(F.col("tags")), lambda p: cell(p["left"], p["right"], 2))
    cells = F.concat(F.array(cell(none, none, 0)), F.transform("tags", lambda a: cell(a, none, 1)), pairs)
    rows = entries.select(F.explode(cells).alias("p")).groupBy("p.left", "p.right")
    return rows.agg(F.count("*").alias("support"), F.max("p.kind").alias("kind"))


def _single(grain: DataFrame) -> DataFrame:
    return grain.where("kind = 1").select(F.col("left").alias("tag"), F.col("support").alias("n"))


def pair_lift(entries: DataFrame, top: int = TOP) -> DataFrame:
    """A29, J4. Lift of pairs with support of two or more."""
    grain = tag_grain(entries)
    return pair_lift_of(grain.where("kind = 2"), _single(grain), grain.where("kind = 0").select(F.col("support").alias("entries")), top)


def pair_lift_of(pairs: DataFrame, counts: DataFrame, n: DataFrame, top: int = TOP) -> DataFrame:
    """pair_lift() from the pairs (left, right, support), the tags (tag, n) and the number of entries."""
    both = pairs.where("support >= 2").join(counts.select(F.col("tag").alias("left"), F.col("n").alias("nl")), "left").join(counts.select(F.col("tag").alias("right"), F.col("n").alias("nr")), "right").join(F.broadcast(n))
    lift = (F.col("support") / F.col("entries")) / ((F.col("nl") / F.col("entries")) * (F.col("nr") / F.col("entries")))
    return both.select("left", "right", "support", lift.alias("lift")).orderBy(F.desc("lift"), F.desc("support"), *named("left", "right")).limit(top)


def triangles(edges: DataFrame) -> DataFrame:
    """tag, closed: in how many triangles of the edges (left, right; each once) a tag is.

    Edges go from the tag of fewer neighbours to that of more. Then no tag has more than sqrt(2 E) of them going out, so
    the wedges that are met at their low end are at most E ** 1.5, whatever hub there is.
    """
    ends = edges.select(F.explode(F.array("left", "right")).alias("tag")).groupBy("tag").agg(F.count("*").alias("degree"))
    ranked = edges.join(ends.select(F.col("tag").alias("left"), F.col("degree").alias("dl")), "left").join(ends.select(F.col("tag").alias("right"), F.col("degree").alias("dr")), "right")
    l, r = F.struct(F.col("dl").alias("d"), F.col("left").alias("t")), F.struct(F.col("dr").alias("d"), F.col("right").alias("t"))
    directed = ranked.select(F.least(l, r).alias("a"), F.greatest(l, r).alias("b"))
    wedges = directed.join(directed.withColumnRenamed("b", "c"), "a").where("b < c").select("a", "b", "c")
    closed = wedges.join(directed.select(F.col("a").alias("b"), F.col("b").alias("c")), ["b", "c"])
    return closed.select(F.explode(F.array("a.t", "b.t", "c.t")).alias("tag")).groupBy("tag").agg(F.count("*").alias("closed"))


def bridge_tags(entries: DataFrame, top: int = TOP) -> DataFrame:
    """A30, J5, M11. Degree x (1 - clustering) x ln(1 + frequency)."""
    grain = tag_grain(entries)
    pairs = grain.where("kind = 2").select("left", "right")
    degree = pairs.select(F.explode(F.array("left", "right")).alias("tag")).groupBy("tag").agg(F.count("*").alias("degree"))
    rows = _single(grain).join(degree, "tag", "left").join(triangles(pairs), "tag", "left").na.fill(0, ["degree", "closed"])
    cluster = F.when(F.col("degree") >= 2, F.col("closed") / (F.col("degree") * (F.col("degree") - 1) / 2)).otherwise(0.0)
    rows = rows.withColumn("clustering", cluster).withColumn("score", F.col("degree") * (1 - F.col("clustering")) * F.log1p("n"))
    return rows.select("tag", "n", "degree", "clustering", "score").orderBy(F.desc("score"), F.desc("degree"), *named("tag")).limit(top)


def weekday_bias(entries: DataFrame, top: int = TOP) -> DataFrame:
    """A31. A tag's share on a weekday over the weekday's share of all entries; support of two or more."""
    days = entries.groupBy("weekday").agg(F.count("*").alias("day_n"))
    n = entries.agg(F.count("*").alias("entries"))
    rows = entries.select("weekday", F.explode("tags").alias("tag")).groupBy("tag", "weekday").agg(F.count("*").alias("support")).where("support >= 2").join(tag_counts(entries), "tag").join(F.broadcast(days), "weekday").join(F.broadcast(n))
    bias = (F.col("support") / F.col("n")) / (F.col("day_n") / F.col("entries"))
    return rows.select("tag", T.monday_first(F.col("weekday")).alias("weekday"), "support", bias.alias("bias")).orderBy(F.desc("bias"), F.desc("support"), *named("tag"), "weekday").limit(top)


def tag_gaps(entries: DataFrame) -> DataFrame:
    """M16. Mean gap of a tag's distinct days; null for one day."""
    return entries.select("epoch_day", F.explode("tags").alias("tag")).groupBy("tag").agg(F.count_distinct("epoch_day").alias("days"), F.when(F.count_distinct("epoch_day") >= 2, (F.max("epoch_day") - F.min("epoch_day")) / (F.count_distinct("epoch_day") - 1)).alias("mean_gap"))


def fastest_tag(entries: DataFrame) -> DataFrame:
    """A32."""
    return tag_gaps(entries).where("mean_gap is not null").orderBy("mean_gap", F.desc("days"), *named("tag")).limit(1)


def persistence(entries: DataFrame) -> DataFrame:
    """A33, M12. Active years of a tag, its longest run of years and their ratio."""
    years = entries.select("year", F.explode("tags").alias("tag")).distinct()
    islands = years.withColumn("island", F.col("year") - F.row_number().over(Window.partitionBy("tag").orderBy("year"))).groupBy("tag", "island").agg(F.count("*").alias("run"))
    return islands.groupBy("tag").agg(F.sum("run").alias("active_years"), F.max("run").alias("longest_run")).withColumn("ratio", F.col("longest_run") / F.col("active_years"))


def persistence_leaders(entries: DataFrame) -> DataFrame:
    """A33. The tag of the longest run of years and the tag of the most active years; the other measure, then the name, on ties."""
    rows = persistence(entries)
    first = rows.orderBy(F.desc("longest_run"), F.desc("active_years"), *named("tag")).limit(1).withColumn("leader", F.lit("most persistent"))
    return first.unionByName(rows.orderBy(F.desc("active_years"), F.desc("longest_run"), *named("tag")).limit(1).withColumn("leader", F.lit("longest lifespan")))


def length_coupling(entries: DataFrame, top: int = TOP) -> DataFrame:
    """A34. Mean words with a tag less the mean of all entries: the ten highest and the ten lowest."""
    base = entries.agg(F.avg("word_count").alias("base"))
    rows = entries.select("word_count", F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"), F.avg("word_count").alias("mean_words")).join(F.broadcast(base)).select("tag", "n", (F.col("mean_words") - F.col("base")).alias("delta"))
    up = rows.where("delta > 0").orderBy(F.desc("delta"), *named("tag")).limit(top).withColumn("side", F.lit("longer"))
    return up.unionByName(rows.where("delta < 0").orderBy("delta", *named("tag")).limit(top).withColumn("side", F.lit("shorter")))


def tag_distribution(entries: DataFrame) -> DataFrame:
    """A27, M7, M8. Entropy and concentration of tags, for each year and over all (year null)."""
    rows = entries.select("year", F.explode("tags").alias("tag"))
    cells = rows.groupBy("year", "tag").agg(F.count("*").alias("n")).unionByName(rows.groupBy("tag").agg(F.count("*").alias("n")).withColumn("year", F.lit(None).cast("int")))
    return spread_of(cells)


def spread_of(cells: DataFrame) -> DataFrame:
    """tag_distribution() from the counts (year, tag, n)."""
    shares = cells.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("year")))
    return shares.groupBy("year").agg(F.count("*").alias("tags"), (-F.sum(F.col("p") * F.log2("p"))).alias("entropy"), F.sum(F.col("p") * F.col("p")).alias("concentration"))


def all_tag_structures(entries: DataFrame, least: int = 1) -> dict[str, DataFrame]:
    """Every table of this module over qualified entries."""
    own = qualified(entries, least)
    return {f.__name__: f(own) for f in (pair_lift, bridge_tags, weekday_bias, fastest_tag, persistence, length_coupling, tag_distribution)}
