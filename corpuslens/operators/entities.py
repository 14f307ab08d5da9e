"""Deep text and names: content terms by year, candidate names, name pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions import czech as Z
from corpuslens.functions.order import named
from corpuslens.functions.text import richness
from corpuslens.operators import bodytext as B


def term_rows(rows: DataFrame) -> DataFrame:
    """X23, A43. year, term, n: content terms of the texts (see bodytext.texts)."""
    words = B.year_words(rows).withColumn("term", Z.content_key_column("w")).where("term is not null")
    return words.groupBy("year", "term").agg(F.sum("n").alias("n"))


def deep_years(rows: DataFrame) -> DataFrame:
    """A42, W7, H6. Content terms, vocabulary, richness, share of content and novelty of each year."""
    terms = term_rows(rows)
    first = terms.groupBy("term").agg(F.min("year").alias("first"))
    by_year = terms.join(first, "term").groupBy("year").agg(F.sum("n").alias("content"), F.count("*").alias("vocabulary"), F.avg((F.col("first") == F.col("year")).cast("double")).alias("novelty"))
    tokens = rows.groupBy("year").agg(F.count("*").alias("entries"), F.sum("token_count").alias("tokens"))
    return tokens.join(by_year, "year", "left").select("year", "entries", "tokens", F.coalesce("content", F.lit(0)).alias("content"), F.coalesce("vocabulary", F.lit(0)).alias("vocabulary"), richness(F.col("content"), F.col("vocabulary")).alias("richness"), F.try_divide("content", "tokens").alias("content_share"), "novelty")


def deep_leaders(years: DataFrame) -> DataFrame:
    """A42. One row: the years of the richest, the most novel and the densest content; of equal ones the first."""
    lead = lambda c: F.max_by("year", F.when(F.col(c).isNotNull(), F.struct(F.col(c), -F.col("year"))))
    return years.agg(lead("richness").alias("richest_year"), lead("novelty").alias("most_novel_year"), lead("content_share").alias("densest_year"))


def mentions(notes: DataFrame) -> DataFrame:
    """path, created, key, label: each name once for a note."""
    found = notes.select("path", "created", F.explode(Z.names_column("text")).alias("label"))
    return found.withColumn("key", Z.name_key_column("label")).where("key != ''").groupBy("path", "key").agg(F.min("label").alias("label"), F.min("created").alias("created"))


def preferred_labels(found: DataFrame) -> DataFrame:
    """A47. The spelling that stands for a key: score, count, shortness, alphabet."""
    counts = found.groupBy("key", "label").agg(F.count("*").alias("n")).withColumn("score", Z.surface_score_column("label"))
    return counts.groupBy("key").agg(F.min_by("label", F.struct(-F.col("score"), -F.col("n"), F.length("label"), F.col("label"))).alias("label"))


def candidates(found: DataFrame) -> DataFrame:
    """A45. Names of two notes or more: support, years, mean gap, bridge score."""
    span = F.max(F.year("created")) - F.min(F.year("created")) + 1
    millis = F.unix_millis(F.max("created")) - F.unix_millis(F.min("created"))
    stats = found.groupBy("key").agg(F.count("*").alias("support"), F.count_distinct(F.year("created")).alias("years"), F.min("created").alias("first_seen"), F.max("created").alias("last_seen"), span.alias("span"), F.when(F.count("*") >= 2, millis / 86400000 / (F.count("*") - 1)).alias("mean_gap")).where("support >= 2")
    return stats.join(preferred_labels(found), "key").withColumn("bridge", F.log2(F.col("support") + 1) * F.col("years") * F.sqrt("span"))


def pairs(found: DataFrame) -> DataFrame:
    """A46, J9, J10. Names that share two notes or more, and how strongly."""
    keys = found.groupBy("path").agg(F.array_sort(F.collect_set("key")).alias("keys"), F.min("created").alias("created"))
    both = F.flatten(F.transform("keys", lambda a: F.transform(F.filter("keys", lambda b: b > a), lambda b: F.struct(a.alias("left_key"), b.alias("right_key")))))
    rows = keys.select("created", F.explode(both).alias("p")).select("created", "p.*").groupBy("left_key", "right_key").agg(F.count("*").alias("support"), F.count_distinct(F.year("created")).alias("years"), (F.max(F.year("created")) - F.min(F.year("created")) + 1).alias("span")).where("support >= 2")
    labels = preferred_labels(found)
    joined = rows.join(labels.select(F.col("key").alias("left_key"), F.col("label").alias("left_label")), "left_key").join(labels.select(F.col("key").alias("right_key"), F.col("label").alias("right_label")), "right_key")
    return joined.withColumn("strength", F.col("support") * F.log2(F.col("years") + 1) * F.sqrt("span"))


def deep_signature(rows: DataFrame, *years: int) -> DataFrame:
    """A44 over content terms."""
    return B.period_signature(term_rows(rows), *years)


def top_candidates(rows: DataFrame, k: int = 10) -> DataFrame:
    """O5. The first names by persistence, bridge score, first appearance and length of life: list, rank, label."""
    first, last = F.year("first_seen"), F.year("last_seen")
    lists = {
        "persistent": [F.desc("support"), F.desc("years"), first.asc(), *named("label")],
        "bridge": [F.desc("bridge"), F.desc("years"), F.desc("support"), *named("label")],
        "newest": [first.desc(), F.desc("support"), F.desc("years"), *named("label")],
        "longest-lived": [(last - first).desc(), F.desc("years"), F.desc("support"), *named("label")],
    }
    out = None
    for name, order in lists.items():
        top = rows.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(name)).orderBy(*order)))  # over k rows
        own = top.select(F.lit(name).alias("list"), "rank", "label", "support", "years")
        out = own if out is None else out.unionByName(own)
    return out


def top_pairs(rows: DataFrame, k: int = 10) -> DataFrame:
    """O5. The strongest pairs of names."""
    return rows.orderBy(F.desc("strength"), F.desc("support"), F.desc("years"), *named("left_label", "right_label")).limit(k)
