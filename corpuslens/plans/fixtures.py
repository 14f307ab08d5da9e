"""The driver's tables read as entries, notes and a link graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.operators.corpus import to_entries


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table that is read in fewer partitions than there are cores is dealt out, since its texts cost time; larger ones stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is an entry: its quantity are its words, the last shipment its revision, three labels its tags."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").cast("long").alias("w"), F.max("l_shipdate").alias("updated"))
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    path = F.concat(F.lit("order/"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0"), F.lit(".md"))
    notes = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(path.alias("path"), F.col("o_orderdate").cast("timestamp").alias("created"), F.col("updated").cast("timestamp").alias("updated"), F.coalesce("w", F.lit(0)).alias("word_count"), F.array(F.lower("o_orderpriority"), F.lower("c_mktsegment"), F.lower("o_orderstatus")).alias("tags"))
    return to_entries(notes)


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is a note with a made-up time of creation; its language and source are its tags."""
    created = F.timestamp_seconds(F.lit(1514764800) + (F.col("doc_id") * 102947 % 3155760) * 60)
    docs = spread(table(spark, sf_dir, "documents"))
    path = F.concat("source", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".md"))
    updated = F.when(F.col("doc_id") % 3 == 0, created + F.make_interval(hours=F.col("doc_id") * 31 % 2000)).otherwise(created)
    from corpuslens.functions.text import tokens

    return docs.select(path.alias("path"), created.alias("created"), updated.alias("updated"), "text", F.array("lang", "source").alias("tags"), F.size(tokens(F.col("text"))).cast("long").alias("word_count"))


def linked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is a note: its hrefs and one made-up link are its links, the language of its url is folder and tag."""
    pages = spread(table(spark, sf_dir, "pages"))
    n = pages.agg(F.count("*").alias("n"))
    name = lambda c: F.concat(F.lit("page/"), c.cast("string"), F.lit(".md"))
    lang = F.regexp_extract("url", "://[^/]*/([a-z]+)/", 1)
    hrefs = F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))
    return pages.join(F.broadcast(n)).select(name(F.col("page_id")).alias("path"), F.concat(hrefs, F.array(name((F.col("page_id") * 17 + 1) % F.col("n")))).alias("links"), F.array(lang).alias("tags"), lang.alias("folder"))


def named_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is a note in one of seven folders of folders, with a name that others have too; it links to pages by path, by path without extension and by name."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("k"))
    n = pages.agg(F.count("*").alias("n"))
    text = lambda name, x: F.concat(F.lit(name), x.cast("string"))
    name = lambda k: text("p", k % 50)
    path = lambda k: F.concat_ws("/", text("d", k % 7), text("e", F.floor(k / 350)), name(k))
    k, n_ = F.col("k"), F.col("n")
    links = F.array(F.concat(path(k * 3 % n_), F.lit(".md")), path((k * 5 + 1) % n_), name(k * 11 + 2), F.concat(name(k + 1), F.lit("#part")), F.lit("nowhere"))
    return pages.join(F.broadcast(n)).select(F.concat(path(k), F.lit(".md")).alias("path"), links.alias("links"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is a parsed file: of seven, one has no date, two an invalid one; every fifth has no file time, every eleventh no word."""
    from corpuslens.functions import timestamps as T

    rows = notes(spark, sf_dir).withColumn("k", F.regexp_extract("path", r"/(\d+)\.md$", 1).cast("long"))
    text = F.when(F.col("k") % 7 == 0, F.lit(None)).when(F.col("k") % 7 == 1, F.lit("2021-13-40")).when(F.col("k") % 7 == 2, F.lit("")).otherwise(F.date_format("created", "yyyy-MM-dd HH:mm"))
    later = F.when(F.col("k") % 2 == 0, F.date_format("updated", "yyyy-MM-dd")).otherwise(F.lit(None))
    file_time = F.when(F.col("k") % 5 != 0, F.col("created"))
    return rows.select(
        "path", T.resolve(text, F.col("k") % 7 > 0, file_time, "ctime").alias("created"), T.resolve(later, F.col("k") % 2 == 0, F.col("updated"), "mtime").alias("updated"),
        F.when(F.col("k") % 11 == 0, 0).otherwise(F.col("word_count")).cast("long").alias("word_count"), "tags",
    )


def sparse_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of facts(), by plain columns: undated notes are gone, some have no words, no tags, or a revision before their creation."""
    rows = notes(spark, sf_dir).withColumn("k", F.regexp_extract("path", r"/(\d+)\.md$", 1).cast("long"))
    words = F.when(F.col("k") % 11 == 0, 0).otherwise(F.col("word_count")).cast("long")
    created = F.when(F.col("k") % 7 > 2, F.date_trunc("minute", "created")).when(F.col("k") % 5 != 0, F.col("created"))
    updated = F.when(F.col("k") % 2 == 0, F.date_trunc("day", "updated")).otherwise(F.col("updated"))
    tags = F.when(words % 4 == 0, F.array().cast("array<string>")).otherwise(F.col("tags"))
    return to_entries(rows.select("path", created.alias("created"), updated.alias("updated"), words.alias("word_count"), tags.alias("tags")))
