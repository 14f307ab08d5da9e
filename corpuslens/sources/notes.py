"""Notes from a folder of Markdown files, their parsing, and the files that exports are written to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.config import AnalysisConfig, RecommendConfig
from corpuslens.functions import text as X
from corpuslens.functions import timestamps as T

SAMPLES = 20


def below(spark: SparkSession, root: str, path: Column, folders: int = 0) -> Column:
    """The part of a file's full path that lies below root (and below so many folders in it)."""
    start = spark._jvm.org.apache.hadoop.fs.Path(root)
    full = start.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(start).toString()
    inner = F.substr(path, F.lit(len(full.rstrip("/")) + 2))
    for _ in range(folders):
        inner = F.regexp_replace(inner, "^[^/]*/", "")
    return inner


def scan(spark: SparkSession, root: str, times: DataFrame | None = None) -> DataFrame:
    """S1. path (below root), content, ctime, mtime, size of every .md file. Spark's readers skip folders whose name begins with . or _.

    Spark does not know when a file was made: times (path, ctime) says it, from a listing of the storage; null without.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).load(root)
    rows = files.select(below(spark, root, F.col("path")).alias("path"), F.col("content").cast("string").alias("content"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))
    known = rows.withColumn("ctime", F.lit(None).cast("timestamp")) if times is None else rows.join(times.select("path", F.col("ctime").cast("timestamp").alias("ctime")).dropDuplicates(["path"]), "path", "left")
    return known.select("path", "content", "ctime", "mtime", "size")


def normalize_path(value: str) -> str:
    """S7."""
    return value.replace("\\", "/").strip().strip("/")


def exclusion_reason(config: AnalysisConfig, path: Column) -> Column:
    """S2-S6. hidden, ignored, scope or null, in this order."""
    folders = F.split(F.lower(X.folder(path)), "/")
    hidden = F.exists(folders, lambda s: s.startswith(".")) if config.skip_hidden else F.lit(False)
    ignored = F.lit(False)
    for rule in map(normalize_path, config.ignored_folders):
        ignored |= F.lower(path).startswith(rule.lower() + "/") if "/" in rule else F.array_contains(folders, rule.lower())
    listed = F.lit(False)
    for name in (normalize_path(x).lower() for x in config.folders):
        listed |= F.lower(path).startswith(name + "/") if config.subfolders else F.lower(X.folder(path)) == name
    outside = {"all": F.lit(False), "include": ~listed, "exclude": listed}[config.scope_mode]
    return F.when(hidden, "hidden").when(ignored, "ignored").when(outside, "scope")


def scope_summary(files: DataFrame, config: AnalysisConfig) -> DataFrame:
    """S8. Total, matched, left out by reason, and the first paths."""
    rows = files.select("path", exclusion_reason(config, F.col("path")).alias("reason"))
    sample = rows.where("reason is null").orderBy("path").limit(SAMPLES).agg(F.array_sort(F.collect_list("path")).alias("sample"))
    return rows.agg(F.count("*").alias("total"), F.count_if(F.col("reason").isNull()).alias("matched"), *[F.count_if(F.col("reason") == r).alias(r) for r in ("hidden", "ignored", "scope")]).join(F.broadcast(sample))


def frontmatter(content: Column) -> Column:
    """S20. Map of the block's `key: value` lines and `- item` lists (joined by commas); the first of equal keys, lower case."""
    block = F.regexp_extract(F.replace(content, F.lit("\r\n"), F.lit("\n")), r"(?s)\A---\n(.*?)\n---(?:\n|\z)", 1)
    flat = F.regexp_replace(block, r"\n[ \t]*-[ \t]+", ", ")
    lines = F.filter(F.split(flat, "\n"), lambda x: x.contains(":"))
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), F.regexp_replace(F.trim(F.regexp_replace(x, r"^[^:]*:", "")), r"^,\s*|^[\"']|[\"']$", "").alias("v")))
    keys = F.transform(pairs, lambda p: p["k"])
    first = F.filter(pairs, lambda p, i: F.array_position(keys, p["k"]) == i + 1)
    return F.map_from_entries(first)


def parse(files: DataFrame, config: AnalysisConfig = AnalysisConfig()) -> DataFrame:
    """note_fact: path, size, mtime, created, updated (structs with source and issue), word_count, tags, links, folder, text."""
    meta = files.withColumn("__meta", frontmatter(F.coalesce("content", F.lit(""))))
    text = X.clean_markdown(F.col("content"), config.exclude_fences, config.exclude_inline_code)
    value = lambda k: F.try_element_at(F.col("__meta"), F.lit(k.lower()))
    has = lambda k: F.map_contains_key("__meta", F.lit(k.lower()))
    rows = meta.select(
        "path", "size", "mtime", T.resolve(value(config.created_key), has(config.created_key), F.col("ctime"), "ctime").alias("created"), T.resolve(value(config.updated_key), has(config.updated_key), F.col("mtime"), "mtime").alias("updated"),
        X.tag_set(X.raw_tags(F.coalesce(value("tags"), F.lit(""))), config.tag_mode, config.tag_aliases, config.ignored_tags).alias("tags"), X.wiki_links(F.col("content")).alias("links"), X.folder(F.col("path")).alias("folder"), text.alias("text"),
    )
    return rows.withColumn("word_count", F.size(X.words(F.col("text"))).cast("long")).withColumn("chronology_year", F.col("created.value.year"))


def inspect(files: DataFrame, path: str, config: AnalysisConfig = AnalysisConfig()) -> DataFrame:
    """X35. How the words of one note are counted: path, word_count, cleaned (the text that is counted), tokens."""
    cleaned = X.clean_markdown(F.col("content"), config.exclude_fences, config.exclude_inline_code)
    own = files.where(F.col("path") == path).select("path", cleaned.alias("cleaned")).withColumn("tokens", X.words(F.col("cleaned")))
    return own.select("path", F.size("tokens").cast("long").alias("word_count"), "cleaned", "tokens")


def plain_tags(content: Column) -> Column:
    """X28. The block's `tags` as they stand: items of a list (dashes or brackets), or one string; numbers, booleans and nulls are no tags."""
    block = F.regexp_extract(F.replace(F.coalesce(content, F.lit("")), F.lit("\r\n"), F.lit("\n")), r"(?s)\A---\n(.*?)\n---(?:\n|\z)", 1)
    value = F.rtrim(F.regexp_extract(block, r"(?m)^tags:[ \t]*(.*(?:\n[ \t]*-[ \t]+.*)*)", 1))
    items = (
        F.when(value.contains("\n"), F.split(F.regexp_replace(value, r"\A\s*-[ \t]+", ""), r"\n[ \t]*-[ \t]+"))
        .when(value.startswith("["), F.split(F.regexp_replace(value, r"\A\[|\]\z", ""), ","))
        .otherwise(F.array(value))
    )
    strings = F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: ~F.rlike(x, F.lit(r"(?i)\A(?:[+-]?\d+(?:\.\d+)?|true|false|null|~|)\z")))
    return F.transform(strings, lambda x: F.regexp_replace(x, "^([\"'])(.*)\\1$", "$2"))


def note_index(files: DataFrame, config: RecommendConfig = RecommendConfig()) -> DataFrame:
    """S10, X28, X29. What recommendations read: path, title, folder, tags, links, mtime, size and the first 600 characters.

    Its scope is its own: a file whose name begins with a dot is hidden too, and excluded folders are compared with case.
    """
    path = F.col("path")
    keep = F.lit(config.indexing)
    if config.skip_hidden:
        keep &= ~F.exists(F.split(path, "/"), lambda s: s.startswith("."))
    for name in config.exclude_folders:
        keep &= ~(path.startswith(name + "/") | (path == name))
    title = F.regexp_replace(F.substring_index("path", "/", -1), r"\.md$", "")
    text = F.coalesce("content", F.lit(""))
    return files.where(keep).select("path", title.alias("title"), X.folder(path).alias("folder"), plain_tags(F.col("content")).alias("tags"), X.wiki_links(text).alias("links"), "mtime", "size", F.substring(text, 1, 600).alias("preview"))


def to_notes(facts: DataFrame) -> DataFrame:
    """path, created, updated, word_count, tags, text: what the operators read."""
    stamp = lambda c: F.timestamp_millis(F.col(f"{c}.value.epoch_millis"))
    return facts.select("path", stamp("created").alias("created"), stamp("updated").alias("updated"), "word_count", "tags", "text")


def write_csv(rows: DataFrame, path: str) -> None:
    """S19. One file with a header; quotes doubled, empty cells empty, values untrimmed."""
    rows.coalesce(1).write.mode("overwrite").csv(path, header=True, escape='"', emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_text(spark: SparkSession, folder: str, base: str, text: str, now) -> str:
    """S18. Write a report as a new Markdown file of the folder, under the first free name; returns its path."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    files = hadoop.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    path = f"{folder.rstrip('/')}/{export_name(base, now, lambda name: files.exists(hadoop.Path(f'{folder}/{name}')))}"
    out = files.create(hadoop.Path(path), False)
    out.write(bytearray(text.encode()))
    out.close()
    return path


def export_name(base: str, now, taken) -> str:
    """S18. base-YYYY-MM-DD-HHMMSS.md, with -2 to -999 where it is taken."""
    stem = f"{base}-{now:%Y-%m-%d-%H%M%S}"
    for k in ["", *(f"-{i}" for i in range(2, 1000))]:
        if not taken(f"{stem}{k}.md"):
            return f"{stem}{k}.md"
    raise FileExistsError(stem)

