"""Totals, calendars, histograms and tag tables over entries.

entries: path, created, updated, year, month, weekday (0 Sunday), epoch_day, word_count, reading_minutes, lag_days,
depth, tags. All results are lazy, and have a total order where they are ranked (path or label last).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions import timestamps as T
from corpuslens.functions.order import local, named, sorted_texts


def to_entries(notes: DataFrame, per_minute: int = 230) -> DataFrame:
    """G2. notes: path, created, updated, word_count, tags."""
    made, words = F.col("created"), F.col("word_count")
    lag, minutes = T.lag_days(made, F.col("updated")), T.reading_minutes(words, per_minute)
    return notes.where("created is not null").select(
        "path", "created", "updated", F.year(made).alias("year"), F.month(made).alias("month"), T.weekday(made).alias("weekday"), T.epoch_day(made).alias("epoch_day"),
        words.cast("long").alias("word_count"), minutes.alias("reading_minutes"), lag.alias("lag_days"), T.note_depth(minutes, lag).alias("depth"), sorted_texts(F.array_distinct("tags")).alias("tags"),
    )


def totals(entries: DataFrame) -> DataFrame:
    """A1, A2. One pass over all entries and each year (year null: all)."""
    return entries.rollup("year").agg(
        F.count("*").alias("entries"), F.sum("word_count").alias("words"), F.avg("word_count").alias("mean_words"), F.median("word_count").alias("median_words"), F.sum("reading_minutes").alias("reading_minutes"),
    )


def spine(spark, years: DataFrame, name: str, first: int, last: int) -> DataFrame:
    """Every year with every value of a calendar part."""
    return years.select("year", F.explode(F.sequence(F.lit(first), F.lit(last))).alias(name))


def month_heatmap(entries: DataFrame) -> DataFrame:
    """A11, A12. year x month: entries, words, mean words; zeros where there is nothing."""
    grid = spine(entries.sparkSession, entries.select("year").distinct(), "month", 1, 12)
    cells = entries.groupBy("year", "month").agg(F.count("*").alias("entries"), F.sum("word_count").alias("words"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return grid.join(cells, ["year", "month"], "left").select("year", "month", zero("entries").alias("entries"), zero("words").alias("words"), F.when(F.col("entries") > 0, F.col("words") / F.col("entries")).otherwise(0.0).alias("mean_words"))


def weekday_heatmap(entries: DataFrame) -> DataFrame:
    """A13, T11. year x weekday (Monday first): entries, how often the weekday occurs that year, entries a day."""
    days = entries.select("year").distinct().select("year", F.explode(F.sequence(F.make_date("year", F.lit(1), F.lit(1)), F.make_date("year", F.lit(12), F.lit(31)))).alias("day"))
    grid = days.groupBy("year", F.weekday("day").alias("weekday")).agg(F.count("*").alias("occurrences"))
    cells = entries.groupBy("year", T.monday_first(F.col("weekday")).alias("weekday")).agg(F.count("*").alias("n"))
    return grid.join(cells, ["year", "weekday"], "left").select("year", "weekday", F.coalesce("n", F.lit(0)).alias("entries"), "occurrences", (F.coalesce("n", F.lit(0)) / F.col("occurrences")).alias("per_day"))


def histogram(values: DataFrame, value: str) -> DataFrame:
    """A15, M19. Bins of a nice width that cover 0 to the largest value; the last takes what is left."""
    known = values.where(F.col(value).isNotNull()).select(F.col(value).alias("v"))
    stats = known.agg(F.count("*").alias("n"), F.max("v").alias("most")).where("n > 0")
    bins = F.least(F.greatest(F.floor(F.sqrt("n") + 0.5), F.lit(6)), F.lit(14))
    rough = F.greatest(F.lit(1.0), (F.col("most") + 1) / bins)
    power = F.pow(F.lit(10.0), F.floor(F.log10("rough")))
    part = F.col("rough") / F.col("power")
    step = F.when(part <= 1, 1).when(part <= 2, 2).when(part <= 5, 5).otherwise(10) * F.col("power")
    shape = stats.withColumn("rough", rough).withColumn("power", power).withColumn("step", step).select("step", F.ceil((F.col("most") + 1) / F.col("step")).cast("int").alias("bins"))
    grid = shape.select("step", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    # The shape is one row, so the join adds columns only.
    cells = known.join(F.broadcast(shape)).groupBy(F.least(F.floor(F.col("v") / F.col("step")), F.col("bins") - 1).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return grid.join(cells, "bin", "left").select("bin", (F.col("bin") * F.col("step")).alias("low"), ((F.col("bin") + 1) * F.col("step")).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def month_profile(entries: DataFrame) -> DataFrame:
    """A19. Twelve rows: entries, mean and median words of a month of the year (0 if empty)."""
    grid = entries.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("month"))
    cells = entries.groupBy("month").agg(F.count("*").alias("n"), F.avg("word_count").alias("a"), F.median("word_count").alias("m"))
    return grid.join(cells, "month", "left").select("month", F.coalesce("n", F.lit(0)).alias("entries"), F.coalesce("a", F.lit(0.0)).alias("mean_words"), F.coalesce("m", F.lit(0.0)).alias("median_words"))


def hourly_activity(stamps: DataFrame, ts: str, timed: Column | None = None, words: str | None = None) -> DataFrame:
    """A20. Twenty-four rows; only stamps with a time of day count. words: the column whose mean is given too."""
    grid = stamps.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    mean = [F.avg(words).alias("mean")] if words else []
    cells = stamps.where(timed if timed is not None else F.col(ts).isNotNull()).groupBy(F.hour(ts).alias("hour")).agg(F.count("*").alias("n"), *mean)
    shown = [F.coalesce("mean", F.lit(0.0)).alias("mean_words")] if words else []
    return grid.join(cells, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("entries"), *shown)


def first_by(rows: DataFrame, score: Column, order: Column, where: Column | None = None) -> DataFrame:
    """H13, O11. The row with the largest score; the first in order if several have it."""
    return (rows if where is None else rows.where(where)).orderBy(score.desc_nulls_last(), order.asc()).limit(1)


def extremes(points: DataFrame, order: str, score: str) -> DataFrame:
    """A22. The highest and the lowest point that has entries; of equal ones the first. points: one row a month or an hour."""
    used = points.where("entries > 0")
    top = first_by(used, F.col(score), F.col(order)).withColumn("which", F.lit("highest"))
    return top.unionByName(first_by(used, -F.col(score), F.col(order)).withColumn("which", F.lit("lowest")))


def tag_summary(entries: DataFrame) -> DataFrame:
    """A10. Entries, entries with a tag, mean and median number of tags."""
    n = F.size("tags")
    return entries.agg(F.count("*").alias("entries"), F.count_if(n > 0).alias("tagged"), F.avg(n).alias("mean_tags"), F.median(n).alias("median_tags"))


def tag_coverage(entries: DataFrame) -> DataFrame:
    """A17. By year: entries, tagged entries, their share, mean and median number of tags."""
    n = F.size("tags")
    return entries.groupBy("year").agg(F.count("*").alias("entries"), F.count_if(n > 0).alias("tagged"), (F.count_if(n > 0) / F.count("*")).alias("share"), F.avg(n).alias("mean_tags"), F.median(n).alias("median_tags"))


def tag_year_heatmap(entries: DataFrame, least: int = 1, top: int = 10) -> DataFrame:
    """A21. The most frequent tags by year; zeros where a tag is absent."""
    tags = entries.select("year", F.explode("tags").alias("tag"))
    best = tags.groupBy("tag").agg(F.count("*").alias("total")).where(F.col("total") >= max(1, least)).orderBy(F.desc("total"), *named("tag")).limit(top)
    grid = entries.select("year").distinct().join(F.broadcast(best))
    cells = tags.groupBy("year", "tag").agg(F.count("*").alias("n"))
    return grid.join(cells, ["year", "tag"], "left").select("tag", "year", "total", F.coalesce("n", F.lit(0)).alias("entries"))


def combinations(tags: Column, size: int) -> Column:
    """A6. Labels of all combinations of one to `size` sorted tags."""
    one = F.transform(tags, lambda a, i: F.struct(a.alias("label"), i.alias("last")))
    out, level = one, one
    for _ in range(size - 1):
        level = F.flatten(F.transform(level, lambda c: F.filter(F.transform(tags, lambda t, i: F.struct(F.concat(c["label"], F.lit(" + "), t).alias("label"), i.alias("last"))), lambda x: x["last"] > c["last"])))
        out = F.concat(out, level)
    return F.transform(out, lambda c: c["label"])


def tag_rows(entries: DataFrame, size: int = 1, least: int = 1, by_year: bool = False) -> DataFrame:
    """A4, A5, A7-A9. Labels: entries, words against the baseline of all entries, top two weekdays, dominant month."""
    keys = ["year"] if by_year else []
    base = entries.groupBy(*keys).agg(F.avg("word_count").alias("base_mean"), F.median("word_count").alias("base_median"))
    month = F.date_format("created", "MMMM" if by_year else "yyyy-MM")
    rows = entries.select(*keys, "path", "word_count", T.monday_first(F.col("weekday")).alias("day"), month.alias("month"), F.explode(combinations(F.col("tags"), size)).alias("label"))
    keys = [*keys, "label"]
    main = rows.groupBy(*keys).agg(F.count("*").alias("entries"), F.avg("word_count").alias("mean_words"), F.median("word_count").alias("median_words")).where(F.col("entries") >= least)
    days = rows.groupBy(*keys, "day").agg(F.count("*").alias("n")).withColumn("turn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "day"))).where("turn <= 2")
    top = days.groupBy(*keys).agg(F.max(F.expr("if(turn = 1, day, null)")).alias("weekday"), F.max(F.expr("if(turn = 1, n, null)")).alias("weekday_entries"), F.max(F.expr("if(turn = 2, day, null)")).alias("second_weekday"), F.max(F.expr("if(turn = 2, n, null)")).alias("second_entries"))
    months = rows.groupBy(*keys, "month").agg(F.count("*").alias("n"), F.min(F.struct(local("path").alias("l"), F.col("path").alias("p"))).alias("seen"))
    dominant = months.withColumn("turn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "seen"))).where("turn = 1").select(*keys, "month", F.col("n").alias("month_entries"))
    joined = main.join(top, keys).join(dominant, keys)
    joined = joined.join(base, ["year"]) if by_year else joined.join(F.broadcast(base))
    return joined.select(*keys, "entries", "mean_words", "median_words", (F.col("mean_words") - F.col("base_mean")).alias("mean_delta"), (F.col("median_words") - F.col("base_median")).alias("median_delta"), "weekday", "second_weekday", (F.col("weekday_entries") / F.col("entries")).alias("weekday_share"), (F.col("second_entries") / F.col("entries")).alias("second_share"), "month", (F.col("month_entries") / F.col("entries")).alias("month_share"))


def date_issues(notes: DataFrame) -> DataFrame:
    """A3. Notes with a missing or invalid date, by path."""
    return notes.where("created.issue is not null or updated.issue is not null").select("path", F.col("created.issue").alias("created_issue"), F.col("created.source").alias("created_source"), F.col("updated.issue").alias("updated_issue"), F.col("updated.source").alias("updated_source")).orderBy(*named("path"))


def _file_counts(facts: DataFrame):
    fallback = lambda c: F.count_if(F.col(f"{c}.source").isin("filesystem-ctime", "filesystem-mtime"))
    issue = lambda c, kind: F.count_if(F.col(f"{c}.issue") == kind)
    return fallback, issue


def file_totals(facts: DataFrame, per_minute: int = 230, method: str = "mean") -> DataFrame:
    """A1, P7, P8. All files, dated or not: words, averages, reading time, fallbacks to file times, date issues, undated files.

    facts: created and updated as resolve() gives them, word_count. method: which average is the selected one.
    """
    fallback, issue = _file_counts(facts)
    words = F.coalesce(F.sum("word_count"), F.lit(0))
    mean, median = F.coalesce(F.avg("word_count"), F.lit(0.0)), F.coalesce(F.median("word_count"), F.lit(0.0))
    out = facts.agg(
        F.count("*").alias("entries"), words.alias("words"), mean.alias("mean_words"), median.alias("median_words"), (mean if method == "mean" else median).alias("selected_words"),
        fallback("created").alias("created_fallbacks"), fallback("updated").alias("updated_fallbacks"), issue("created", "missing").alias("created_missing"), issue("created", "invalid").alias("created_invalid"),
        issue("updated", "missing").alias("updated_missing"), issue("updated", "invalid").alias("updated_invalid"), F.count_if(F.col("created.value").isNull()).alias("undated"),
    )
    minutes = T.reading_minutes(F.col("words"), per_minute)
    return out.withColumn("reading_minutes", minutes).withColumn("reading_label", T.reading_label(minutes)).withColumn("selected_minutes", T.reading_minutes(F.col("selected_words"), per_minute))


def file_years(facts: DataFrame, per_minute: int = 230) -> DataFrame:
    """A2, A14. Of each year: files, words, averages, reading time (added up file by file), fallbacks to file times."""
    fallback, _ = _file_counts(facts)
    minutes = F.sum(T.reading_minutes(F.col("word_count"), per_minute))
    dated = facts.where(F.col("created.value").isNotNull())
    return dated.groupBy(F.col("created.value.year").alias("year")).agg(
        F.count("*").alias("entries"), F.sum("word_count").alias("words"), minutes.alias("reading_minutes"), T.reading_label(minutes).alias("reading_label"), F.avg("word_count").alias("mean_words"), F.median("word_count").alias("median_words"),
        fallback("created").alias("created_fallbacks"), fallback("updated").alias("updated_fallbacks"),
    )


def ordered_tag_rows(rows: DataFrame) -> DataFrame:
    """O1. Tag rows as a report lists them: entries, size of the mean's delta, weekday share, label."""
    return rows.orderBy(F.desc("entries"), F.desc(F.abs("mean_delta")), F.desc("weekday_share"), *named("label"))
