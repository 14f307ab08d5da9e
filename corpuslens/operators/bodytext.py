"""Body text: richness, sentences, novelty, openings, phrases, period signatures.

notes: path, created, text, tags (and word_count). texts(): one row a note with its tokens and what derives from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions import text as X
from corpuslens.functions import timestamps as T
from corpuslens.functions.order import named


def texts(notes: DataFrame, *keep: str) -> DataFrame:
    """X10-X19. A note's tokens, vocabulary, sentence moments, opening signature; words and lag if the notes have them; keep: more of their columns."""
    tokens = notes.withColumn("tokens", X.tokens(F.col("text"))).withColumn("sentences", X.sentence_lengths(F.coalesce("text", F.lit(""))))
    more = [*keep, "word_count"] if "word_count" in notes.columns else [*keep]
    count = F.aggregate("sentences", F.lit(0).cast("long"), lambda s, x: s + x)  # of all tokens: each is in a sentence
    if "updated" in notes.columns:
        more.append(T.lag_days(F.col("created"), F.col("updated"), True).cast("double").alias("lag_days"))
    return tokens.select(
        "path", "created", F.year("created").alias("year"), F.month("created").alias("month"), T.instant_day(F.col("created")).alias("epoch_day"), "tags", "tokens", count.alias("token_count"),
        F.array_distinct("tokens").alias("vocabulary"), F.size("sentences").cast("long").alias("sentence_count"), count.alias("sentence_words"),
        F.aggregate("sentences", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x).alias("sentence_squares"), X.opening_signature(X.opening_line(F.coalesce("text", F.lit("")))).alias("opening"), *more,
    )


def _sentence_columns():
    mean = F.try_divide(F.sum("sentence_words"), F.sum("sentence_count"))
    square = F.try_divide(F.sum("sentence_squares"), F.sum("sentence_count"))
    return mean.alias("sentence_mean"), F.sqrt(F.greatest(F.lit(0.0), square - mean * mean)).alias("sentence_variation")


def year_words(rows: DataFrame) -> DataFrame:
    """year, w, n: how often a year has each word. Texts are read once; what leaves a task is its distinct words."""
    return rows.select("year", F.explode("tokens").alias("w")).groupBy("year", "w").agg(F.count("*").alias("n"))


def lexical_by_year(rows: DataFrame) -> DataFrame:
    """A38, A39, G6. Tokens, distinct words, richness and sentence length of each year."""
    words = year_words(rows).groupBy("year").agg(F.sum("n").alias("tokens"), F.count("*").alias("vocabulary"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    main = rows.groupBy("year").agg(*_sentence_columns()).join(words, "year", "left")
    return main.select("year", zero("tokens").alias("tokens"), zero("vocabulary").alias("vocabulary"), X.richness(F.col("tokens"), F.col("vocabulary")).alias("richness"), "sentence_mean", "sentence_variation")


def novelty(rows: DataFrame) -> DataFrame:
    """W6. Share of a year's vocabulary that no earlier year has: the first year of each word decides, no running set."""
    first = F.min("year").over(Window.partitionBy("w"))
    words = year_words(rows).select("year", (first == F.col("year")).alias("fresh"))
    return words.groupBy("year").agg(F.count("*").alias("vocabulary"), F.count_if("fresh").alias("fresh")).withColumn("novelty", F.col("fresh") / F.col("vocabulary"))


def recurring_paths(rows: DataFrame) -> DataFrame:
    """J6. The notes that hold a phrase which two notes or more hold."""
    found = rows.select("path", F.explode(X.phrases(F.col("tokens"))).alias("phrase"))
    return found.join(recurring_phrases(rows).select("phrase"), "phrase", "left_semi").select("path").distinct()


def year_profiles(rows: DataFrame) -> DataFrame:
    """G6. Of each year: entries, richness, novelty, sentences, the leading opening and its share, share of notes with a recurring phrase."""
    marked = rows.select("path", "year").join(recurring_paths(rows).withColumn("recurs", F.lit(1)), "path", "left")
    shares = marked.groupBy("year").agg(F.count("*").alias("entries"), F.avg(F.coalesce("recurs", F.lit(0))).alias("recurring_share"))
    openings = rows.where("opening is not null").groupBy("year", "opening").agg(F.count("*").alias("n"))
    leading = openings.groupBy("year").agg(F.min_by("opening", F.struct(-F.col("n"), F.col("opening"))).alias("opening"), (F.max("n") / F.sum("n")).alias("opening_share"))
    lexical = lexical_by_year(rows).select("year", "richness", "sentence_mean", "sentence_variation")
    return shares.join(lexical, "year").join(novelty(rows).select("year", "novelty"), "year", "left").join(leading, "year", "left").select("year", "entries", "richness", "novelty", "sentence_mean", "sentence_variation", "opening", "opening_share", "recurring_share")


def month_climate(rows: DataFrame) -> DataFrame:
    """A41. Twelve rows, nulls for empty months."""
    grid = rows.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("month"))
    return grid.join(rows.groupBy("month").agg(F.sum("token_count").alias("tokens"), *_sentence_columns()), "month", "left")


def opening_signatures(rows: DataFrame) -> DataFrame:
    """A36. Count and share of each opening signature."""
    cells = rows.where("opening is not null").groupBy("opening").agg(F.count("*").alias("n"))
    return cells.join(F.broadcast(cells.agg(F.sum("n").alias("total")))).select("opening", "n", (F.col("n") / F.col("total")).alias("share"))


def opening_shift(rows: DataFrame) -> DataFrame:
    """W10, H23, M15. Total variation distance of each year's openings to those of the year before."""
    cells = rows.where("opening is not null").groupBy("year", "opening").agg(F.count("*").alias("n"))
    return opening_shift_of(cells, rows.groupBy("year").agg(F.count("opening").alias("total")))


def opening_shift_of(cells: DataFrame, years: DataFrame) -> DataFrame:
    """opening_shift() from the counts (year, opening, n) and the openings of each year (year, total)."""
    grid = years.withColumn("opening", F.explode(F.array(*map(F.lit, X.SIGNATURES))))
    shares = grid.join(cells, ["year", "opening"], "left").select("year", "opening", F.when(F.col("total") > 0, F.coalesce("n", F.lit(0)) / F.col("total")).otherwise(0.0).alias("p"))
    w = Window.partitionBy("opening").orderBy("year")
    moved = shares.select("year", F.lag("year").over(w).alias("before"), F.abs(F.col("p") - F.lag("p").over(w)).alias("d")).where("before is not null")
    return moved.groupBy("before", "year").agg((F.sum("d") / 2).alias("distance"))


def recurring_phrases(rows: DataFrame) -> DataFrame:
    """A37, A48. Phrases of two entries or more: entries, years, mean gap of days, score."""
    found = rows.select("year", "epoch_day", "path", F.explode(X.phrases(F.col("tokens"))).alias("phrase"))
    days = F.count_distinct("epoch_day")
    gap = F.when(days >= 2, (F.max("epoch_day") - F.min("epoch_day")) / (days - 1))
    return scored(found.groupBy("phrase").agg(F.count("*").alias("entries"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), gap.alias("mean_gap")).where("entries >= 2"))


def scored(stats: DataFrame) -> DataFrame:
    """The score of recurring phrases: entries, first_year, last_year, mean_gap."""
    score = F.col("entries") * F.log2(2 + (F.col("last_year") - F.col("first_year"))) * F.log2(2 + F.coalesce("mean_gap", F.lit(0.0)))
    return stats.withColumn("score", score)


def tag_profiles(rows: DataFrame, least: int = 1) -> DataFrame:
    """A40. Of each tag: entries, words, mean richness, sentences (pooled mean, median of the notes' means), positive revision lags."""
    sentence = F.when(F.col("sentence_count") > 0, F.col("sentence_words") / F.col("sentence_count"))
    own = rows.select(F.explode(F.array_distinct("tags")).alias("tag"), "word_count", X.richness(F.col("token_count"), F.size("vocabulary")).alias("richness"), "sentence_count", "sentence_words", F.when(sentence > 0, sentence).alias("sentence"), F.when(F.col("lag_days") > 0, F.col("lag_days")).alias("lag"))
    out = own.groupBy("tag").agg(
        F.count("*").alias("entries"), F.avg("word_count").alias("mean_words"), F.median("word_count").alias("median_words"), F.avg("richness").alias("mean_richness"), F.try_divide(F.sum("sentence_words"), F.sum("sentence_count")).alias("mean_sentence"),
        F.median("sentence").alias("median_sentence"), F.avg("lag").alias("mean_lag"), F.median("lag").alias("median_lag"),
    )
    return out.where(F.col("entries") >= least).orderBy(F.desc("entries"), F.desc_nulls_last("mean_richness"), *named("tag"))


def period_signature(terms: DataFrame, selected_from: int, selected_to: int, compared_from: int, compared_to: int) -> DataFrame:
    """A43, A44, J8. terms: year, term, n. Smoothed rates of two periods and the log2 of their ratio; support of two or more."""
    inside = lambda a, b: F.when(F.col("year").between(a, b), F.col("n")).otherwise(0)
    counts = terms.groupBy("term").agg(F.sum(inside(selected_from, selected_to)).alias("selected"), F.sum(inside(compared_from, compared_to)).alias("compared")).where("selected + compared > 0")
    sizes = counts.agg(F.count("*").alias("v"), F.sum("selected").alias("ns"), F.sum("compared").alias("nc"))
    rate = lambda c, n: (F.col(c) + 0.5) / (F.col(n) + 0.5 * F.col("v"))
    rows = counts.join(F.broadcast(sizes)).withColumn("selected_rate", rate("selected", "ns")).withColumn("compared_rate", rate("compared", "nc"))
    kind = F.when(F.col("compared") == 0, "emergent").when(F.col("selected") == 0, "fading").otherwise("distinctive")
    return rows.select("term", "selected", "compared", "selected_rate", "compared_rate", F.log2(F.col("selected_rate") / F.col("compared_rate")).alias("score"), kind.alias("kind")).where("selected + compared >= 2")


def resolve_period(years: list[int], first: int | None = None, last: int | None = None, earlier: bool = False) -> tuple[int, int, int, int] | None:
    """Selected and compared years: the latest of `years` if none is given; all earlier ones, or (see split_period) all others."""
    if not years:
        return None
    a, b = first if first is not None else last, last if last is not None else first
    a, b = (max(years), max(years)) if a is None else (min(a, b), max(a, b))
    return a, b, min([*years, a]), a - 1 if earlier else max([*years, b])


def period_terms(terms: DataFrame, first: int, last: int, earlier: bool = False) -> DataFrame:
    """A44 against all other years, or only those before: the years inside count as selected, never as compared."""
    inside = F.col("year").between(first, last)
    other = F.col("year") < first if earlier else ~inside
    marked = terms.where(inside | other).withColumn("year", F.when(inside, F.lit(1)).otherwise(F.lit(0)))
    return period_signature(marked, 1, 1, 0, 0)


def period_lists(signature: DataFrame) -> DataFrame:
    """O6. The distinctive, emergent and fading terms in their orders: list, rank, term, selected, compared, score."""
    lists = [
        ("distinctive", F.col("score") > 0, [F.desc("score"), F.desc("selected"), *named("term")]),
        ("emergent", (F.col("compared") == 0) & (F.col("selected") >= 2), [F.desc("selected_rate"), F.desc("selected"), *named("term")]),
        ("fading", F.col("score") < 0, [F.asc("score"), F.desc("compared"), *named("term")]),
    ]
    out = None
    for name, keep, order in lists:
        top = signature.where(keep).orderBy(*order).limit(10)
        rows = top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(name)).orderBy(*order))).select(F.lit(name).alias("list"), "rank", "term", "selected", "compared", "score")  # over ten rows
        out = rows if out is None else out.unionByName(rows)
    return out


def records(notes: DataFrame, rows: DataFrame) -> DataFrame:
    """G9, J7. What the record sections rank notes by. notes: path, created, updated, word_count, tags."""
    hits = rows.select("path", F.explode(X.phrases(F.col("tokens"))).alias("phrase")).join(recurring_phrases(rows).select("phrase"), "phrase").groupBy("path").agg(F.count("*").alias("recurring"))
    own = rows.select("path", X.richness(F.col("token_count"), F.size("vocabulary")).alias("richness"), F.when(F.col("sentence_count") > 0, F.col("sentence_words") / F.col("sentence_count")).alias("sentence_mean"), F.size("vocabulary").alias("unique_words"))
    tags, words = F.size("tags"), F.col("word_count")
    lag = T.lag_days(F.col("created"), F.col("updated"))
    base = notes.select("path", "word_count", F.when(words > 0, words).alias("positive_words"), tags.alias("tag_count"), F.when(lag > 0, lag).alias("lag_days"), F.when(words > 0, 100 * tags / words).alias("tag_density"))
    found = base.join(own, "path", "left").join(hits, "path", "left")
    return found.withColumn("recurring", F.when(F.col("recurring") > 0, F.col("recurring")))


# Each section ranks the notes whose value is known (null: the note does not qualify).
SECTIONS = [("longest-notes", "word_count", False), ("shortest-notes", "positive_words", True), ("most-tags", "tag_count", False), ("longest-revision-lags", "lag_days", False), ("highest-lexical-richness", "richness", False), ("fewest-tags", "tag_count", True), ("longest-average-sentences", "sentence_mean", False), ("most-repetitive-phrases", "recurring", False), ("most-unique-words", "unique_words", False), ("highest-tag-density", "tag_density", False)]
#: The sections of the short view.
SIMPLE = ("longest-notes", "shortest-notes", "most-tags", "longest-revision-lags", "highest-lexical-richness")


def record_sections(candidates: DataFrame, k: int = 10, ids: tuple[str, ...] | None = None) -> DataFrame:
    """G8, G10, H19, O3, O10. The k first of each section: score, then words descending, then path. k <= 0 shows none.

    One pass: a candidate is a row for each section that it qualifies for, of which tasks keep the first k.
    """
    shown = [(name, F.col(score).cast("double"), up) for name, score, up in SECTIONS if ids is None or name in ids]
    cells = F.array(*(F.struct(F.lit(name).alias("section"), score.alias("score"), (score if up else -score).alias("key")) for name, score, up in shown))
    rows = candidates.select("path", "word_count", F.explode(cells).alias("c")).select("c.*", "path", "word_count").where("score is not null")
    order = Window.partitionBy("section").orderBy("key", F.desc("word_count"), *named("path"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(0, k)).select("section", "path", "score", "word_count", "rank")


def revision_examples(notes: DataFrame, k: int = 25) -> DataFrame:
    """G12. The longest whole-day revision lags."""
    return notes.select("path", "word_count", T.lag_days(F.col("created"), F.col("updated"), True).alias("lag"), T.local_label(F.col("created")).alias("created"), T.local_label(F.col("updated")).alias("updated")).where("lag > 0").orderBy(F.desc("lag"), F.desc("word_count"), *named("path")).limit(k)

