"""Rhythm, volume and revision structure of entries, by year or over all (group: columns, empty for all)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions import timestamps as T
from corpuslens.functions.order import local, named
from corpuslens.operators import ranks as R
from corpuslens.operators.tagstructure import tag_distribution


#: The names of the seasons, from December on.
SEASONS = ("Winter", "Spring", "Summer", "Autumn")


def day_activity(entries: DataFrame, *group: str) -> DataFrame:
    """W1. One row for each day with entries; what follows works on at most 366 rows a year."""
    return entries.groupBy(*group, "epoch_day").agg(F.count("*").alias("entries"), F.sum("word_count").alias("words"))


def intervals(entries: DataFrame, *group: str) -> DataFrame:
    """W2. Days since the day before that has entries (at least 1), in order; the first day has none."""
    w = Window.partitionBy(*group).orderBy("epoch_day")
    return day_activity(entries, *group).select(*group, "epoch_day", F.greatest(F.lit(1), F.col("epoch_day") - F.lag("epoch_day").over(w)).alias("gap"), F.lag("epoch_day").over(w).alias("before")).where("before is not null").drop("before")


def streaks(entries: DataFrame, *group: str) -> DataFrame:
    """W3. Runs of days in a row: first, last, days, entries."""
    w = Window.partitionBy(*group).orderBy("epoch_day")
    return day_activity(entries, *group).withColumn("island", F.col("epoch_day") - F.row_number().over(w)).groupBy(*group, "island").agg(F.min("epoch_day").alias("first_day"), F.max("epoch_day").alias("last_day"), F.count("*").alias("days"), F.sum("entries").alias("entries")).drop("island")


def _days(entries: DataFrame, *group: str) -> DataFrame:
    """One row a day: entries, words, revised entries. All of the temporal measures come from this table."""
    revised = F.count_if(F.col("lag_days") > 0)
    return entries.groupBy(*group, "epoch_day", "month").agg(F.count("*").alias("entries"), F.sum("word_count").alias("words"), revised.alias("revised"))


def _season_scores() -> list[Column]:
    """A25. By season the mean of its shares of entries, words and revisions, over days."""
    own = lambda c, s: F.sum(F.when(T.season(F.col("month")) == s, F.col(c)).otherwise(0))
    share = lambda c, s: F.when(F.sum(c) > 0, own(c, s) / F.sum(c)).otherwise(0.0)
    kinds = sum(((F.sum(c) > 0).cast("int") for c in ("entries", "words", "revised")), F.lit(0))
    return [(share("entries", s) + share("words", s) + share("revised", s)) / F.greatest(kinds, F.lit(1)) for s in range(4)]


def _top_season() -> Column:
    """The first season of the largest score."""
    return F.element_at(F.array(*map(F.lit, SEASONS)), F.array_position("scores", F.array_max("scores")).cast("int"))


def temporal(entries: DataFrame, *group: str, strict: bool = True) -> DataFrame:
    """W4, M6, A25. Burstiness, longest gap, 90th percentile of the gaps, share of long silences, fragility, season
    asymmetry and the strongest season; one pass over the entries, then windows over days (at most 366 a year).

    strict: the percentile reads the gaps in their order in time, not sorted.
    """
    return temporal_of(_days(entries, *group), *group, strict=strict)


def temporal_of(days: DataFrame, *group: str, strict: bool = True, more: dict[str, Column] | None = None) -> DataFrame:
    """temporal() from one row a day: group, epoch_day, month, entries, words, revised. more: further aggregates of the days."""
    more = more or {}
    order = Window.partitionBy(*group).orderBy("epoch_day")
    day, every = F.col("epoch_day"), Window.partitionBy(*group)
    before = F.lag("epoch_day").over(order)
    gap = F.when(before.isNotNull(), F.greatest(F.lit(1), day - before))
    many, turn = F.count("*").over(every) - 1, F.row_number().over(order) - 2  # of the gaps; the first day has none
    begins = before.isNull() | (day - before != 1)
    long_run = F.coalesce(F.lead("epoch_day", 2).over(order) == day + 2, F.lit(False))
    rows = days.select("*", gap.alias("gap"), many.alias("many"), turn.alias("turn"), begins.alias("begins"), (begins & ~long_run).alias("short"))
    at = (F.col("many") - 1) * F.lit(0.9)
    picked = lambda place: F.max(F.when(F.col("turn") == place(at), F.col("gap")))
    low, high, past = picked(F.floor), picked(F.ceil), F.max(at) - F.floor(F.max(at))
    p90 = (low + (high - low) * past if strict else F.percentile("gap", 0.9)) - 1  # a silence is a day shorter than its gap
    spread, mean = F.stddev_pop("gap"), F.avg("gap")
    out = rows.groupBy(*group).agg(
        F.count("*").alias("n_days"), F.when((F.count("gap") >= 2) & (spread + mean > 0), (spread - mean) / (spread + mean)).otherwise(0.0).alias("burstiness"),
        F.coalesce(F.max("gap") - 1, F.lit(0.0)).alias("longest_gap"), F.coalesce(p90, F.lit(0.0)).alias("p90_gap"), F.coalesce(F.avg((F.col("gap") > 30).cast("double")), F.lit(0.0)).alias("long_silences"),
        F.when(F.count("*") >= 2, F.count_if("short") / F.count_if("begins")).otherwise(0.0).alias("fragility"), F.array(*_season_scores()).alias("scores"), *(v.alias(k) for k, v in more.items()),
    )
    shown = ["burstiness", "longest_gap", "p90_gap", "long_silences", "fragility"]
    return out.where("n_days > 0").select(*group, *shown, (F.array_max("scores") - F.array_min("scores")).alias("season_asymmetry"), _top_season().alias("dominant_season"), *more)


def volume(entries: DataFrame, *group: str) -> DataFrame:
    """A23, M8. Skew, tail ratio, short to long notes, concentration of the words over months.

    From one table of how many notes of a month have how many words; a percentile's buffer holds the lengths that occur,
    at most as many as the longest note has words.
    """
    keys = list(group)
    cells = entries.groupBy(*dict.fromkeys([*group, "year", "month", "word_count"])).agg(F.count("*").alias("n"))
    months = cells.groupBy(*dict.fromkeys([*group, "year", "month"])).agg(F.sum(F.col("n") * F.col("word_count")).alias("words"))
    squares = F.sum(F.col("words").cast("double") * F.col("words"))
    herfindahl = months.groupBy(*group).agg(F.when(F.sum("words") > 0, squares / F.pow(F.sum("words").cast("double"), 2)).otherwise(0.0).alias("concentration"))
    n, one, two = (F.sum(F.col("n") * F.pow(F.col("word_count").cast("decimal(18,0)"), F.lit(k)) if k > 1 else F.col("n") * F.col("word_count") if k else F.col("n")).cast("double") for k in range(3))
    quantiles = F.percentile("word_count", F.array(F.lit(0.5), F.lit(0.9)), F.col("n"))
    stats = cells.groupBy(*group).agg(n.alias("n_notes"), one.alias("s1"), two.alias("s2"), quantiles.alias("q"))
    stats = stats.select(*group, (F.col("s1") / F.col("n_notes")).alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("s2") * F.col("n_notes") - F.col("s1") * F.col("s1"))).alias("root"), "n_notes", F.col("q")[0].alias("median"), F.col("q")[1].alias("p90"))
    joined = cells.select(*group, "word_count", "n").join(F.broadcast(stats.select(*group, "median")), keys or None)
    some = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(0))
    ends = joined.groupBy(*group).agg(some(F.col("word_count") <= 0.5 * F.col("median")).alias("short"), some(F.col("word_count") >= 1.5 * F.col("median")).alias("long"))
    both = stats.join(ends, keys).join(herfindahl, keys) if keys else stats.join(F.broadcast(ends)).join(F.broadcast(herfindahl))
    sd = F.col("root") / F.col("n_notes")
    return both.select(
        *group, F.when(sd > 0, 3 * (F.col("mean") - F.col("median")) / sd).otherwise(0.0).alias("skew"), F.when(F.col("median") > 0, F.col("p90") / F.col("median")).otherwise(0.0).alias("tail_ratio"),
        ((F.col("short") + 1) / (F.col("long") + 1)).alias("short_long"), "concentration",
    )


def revisits(entries: DataFrame, *group: str) -> DataFrame:
    """A24. Usable and revisited entries, their ratio, the largest lag, intensity: what needs no order of the lags."""
    positive = F.when(F.col("lag_days") > 0, F.col("lag_days"))
    main = entries.groupBy(*group).agg(
        F.count("lag_days").alias("usable"), F.count(positive).alias("revisited"), F.coalesce(F.max(positive), F.lit(0.0)).alias("max_lag"),
        F.coalesce(F.sum(F.col("word_count") * F.log1p(positive)), F.lit(0.0)).alias("intensity"), F.sum("word_count").alias("words"),
    )
    ratio = F.when(F.col("usable") > 0, F.col("revisited") / F.col("usable")).otherwise(0.0)
    each = F.when(F.col("words") > 0, F.col("intensity") / F.col("words")).otherwise(0.0)
    return main.select(*group, "usable", "revisited", ratio.alias("revisit_ratio"), "max_lag", "intensity", each.alias("intensity_per_word"))


def lag_ranks(entries: DataFrame, *group: str) -> DataFrame:
    """A24, M3, M5. Median and 90th percentile of the positive lags, and the half-life (weighted median lag), in days.

    Lags are whole milliseconds; their ranks are found by histograms (see ranks), so no task sorts or holds all lags.
    """
    keys = list(group)
    key = F.round(F.col("lag_days") * T.DAY).cast("long").alias("key")
    cells = entries.where("lag_days > 0").groupBy(*group, key).agg(F.count("*").alias("n"), F.sum(F.greatest(F.lit(1), F.col("word_count"))).alias("weight"))
    totals = cells.groupBy(*group).agg(F.sum("n").alias("n_all"), F.sum("weight").alias("w_all")).where("n_all > 0")
    many = F.col("n_all")
    wanted = {"half": ("weight", F.col("w_all") / 2)}
    for name, share in (("median", 0.5), ("p90", 0.9)):
        low, high, _ = R.place(many, share)
        wanted |= {f"{name}_low": ("n", low), f"{name}_high": ("n", high)}
    ranks = totals.select(*group, F.explode(F.array(*(F.struct(F.lit(k).alias("rank"), F.lit(kind).alias("kind"), goal.cast("decimal(38,1)").alias("goal")) for k, (kind, goal) in wanted.items()))).alias("r"))
    found = R.search(cells, ranks.select(*group, "r.*"), keys)
    value = lambda k: (F.max(F.when(F.col("rank") == k, F.col("value"))) / F.lit(T.DAY)).alias(k)
    wide = found.groupBy(*group).agg(*map(value, wanted))
    both = wide.join(totals, keys) if keys else wide.join(F.broadcast(totals))
    mid = lambda k, share: R.between(F.col(f"{k}_low"), F.col(f"{k}_high"), R.place(many, share)[2])
    return both.select(*group, mid("median", 0.5).alias("median_lag"), mid("p90", 0.9).alias("p90_lag"), F.col("half").alias("half_life"))


def revision(entries: DataFrame, *group: str) -> DataFrame:
    """A24, M5. Usable and revisited entries, lags, half-life (weighted median lag), intensity."""
    keys = list(group)
    main, ordered = revisits(entries, *group), lag_ranks(entries, *group)
    both = main.join(ordered, keys, "left") if keys else main.join(F.broadcast(ordered), how="left")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return both.select(*group, "usable", "revisited", "revisit_ratio", zero("median_lag"), zero("p90_lag"), "max_lag", zero("half_life"), "intensity", "intensity_per_word")


def weekday_stability(entries: DataFrame) -> DataFrame:
    """A26, M9. One minus the mean Jensen-Shannon distance of the years' weekdays to all years', weighted by entries."""
    cells = entries.groupBy("year", "weekday").agg(F.count("*").alias("n"))
    years, days = entries.groupBy("year").agg(F.count("*").alias("year_n")), entries.groupBy("weekday").agg(F.count("*").alias("day_n"))
    all_n = entries.agg(F.count("*").alias("all_n"))
    grid = years.join(F.broadcast(days)).join(F.broadcast(all_n)).join(cells, ["year", "weekday"], "left")
    p, q = F.coalesce(F.col("n"), F.lit(0)) / F.col("year_n"), F.col("day_n") / F.col("all_n")
    mid = (p + q) / 2
    term = lambda x: F.when(x > 0, x * F.log2(x / mid)).otherwise(0.0)
    by_year = grid.groupBy("year", "year_n").agg(F.sqrt(F.greatest(F.sum(term(p) + term(q)) / 2, F.lit(0.0))).alias("distance"))
    return by_year.agg((1 - F.sum(F.col("year_n") * F.col("distance")) / F.sum("year_n")).alias("stability"))


def pearson(rows: DataFrame, a: str, b: str) -> DataFrame:
    """M10. Null for fewer than two rows or without variance."""
    known = F.col(a).isNotNull() & F.col(b).isNotNull()
    return rows.where(known).agg(F.when(F.count("*") >= 2, F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))).alias("correlation"), F.count("*").alias("pairs"))


def revision_length_correlation(entries: DataFrame) -> DataFrame:
    """W12."""
    return pearson(entries.where("lag_days > 0").select(F.col("lag_days").alias("a"), F.col("word_count").cast("double").alias("b")), "a", "b")


def cadence_depth_correlation(entries: DataFrame) -> DataFrame:
    """W11. Gap to the entry before against depth. Gaps inside a day are 0, so days are windowed, not entries.

    Only a day's first entry (words, then path) has a gap, so sums of the others need no order.
    """
    first = F.min_by("depth", F.struct("word_count", "path"))
    days = entries.groupBy("epoch_day").agg(first.alias("first"), F.count("depth").alias("n"), F.sum("depth").alias("s"), F.sum(F.col("depth") * F.col("depth")).alias("q"))
    w = Window.partitionBy().orderBy("epoch_day")  # one row a day
    gaps = days.withColumn("gap", (F.col("epoch_day") - F.lag("epoch_day").over(w)).cast("double"))
    known = F.col("gap").isNotNull()
    own = gaps.select(
        F.when(known, F.col("n")).otherwise(F.col("n") - 1).alias("n"), F.coalesce("gap", F.lit(0.0)).alias("x"), F.when(known, F.col("s")).otherwise(F.col("s") - F.col("first")).alias("y"),
        F.coalesce(F.col("gap") * F.col("gap"), F.lit(0.0)).alias("xx"), F.when(known, F.col("q")).otherwise(F.col("q") - F.col("first") * F.col("first")).alias("yy"), F.coalesce(F.col("gap") * F.col("first"), F.lit(0.0)).alias("xy"),
    )
    n, x, y, xx, yy, xy = (F.sum(c) for c in ("n", "x", "y", "xx", "yy", "xy"))
    spread = F.sqrt(F.greatest(F.lit(0.0), n * xx - x * x)) * F.sqrt(F.greatest(F.lit(0.0), n * yy - y * y))
    return own.agg(F.when((n >= 2) & (spread > 0), (n * xy - x * y) / spread).alias("correlation"), F.coalesce(n, F.lit(0)).alias("pairs"))


def longest_streak(entries: DataFrame) -> DataFrame:
    """W5. Most days, then most entries, then the earliest."""
    return streaks(entries).orderBy(F.desc("days"), F.desc("entries"), "first_day").limit(1)


def silence_gaps(entries: DataFrame, k: int = 25) -> DataFrame:
    """W14. The longest silences and the entries on either side of them."""
    at = F.struct(local("path").alias("l"), F.col("path").alias("p"), T.local_label(F.col("created")).alias("d"))
    days = entries.groupBy(T.instant_day(F.col("created")).alias("epoch_day")).agg(F.min(at).alias("first"), F.max(at).alias("last"))
    w = Window.partitionBy().orderBy("epoch_day")  # one row a day
    before = lambda c: F.lag(c).over(w)
    rows = days.select(
        before("last.p").alias("from_path"), F.col("first.p").alias("to_path"), before("epoch_day").alias("from_day"), F.col("epoch_day").alias("to_day"),
        before("last.d").alias("from_date"), F.col("first.d").alias("to_date"),
    )
    rows = rows.withColumn("gap_days", F.col("to_day") - F.col("from_day") - 1).where("gap_days > 0").orderBy(F.desc("gap_days"), *named("from_path", "to_path")).limit(k)
    return rows


def years(entries: DataFrame, strict: bool = True) -> DataFrame:
    """A row for each year that everything by year is made of: totals, temporal measures and revisits."""
    base = entries.groupBy("year").agg(F.count("*").alias("entries"), F.sum("word_count").alias("words"), F.avg("word_count").alias("mean_words"))
    return base.join(temporal(entries, "year", strict=strict), "year").join(revisits(entries, "year").select("year", "revisit_ratio", "intensity_per_word", F.col("intensity").alias("revision_weighted_words")), "year")


def year_profiles(entries: DataFrame, texts: DataFrame | None = None, strict: bool = True) -> DataFrame:
    """G14, W13. A row for each year with its structure, tags, change from the year before and productivity mode."""
    base = years(entries, strict)
    lags = lag_ranks(entries, "year").select("year", "median_lag", "half_life")
    joined = base.join(volume(entries, "year"), "year").join(lags, "year", "left").na.fill(0.0, ["median_lag", "half_life"])
    tags = tag_distribution(entries).where("year is not null").select("year", F.col("entropy").alias("tag_entropy"), F.col("concentration").alias("tag_concentration"))
    shifts = regime_shifts(entries, strict, texts, base).select(F.col("to_year").alias("year"), F.col("score").alias("regime_shift"))
    joined = joined.join(tags, "year", "left").join(shifts, "year", "left")
    mid = joined.agg(F.percentile("entries", 0.5).alias("m_n"), F.percentile("mean_words", 0.5).alias("m_w"), F.percentile("concentration", 0.5).alias("m_c"), F.percentile("intensity_per_word", 0.5).alias("m_r"))
    mode = (
        F.when((F.col("revisit_ratio") >= 0.25) & (F.col("intensity_per_word") >= F.greatest(F.lit(0.05), F.col("m_r") * 1.2)), "revision-heavy layering")
        .when((F.col("burstiness") >= 0.2) & (F.col("mean_words") <= F.col("m_w")), "bursty short-form")
        .when((F.col("concentration") >= F.col("m_c") * 1.15) & (F.col("mean_words") >= F.col("m_w")), "concentrated deep-writing")
        .when((F.col("entries") >= F.col("m_n")) & (F.col("mean_words") >= F.col("m_w")), "steady prolific")
        .when((F.col("entries") < F.col("m_n")) & (F.col("mean_words") >= F.col("m_w")), "sparse deep-writing")
        .otherwise("mixed cadence")
    )
    return joined.join(F.broadcast(mid)).withColumn("mode", mode).drop("m_n", "m_w", "m_c", "m_r")


def predominant_mode(profiles: DataFrame) -> DataFrame:
    """A35."""
    return profiles.groupBy("mode").agg(F.count("*").alias("years")).orderBy(F.desc("years"), *named("mode")).limit(1)


def tag_change(entries: DataFrame, strict: bool = True) -> DataFrame:
    """Q-2, M9. Jensen-Shannon distance of each year's tags to the year before; strict: compared by position of the sorted tags."""
    tags = entries.select("year", F.explode("tags").alias("tag")).groupBy("year", "tag").agg(F.count("*").alias("n"))
    return tag_change_of(tags, entries.select("year").distinct(), strict)


def tag_change_of(tags: DataFrame, every: DataFrame, strict: bool = True) -> DataFrame:
    """tag_change() from the counts (year, tag, n) and all years with entries."""
    shares = tags.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("year"))).withColumn("place", F.row_number().over(Window.partitionBy("year").orderBy(*named("tag"))))
    key = "place" if strict else "tag"
    order = Window.partitionBy().orderBy("year")  # one row a year
    around = every.select("year", F.lag("year").over(order).alias("before"), F.lead("year").over(order).alias("after"))
    years, zero = around.where("before is not null").select("year", "before"), F.lit(0.0)
    # A share counts in its own year, and in the next one as what was there before.
    use = lambda year, p, q: F.struct(year.alias("year"), p.alias("p"), q.alias("q"))
    uses = F.array(use(F.when(F.col("before").isNotNull(), F.col("year")), F.col("p"), zero), use(F.col("after"), zero, F.col("p")))
    cells = shares.join(around, "year").select(F.col(key).alias("key"), F.explode(uses).alias("c")).select("key", "c.*").where("year is not null")
    both = cells.groupBy("year", "key").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    mid = (F.col("p") + F.col("q")) / 2
    term = lambda c: F.when(F.col(c) > 0, F.col(c) * F.log2(F.col(c) / mid)).otherwise(0.0)
    some = F.when((F.sum("p") > 0) & (F.sum("q") > 0), F.sqrt(F.greatest(F.sum(term("p") + term("q")) / 2, F.lit(0.0)))).otherwise(0.0)
    return years.join(both.groupBy("year").agg(some.alias("tag_change")), "year", "left").select("year", "before", F.coalesce("tag_change", F.lit(0.0)).alias("tag_change"))


def text_change(profiles: DataFrame) -> DataFrame:
    """W9, J12. to_year, text_change: how much the body text differs from the year before that has any (see bodytext.year_profiles)."""
    w = Window.partitionBy().orderBy("year")  # one row a year
    names = ["richness", "novelty", "sentence_mean", "recurring_share"]
    rows = profiles.select("year", F.lag("year").over(w).alias("from_year"), *(F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in names), *(F.coalesce(F.lag(c).over(w), F.lit(0.0)).alias(f"old_{c}") for c in names))
    moved = lambda c, k: F.least(F.lit(1.0), F.abs(F.col(c) - F.col(f"old_{c}")) * k)
    sentence = F.least(F.lit(1.0), F.abs(F.ln((F.col("sentence_mean") + 1) / (F.col("old_sentence_mean") + 1))))
    change = moved("richness", 4) * 0.35 + moved("novelty", 2) * 0.25 + sentence * 0.2 + moved("recurring_share", 2) * 0.2
    return rows.where("from_year is not null").select("from_year", F.col("year").alias("to_year"), change.alias("text_change"))


def regime_shifts(entries: DataFrame, strict: bool = True, texts: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """W8, J11, O7. How much each year differs from the one before it that has entries; the largest change first.

    texts: the years' text profiles; where both years have one, the text counts too and the weights differ.
    known: years(), if there already.
    """
    return regime_shifts_of(known if known is not None else years(entries, strict), tag_change(entries, strict), texts)


def regime_shifts_of(known: DataFrame, changes: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """regime_shifts() from the years (year, words, revisit_ratio, burstiness) and tag_change()."""
    names = ["words", "revisit_ratio", "burstiness"]
    before = Window.partitionBy().orderBy("year")  # one row a year
    profiles = known.select("year", *names, *(F.lag(c).over(before).alias(f"old_{c}") for c in names))
    both = changes.join(profiles, "year")
    one = F.lit(1.0)
    parts = both.select(
        F.col("before").alias("from_year"), F.col("year").alias("to_year"), "tag_change", F.least(one, F.abs(F.ln((F.col("words") + 1) / (F.col("old_words") + 1)))).alias("volume_change"),
        F.least(one, F.abs(F.col("revisit_ratio") - F.col("old_revisit_ratio"))).alias("revision_change"), F.least(one, F.abs(F.col("burstiness") - F.col("old_burstiness")) * 2).alias("cadence_change"),
    )
    changed = text_change(texts) if texts is not None else parts.select("from_year", "to_year", F.lit(None).cast("double").alias("text_change")).where("false")
    parts = parts.join(changed, ["from_year", "to_year"], "left")
    plain = F.col("tag_change") * 0.45 + F.col("volume_change") * 0.25 + F.col("revision_change") * 0.15 + F.col("cadence_change") * 0.15
    full = F.col("tag_change") * 0.35 + F.col("text_change") * 0.2 + F.col("volume_change") * 0.2 + F.col("revision_change") * 0.125 + F.col("cadence_change") * 0.125
    scored = parts.select("from_year", "to_year", "tag_change", F.coalesce("text_change", F.lit(0.0)).alias("text_change"), "volume_change", "revision_change", "cadence_change", F.when(F.col("text_change").isNotNull(), full).otherwise(plain).alias("score"))
    return scored.orderBy(F.desc("score"), "to_year")
