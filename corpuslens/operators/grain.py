"""What cards and readings are made of, from three passes over the notes: facts, words and phrases.

Each pass ends in one aggregation, whose exchange all tables that are made from it share. So that the branches of a plan
have the same exchange, nothing that they do may go below it: the groups' columns are never null, and all measures, the
kind of a row too, come in one array that slice() keeps whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions import text as X
from corpuslens.functions import timestamps as T
from corpuslens.functions.order import sorted_texts
from corpuslens.operators import bodytext as B
from corpuslens.operators import rhythm as H
from corpuslens.operators import tagstructure as G

#: Kinds of facts. All but the last, tags of notes without a date, are of dated notes.
DAY, OPENING, TAG, PAIR, TAGGED, LOOSE = range(6)
#: The sums of each kind, by place.
SUMS = {DAY: ("words", "revised", "usable", "intensity", "sentence_count", "sentence_words"), TAG: ("lag", "lagging", "richness", "rich")}
SUMS[LOOSE] = SUMS[TAG]
WIDTH = max(map(len, SUMS.values()))


def _whole(*values: Column, kind: str) -> Column:
    """The values as one array, which the optimizer takes no value out of."""
    return F.slice(F.array(*(v.cast(kind) for v in values)), 1, len(values))


def facts(rows: DataFrame, rich: bool = True) -> DataFrame:
    """year, month, day, left, right, m: one row for each day, opening of a year, tag of a year and pair of tags.

    rows: texts() with updated. rich: the mean richness of a tag's notes is wanted, which takes each note's distinct words.
    """
    dated, none = F.col("created").isNotNull(), F.lit("")
    exact = T.lag_days(F.col("created"), F.col("updated"))
    later, whole = F.when(exact > 0, exact), F.when(F.col("lag_days") > 0, F.col("lag_days"))
    richness = X.richness(F.col("token_count"), F.size("vocabulary")) if rich else F.lit(None).cast("double")
    flag = lambda c: F.when(c.isNotNull(), 1)
    measures = {
        DAY: {"words": F.col("word_count"), "revised": flag(later), "usable": flag(exact), "intensity": F.col("word_count") * F.log1p(later), "sentence_count": F.col("sentence_count"), "sentence_words": F.col("sentence_words")},
        TAG: {"lag": whole, "lagging": flag(whole), "richness": richness, "rich": flag(richness)},
    }
    sums = {kind: [F.coalesce(own[name].cast("double"), F.lit(0.0)).alias(name) for name in SUMS[kind]] for kind, own in measures.items()}
    note = rows.select(
        F.coalesce("year", F.lit(0)).alias("year"), F.coalesce(F.month("created"), F.lit(0)).alias("month"), F.coalesce(T.epoch_day(F.col("created")), F.lit(0)).alias("day"), dated.alias("dated"), "opening",
        sorted_texts(F.array_distinct(F.filter("tags", lambda t: t.isNotNull()))).alias("tags"), F.struct(*sums[DAY]).alias("of_day"), F.struct(*sums[TAG]).alias("of_tag"),
    )

    def cell(kind: int, left: Column = none, right: Column = none, year: Column = F.lit(0), month: Column = F.lit(0), day: Column = F.lit(0)) -> Column:
        own = [F.col("of_day" if kind == DAY else "of_tag")[name] for name in SUMS.get(kind, ())]
        return F.struct(F.lit(kind).alias("kind"), year.alias("year"), month.alias("month"), day.alias("day"), left.alias("left"), right.alias("right"), *(x.alias(f"m{k}") for k, x in enumerate([*own, *[F.lit(0.0)] * (WIDTH - len(own))])))

    some = lambda condition, one: F.when(condition, F.array(one)).otherwise(F.array().cast(nothing))
    nothing = note.select(F.array(cell(TAG)).alias("c")).schema["c"].dataType
    tags, of = F.coalesce("tags", F.array().cast("array<string>")), F.col("year")
    pairs = F.transform(G._pairs(F.col("tags")), lambda p: cell(PAIR, p["left"], p["right"]))
    cells = F.concat(
        some(F.col("dated"), cell(DAY, year=of, month=F.col("month"), day=F.col("day"))), some(F.col("dated") & F.col("opening").isNotNull(), cell(OPENING, F.coalesce("opening", none), year=of)),
        F.when(F.col("dated"), F.transform(tags, lambda t: cell(TAG, F.coalesce(t, none), year=of))).otherwise(F.transform(tags, lambda t: cell(LOOSE, F.coalesce(t, none)))), some(F.col("dated") & (F.size(tags) > 0), cell(TAGGED)), F.when(F.col("dated") & (F.size(tags) > 1), pairs).otherwise(F.array().cast(nothing)),
    )
    found = note.select(F.explode(cells).alias("c")).select("c.*")
    text = lambda c: F.coalesce(c, none).alias(c)
    keys = [F.col("kind").alias("of"), "year", "month", "day", text("left"), text("right")]
    return found.groupBy(*keys).agg(_whole(F.max("kind"), F.count("*"), *(F.sum(f"m{k}") for k in range(WIDTH)), kind="double").alias("m")).select("year", "month", "day", "left", "right", "m")


def _of(found: DataFrame, kind: int) -> tuple[DataFrame, Column, dict[str, Column]]:
    """The facts of a kind, the number of notes behind each, and its sums."""
    return found.where(F.col("m")[0] == kind), F.col("m")[1].cast("long"), {name: F.col("m")[k] for k, name in enumerate(SUMS.get(kind, ()), 2)}


def words(rows: DataFrame) -> DataFrame:
    """year, w: the distinct words of each year. (explode() would add a filter that makes the words a second time.)"""
    return rows.where("created is not null").select("year", F.explode_outer("vocabulary").alias("w")).where("w is not null").distinct()


def phrases(rows: DataFrame, days: bool = True) -> DataFrame:
    """phrase, m: how many notes hold it, its first and last year; of a phrase that one note holds, that note and its number of phrases; days: how many it has, the first and the last.

    A note without phrases counts as one phrase of its own, which no text can hold.
    """
    held = rows.select(F.monotonically_increasing_id().alias("note"), "year", "epoch_day", X.phrases(F.col("tokens")).alias("held"))
    own = F.array(F.concat(F.lit(" "), F.col("note").cast("string")))
    held = held.withColumn("held", F.when(F.size("held") > 0, F.col("held")).otherwise(own))
    found = held.select("note", "year", "epoch_day", F.size("held").alias("many"), F.explode("held").alias("phrase"))
    day = F.col("epoch_day")
    measures = [F.count("*"), F.min("year"), F.max("year"), F.min("note"), F.min("many"), *([F.count_distinct(day), F.min(day), F.max(day)] if days else [])]
    return found.groupBy(F.coalesce("phrase", F.lit("")).alias("phrase")).agg(_whole(*measures, kind="long").alias("m"))


def recurring(found: DataFrame) -> DataFrame:
    """recurring_phrases() from phrases()."""
    n, first, last, _, _, days, begin, end = (F.col("m")[k] for k in range(8))
    gap = F.when(days >= 2, (end - begin) / (days - 1))
    return B.scored(found.where(n >= 2).select("phrase", n.alias("entries"), first.cast("int").alias("first_year"), last.cast("int").alias("last_year"), gap.alias("mean_gap")))


def alone(found: DataFrame) -> DataFrame:
    """year, alone: the notes whose phrases no other note holds."""
    n, year, _, note, many = (F.col("m")[k] for k in range(5))
    once = found.where(n == 1).select(note.alias("note"), year.cast("int").alias("year"), many.alias("many"))
    return once.groupBy("note", "year", "many").agg(F.count("*").alias("n")).where("n = many").groupBy("year").agg(F.count("*").alias("alone"))


def year_texts(years: DataFrame, used: DataFrame, found: DataFrame) -> DataFrame:
    """year, richness, novelty, sentence_mean, recurring_share of bodytext.year_profiles(), from years(), words() and phrases()."""
    first = F.min("year").over(Window.partitionBy("w"))
    vocabulary = used.select("year", (first == F.col("year")).alias("fresh")).groupBy("year").agg(F.count("*").alias("vocabulary"), F.count_if("fresh").alias("fresh"))
    rows = years.join(vocabulary, "year", "left").join(alone(found), "year", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.select(
        "year", X.richness(F.col("tokens"), zero("vocabulary")).alias("richness"), (F.col("fresh") / F.col("vocabulary")).alias("novelty"),
        F.when(F.col("sentence_count") > 0, F.col("tokens") / F.col("sentence_count")).alias("sentence_mean"), ((F.col("entries") - zero("alone")) / F.col("entries")).alias("recurring_share"),
    )


def structure(notes: DataFrame, full: bool = False) -> dict[str, DataFrame]:
    """What headlines() takes, over notes with body text; full: what structural_readings() takes.

    notes: path, created, updated, text, tags, and word_count where that is not the number of tokens.
    """
    rows = B.texts(notes, "updated")
    rows = rows if "word_count" in rows.columns else rows.withColumn("word_count", F.col("token_count"))
    made, used, held = facts(rows, full), words(rows), phrases(rows, full)
    day, n, sums = _of(made, DAY)
    days = day.select("year", F.col("day").alias("epoch_day"), "month", n.alias("entries"), *(v.alias(k) for k, v in sums.items()))
    total = lambda *names: {c: F.sum(c).cast("double" if c == "intensity" else "long") for c in names}
    base = days.withColumnRenamed("sentence_words", "tokens").groupBy("year").agg(*(v.alias(k) for k, v in total("entries", "sentence_count", "tokens").items()))
    ratio = F.when(F.col("usable") > 0, F.col("revised") / F.col("usable")).otherwise(0.0)
    each = F.when(F.col("words") > 0, F.col("intensity") / F.col("words")).otherwise(0.0)
    years = H.temporal_of(days, "year", more=total("words", "revised", "usable", "intensity")).select("year", "burstiness", "words", ratio.alias("revisit_ratio"), each.alias("intensity_per_word"))
    months = days.groupBy("year", "month").agg(F.sum("words").alias("words"))
    dense = months.groupBy("year").agg(F.when(F.sum("words") > 0, F.sum(F.col("words") * F.col("words")) / F.pow(F.sum("words"), 2)).otherwise(0.0).alias("concentration"))
    tag, n, sums = _of(made, TAG)
    cells = tag.select("year", F.col("left").alias("tag"), n.alias("n"))
    spread = G.spread_of(cells).select("year", F.col("entropy").alias("tag_entropy"), F.col("concentration").alias("tag_concentration"))
    pairs = _of(made, PAIR)[0].select("left", "right", n.alias("support"))
    tagged = _of(made, TAGGED)[0].select(n.alias("entries"))
    openings = _of(made, OPENING)[0].select("year", F.col("left").alias("opening"), n.alias("n"))
    known = base.select("year").join(openings.groupBy("year").agg(F.sum("n").alias("total")), "year", "left").na.fill(0, ["total"])
    texts = year_texts(base, used, held)
    out = {
        "profiles": years.select("year", "burstiness", "intensity_per_word", "revisit_ratio").join(dense, "year").join(spread, "year", "left"),
        "pairs": G.pair_lift_of(pairs, cells.groupBy("tag").agg(F.sum("n").alias("n")), tagged),
        "shifts": H.regime_shifts_of(years, H.tag_change_of(cells, base.select("year")), texts), "texts": texts, "openings": B.opening_shift_of(openings, known),
    }
    if full:
        mean = lambda a, b: F.when(F.sum(b) > 0, F.sum(a) / F.sum(b))
        out["phrases"] = recurring(held)
        tags = made.where(F.col("m")[0].isin(TAG, LOOSE)).select(F.col("left").alias("tag"), n.alias("n"), *(v.alias(k) for k, v in sums.items()))
        out["tags"] = tags.groupBy("tag").agg(F.sum("n").alias("entries"), mean("lag", "lagging").alias("mean_lag"), mean("richness", "rich").alias("mean_richness"))
    return out
