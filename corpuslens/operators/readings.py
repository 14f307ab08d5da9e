"""Headline cards and structural readings: a few sentences from the tables of an analysis, each read in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.order import named


def metric(value: Column) -> Column:
    """A whole number as it is, others with two decimals."""
    return F.when(value == F.floor(value), value.cast("long").cast("string")).otherwise(F.format_string("%.2f", value.cast("double")))


def _leaders(profiles: DataFrame, columns: list[str]) -> DataFrame:
    """One row: for each column the row with its largest value (the earliest year of equal ones) as a struct, or null."""
    pick = lambda c: F.max_by(F.struct("*"), F.when(F.col(c).isNotNull(), F.struct(F.col(c), -F.col("year")))).alias(f"by_{c}")
    return profiles.agg(*map(pick, columns))


def _one(rows: DataFrame, name: str, order: list[Column] | None = None) -> DataFrame:
    """One row with the first of the rows as a struct, or null."""
    return (rows.orderBy(*order) if order else rows).limit(1).agg(F.first(F.struct("*")).alias(name))


def _table(row: DataFrame, cards: list[tuple]) -> DataFrame:
    cells = [F.struct(F.lit(k).alias("place"), F.lit(label).alias("label"), value.cast("string").alias("value"), detail.alias("detail")) for k, (label, value, detail) in enumerate(cards, 1)]
    return row.select(F.explode(F.array(*cells)).alias("card")).select("card.*")


def _say(*parts) -> Column:
    return F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))


def headlines(profiles: DataFrame, pairs: DataFrame, shifts: DataFrame, texts: DataFrame | None = None, openings: DataFrame | None = None) -> DataFrame:
    """G4. place, label, value, detail: eight cards, three more with body text. pairs: in the order of their lift."""
    names = ["burstiness", "intensity_per_word", "tag_concentration", "tag_entropy", "concentration", "revisit_ratio"]
    row = _leaders(profiles, names).join(_one(pairs, "pair")).join(_one(shifts, "shift", [F.desc("score"), F.col("to_year")]))

    def card(label, column, said, none):
        found = F.col(f"by_{column}")
        return label, F.coalesce(found["year"].cast("string"), F.lit("(none)")), F.coalesce(_say(said, metric(found[column])), F.lit(none))

    pair, shift = F.col("pair"), F.col("shift")
    cards = [
        card("Most bursty year", "burstiness", "Burstiness ", "Not enough dated entries."),
        card("Most revision-heavy year", "intensity_per_word", "Revision intensity ", "No usable revision data."),
        card("Most thematically concentrated year", "tag_concentration", "Tag concentration ", "No qualifying tag distribution."),
        card("Most semantically diverse year", "tag_entropy", "Tag entropy ", "No qualifying tag distribution."),
        ("Strongest recurring motif", F.coalesce(_say(pair["left"], " + ", pair["right"]), F.lit("(none)")), F.coalesce(_say("Lift ", metric(pair["lift"]), ", support ", pair["support"].cast("string")), F.lit("No qualifying tag pair."))),
        ("Sharpest regime shift year", F.coalesce(shift["to_year"].cast("string"), F.lit("(none)")), F.coalesce(_say("From ", shift["from_year"].cast("string"), ", score ", metric(shift["score"])), F.lit("Not enough adjacent years."))),
        card("Most concentrated writing year", "concentration", "Concentration ", "Not enough dated entries."),
        card("Most revisited year", "revisit_ratio", "Revisit ratio ", "No usable revision data."),
    ]
    if texts is not None:
        row = row.join(_leaders(texts, ["richness", "recurring_share"])).join(_one(openings, "opening_moved", [F.desc("distance"), F.col("year")]))
        moved = F.col("opening_moved")
        cards += [
            card("Richest vocabulary year", "richness", "Lexical richness ", "No body-text year profile."),
            card("Most repetitive phrasing year", "recurring_share", "Recurring phrase share ", "No recurring phrase profile."),
            ("Sharpest opening-style shift", F.coalesce(moved["year"].cast("string"), F.lit("(none)")), F.coalesce(_say("From ", moved["before"].cast("string"), ", score ", metric(moved["distance"])), F.lit("No consecutive opening-style shift."))),
        ]
    return _table(row, cards)


def structural_readings(profiles: DataFrame, pairs: DataFrame, shifts: DataFrame, texts: DataFrame | None = None, openings: DataFrame | None = None, phrases: DataFrame | None = None, tags: DataFrame | None = None) -> DataFrame:
    """G5. place, label, value, detail: up to seven readings; those without data are left out."""
    row = _leaders(profiles, ["concentration"]).join(_one(pairs, "pair")).join(_one(shifts, "shift", [F.desc("score"), F.col("to_year")]))
    shift, dense, pair = F.col("shift"), F.col("by_concentration"), F.col("pair")
    cards = [
        ("Sharpest structural shift", shift["to_year"], _say("From ", shift["from_year"].cast("string"), "; combined score ", metric(shift["score"]), ".")),
        ("Most concentrated writing year", dense["year"], _say("Writing concentration ", metric(dense["concentration"]), ".")),
        ("Strongest recurring tag motif", _say(pair["left"], " + ", pair["right"]), _say("Lift ", metric(pair["lift"]), " across ", pair["support"].cast("string"), " entries.")),
    ]
    if texts is not None:
        row = row.join(_leaders(texts, ["richness"])).join(_one(openings, "opening_moved", [F.desc("distance"), F.col("year")])).join(_one(phrases, "phrase_family", [F.desc("score"), F.desc("entries"), *named("phrase")])).join(_one(tags.where("mean_lag is not null"), "revised_tag", [F.desc("mean_lag"), F.desc("entries"), F.desc_nulls_last("mean_richness"), *named("tag")]))
        rich, phrase, tag, moved = F.col("by_richness"), F.col("phrase_family"), F.col("revised_tag"), F.col("opening_moved")
        zero = F.lit(0.0)
        cards += [
            ("Richest vocabulary period", rich["year"], _say("Lexical richness ", metric(rich["richness"]), " with novelty ", metric(F.coalesce(rich["novelty"], zero)), ".")),
            ("Most persistent recurrent phrase", phrase["phrase"], _say(phrase["entries"].cast("string"), " entries from ", phrase["first_year"].cast("string"), " to ", phrase["last_year"].cast("string"), ".")),
            ("Most revision-heavy tag", tag["tag"], _say("Average revision lag ", metric(tag["mean_lag"]), " days.")),
            ("Sharpest opening-style drift", moved["year"], _say("Shift from ", moved["before"].cast("string"), " with score ", metric(moved["distance"]), ".")),
        ]
    return _table(row, cards).where("value is not null")
