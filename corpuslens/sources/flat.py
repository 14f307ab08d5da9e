"""The flat export: every table of an analysis in one table of 34 text columns, one row type for each kind of result.

A table that is not given leaves its rows out. All rows are built with column functions from tables that the operators
have already reduced, so the export adds no shuffle of its own but the sort when it is written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.config import AnalysisConfig, YearScope
from corpuslens.functions import timestamps as T
from corpuslens.functions.order import named as keys

# The columns of the format, in their order.
COLUMNS = [
    "row_type", "year", "label", "entries", "words", "reading_time_minutes", "reading_time_label", "average_entry_words", "average_entry_method", "average_entry_reading_minutes", "average_entry_reading_label",
    "analysis_duration_label", "created_fallback_count", "updated_fallback_count", "tag_entry_count", "tag_average_words", "tag_median_words", "tag_mean_word_delta", "tag_median_word_delta", "tag_primary_weekday",
    "tag_primary_weekday_share", "tag_secondary_weekday", "tag_secondary_weekday_share", "tag_dominant_month", "tag_dominant_month_share", "tag_filtered_entries", "tag_candidate_count", "tag_mean_tags_per_note",
    "tag_median_tags_per_note", "advanced_group", "advanced_name", "advanced_value", "advanced_detail", "advanced_score",
]
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
#: What a row needs besides its columns to be put in order: block, numbers (ascending), text.
ORDER = ["part", "place", "tie"]


def decimal(value: Column | str) -> Column:
    """V4. A whole number without decimals, others with two; null is 0. Sums are rounded to nine places first, so that their order of addition does not show."""
    exact = F.round(F.coalesce((F.col(value) if isinstance(value, str) else value).cast("double"), F.lit(0.0)), 9)
    cents = F.signum(exact) * F.floor(F.abs(exact) * 100 + 0.5) / 100
    return F.when(exact == F.floor(exact), exact.cast("long").cast("string")).otherwise(F.format_string("%.2f", cents))


def whole(value: Column | str) -> Column:
    return F.coalesce((F.col(value) if isinstance(value, str) else value).cast("string"), F.lit(""))


def facts(*parts: tuple[str, Column]) -> Column:
    """H27. `name=value; name=value`."""
    return F.concat_ws("; ", *(F.concat(F.lit(f"{name}="), value) for name, value in parts))


def named(index: Column | str, names: list[str]) -> Column:
    """The name at a number from 0; empty for null."""
    return F.coalesce(F.get(F.array(*map(F.lit, names)), F.col(index) if isinstance(index, str) else index), F.lit(""))


def clock(hour: str) -> Column:
    """H29. `07:00`, or `(none)`."""
    return F.when(F.col(hour).isNull(), "(none)").otherwise(F.format_string("%02d:00", hour))


class Flat:
    """Gathers the blocks in the order in which they are added."""

    def __init__(self):
        self.blocks: list[DataFrame] = []

    def add(self, rows: DataFrame, kind: str, place: list[Column] = (), tie: Column | None = None, **cells: Column) -> None:
        """place: what the rows are ordered by, ascending; tie: the last key."""
        blank = F.lit("")
        keys = F.array(*(F.coalesce(p.cast("double"), F.lit(0.0)) for p in place)) if place else F.array().cast("array<double>")
        own = [F.lit(kind).alias("row_type"), *((F.coalesce(cells[c].cast("string"), blank) if c in cells else blank).alias(c) for c in COLUMNS[1:])]
        self.blocks.append(rows.select(*own, F.lit(len(self.blocks)).alias("part"), keys.alias("place"), (tie if tie is not None else blank).alias("tie")))

    def advanced(self, rows: DataFrame, kind: str, group: str, name: Column, value: Column, detail: Column | None = None, score: Column | None = None, **more) -> None:
        cells = {"advanced_group": F.lit(group), "advanced_name": name, "advanced_value": value}
        if detail is not None:
            cells["advanced_detail"] = detail
        if score is not None:
            cells["advanced_score"] = score
        self.add(rows, kind, **more, **cells)

    def table(self) -> DataFrame:
        out = self.blocks[0]
        for block in self.blocks[1:]:
            out = out.unionByName(block)
        return out


def _year() -> dict[str, Column]:
    return {"year": F.col("year")}


def _tag_cells(label: str = "label") -> dict[str, Column]:
    """H26."""
    second = F.col("second_weekday").isNotNull()
    return {
        "label": F.col(label), "tag_entry_count": whole("entries"), "tag_average_words": decimal("mean_words"), "tag_median_words": decimal("median_words"), "tag_mean_word_delta": decimal("mean_delta"), "tag_median_word_delta": decimal("median_delta"),
        "tag_primary_weekday": named("weekday", WEEKDAYS), "tag_primary_weekday_share": decimal("weekday_share"), "tag_secondary_weekday": named("second_weekday", WEEKDAYS), "tag_secondary_weekday_share": F.when(second, decimal("second_share")),
        "tag_dominant_month": F.col("month"), "tag_dominant_month_share": decimal("month_share"), "tag_filtered_entries": whole("considered"), "tag_candidate_count": whole("labels"),
    }


def _totals(flat: Flat, t: dict[str, DataFrame], method: str, duration: str) -> None:
    """H28. Overall, years and tags. Sizes of the tag tables are one row, or one a year, and are joined to their rows."""
    if "tags" in t and "tag_summary" in t:
        size = t["tag_summary"].select(F.col("entries").alias("considered"), "mean_tags", "median_tags").join(F.broadcast(t["tags"].agg(F.count("*").alias("labels"))))
    else:
        size = None
    if "file_totals" in t:
        rows = t["file_totals"]
        cells = {
            "entries": whole("entries"), "words": whole("words"), "reading_time_minutes": decimal("reading_minutes"), "reading_time_label": F.col("reading_label"), "average_entry_words": decimal("selected_words"), "average_entry_method": F.lit(method),
            "average_entry_reading_minutes": decimal("selected_minutes"), "average_entry_reading_label": T.reading_label(F.col("selected_minutes")), "analysis_duration_label": F.lit(duration), "created_fallback_count": whole("created_fallbacks"), "updated_fallback_count": whole("updated_fallbacks"),
        }
        if size is not None:
            rows = rows.join(F.broadcast(size))
            cells |= {"tag_filtered_entries": whole("considered"), "tag_candidate_count": whole("labels"), "tag_mean_tags_per_note": decimal("mean_tags"), "tag_median_tags_per_note": decimal("median_tags")}
        flat.add(rows, "overall", **cells)
    if "file_years" in t:
        flat.add(
            t["file_years"], "year", [F.col("year")], **_year(), entries=whole("entries"), words=whole("words"), reading_time_minutes=decimal("reading_minutes"), reading_time_label=F.col("reading_label"),
            created_fallback_count=whole("created_fallbacks"), updated_fallback_count=whole("updated_fallbacks"),
        )
    order = [-F.col("entries"), -F.round(F.abs("mean_delta"), 9), -F.col("weekday_share")]
    if size is not None:
        flat.add(t["tags"].join(F.broadcast(size.select("considered", "labels"))), "tag_overall", order, F.col("label"), **_tag_cells())
    if "tags_by_year" in t and "tag_coverage" in t:
        sizes = t["tag_coverage"].select("year", F.col("entries").alias("considered")).join(t["tags_by_year"].groupBy("year").agg(F.count("*").alias("labels")), "year")
        flat.add(t["tags_by_year"].join(sizes, "year"), "tag_year", [F.col("year"), *order], F.col("label"), **_year(), **_tag_cells())


def _years_and_texts(flat: Flat, t: dict[str, DataFrame], scope: str | None, top: int, config: AnalysisConfig | None) -> None:
    if "headlines" in t:
        flat.advanced(t["headlines"], "advanced_headline", "headline", F.col("label"), F.col("value"), F.col("detail"), place=[F.col("place")])
    if "year_profiles" in t:
        detail = facts(("burstiness", decimal("burstiness")), ("concentration", decimal("concentration")), ("revisit_ratio", decimal("revisit_ratio")))
        flat.advanced(t["year_profiles"], "advanced_year", "year_profile", F.lit("productivity_mode"), F.col("mode"), detail, decimal("regime_shift"), place=[F.col("year")], **_year())
    if "text_years" in t:
        detail = facts(("novelty", decimal("novelty")), ("avg_sentence", decimal("sentence_mean")), ("opening", whole("opening")))
        flat.advanced(t["text_years"], "advanced_text_year", "body_text", F.lit("year_profile"), decimal("richness"), detail, decimal("recurring_share"), place=[F.col("year")], **_year())
    if "phrases" in t:
        best = t["phrases"].orderBy(F.desc("score"), F.desc("entries"), *keys("phrase")).limit(top)
        detail = facts(("first_year", whole("first_year")), ("last_year", whole("last_year")), ("avg_gap_days", decimal("mean_gap")))
        flat.advanced(best, "advanced_text_phrase", "body_text", F.col("phrase"), whole("entries"), detail, decimal("score"), place=[-F.col("score"), -F.col("entries")], tie=F.col("phrase"), year=F.col("last_year"))
    if "tag_texts" in t:
        detail = facts(
            ("avg_words", decimal("mean_words")), ("median_words", decimal("median_words")), ("lexical_richness", decimal("mean_richness")), ("avg_sentence", decimal("mean_sentence")), ("median_sentence", decimal("median_sentence")),
            ("avg_revision_lag", decimal("mean_lag")), ("median_revision_lag", decimal("median_lag")),
        )
        order = [-F.col("entries"), -F.coalesce("mean_richness", F.lit(-1.0))]
        flat.advanced(t["tag_texts"], "advanced_text_tag", "body_text", F.col("tag"), whole("entries"), detail, decimal("mean_richness"), place=order, tie=F.col("tag"))
    if flat.blocks and (scope is not None or config is not None):
        label = config.text_years.label() if config is not None else scope
        flat.advanced(_one(flat), "advanced_text_scope", "body_text", F.lit("time_scope"), F.lit(label), F.lit(_mode(label, config and config.text_years)))


def _one(flat: Flat) -> DataFrame:
    return flat.blocks[0].sparkSession.range(1)


def _mode(label: str, years: YearScope | None) -> str:
    if label == "All eligible years":
        return "mode=all-years"
    ends = lambda x: "" if x is None else x
    return "mode=year-range" + (f"; from={ends(years.from_year)}; to={ends(years.to_year)}" if years else "")


def _deep(flat: Flat, t: dict[str, DataFrame], top: int) -> None:
    group = "czech_normalized_text"
    if "deep_years" in t:
        detail = facts(("entries", whole("entries")), ("content_tokens", whole("content")), ("vocabulary", whole("vocabulary")), ("novelty", decimal("novelty")), ("content_share", decimal("content_share")))
        flat.advanced(t["deep_years"], "advanced_czech_year", group, F.lit("year_profile"), decimal("richness"), detail, decimal("vocabulary"), place=[F.col("year")], **_year())
    if "period_lists" in t:
        terms = t["period_lists"]
        turn = F.array_position(F.array(*map(F.lit, ("distinctive", "emergent", "fading"))), F.col("list"))
        detail = facts(("selected_count", whole("selected")), ("comparison_count", whole("compared")))
        for name in ("distinctive", "emergent", "fading"):
            lead = terms.where((F.col("list") == name) & (F.col("rank") == 1)).agg(F.first("term").alias("term"), F.first("score").alias("score"))
            flat.advanced(lead, "advanced_period_signature_metric", "period_signature", F.lit(f"strongest_{name}_term"), F.coalesce("term", F.lit("(none)")), score=decimal("score"))
        flat.advanced(terms, "advanced_period_signature_term", "period_signature", F.concat("list", F.lit(":"), "term"), F.col("term"), detail, decimal("score"), place=[turn, F.col("rank")])
    if "entities" in t:
        names, first, last = t["entities"], F.year("first_seen"), F.year("last_seen")
        span = [("support", whole("support")), ("first_year", whole(first)), ("last_year", whole(last)), ("active_years", whole("years"))]
        lists = {"persistent": ([-F.col("support"), -F.col("years"), first], F.col("label")), "bridge": ([-F.col("bridge"), -F.col("years"), -F.col("support")], F.col("label"))}
        for name, (order, tie) in lists.items():
            best = names.orderBy(*order, tie).limit(top)
            flat.advanced(best, "advanced_entity_candidate", "entity_candidates", F.concat(F.lit(f"{name}:"), "label"), F.col("label"), facts(*span, ("avg_gap_days", decimal("mean_gap"))), decimal("bridge"), place=order, tie=tie)
    if "entity_pairs" in t:
        order = [-F.col("strength"), -F.col("support"), -F.col("years")]
        label = F.concat_ws(" + ", "left_label", "right_label")
        best = t["entity_pairs"].orderBy(*order, *keys("left_label", "right_label")).limit(top)
        detail = facts(("left", whole("left_label")), ("right", whole("right_label")), ("active_years", whole("years")))
        flat.advanced(best, "advanced_entity_pair", "entity_candidates", label, whole("support"), detail, decimal("strength"), place=order, tie=label)


def _structure(flat: Flat, t: dict[str, DataFrame]) -> None:
    if "pair_lift" in t:
        label = F.concat_ws(" + ", "left", "right")
        flat.advanced(t["pair_lift"], "advanced_tag_pair", "tag_structure", label, whole("support"), F.lit("pair_lift"), decimal("lift"), place=[-F.round("lift", 9), -F.col("support")], tie=label)
    if "bridge_tags" in t:
        flat.advanced(t["bridge_tags"], "advanced_bridge_tag", "tag_structure", F.col("tag"), whole("n"), facts(("degree", whole("degree"))), decimal("score"), place=[-F.round("score", 9), -F.col("degree")], tie=F.col("tag"))
    if "regime_shifts" in t:
        detail = facts(("tag", decimal("tag_change")), ("text", decimal("text_change")), ("volume", decimal("volume_change")), ("revision", decimal("revision_change")), ("cadence", decimal("cadence_change")))
        name = F.concat_ws("->", F.col("from_year").cast("string"), F.col("to_year").cast("string"))
        flat.advanced(t["regime_shifts"], "advanced_regime_shift", "hidden_structure", name, decimal("score"), detail, decimal("score"), place=[-F.col("score"), -F.col("to_year")], year=F.col("to_year"))
    if "readings" in t:
        flat.advanced(t["readings"], "advanced_structural_reading", "hidden_structure", F.col("label"), F.col("value"), F.col("detail"), place=[F.col("place")])


def _extra(flat: Flat, t: dict[str, DataFrame]) -> None:
    group = "extra_metrics"
    add = lambda rows, name, value, detail=None, score=None: flat.advanced(rows, "extra_metric", group, F.lit(name), value, detail, score)
    if "longest_streak" in t:
        day = lambda c: F.date_format(F.date_from_unix_date(F.col(c).cast("int")), "yyyy-MM-dd")
        add(t["longest_streak"], "longest_writing_streak", whole("days"), facts(("start", day("first_day")), ("end", day("last_day")), ("entries", whole("entries"))), decimal("days"))
    if "hours" in t:
        hours = t["hours"] if "mean_words" in t["hours"].columns else t["hours"].withColumn("mean_words", F.lit(None).cast("double"))
        add(hours.agg(F.sum("entries").alias("n")), "timed_entries", whole("n"), score=decimal("n"))
        used = F.when(F.col("entries") > 0, F.col("entries"))
        for name, sign in (("most_active_hour", -1), ("quietest_active_hour", 1)):
            found = hours.agg(F.min_by(F.struct("*"), F.when(used.isNotNull(), F.struct((used * sign).alias("n"), F.col("hour")))).alias("h")).select("h.*")
            add(found, name, clock("hour"), facts(("entries", decimal("entries")), ("mean_words", decimal("mean_words"))), decimal("entries"))
    if "tag_years" in t:
        tags = t["tag_years"].groupBy("tag", "total").agg(F.count("*").alias("years"))
        lead = tags.agg(F.count("*").alias("shown"), F.min_by("tag", F.struct(-F.col("total"), F.col("tag"))).alias("tag"), F.max("total").alias("total"))
        add(lead, "displayed_heatmap_tags", whole("shown"), score=decimal("shown"))
        add(lead, "top_tag_in_scope", F.coalesce("tag", F.lit("(none)")), facts(("count", decimal("total"))), decimal("total"))
    if "month_profile" in t:
        detail = facts(("mean_words", decimal("mean_words")), ("median_words", decimal("median_words")))
        flat.advanced(t["month_profile"], "extra_month", group, named(F.col("month") - 1, MONTHS), whole("entries"), detail, decimal("mean_words"), place=[F.col("month")])
    if "hours" in t:
        flat.advanced(hours.where("entries > 0"), "extra_hour", group, clock("hour"), whole("entries"), facts(("mean_words", decimal("mean_words"))), decimal("entries"), place=[F.col("hour")])
    if "tag_years" in t:
        flat.advanced(t["tag_years"].where("entries > 0"), "extra_tag_frequency", group, F.col("tag"), whole("entries"), F.lit("tag_frequency_over_years"), decimal("entries"), place=[-F.col("total")], tie=F.concat("tag", F.col("year").cast("string")), **_year())


def _examples(flat: Flat, t: dict[str, DataFrame], limit: int) -> None:
    """The example rows, at most `limit` of each kind (at least one)."""
    limit, group = max(1, limit), "structural_examples"
    if "silence_gaps" in t:
        rows = t["silence_gaps"].orderBy(F.desc("gap_days"), *keys("from_path", "to_path")).limit(limit)
        detail = facts(("before", whole("from_path")), ("before_date", whole("from_date")), ("after", whole("to_path")), ("after_date", whole("to_date")))
        flat.advanced(rows, "structural_example_silence_gap", group, F.lit("silence_gap"), decimal("gap_days"), detail, decimal("gap_days"), place=[-F.col("gap_days")], tie=F.col("from_path"))
    if "revision_examples" in t:
        rows = t["revision_examples"].orderBy(F.desc("lag"), F.desc("word_count"), *keys("path")).limit(limit)
        flat.advanced(rows, "structural_example_revision_lag", group, F.col("path"), decimal("lag"), facts(("created", whole("created")), ("updated", whole("updated")), ("words", decimal("word_count"))), decimal("lag"), place=[-F.col("lag"), -F.col("word_count")], tie=F.col("path"))
    notes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda p: p["path"]), " | ")
    if "phrase_examples" in t and "phrases" in t:
        shown = t["phrase_examples"].groupBy("phrase").agg(notes.alias("notes")).join(t["phrases"], "phrase")
        rows = shown.orderBy(F.desc("score"), F.desc("entries"), *keys("phrase")).limit(limit)
        flat.advanced(rows, "structural_example_phrase", group, F.col("phrase"), whole("entries"), facts(("avg_gap_days", decimal("mean_gap")), ("notes", F.col("notes"))), decimal("score"), place=[-F.col("score"), -F.col("entries")], tie=F.col("phrase"))
    if "pair_examples" in t and "pair_lift" in t:
        shown = t["pair_lift"].join(t["pair_examples"].groupBy("left", "right").agg(notes.alias("notes")), ["left", "right"], "left")
        label = F.concat_ws(" + ", "left", "right")
        rows = shown.orderBy(F.desc("lift"), F.desc("support"), *keys("left", "right")).limit(limit)
        flat.advanced(rows, "structural_example_tag_pair", group, label, whole("support"), facts(("lift", decimal("lift")), ("notes", whole("notes"))), decimal("lift"), place=[-F.round("lift", 9), -F.col("support")], tie=label)
    if "bridge_examples" in t and "bridge_tags" in t:
        shown = t["bridge_tags"].join(t["bridge_examples"].groupBy("tag").agg(notes.alias("notes")), "tag", "left")
        rows = shown.orderBy(F.desc("score"), F.desc("degree"), *keys("tag")).limit(limit)
        flat.advanced(rows, "structural_example_bridge_tag", group, F.col("tag"), whole("n"), facts(("degree", whole("degree")), ("notes", whole("notes"))), decimal("score"), place=[-F.round("score", 9), -F.col("degree")], tie=F.col("tag"))
    if "shift_examples" in t and "regime_shifts" in t:
        sides = t["shift_examples"].groupBy("from_year", "to_year", "side").agg(notes.alias("notes"))
        both = sides.groupBy("from_year", "to_year").agg(*(F.coalesce(F.max(F.when(F.col("side") == s, F.col("notes"))), F.lit("")).alias(s) for s in ("before", "after")))
        rows = both.join(t["regime_shifts"].select("from_year", "to_year", "score"), ["from_year", "to_year"]).orderBy(F.desc("score"), F.desc("to_year")).limit(limit)
        name = F.concat_ws("->", F.col("from_year").cast("string"), F.col("to_year").cast("string"))
        flat.advanced(rows, "structural_example_regime_shift", group, name, decimal("score"), facts(("from_notes", F.col("before")), ("to_notes", F.col("after"))), decimal("score"), place=[-F.col("score"), -F.col("to_year")], year=F.col("to_year"))


def flat_rows(tables: dict[str, DataFrame], method: str = "mean", duration: str = "", text_scope: str | None = None, top: int = 10, examples: int = 0, config: AnalysisConfig | None = None) -> DataFrame:
    """G15, S19, U5, H26-H29. The 34 columns as text, with part, place and tie for their order.

    tables: as analyze() names them; file_totals, file_years, tag_summary, hours, readings and period_lists besides.
    examples: how many example rows of each kind; 0 for none. config: adds the rows that say which years and tags count.
    """
    flat = Flat()
    _totals(flat, tables, method, duration)
    _years_and_texts(flat, tables, text_scope, top, config)
    if config is not None and config.deep_text and flat.blocks:
        deep = config.deep.resolved(config)
        ends = ["" if x is None else x for x in (deep.years.from_year, deep.years.to_year)]
        tags = f"; from={ends[0]}; to={ends[1]}; included={'|'.join(deep.included)}; excluded={'|'.join(deep.excluded)}"
        flat.advanced(_one(flat), "advanced_czech_scope", "czech_normalized_text", F.lit("scope"), F.lit(deep.label()), F.lit(f"mode=defined{tags}" if deep.defined else "mode=all"))
    _deep(flat, tables, top)
    _structure(flat, tables)
    _extra(flat, tables)
    if config is not None and flat.blocks:
        flat.advanced(_one(flat), "extra_metric", "extra_metrics", F.lit("hour_metric_scope"), F.lit(config.hour_years.label()))
    if examples > 0:
        _examples(flat, tables, examples)
    if not flat.blocks:
        raise ValueError("no table of the export is given")
    return flat.table()


def write_flat(rows: DataFrame, path: str) -> None:
    """S19. CSV with a header, in order; cells are quoted where they hold a quote, comma or line break."""
    ordered = rows.orderBy(*ORDER).select(*COLUMNS)
    ordered.coalesce(1).write.mode("overwrite").csv(path, header=True, escape='"', emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
