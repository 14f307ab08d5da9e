"""The Markdown report: eight sections over the tables of an analysis.

Spark sorts and cuts every table before its few rows come to the driver; only then are they written as text. A table
that is not given leaves out what is read from it, an empty one shows `(none)`.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal
from math import floor

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from corpuslens.config import AnalysisConfig
from corpuslens.operators.bodytext import SIMPLE
from corpuslens.sources.flat import MONTHS, WEEKDAYS

NONE = "(none)"
#: Rows shown of each list. 0 or less: all (records and examples: none).
LIMITS = {"tags": 20, "tags_by_year": 10, "pair_lift": 5, "regime_shifts": 5, "date_issues": 10, "phrases": 5, "period_lists": 10, "entities": 10, "entity_pairs": 10, "tag_texts": 10, "records": 20, "examples": 0}
# The names of the combination depths.
DEPTHS = {1: "Single tags only", 2: "Single tags and pairs", 3: "Single tags, pairs, and triplets"}


def number(value) -> str:
    """V4. A whole number as it is, others with one decimal; the binary value is rounded, half up."""
    if value is None:
        return NONE
    if value == floor(value):
        return str(int(value))
    return str(Decimal(float(value)).quantize(Decimal("0.1"), ROUND_HALF_UP))


def signed(value) -> str:
    return NONE if value is None else "0" if value == 0 else ("+" if value > 0 else "-") + number(abs(value))


def percent(value) -> str:
    return f"{floor((value or 0.0) * 100 + 0.5)}%"


def plain(value) -> str:
    return NONE if value is None or value == "" else str(value)


def share(label: str | None, part: float | None) -> str:
    return "" if not label or not part else f"{label} ({percent(part)})"


def link(path: str) -> str:
    """V6."""
    bare = path[:-3] if path.lower().endswith(".md") else path
    return f"[[{bare}|{bare.rsplit('/', 1)[-1]}]]"


def callout(kind: str, title: str, *said: str) -> list[str]:
    return [f"> [!{kind}] {title}", *(f"> {x}" for x in said), ""]


def grid(heads: list[str], rows: list[list[str]], text: set[int] = frozenset()) -> list[str]:
    """A table; the columns in `text` are aligned left, the others right. No rows: one row of `(none)`."""
    cells = lambda row: "| " + " | ".join(x.replace("|", "\\|") for x in row) + " |"
    marks = "| " + " | ".join("---" if k in text else "---:" for k in range(len(heads))) + " |"
    return [cells(heads), marks, *map(cells, rows or [[NONE] * len(heads)]), ""]


def metrics(rows: list[tuple[str, str]]) -> list[str]:
    return grid(["Metric", "Value"], [list(r) for r in rows], {0, 1})


class Report:
    """Writes the sections one after the other."""

    def __init__(self, tables: dict[str, DataFrame], config: AnalysisConfig, limits: dict[str, int], expanded: bool, run: dict[str, str]):
        self.t, self.config, self.limits, self.expanded, self.run = tables, config, LIMITS | limits, expanded, run

    def rows(self, name: str, *order, limit: int = 0) -> list[Row]:
        """The first rows of a table (all of one that is small by its nature)."""
        if name not in self.t:
            return []
        found = self.t[name].orderBy(*order) if order else self.t[name]
        return (found.limit(limit) if limit > 0 else found).collect()

    def first(self, name: str, *order) -> Row | None:
        return next(iter(self.rows(name, *order, limit=1)), None)

    def pairs(self, name: str, shown: list[tuple[str, str, Callable]]) -> list[tuple[str, str]]:
        """Metrics out of a table of one row."""
        row = self.first(name)
        return [] if row is None else [(label, say(row[column])) for label, column, say in shown if column in row]

    def overview(self) -> list[str]:
        years, all_files = self.rows("file_years", "year"), self.first("file_totals")
        if all_files is None:
            return []
        written = ", ".join(str(y["year"]) for y in years) or NONE
        out = callout(
            "summary", "Snapshot", *(f"- **{k}:** {v}" for k, v in self.run.items()), f"- **Entries:** {all_files['entries']}", f"- **Words:** {all_files['words']}", f"- **Years written:** {written}",
            f"- **Time to read all:** {all_files['reading_label']}",
        )
        if all_files["created_fallbacks"] or all_files["updated_fallbacks"]:
            out += callout("warning", "Fallback dates used", f"- **Created fallback:** {all_files['created_fallbacks']}", f"- **Updated fallback:** {all_files['updated_fallbacks']}", "- Read what depends on these dates with care.")
        out += ["## Overview", ""] + metrics([("Years written", written)] + self.pairs("file_totals", [
            ("Total entries", "entries", str), ("Total words", "words", str), ("Mean words per entry", "mean_words", number), ("Median words per entry", "median_words", number), ("Time to read all", "reading_label", str),
            ("Average-length entry", "selected_words", lambda v: f"{number(v)} words, {self.config.summary_method}"),
        ]) + [("Reading speed", f"{self.config.words_per_minute} words per minute")])
        shown = [[str(y["year"]), str(y["entries"]), str(y["words"]), y["reading_label"], str(y["created_fallbacks"]), str(y["updated_fallbacks"])] for y in years]
        return out + ["### Per-year summary", ""] + grid(["Year", "Entries", "Words", "Reading time", "Created fallback", "Updated fallback"], shown, {0, 3})

    def scope(self) -> list[str]:
        c = self.config
        yes = lambda v: "Yes" if v else "No"
        counts = self.pairs("scope_summary", [("Matched markdown files", "matched", str), ("Ignored by scope", "scope", str), ("Ignored by folder rules", "ignored", str), ("Ignored by hidden folders", "hidden", str)])
        own = [("Folder mode", c.scope_mode), ("Scope folders", ", ".join(c.folders) or NONE), ("Include subfolders", yes(c.subfolders)), ("Ignore hidden folders", yes(c.skip_hidden)), ("Ignored folder rules", ", ".join(c.ignored_folders) or NONE)]
        return ["## Scope", ""] + metrics(own + counts)

    def _tags(self, rows: list[Row], month: str) -> list[str]:
        day = lambda k: None if k is None else WEEKDAYS[k]
        days = lambda r: " / ".join(filter(None, (share(day(r["weekday"]), r["weekday_share"]), share(day(r["second_weekday"]), r["second_share"])))) or NONE
        shown = [[r["label"], str(r["entries"]), number(r["mean_words"]), number(r["median_words"]), signed(r["mean_delta"]), signed(r["median_delta"]), days(r), share(r["month"], r["month_share"]) or NONE] for r in rows]
        return grid(["Tag", "Entries", "Avg words", "Median words", "Mean delta vs baseline", "Median delta vs baseline", "Most common weekday", month], shown, {0, 6, 7})

    def tags(self) -> list[str]:
        """H31. The per-year tables are cut to their first rows in Spark: what comes back is bounded by the years."""
        c = self.config
        out = ["## Tag analytics", ""] + metrics([("Minimum frequency", str(c.min_tag_count)), ("Combination depth", DEPTHS[c.combination_size]), ("Hierarchy mode", c.tag_mode), ("Alias rules", str(len(c.tag_aliases))), ("Ignored tags", str(len(c.ignored_tags)))] + self.pairs("tag_summary", [("Filtered entries", "entries", str), ("Mean tags per note", "mean_tags", number), ("Median tags per note", "median_tags", number)]))
        order = [F.desc("entries"), F.desc(F.abs("mean_delta")), F.desc("weekday_share"), F.col("label")]
        if "tags" in self.t:
            out += ["### All years combined", ""] + self._tags(self.rows("tags", *order, limit=self.limits["tags"]), "Most common month/year")
        if "tags_by_year" in self.t:
            turn = F.row_number().over(Window.partitionBy("year").orderBy(*order))
            k = self.limits["tags_by_year"]
            best = self.t["tags_by_year"].withColumn("turn", turn)
            years: dict[int, list[Row]] = {}
            for row in (best.where(F.col("turn") <= k) if k > 0 else best).orderBy("year", "turn").collect():
                years.setdefault(row["year"], []).append(row)
            for year, rows in years.items():
                out += [f"### {year}", ""] + self._tags(rows, "Most common month")
        return out

    def _sayings(self, kind: str, title: str, name: str) -> list[str]:
        rows = self.rows(name, "place")
        return callout(kind, title, *(f"- **{r['label']}:** {r['value']}. {r['detail']}" for r in rows)) if rows else []

    def structure(self) -> list[str]:
        """H32, G17."""
        days = lambda v: NONE if v is None else f"{number(v)} d"
        out = ["## Structural patterns", ""] + self._sayings("abstract", "Headline findings", "headlines")
        found = []
        for name, shown in {
            "temporal": [("Burstiness index", "burstiness", number), ("Longest silence gap", "longest_gap", days), ("Seasonal asymmetry", "season_asymmetry", number)],
            "weekday_stability": [("Weekday bias stability", "stability", percent)],
            "volume": [("Length skewness", "skew", number), ("Tail heaviness", "tail_ratio", number), ("Compression vs expansion", "short_long", number)],
            "revision": [("Revisit ratio", "revisit_ratio", percent), ("Revision half-life", "half_life", days), ("Revision-weighted words index", "intensity_per_word", number)],
            "cadence_depth": [("Cadence vs note depth", "correlation", number)], "revision_length": [("Revision vs final length", "correlation", number)], "predominant_mode": [("Predominant productivity mode", "mode", plain)],
        }.items():
            found += self.pairs(name, shown)
        if "tag_distribution" in self.t:
            over_all = next((r for r in self.rows("tag_distribution") if r["year"] is None), None)
            found += [] if over_all is None else [("Tag entropy", number(over_all["entropy"])), ("Tag concentration", number(over_all["concentration"]))]
        out += ["### Overall advanced metrics", ""] + metrics(found) if found else []
        if "year_profiles" in self.t:
            shown = [[str(r["year"]), str(r["entries"]), number(r["mean_words"]), number(r["burstiness"]), number(r["concentration"]), percent(r["revisit_ratio"]), number(r["tag_entropy"]), plain(r["mode"]), number(r["regime_shift"])] for r in self.rows("year_profiles", "year")]
            out += ["### Year profiles", ""] + grid(["Year", "Entries", "Avg words", "Burstiness", "Concentration", "Revisit ratio", "Tag entropy", "Mode", "Shift from previous"], shown, {7})
        own = []
        if "fastest_tag" in self.t:
            tag = self.first("fastest_tag")
            own.append(("Fastest-returning tag", NONE if tag is None else f"{tag['tag']} ({number(tag['mean_gap'])} d)"))
        if "persistence" in self.t:
            tag = self.first("persistence", F.desc("longest_run"), F.desc("active_years"), "tag")
            own.append(("Most persistent tag", NONE if tag is None else f"{tag['tag']} ({tag['longest_run']}/{tag['active_years']} y)"))
        if "length_coupling" in self.t:
            ends = {r["side"]: r for r in reversed(self.rows("length_coupling", F.desc(F.abs("delta")), "tag"))}
            own += [(f"Strongest {kind} tag-length coupling", f"{ends[side]['tag']} ({signed(ends[side]['delta'])})" if side in ends else NONE) for kind, side in (("positive", "longer"), ("negative", "shorter"))]
        if own:
            out += ["### Tag structures", ""] + metrics(own)
        if "pair_lift" in self.t:
            rows = self.rows("pair_lift", F.desc("lift"), F.desc("support"), "left", "right", limit=self.limits["pair_lift"])
            out += grid(["Pair", "Support", "Lift"], [[f"{r['left']} + {r['right']}", str(r["support"]), number(r["lift"])] for r in rows], {0})
        out += self.texts() + ["### Hidden structures", ""] + self._sayings("abstract", "Structural readings", "readings")
        if "regime_shifts" in self.t:
            rows = self.rows("regime_shifts", F.desc("score"), F.desc("to_year"), limit=self.limits["regime_shifts"])
            parts = ["score", "tag_change", "text_change", "volume_change", "revision_change", "cadence_change"]
            out += grid(["From", "To", "Score", "Tag", "Text", "Volume", "Revision", "Cadence"], [[str(r["from_year"]), str(r["to_year"]), *(number(r[p]) for p in parts)] for r in rows])
        return out + self.examples()

    def texts(self) -> list[str]:
        """G17. Body text, words of periods, names."""
        if not self.config.body_text:
            return ["### Text-aware patterns", ""] + callout("note", "Body-text analysis", "Body-text analysis is switched off.")
        out = []
        if "text_years" in self.t:
            shown = [[str(r["year"]), number(r["richness"]), percent(r["novelty"]), number(r["sentence_mean"]), number(r["sentence_variation"]), plain(r["opening"]), percent(r["recurring_share"])] for r in self.rows("text_years", "year")]
            out += grid(["Year", "Lexical richness", "Novelty", "Avg sentence", "Variation", "Opening", "Recurring phrase share"], shown, {5})
        if "phrases" in self.t:
            rows = self.rows("phrases", F.desc("score"), F.desc("entries"), "phrase", limit=self.limits["phrases"])
            span = lambda a, b: str(a) if a == b else f"{a}-{b}"
            out += grid(["Phrase", "Entries", "Year span", "Avg gap", "Score"], [[r["phrase"], str(r["entries"]), span(r["first_year"], r["last_year"]), number(r["mean_gap"]), number(r["score"])] for r in rows], {0, 2})
        if "tag_texts" in self.t:
            rows = self.rows("tag_texts", F.desc("entries"), F.desc_nulls_last("mean_richness"), "tag", limit=self.limits["tag_texts"])
            out += grid(["Tag", "Entries", "Avg words", "Lexical richness", "Avg sentence", "Avg revision lag"], [[r["tag"], str(r["entries"]), *(number(r[c]) for c in ("mean_words", "mean_richness", "mean_sentence", "mean_lag"))] for r in rows], {0})
        if "period_lists" in self.t:
            k = self.limits["period_lists"]
            rows = [r for r in self.rows("period_lists", "list", "rank") if k <= 0 or r["rank"] <= k]
            out += grid(["List", "Term", "Selected", "Compared", "Score"], [[r["list"], r["term"], str(r["selected"]), str(r["compared"]), number(r["score"])] for r in rows], {0, 1})
        if "entities" in self.t:
            rows = self.rows("entities", F.desc("support"), F.desc("years"), "label", limit=self.limits["entities"])
            out += grid(["Name", "Entries", "Years", "Avg gap", "Bridge"], [[r["label"], str(r["support"]), str(r["years"]), number(r["mean_gap"]), number(r["bridge"])] for r in rows], {0})
        if "entity_pairs" in self.t:
            rows = self.rows("entity_pairs", F.desc("strength"), F.desc("support"), F.desc("years"), "left_label", "right_label", limit=self.limits["entity_pairs"])
            out += grid(["Names", "Entries", "Years", "Strength"], [[f"{r['left_label']} + {r['right_label']}", str(r["support"]), str(r["years"]), number(r["strength"])] for r in rows], {0})
        return ["### Text-aware patterns", "", *out] if out else []

    def examples(self) -> list[str]:
        """H35. Notes behind the figures; none unless a number is asked for."""
        k, out = self.limits["examples"], []
        if k <= 0:
            return out
        if "silence_gaps" in self.t:
            rows = self.rows("silence_gaps", F.desc("gap_days"), "from_day", limit=k)
            out += ["#### Silence gaps", ""] + grid(["Days", "Before", "After"], [[number(r["gap_days"]), link(r["from_path"]), link(r["to_path"])] for r in rows], {1, 2})
        if "revision_examples" in self.t:
            rows = self.rows("revision_examples", F.desc("lag"), F.desc("word_count"), "path", limit=k)
            out += ["#### Revision lags", ""] + grid(["Note", "Days", "Words"], [[link(r["path"]), number(r["lag"]), str(r["word_count"])] for r in rows], {0})
        for name, title, keys in (("phrase_examples", "Recurring phrases", ["phrase"]), ("pair_examples", "Tag pairs", ["left", "right"]), ("bridge_examples", "Bridge tags", ["tag"]), ("shift_examples", "Regime shifts", ["from_year", "to_year", "side"])):
            if name in self.t:
                notes = F.array_sort(F.collect_list(F.struct("rank", "path"))).alias("notes")
                rows = self.t[name].groupBy(*keys).agg(notes).orderBy(*keys).limit(k).collect()
                out += [f"#### {title}", ""] + grid([x.replace("_", " ").capitalize() for x in keys] + ["Notes"], [[*(str(r[x]) for x in keys), ", ".join(link(n["path"]) for n in r["notes"])] for r in rows], set(range(len(keys) + 1)))
        return ["### Structural examples", "", *out] if out else []

    def records(self) -> list[str]:
        """H37. The short view has five sections, the expanded one ten."""
        k = self.limits["records"]
        if k <= 0 or "records" not in self.t:
            return []
        sections: dict[str, list[Row]] = {}
        for row in self.t["records"].where(F.col("rank") <= k).orderBy("rank").collect():
            sections.setdefault(row["section"], []).append(row)
        out = []
        for name in sections if self.expanded else [s for s in SIMPLE if s in sections]:
            out += [f"### {name.replace('-', ' ').capitalize()}", ""] + grid(["Note", "Value", "Detail"], [[link(r["path"]), number(r["score"]), f"{r['word_count']} words"] for r in sections[name]], {0, 1, 2})
        return ["## Records", "", *out] if out else []

    def extra(self) -> list[str]:
        """H34."""
        found, out = [], []
        if "longest_streak" in self.t:
            day = lambda c: F.date_format(F.date_from_unix_date(F.col(c).cast("int")), "yyyy-MM-dd").alias(c)
            streak = self.t["longest_streak"].select("days", "entries", day("first_day"), day("last_day")).first()
            found.append(("Longest writing streak", NONE if streak is None else f"{streak['days']} d ({streak['first_day']} -> {streak['last_day']}, {streak['entries']} entries)"))
        months = self.rows("month_profile", "month")
        used = [r for r in months if r["entries"]]
        if months:
            say = lambda r: f"{MONTHS[r['month'] - 1]} ({number(r['mean_words'])} words)"
            found += [("Most verbose month", say(max(used, key=lambda r: r["mean_words"])) if used else NONE), ("Shortest month", say(min(used, key=lambda r: r["mean_words"])) if used else NONE)]
            out += ["### Month length by calendar month", ""] + grid(["Month", "Entries", "Mean words", "Median words"], [[MONTHS[r["month"] - 1], str(r["entries"]), number(r["mean_words"]), number(r["median_words"])] for r in months], {0})
        hours = [r for r in self.rows("hours", "hour") if r["entries"]]
        if "hours" in self.t:
            say = lambda r: f"{r['hour']:02d}:00 ({r['entries']} entries)"
            found += [("Most active hour", say(max(hours, key=lambda r: r["entries"])) if hours else NONE), ("Quietest active hour", say(min(hours, key=lambda r: r["entries"])) if hours else NONE), ("Timed entries", str(sum(r["entries"] for r in hours)))]
            mean = lambda r: number(r["mean_words"]) if "mean_words" in r else NONE
            out += ["### Hour-of-day activity", ""] + (grid(["Hour", "Entries", "Mean words"], [[f"{r['hour']:02d}:00", str(r["entries"]), mean(r)] for r in hours], {0}) if hours else callout("note", "Hour-of-day activity", "No entry in scope has a time of day."))
        if "tag_years" in self.t:
            cells = self.t["tag_years"].groupBy("tag", "total").pivot("year").agg(F.first("entries")).orderBy(F.desc("total"), "tag")
            years, rows = [c for c in cells.columns if c not in ("tag", "total")], cells.collect()
            found += [("Displayed heatmap tags", str(len(rows))), ("Top tag in scope", f"{rows[0]['tag']} ({rows[0]['total']})" if rows else NONE)]
            out += ["### Tag frequency over years", ""] + (grid(["Tag", *years], [[r["tag"], *(str(r[y] or 0) for y in years)] for r in rows], {0}) if rows else callout("note", "Tag frequency over years", "No tag is frequent enough."))
        return ["## Extra metrics", ""] + (metrics(found) if found else []) + out

    def dates(self) -> list[str]:
        """H33, V8."""
        out = ["## Date quality", ""] + callout("warning", "Interpretation caveat", "- A fallback date stands where the note's own date is missing or invalid; such notes still count.")
        found = self.pairs("file_totals", [
            ("Created key missing", "created_missing", str), ("Created key invalid", "created_invalid", str), ("Updated key missing", "updated_missing", str), ("Updated key invalid", "updated_invalid", str),
            ("Entries using created fallback", "created_fallbacks", str), ("Entries using updated fallback", "updated_fallbacks", str), ("Unresolved chronology", "undated", str),
        ])
        rows = self.rows("date_issues", "path", limit=self.limits["date_issues"])
        out += metrics(found) if found else []
        if rows:
            shown = [[r["path"], *(f"{r[f'{c}_issue'] or 'OK'} / {r[f'{c}_source']}" for c in ("created", "updated"))] for r in rows]
            out += ["### Sample date issues", ""] + grid(["Path", "Created", "Updated"], shown, {0, 1, 2}) + [f"_Showing the first {len(rows)} issue rows._", ""]
        return out

    def performance(self) -> list[str]:
        """H37. cache_counts: what FeatureStore.refresh() counts."""
        counts = self.pairs("cache_counts", [("Reused cached files", "reused", str), ("Refreshed files", "refreshed", str), ("Dropped deleted files", "dropped", str)])
        return ["## Performance", ""] + metrics([*self.run.items(), *counts])


def report(tables: dict[str, DataFrame], config: AnalysisConfig = AnalysisConfig(), limits: dict[str, int] | None = None, expanded: bool = False, run: dict[str, str] | None = None) -> str:
    """G16, G17, H31-H38. The report as Markdown.

    tables: as analyze() names them; file_totals, file_years, scope_summary, date_issues, cache_counts and period_lists
    besides. limits: see LIMITS. expanded: all ten record sections. run: what is said of the run, by label.
    """
    r = Report(tables, config, limits or {}, expanded, run or {})
    parts = [r.overview(), r.scope(), r.tags(), r.structure(), r.records(), r.extra(), r.dates(), r.performance()]
    return "\n".join(["# Corpus statistics report", "", *(line for part in parts for line in part)])
