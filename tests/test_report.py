"""The Markdown report: formats, every section, cut lists, empty and missing tables."""

import datetime

import pytest

from corpuslens.config import AnalysisConfig
from corpuslens.operators import corpus as C
from corpuslens.plans.analysis import analyze
from corpuslens.sources import report as R


def test_formats():
    assert [R.number(v) for v in (2.0, 0.25, 0.35, -1.25, 7, None, 12.96)] == ["2", "0.3", "0.3", "-1.3", "7", "(none)", "13.0"]  # as a double, 0.35 is a little less
    assert [R.signed(v) for v in (1.5, -2.0, 0.0, None)] == ["+1.5", "-2", "0", "(none)"]
    assert [R.percent(v) for v in (0.125, 0.5, None)] == ["13%", "50%", "0%"]
    assert R.link("a/b.MD") == "[[a/b|b]]" and R.link("c") == "[[c|c]]"
    assert R.grid(["A", "B"], [["x|y", "1"]], {0}) == ["| A | B |", "| --- | ---: |", "| x\\|y | 1 |", ""]
    assert R.grid(["A"], [])[2] == "| (none) |"


@pytest.fixture
def tables(spark):
    make = spark.createDataFrame
    tag = "entries long, mean_words double, median_words double, mean_delta double, median_delta double, weekday int, weekday_share double, second_weekday int, second_share double, month string, month_share double"
    return {
        "file_totals": make([(3, 60, 20.0, 15.5, 15.5, "1 min", 1, 0, 1, 0, 2, 0, 1)], "entries long, words long, mean_words double, median_words double, selected_words double, reading_label string, created_fallbacks long, updated_fallbacks long, created_missing long, created_invalid long, updated_missing long, updated_invalid long, undated long"),
        "file_years": make([(2021, 1, 10, "0 min", 1, 0), (2020, 2, 50, "1 min", 0, 0)], "year int, entries long, words long, reading_label string, created_fallbacks long, updated_fallbacks long"),
        "scope_summary": make([(5, 3, 1, 1, 0)], "total long, matched long, hidden long, ignored long, scope long"),
        "tag_summary": make([(3, 2, 1.5, 1.0)], "entries long, tagged long, mean_tags double, median_tags double"),
        "tags": make([("b", 1, 5.0, 5.0, -15.0, -10.5, 6, 1.0, None, None, "2020-01", 1.0), ("a|c", 2, 30.0, 30.25, 10.0, 14.75, 0, 0.5, 6, 0.5, "2020-02", 0.5)], "label string, " + tag),
        "tags_by_year": make([(2020, "b", 1, 5.0, 5.0, -15.0, -10.5, 6, 1.0, None, None, "January", 1.0), (2020, "a", 2, 30.0, 30.0, 10.0, 14.5, 0, 0.5, 6, 0.5, "February", 0.5)], "year int, label string, " + tag),
        "tag_distribution": make([(2020, 9.0, 9.0), (None, 1.58, 0.5)], "year int, entropy double, concentration double"),
        "headlines": make([(2, "Second", "v2", "d2"), (1, "First", "v1", "d1")], "place int, label string, value string, detail string"),
        "length_coupling": make([("a", 2, 10.0, "longer"), ("c", 2, 12.5, "longer"), ("b", 1, -15.0, "shorter")], "tag string, n long, delta double, side string"),
        "regime_shifts": make([(y, y + 1, 0.1, 0.0, 0.2, 0.3, 0.4, y / 10000.0) for y in range(2010, 2018)], "from_year int, to_year int, tag_change double, text_change double, volume_change double, revision_change double, cadence_change double, score double"),
        "records": make([(s, f"d/{k}.md", 10.0 - k, 7, k) for s in ("longest-notes", "fewest-tags") for k in (1, 2)], "section string, path string, score double, word_count long, rank int"),
        "longest_streak": make([(18262, 18264, 3, 4)], "first_day int, last_day int, days long, entries long"),
        "month_profile": make([(m, int(m in (2, 3)), 10.0 * m if m in (2, 3) else 0.0, 0.0) for m in range(1, 13)], "month int, entries int, mean_words double, median_words double"),
        "hours": make([(h, h if h in (7, 9) else 0) for h in range(24)], "hour int, entries long"),
        "tag_years": make([("a", 2020, 5, 3), ("a", 2021, 5, 2), ("b", 2020, 9, 9), ("b", 2021, 9, 0)], "tag string, year int, total long, entries long"),
        "date_issues": make([(f"n{k:02d}.md", "missing", "filesystem-ctime", None, "frontmatter") for k in range(12)], "path string, created_issue string, created_source string, updated_issue string, updated_source string"),
        "silence_gaps": make([("x.md", "y.md", 1, 11, 10), ("p.md", "q.md", 20, 80, 60)], "from_path string, to_path string, from_day int, to_day int, gap_days int"),
        "phrase_examples": make([("in all", 2, "b.md"), ("in all", 1, "z.md")], "phrase string, rank int, path string"),
        "cache_counts": make([(2, 1, 0)], "reused long, refreshed long, dropped long"),
    }


def test_sections(tables):
    text = R.report(tables, limits={"examples": 1}, run={"Generated": "today"})
    lines = text.split("\n")
    assert [x for x in lines if x.startswith("## ")] == [f"## {x}" for x in ("Overview", "Scope", "Tag analytics", "Structural patterns", "Records", "Extra metrics", "Date quality", "Performance")]
    for line in [
        "> - **Years written:** 2020, 2021", "> [!warning] Fallback dates used", "| Average-length entry | 15.5 words, mean |", "| 2021 | 1 | 10 | 0 min | 1 | 0 |", "| Ignored by hidden folders | 1 |", "| Tag entropy | 1.6 |",
        "| a\\|c | 2 | 30 | 30.3 | +10 | +14.8 | Monday (50%) / Sunday (50%) | 2020-02 (50%) |", "| b | 1 | 5 | 5 | -15 | -10.5 | Sunday (100%) | January (100%) |", "| Strongest positive tag-length coupling | c (+12.5) |",
        "| [[d/1\\|1]] | 9 | 7 words |", "| Longest writing streak | 3 d (2020-01-01 -> 2020-01-03, 4 entries) |", "| Most verbose month | Mar (30 words) |", "| Quietest active hour | 07:00 (7 entries) |", "| 09:00 | 9 | (none) |",
        "| Tag | 2020 | 2021 |", "| Top tag in scope | b (9) |", "| n00.md | missing / filesystem-ctime | OK / frontmatter |", "_Showing the first 10 issue rows._", "| 60 | [[p\\|p]] | [[q\\|q]] |", "| in all | [[z\\|z]], [[b\\|b]] |", "| Refreshed files | 1 |",
    ]:
        assert line in lines, line
    assert lines.index("> - **First:** v1. d1") < lines.index("> - **Second:** v2. d2")
    assert lines.index("| b | 9 | 0 |") < lines.index("| a | 3 | 2 |")
    shifts = [x for x in lines if x.startswith("| 201")]
    assert len(shifts) == 5 and shifts[0].startswith("| 2017 | 2018 | 0.2 |")
    assert "### Longest notes" in lines and "### Fewest tags" not in lines
    assert "### Fewest tags" in R.report({"records": tables["records"]}, expanded=True)
    assert "[[p" not in R.report({"silence_gaps": tables["silence_gaps"]}) and "## Records" not in R.report({"records": tables["records"]}, limits={"records": 0})


def test_limits_and_nothing(tables):
    every = R.report({k: tables[k] for k in ("regime_shifts", "tags_by_year")}, limits={"regime_shifts": 0, "tags_by_year": 1}).split("\n")
    assert sum(x.startswith("| 201") for x in every) == 8
    assert any(x.startswith("| a | 2") for x in every) and not any(x.startswith("| b | 1") for x in every)
    empty = R.report({k: v.where("false") for k, v in tables.items()})
    assert "| (none) | (none) | (none) |" in empty and "No tag is frequent enough." in empty
    assert "## Performance" in R.report({}) and "Body-text analysis is switched off." in R.report({}, AnalysisConfig(body_text=False))


def test_whole_analysis(spark):
    day = lambda k: datetime.datetime(2019 + k % 3, 1 + k % 12, 1 + k % 28, 7)
    rows = [(f"f/n{k}.md", day(k), day(k) + datetime.timedelta(days=k % 5), 5 + k, ["x", "y"] if k % 2 else ["x"], f"Today I met Anna Novak again. The sea was calm on day {k}.") for k in range(24)]
    notes = spark.createDataFrame(rows, "path string, created timestamp, updated timestamp, word_count long, tags array<string>, text string").cache()
    tables = analyze(notes)
    wanted = ("tag_summary", "tags", "temporal", "volume", "revision", "weekday_stability", "predominant_mode", "pair_lift", "persistence", "fastest_tag", "text_years", "phrases", "tag_texts", "records", "hours", "tag_years")
    text = R.report({k: tables[k] for k in wanted})
    assert "| x | 24 |" in text and "| Weekday bias stability |" in text and "### Text-aware patterns" in text and "### Longest notes" in text
    assert C.totals(C.to_entries(notes)).count() == 4
