"""The flat export: cells, order, quoting and the rows that the registered query does not show."""

import glob

import pytest
from pyspark.sql import functions as F

from corpuslens.sources import flat as FL


def advanced(kind, year, group, name, value, detail="", score=""):
    return [kind, year] + [""] * 27 + [group, name, value, detail, score]


def test_decimal(spark):
    rows = spark.createDataFrame([(2.0,), (0.125,), (-0.125,), (1.005,), (None,), (12.3456,), (1e-12,)], "v double")
    assert [r[0] for r in rows.select(FL.decimal("v")).collect()] == ["2", "0.13", "-0.13", "1.00", "0", "12.35", "0"]


def test_rows(spark):
    make = spark.createDataFrame
    tables = {
        "text_years": make([(2020, 0.9, 0.5, 7.25, None, 0.1), (2019, None, None, None, "other", 0.0)], "year int, richness double, novelty double, sentence_mean double, opening string, recurring_share double"),
        "phrases": make([("in, the \"end\"", 2, 2019, 2020, 3.5, 4.0), ("all of it", 3, 2019, 2019, None, 9.0)], "phrase string, entries long, first_year int, last_year int, mean_gap double, score double"),
        "phrase_examples": make([("all of it", 2, "b.md"), ("all of it", 1, "a.md")], "phrase string, rank int, path string"),
        "period_lists": make([("fading", 1, "old", 0, 3, -1.5)], "list string, rank int, term string, selected long, compared long, score double"),
        "entity_pairs": make([("Ann", "Bob", 2, 1, 2.0), ("Ann", "Cid", 4, 2, 6.25)], "left_label string, right_label string, support long, years long, strength double"),
        "hours": make([(h, 2 if h in (7, 9) else 0, 10.0) for h in range(24)], "hour int, entries long, mean_words double"),
        "regime_shifts": make([(2019, 2020, 0.5, 0.0, 0.25, 1.0, 0.125, 0.4)], "from_year int, to_year int, tag_change double, text_change double, volume_change double, revision_change double, cadence_change double, score double"),
        "shift_examples": make([(2019, 2020, "before", 1, "a.md"), (2019, 2020, "before", 2, "b.md")], "from_year int, to_year int, side string, rank int, path string"),
    }
    out = FL.flat_rows(tables, text_scope="2019 to 2020", examples=1).orderBy(*FL.ORDER).select(*FL.COLUMNS).collect()
    assert all(len(r) == 34 for r in out)
    shift = "tag=0.50; text=0; volume=0.25; revision=1; cadence=0.13"
    strongest = lambda kind, term, score: advanced("advanced_period_signature_metric", "", "period_signature", f"strongest_{kind}_term", term, "", score)
    assert [list(r) for r in out] == [
        advanced("advanced_text_year", "2019", "body_text", "year_profile", "0", "novelty=0; avg_sentence=0; opening=other", "0"),
        advanced("advanced_text_year", "2020", "body_text", "year_profile", "0.90", "novelty=0.50; avg_sentence=7.25; opening=", "0.10"),
        advanced("advanced_text_phrase", "2019", "body_text", "all of it", "3", "first_year=2019; last_year=2019; avg_gap_days=0", "9"),
        advanced("advanced_text_phrase", "2020", "body_text", 'in, the "end"', "2", "first_year=2019; last_year=2020; avg_gap_days=3.50", "4"),
        advanced("advanced_text_scope", "", "body_text", "time_scope", "2019 to 2020", "mode=year-range"),
        strongest("distinctive", "(none)", "0"),
        strongest("emergent", "(none)", "0"),
        strongest("fading", "old", "-1.50"),
        advanced("advanced_period_signature_term", "", "period_signature", "fading:old", "old", "selected_count=0; comparison_count=3", "-1.50"),
        advanced("advanced_entity_pair", "", "entity_candidates", "Ann + Cid", "4", "left=Ann; right=Cid; active_years=2", "6.25"),
        advanced("advanced_entity_pair", "", "entity_candidates", "Ann + Bob", "2", "left=Ann; right=Bob; active_years=1", "2"),
        advanced("advanced_regime_shift", "2020", "hidden_structure", "2019->2020", "0.40", shift, "0.40"),
        advanced("extra_metric", "", "extra_metrics", "timed_entries", "4", "", "4"),
        advanced("extra_metric", "", "extra_metrics", "most_active_hour", "07:00", "entries=2; mean_words=10", "2"),
        advanced("extra_metric", "", "extra_metrics", "quietest_active_hour", "07:00", "entries=2; mean_words=10", "2"),
        advanced("extra_hour", "", "extra_metrics", "07:00", "2", "mean_words=10", "2"),
        advanced("extra_hour", "", "extra_metrics", "09:00", "2", "mean_words=10", "2"),
        advanced("structural_example_phrase", "", "structural_examples", "all of it", "3", "avg_gap_days=0; notes=a.md | b.md", "9"),
        advanced("structural_example_regime_shift", "2020", "structural_examples", "2019->2020", "0.40", "from_notes=a.md | b.md; to_notes=", "0.40"),
    ]
    with pytest.raises(ValueError):
        FL.flat_rows({})


def test_empty_hours(spark):
    hours = spark.createDataFrame([(h, 0, 0.0) for h in range(24)], "hour int, entries long, mean_words double")
    out = FL.flat_rows({"hours": hours}).orderBy(*FL.ORDER).select("advanced_name", "advanced_value", "advanced_detail", "advanced_score").collect()
    assert [tuple(r) for r in out] == [("timed_entries", "0", "", "0"), ("most_active_hour", "(none)", "entries=0; mean_words=0", "0"), ("quietest_active_hour", "(none)", "entries=0; mean_words=0", "0")]


def test_write(spark, tmp_path):
    rows = spark.createDataFrame([('a "b", c', 2, 2019, 2020, 3.5, 4.0)], "phrase string, entries long, first_year int, last_year int, mean_gap double, score double")
    FL.write_flat(FL.flat_rows({"phrases": rows}), str(tmp_path / "out"))
    (part,) = glob.glob(str(tmp_path / "out" / "*.csv"))
    head, line = open(part).read().splitlines()
    assert head.split(",") == FL.COLUMNS
    assert line == 'advanced_text_phrase,2020,' + "," * 27 + 'body_text,"a ""b"", c",2,first_year=2019; last_year=2020; avg_gap_days=3.50,4'
    back = spark.read.csv(str(tmp_path / "out"), header=True, escape='"').first()
    assert back["advanced_name"] == 'a "b", c' and back["label"] is None
