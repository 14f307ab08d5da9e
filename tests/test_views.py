"""Views, scopes, period choices, readings, and the rules that registered queries do not show."""

import pytest
from pyspark.sql import functions as F

from corpuslens.config import AnalysisConfig, DeepScope, YearScope
from corpuslens.operators import bodytext as B
from corpuslens.operators import entities as M
from corpuslens.operators import readings as R
from corpuslens.operators import rhythm as H
from corpuslens.operators import views as V
from corpuslens.operators.corpus import to_entries
from corpuslens.operators.recommend import recommend, recommend_all


def test_limits_sorting_search(spark):
    rows = spark.createDataFrame([("b10", 2), ("B9", None), (None, 1), ("a", 3)], "name string, n int")
    assert V.limited(rows, None, 2).count() == 2 and V.limited(rows, 0, 2).count() == 4 and V.limited(rows, 3, 0).count() == 3
    assert [r.name for r in V.sorted_by(rows, "name").collect()] == ["a", "B9", "b10", None]
    assert [r.name for r in V.sorted_by(rows, "name", True).collect()] == ["b10", "B9", "a", None]
    assert [r.n for r in V.sorted_by(rows, "n", True).collect()] == [3, 2, 1, None]
    assert [r.name for r in V.search(rows, " B1 ").collect()] == ["b10"] and V.search(rows, " ").count() == 4
    assert V.search(rows, "key", F.lit("Keyword")).count() == 4


def test_labels(spark):
    row = spark.range(1).select(
        V.share_label(F.lit("A"), F.lit(0.6), F.lit("B"), F.lit(0.405)).alias("a"), V.share_label(F.lit("A"), F.lit(0.6), F.lit(None).cast("string"), F.lit(0.0), " / ").alias("b"), V.share_label(F.lit("A"), F.lit(0.0), F.lit("B"), F.lit(0.0)).alias("c"),
        V.wiki_link(F.lit("x/y z.md")).alias("d"), V.histogram_label(F.lit(0.0), F.lit(5.0)).alias("e"), V.histogram_label(F.lit(2.0), F.lit(3.0)).alias("f"), V.span_label(F.lit(2020), F.lit(2020)).alias("g"), V.span_label(F.lit(2020), F.lit(2022)).alias("h"),
        R.metric(F.lit(2.0)).alias("i"), R.metric(F.lit(0.126)).alias("j"),
    ).first()
    assert tuple(row) == ("A (60%) | B (41%)", "A (60%)", "(none)", "[[x/y z|y z]]", "0-4", "2", "2020", "2020-2022", "2", "0.13")


def test_scopes(spark):
    rows = spark.createDataFrame([(2020, ["a"]), (2021, ["a", "x"]), (2022, []), (None, ["a"])], "year int, tags array<string>")
    keep = lambda c: [r.year for r in rows.where(c).collect()]
    assert keep(YearScope(2021, None).holds(F.col("year"))) == [2021, 2022] and YearScope(None, 2021).label() == "start to 2021" and YearScope().label() == "All eligible years"
    config = AnalysisConfig(tag_aliases={"B": "A"}, ignored_tags=("gone",))
    scope = DeepScope(True, YearScope(), ("#b", "gone"), ("X",)).resolved(config)
    assert (scope.included, scope.excluded) == (("a",), ("x",))
    assert keep(scope.holds(F.col("year"), F.col("tags"))) == [2020] and len(keep(DeepScope().holds(F.col("year"), F.col("tags")))) == 4
    assert AnalysisConfig(body_text=False).signature() != AnalysisConfig().signature()


def test_periods(spark):
    assert B.resolve_period([]) is None and B.resolve_period([2019, 2021])[:2] == (2021, 2021)
    assert B.resolve_period([2019, 2021], None, 2020, True) == (2020, 2020, 2019, 2019) and B.resolve_period([2019, 2023], 2022, 2021)[:2] == (2021, 2022)
    terms = spark.createDataFrame([(2020, "old", 3), (2021, "both", 2), (2022, "both", 2), (2022, "new", 4), (2023, "late", 5)], "year int, term string, n long")
    got = {r.term: (r.selected, r.compared, r.kind) for r in B.period_terms(terms, 2022, 2022).collect()}
    assert got == {"old": (0, 3, "fading"), "both": (2, 2, "distinctive"), "new": (4, 0, "emergent"), "late": (0, 5, "fading")}
    earlier = B.period_terms(terms, 2022, 2022, True)
    assert {r.term for r in earlier.collect()} == {"old", "both", "new"}
    assert [(r.list, r["rank"], r.term) for r in B.period_lists(earlier).orderBy("list", "rank").collect()] == [("distinctive", 1, "new"), ("emergent", 1, "new"), ("fading", 1, "old"), ("fading", 2, "both")]


def test_records_qualify(spark):
    notes = spark.createDataFrame([("a", None, None, 0, []), ("b", "2020-01-01", "2020-01-01", 3, ["t"]), ("c", "2020-01-02", "2020-01-05", 5, ["t", "u"])], "path string, c string, u string, word_count long, tags array<string>")
    notes = notes.select("path", F.to_timestamp("c").alias("created"), F.to_timestamp("u").alias("updated"), "word_count", "tags", F.when(F.col("word_count") > 0, "one two three").alias("text"))
    rows = B.record_sections(B.records(notes, B.texts(notes))).collect()
    of = lambda name: [r.path for r in sorted(rows, key=lambda r: r["rank"]) if r.section == name]
    assert of("shortest-notes") == ["b", "c"] and of("longest-revision-lags") == ["c"] and of("longest-notes") == ["c", "b", "a"] and of("fewest-tags") == ["a", "b", "c"]
    assert B.record_sections(B.records(notes, B.texts(notes)), 0).count() == 0 and set(B.SIMPLE) < {s for s, _, _ in B.SECTIONS}


def test_volume_edges(spark):
    notes = spark.createDataFrame([(f"n{k}", "2020-01-01", w) for k, w in enumerate([2, 4, 4, 6, 0])], "path string, c string, word_count long").select("path", F.to_timestamp("c").alias("created"), F.to_timestamp("c").alias("updated"), "word_count", F.array().cast("array<string>").alias("tags"))
    row = H.volume(to_entries(notes)).first()
    assert row.short_long == (2 + 1) / (1 + 1) and row.concentration == 1.0  # both limits are inclusive
    assert H.volume(to_entries(notes.withColumn("word_count", F.lit(0).cast("long")))).first().concentration == 0.0


def test_name_lists(spark):
    rows = spark.createDataFrame([("Ann", 5, 2, 4.0, "2019-01-01", "2020-01-01"), ("Bob", 5, 2, 9.0, "2018-01-01", "2023-01-01"), ("Cid", 2, 1, 1.0, "2022-01-01", "2022-05-01")], "label string, support long, years long, bridge double, a string, b string").select("label", "support", "years", "bridge", F.to_timestamp("a").alias("first_seen"), F.to_timestamp("b").alias("last_seen"))
    got = {(r.list, r["rank"]): r.label for r in M.top_candidates(rows).collect()}
    assert [got["persistent", 1], got["bridge", 1], got["newest", 1], got["longest-lived", 1]] == ["Bob", "Bob", "Cid", "Bob"]


@pytest.mark.parametrize("seed", [1, 2])
def test_recommend_all_equals_plain(spark, seed):
    """The short list by profiles gives what scoring every pair gives."""
    import random

    g = random.Random(seed)
    rows = [(f"n{k:02}", [f"n{g.randrange(40):02}" for _ in range(g.randrange(4))], [g.choice("abcde") for _ in range(g.randrange(4))], g.choice(["", "f", "g", None])) for k in range(40)]
    notes = spark.createDataFrame(rows, "path string, links array<string>, tags array<string>, folder string").coalesce(1)
    got = {}
    for r in recommend_all(notes).collect():
        got.setdefault(r.src, []).append((r["rank"], r.dst, r.score, r.explanation))
    for path in ("n00", "n07", "n21", "n39"):
        assert [x[1:] for x in sorted(got.get(path, []))] == [(r.dst, r.score, r.explanation) for r in recommend(notes, path).collect()]
