"""SQL over the operators: views and table functions give what the DataFrames give."""

import datetime

from corpuslens.config import AnalysisConfig, DeepScope, RecommendConfig, YearScope
from corpuslens.operators import corpus as C
from corpuslens.operators.recommend import recommend_all
from corpuslens.plans import surface
from corpuslens.plans.analysis import analyze
from corpuslens.plans.queries import QUERIES
from corpuslens.sources import flat as FL

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def made(spark):
    day = lambda k: datetime.datetime(2019 + k % 3, 1 + k % 12, 1 + k % 28, 7 + k % 2)
    notes = [(f"f/n{k}.md", day(k), day(k) + datetime.timedelta(days=k % 5), 5 + k, ["x", "y"] if k % 2 else ["x"], f"Today I met Anna Novak again. The sea was calm on day {k}.") for k in range(24)]
    return spark.createDataFrame(notes, "path string, created timestamp, updated timestamp, word_count long, tags array<string>, text string").cache()


def test_every_query_is_a_view(spark):
    names = surface.register_queries(spark, SF)
    assert {f"q_{n}" for n in QUERIES} <= set(names)
    for name in QUERIES:  # the view is the DataFrame's plan: same columns, and the same analysed query
        assert spark.table(f"q_{name}").dtypes == QUERIES[name](spark, SF).dtypes
    for name in ("corpus_totals", "tag_pair_lift", "hour_activity", "silence_gaps", "tag_persistence", "month_heatmap"):
        assert rows(spark.sql(f"SELECT * FROM q_{name}")) == rows(QUERIES[name](spark, SF))
    found = spark.sql("SELECT t.year, t.entries, m.entries FROM q_corpus_totals t JOIN (SELECT year, sum(entries) AS entries FROM q_month_heatmap GROUP BY year) m USING (year)").collect()
    assert found and all(r[1] == r[2] for r in found)


def test_table_functions(spark):
    notes = made(spark)
    tables = analyze(notes)
    entries = C.to_entries(notes)
    links = spark.createDataFrame([("a", ["b"], ["t"], "f"), ("b", [], ["t"], "f"), ("c", ["a"], [], "")], "path string, links array<string>, tags array<string>, folder string")
    used = {k: tables[k] for k in ("tags", "pair_lift", "year_profiles", "records", "phrases")} | {"entries": entries, "recommendations": recommend_all(links, RecommendConfig())}
    names = surface.register(spark, used, "s_")
    assert {f"s_{n}" for n in surface.FUNCTIONS} <= set(names)
    q = lambda text: rows(spark.sql(text))
    assert q("SELECT path FROM s_entries_between(2020, 2020)") == rows(entries.where("year = 2020").select("path"))
    assert q("SELECT count(*) FROM s_entries_tagged('y')") == [(12,)]
    assert q("SELECT hour, entries FROM s_hours_between(2019, 2021)") == [(7, 12), (8, 12)]
    assert q("SELECT entries, words FROM s_totals_between(2019, 2019)") == rows(entries.where("year = 2019").selectExpr("count(*)", "sum(word_count)"))
    assert q("SELECT label FROM s_tags_of_at_least(13)") == [("x",)]
    assert q("SELECT `left`, `right`, rank FROM s_strongest_pairs(1)") == [("x", "y", 1)]
    assert q("SELECT * FROM s_profile_of(2020)") == rows(tables["year_profiles"].where("year = 2020"))
    assert len(q("SELECT * FROM s_records_of('longest-notes', 3)")) == 3
    assert q("SELECT phrase FROM s_phrases_between(2019, 2021)") == rows(tables["phrases"].select("phrase"))
    assert q("SELECT dst, rank FROM s_recommended_for('a', 5)") == [("b", 1), ("c", 2)]
    # A function joins like a table, once for each row that names its parameter.
    assert q("SELECT y.year, t.entries FROM (SELECT DISTINCT year FROM s_entries) y, LATERAL s_totals_between(y.year, y.year) t") == [(2019, 8), (2020, 8), (2021, 8)]


def test_scopes_in_force(spark):
    """P2-P5, Q-4, Q-5, H8: hours, body text and deep text each read their own years and tags; an empty scope gives empty tables."""
    notes = made(spark)
    config = AnalysisConfig(deep_text=True, hour_years=YearScope(2020, 2020), text_years=YearScope(None, 2020), deep=DeepScope(True, YearScope(2020, None), ("#X",), ("y",)))
    tables = analyze(notes, config)
    assert sum(r.entries for r in tables["hours"].collect()) == 8
    assert sorted(r.year for r in tables["text_years"].collect()) == [2019, 2020]
    assert sorted(r.year for r in tables["opening_shift"].collect()) == [2020, 2021]  # not scoped
    deep = {r.year: r.entries for r in tables["deep_years"].collect()}
    assert deep == {2020: 4, 2021: 4} and tables["deep_leaders"].first().richest_year in deep
    assert sum(r.entries for r in tables["totals"].where("year is not null").collect()) == 24  # core totals take no scope
    names = {r.label: r.support for r in tables["entities"].collect()}
    assert names and max(names.values()) == 8
    none = analyze(notes, AnalysisConfig(deep_text=True, text_years=YearScope(1999, 1999)))
    for name in ("text_years", "deep_years", "entities"):
        assert none[name].count() == 0, name
    assert tuple(none["deep_leaders"].first()) == (None, None, None)
    off = analyze(notes, AnalysisConfig(body_text=False))
    assert off["deep_years"].count() == 0 and off["month_climate"].count() == 12 and off["lexical"].count() == 0
    flat = FL.flat_rows({"hours": tables["hours"], "text_years": tables["text_years"]}, config=config)
    said = {r.advanced_name: (r.advanced_value, r.advanced_detail) for r in flat.where("row_type like '%scope' or advanced_name like '%scope'").collect()}
    assert said == {"time_scope": ("start to 2020", "mode=year-range; from=; to=2020"), "scope": ("2020 to end", "mode=defined; from=2020; to=; included=x; excluded=y"), "hour_metric_scope": ("2020 to 2020", "")}
