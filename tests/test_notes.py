"""Parsing of notes: clean-up, dates, tags, openings, names, the feature store, exports."""

import datetime

import pytest
from pyspark.sql import functions as F

from corpuslens.config import AnalysisConfig, RecommendConfig, parse_aliases, parse_lines, parse_years
from corpuslens.functions import czech, text, timestamps
from corpuslens.sources import notes as N
from corpuslens.sources.store import FeatureStore

WORDS = [("[[note]]", 0), ("[[note|alias text]]", 2), ("![[img.png]]", 0), ("[label](http://x)", 1), ("```\ncode\n~~~\nmore\n```\nout", 1), ("in\n```\nrest", 1), ("a `code` b", 2), ("a `b", 2), ("--- ABC 12", 0), ("a - b – c", 3), ("- [x] done", 1), ("1) one", 1), ("> quote", 1), ("## H", 1), ("", 0), (None, 0)]


def test_words(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(WORDS)], "k int, t string")
    got = {r[0]: r[1] for r in df.select("k", F.size(text.words(text.clean_markdown(F.col("t"))))).collect()}
    assert got == {k: n for k, (_, n) in enumerate(WORDS)}


@pytest.mark.parametrize(("value", "kind"), [("2021-11-05", "date"), ("2024-09-11T17:49", "datetime"), ("2024-02-30", None), ("2024-1-1", None), ("2024-09-11T17:49Z", None), ("", None), (None, None)])
def test_timestamps(spark, value, kind):
    row = spark.createDataFrame([(value,)], "t string").select(timestamps.parse_timestamp(F.col("t")), timestamps.precision(F.col("t"))).first()
    assert (row[0] is not None, row[1]) == (kind is not None, kind)


@pytest.mark.parametrize(("line", "kind"), [("Dnes je pátek", "temporal"), ("17:45 x", "temporal"), ("Oh no", "emotional"), ("In the garden", "scene-setting"), ("short note", "fragmentary"), ("It is a fine day.", "declarative"), ("...", None)])
def test_openings(spark, line, kind):
    assert spark.createDataFrame([(line,)], "t string").select(text.opening_signature(F.col("t"))).first()[0] == kind


def test_tags(spark):
    df = spark.createDataFrame([("#A/B, c",), ('["x", ["y"]]',), ("[p, q]",)], "t string")
    assert [r[0] for r in df.select(text.tag_set(text.raw_tags(F.col("t")))).collect()] == [["a/b", "c"], ["x", "y"], ["p", "q"]]
    assert [r[0] for r in df.select(text.tag_set(text.raw_tags(F.col("t")), "leaf")).collect()][0] == ["b", "c"]
    one = spark.createDataFrame([("a",)], "t string")
    assert one.select(text.tag_set(text.raw_tags(F.col("t")), "full", {"a": "b"}, ("b",))).first()[0] == []


def test_names():
    assert czech.normal("žluťoučký") == "zlutoucky"
    assert czech.names("Potkal jsem Jana Nováka.") == ["Jana Nováka"]
    assert czech.names("Jana přišla.") == []
    assert czech.names(None) == []


def test_config():
    assert parse_years("2020, 2019 x 2020") == (2019, 2020)
    assert parse_aliases("a => b\nbad") == {"a": "b"}
    assert parse_lines(" a \n\n b") == ("a", "b")
    assert AnalysisConfig(words_per_minute=float("nan")).words_per_minute == 230
    assert AnalysisConfig().signature() != AnalysisConfig(tag_mode="leaf").signature()


def test_folder_store_and_export(spark, tmp_path):
    root = tmp_path / "vault"
    (root / ".hidden").mkdir(parents=True)
    (root / "a.md").write_text("---\nCreated at: 2021-11-05\ntags: [x, y]\n---\nHello [[b.md]] world")
    (root / "b.md").write_text("---\nCreated at: nonsense\n---\nOther words here")
    (root / ".hidden" / "c.md").write_text("no")
    config = AnalysisConfig()
    files = N.scan(spark, str(root))
    assert sorted(r[0] for r in files.select("path").collect()) == ["a.md", "b.md"]  # Spark's readers skip hidden folders
    listed = spark.createDataFrame([("a.md",), (".hidden/c.md",), ("Old/x.md",), ("b/c/d.md",)], "path string")
    summary = N.scope_summary(listed, AnalysisConfig(ignored_folders=("old",), scope_mode="exclude", folders=("b/c",))).first()
    assert (summary.total, summary.matched, summary.hidden, summary.ignored, summary.scope, summary["sample"]) == (4, 1, 1, 1, 1, ["a.md"])
    own = files.where(N.exclusion_reason(config, F.col("path")).isNull())
    store = FeatureStore(spark, str(tmp_path / "store"), config)
    facts, counts = store.update(own)
    assert (counts["reused"], counts["refreshed"], counts["dropped"]) == (0, 2, 0)
    again, counts = store.update(own.where("path = 'a.md'"), own)
    assert (counts["reused"], counts["refreshed"], counts["dropped"]) == (1, 0, 0)
    a = again.first()
    assert a.created.source == "frontmatter" and a.created.value.year == 2021 and a.tags == ["x", "y"] and a.links == ["b.md"] and a.word_count == 2
    b = facts.where("path = 'b.md'").first()
    assert (b.created.issue, b.created.source) == ("invalid", "filesystem-ctime")
    N.write_csv(again.select("path", F.lit(1).alias("n")), str(tmp_path / "csv"))
    assert list((tmp_path / "csv").glob("*.csv"))
    now = datetime.datetime(2024, 1, 2, 3, 4, 5)
    names = [N.write_text(spark, str(tmp_path), "report", f"# {k}", now) for k in range(3)]
    assert [n.rpartition("/")[2] for n in names] == ["report-2024-01-02-030405.md", "report-2024-01-02-030405-2.md", "report-2024-01-02-030405-3.md"]
    assert (tmp_path / "report-2024-01-02-030405-2.md").read_text() == "# 1"
    assert N.export_name("r", datetime.datetime(2024, 1, 2, 3, 4, 5), lambda n: n.endswith("05.md")) == "r-2024-01-02-030405-2.md"


def test_inspect_and_units(spark):
    files = spark.createDataFrame([("a.md", "# Head\n- one - two `code`"), ("b.md", "no")], "path string, content string")
    row = N.inspect(files, "a.md").first()
    assert (row.path, row.word_count, row.tokens) == ("a.md", 3, ["Head", "one", "two"]) and "code" not in row.cleaned
    assert N.inspect(files, "c.md").count() == 0
    texts = ["", "abc", "été", "𝒜b", "中文", "😀😀"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.units(F.col("t")).alias("n")).collect()
    assert [r.n for r in got] == [len(t.encode("utf-16-le")) // 2 for t in texts]


def test_note_index(spark):
    """S10, X28, X29: own scope with the file name and case, tags as written, preview of 600 characters."""
    head = lambda tags: f"---\ntags: {tags}\n---\nbody [[a/B]]"
    texts = {
        "x.md": head("One, Two"), "f/list.md": "---\r\ntags:\r\n  - A b\r\n  - 3\r\n  - \"4\"\r\n---\r\n" + "y" * 700, "f/g/flow.md": head("[One, 'two', true]"), "f/.dot.md": head("a"), ".h/z.md": head("a"),
        "Skip/a.md": head("a"), "skip/a.md": head("7"), "Skipped.md": "no block", "null.md": None,
    }
    files = spark.createDataFrame([(p, c, 5) for p, c in texts.items()], "path string, content string, size long").withColumn("mtime", F.lit(None).cast("timestamp"))
    rows = {r["path"]: r for r in N.note_index(files, RecommendConfig(exclude_folders=("Skip",))).collect()}
    assert set(rows) == {"x.md", "f/list.md", "f/g/flow.md", "skip/a.md", "Skipped.md", "null.md"}
    assert {p: r["tags"] for p, r in rows.items()} == {"x.md": ["One, Two"], "f/list.md": ["A b", "4"], "f/g/flow.md": ["One", "two"], "skip/a.md": [], "Skipped.md": [], "null.md": []}
    assert (rows["f/g/flow.md"]["title"], rows["f/g/flow.md"]["folder"], rows["x.md"]["folder"]) == ("flow", "f/g", "")
    assert len(rows["f/list.md"]["preview"]) == 600 and rows["null.md"]["preview"] == ""
    assert len(rows["x.md"]["links"]) == 1
    assert N.note_index(files, RecommendConfig(indexing=False)).count() == 0
    assert N.note_index(files, RecommendConfig(skip_hidden=False)).count() == len(texts)
