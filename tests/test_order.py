"""Order of text by the Unicode collation (Q-6), against ICU's order in DuckDB, and what follows from it."""

import random

import duckdb
from pyspark.sql import functions as F

from corpuslens.functions.order import named, sorted_texts
from corpuslens.operators import corpus as C
from corpuslens.operators import examples as EX
from corpuslens.operators import tagstructure as G

WORDS = ["zebra", "Zebra", "čaj", "cizí", "Cizí", "chata", "dub", "ďábel", "éclair", "e", "E", "a b", "a-b", "a/b", "a_b", "ab", "10", "9", "1", "ñu", "nu", "ny", "ž", "z", "ß", "ss", "st", "ø", "o", "ö", "p", "日", "本"]


def icu(words):
    con = duckdb.connect()
    con.sql("create table t(x varchar)")
    con.executemany("insert into t values (?)", [(w,) for w in words])
    return [r[0] for r in con.sql("select x from t order by icu_sort_key(x, 'und'), x").fetchall()]


def test_order_against_icu(spark):
    words = WORDS + [random.Random(6).choice("aábcčdďeéňoózž") + w for w in WORDS]
    df = spark.createDataFrame([(w,) for w in words], "x string")
    want = icu(words)
    assert [r.x for r in df.orderBy(*named("x")).collect()] == want != sorted(words)
    assert df.agg(sorted_texts(F.collect_list("x"))).first()[0] == want
    plain = ["b", "a-c", "a b", "10", "9", "a/b", "ab"]
    assert spark.createDataFrame([(plain,)], "x array<string>").select(sorted_texts(F.col("x"))).first()[0] == icu(plain) == sorted(plain)
    assert spark.createDataFrame([(None,), ([],)], "x array<string>").select(sorted_texts(F.col("x"))).collect()[1][0] == []


def test_tags_pairs_and_labels(spark):
    """Tags, pairs and combined labels follow the reader's order: č between c and d, not behind z."""
    rows = [(f"n{k}", "2020-01-0%d" % (k + 1), ["zoo", "čas", "dub"]) for k in range(3)]
    notes = spark.createDataFrame(rows, "path string, created string, tags array<string>").selectExpr("path", "timestamp(created) AS created", "timestamp(created) AS updated", "10L AS word_count", "tags")
    entries = C.to_entries(notes)
    assert entries.first().tags == ["čas", "dub", "zoo"]
    assert [(r.left, r.right) for r in G.pair_lift(entries).collect()] == [("čas", "dub"), ("čas", "zoo"), ("dub", "zoo")]
    labels = {r.label for r in C.tag_rows(entries, 3).collect()}
    assert labels == {"čas", "dub", "zoo", "čas + dub", "čas + zoo", "dub + zoo", "čas + dub + zoo"}
    assert [r.tag for r in G.bridge_tags(entries).collect()] == ["čas", "dub", "zoo"]


def test_examples_by_day_and_path(spark):
    """J14: the first three notes by day, then path in the reader's order; a pair needs both tags."""
    rows = [("ž.md", 1, ["a", "b"]), ("z.md", 1, ["a", "b"]), ("č.md", 1, ["a", "b"]), ("d.md", 0, ["a"]), ("e.md", 9, ["a", "b"]), ("c.md", 1, ["b"])]
    entries = spark.createDataFrame(rows, "path string, d int, tags array<string>").withColumn("created", F.expr("timestamp'2020-01-01 05:00:00' + make_interval(0, 0, 0, d)"))
    pairs = spark.createDataFrame([("a", "b", 4, 1.0), ("b", "nowhere", 2, 0.5)], "left string, right string, support long, lift double")
    assert [(r.left, r["rank"], r.path) for r in EX.pair_examples(entries, pairs).orderBy("rank").collect()] == [("a", 1, "č.md"), ("a", 2, "z.md"), ("a", 3, "ž.md")]
    bridges = spark.createDataFrame([("a", 5, 1, 0.5)], "tag string, n long, degree long, score double")
    assert [r.path for r in EX.bridge_examples(entries, bridges).orderBy("rank").collect()] == ["d.md", "č.md", "z.md"]


def test_two_days(spark):
    """Q-7: examples go by the UTC day of a moment, calendars by the day in the session's time zone."""
    from corpuslens.functions import timestamps as T

    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Pacific/Auckland")
        row = spark.sql("SELECT timestamp'2020-01-02 03:00:00' AS ts").select(T.epoch_day(F.col("ts")), T.instant_day(F.col("ts"))).first()
        assert (row[0], row[1]) == (18263, 18262)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
