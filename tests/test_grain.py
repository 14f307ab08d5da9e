"""Cards and readings from three passes over the notes: as the single operators give them, also on odd notes."""

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from corpuslens.functions import text as X
from corpuslens.operators import bodytext as B
from corpuslens.operators import corpus as C
from corpuslens.operators import grain as GR
from corpuslens.operators import readings as RD
from corpuslens.operators import rhythm as H
from corpuslens.operators import tagstructure as G
from corpuslens.plans.queries import QUERIES


@pytest.mark.parametrize("name", ["headline_cards", "structural_readings"])
def test_three_scans(spark, name):
    """The plan that ran reads the documents for facts, words and phrases, once each."""
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    df._jdf.queryExecution().toRdd().count()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert 1 <= final.count("FileScan") <= 3


def plain_phrases(tokens):
    out = {}
    for n in (4, 3):
        for i in range(len(tokens) - n + 1):
            g = tokens[i : i + n]
            if max(map(len, g)) >= 5 and not all(re.fullmatch("[0-9]+", x) for x in g) and sum(map(len, g)) >= 3 * n:
                out.setdefault(" ".join(g))
    return list(out)[:60]


def test_phrases(spark):
    """Short, long and repetitive texts; numbers; phrases that only start after the first tokens."""
    g = random.Random(4)
    vocabulary = ["a", "of", "sea", "1234", "56789", "house", "garden", "2", "čas", "winter"]
    texts = [[g.choice(vocabulary[: g.choice([1, 3, 6, 10])]) for _ in range(n)] for n in (0, 2, 3, 4, 5, 60, 119, 120, 121, 122, 300) for _ in range(4)]
    texts += [["a"] * 200 + ["garden", "house", "winter", "sea"], ["house", "of", "sea"] * 90 + ["12345"] * 9, [f"word{k}" for k in range(64)], [f"word{k}" for k in range(400)]]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, toks array<string>").select("k", X.phrases(F.col("toks")).alias("p")).collect()
    assert {r.k: r.p for r in rows} == {k: plain_phrases(t) for k, t in enumerate(texts)}


def test_sentences_hold_all_tokens(spark):
    texts = ["", "One. Two three!? Four…five\n\nsix\nseven", "...", "No end", "a-b.c_d 1.5", "\n\n \nÚvod. Čas’tice", None]
    row = B.texts(spark.createDataFrame([(t,) for t in texts], "text string").select("text", F.lit("p").alias("path"), F.current_timestamp().alias("created"), F.array().cast("array<string>").alias("tags"))).select("tokens", "token_count", "sentence_count").collect()
    assert [r.token_count for r in row] == [len(r.tokens) for r in row] == [0, 7, 0, 2, 4, 2, 0]
    assert [r.sentence_count for r in row] == [0, 6, 0, 1, 3, 2, 0]


def made(spark):
    """Undated notes, texts that are null, empty or without a phrase, no tags, revisions before the creation."""
    g = random.Random(7)
    words = "morning garden river stone winter light house letter 1234 sea of the".split()
    rows = []
    for k in range(160):
        day = datetime.datetime(2017 + k % 4 * (1 + k % 2), 1 + g.randrange(12), 1 + g.randrange(28), g.randrange(24))
        text = g.choice([None, "", "Ah 1 2", "...", *[" ".join(g.choice(words) for _ in range(g.randrange(3, 40))) + g.choice([".", "!", ""]) for _ in range(12)]])
        later = day + datetime.timedelta(hours=g.randrange(-30, 900)) if k % 5 else None
        rows.append((f"f/n{k}.md", None if k % 17 == 3 else day, later, [f"t{g.randrange(5)}" for _ in range(g.randrange(4))], text))
    return spark.createDataFrame(rows, "path string, created timestamp, updated timestamp, tags array<string>, text string").withColumn("word_count", F.size(X.tokens(F.col("text"))).cast("long"))


def test_as_the_operators(spark):
    notes = made(spark).cache()
    entries, texts = C.to_entries(notes), B.texts(notes)
    profiles = B.year_profiles(texts)
    own = dict(profiles=H.year_profiles(entries, profiles), pairs=G.pair_lift(G.qualified(entries)), shifts=H.regime_shifts(entries, texts=profiles), texts=profiles, openings=B.opening_shift(texts))
    more = dict(phrases=B.recurring_phrases(texts), tags=B.tag_profiles(texts))
    got = GR.structure(notes, full=True)

    def same(name, *columns, order=False):
        a, b = ([tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in t[name].select(*columns).where(f"{columns[0]} is not null").collect()] for t in (got, own | more))
        assert len(a) and (a == b if order else sorted(a, key=repr) == sorted(b, key=repr)), name

    same("profiles", "year", "burstiness", "intensity_per_word", "revisit_ratio", "concentration", "tag_entropy", "tag_concentration")
    same("pairs", "left", "right", "support", "lift", order=True)
    same("shifts", "from_year", "to_year", "tag_change", "text_change", "volume_change", "revision_change", "cadence_change", "score")
    same("texts", "year", "richness", "novelty", "sentence_mean", "recurring_share")
    same("openings", "before", "year", "distance")
    same("phrases", "phrase", "entries", "first_year", "last_year", "mean_gap", "score")
    same("tags", "tag", "entries", "mean_lag", "mean_richness")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(RD.headlines(**GR.structure(notes))) == rows(RD.headlines(**own))
    assert rows(RD.structural_readings(**got)) == rows(RD.structural_readings(**own, **more))


def test_no_tag(spark):
    """A tag that is null is none: pairs and lifts stay as they are without it."""
    notes = made(spark).where("size(tags) > 0")
    lifts = lambda rows: [tuple(r) for r in GR.structure(rows)["pairs"].collect()]
    assert lifts(notes.withColumn("tags", F.concat("tags", F.array(F.lit(None).cast("string"))))) == lifts(notes) != []
