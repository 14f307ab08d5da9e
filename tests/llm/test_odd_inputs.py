"""Long texts, clashing columns and repeated ids where test_operators.py does not have them."""

import hashlib

import numpy as np
import pytest

from corpuslens.llm import forest, langid, licenses, queries, topk, urlfilter


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(9)
    rows = [(k, rng.normal(size=4).tolist()) for k in range(60)]
    return rows, spark.createDataFrame([(*r, 7, 0.5, [1.0], 3) for r in rows], "vec_id long, embedding array<double>, query_id int, score double, vector array<double>, rank int")


def test_vectors_with_clashing_columns(spark, vectors):
    rows, df = vectors
    plain = df.select("vec_id", "embedding")
    for run in (topk.top_k, forest.nearest):
        own = sorted(map(tuple, run(df, df.where("vec_id % 50 = 0")).collect()))
        assert own == sorted(map(tuple, run(plain, plain.where("vec_id % 50 = 0")).collect())) and len(own) == 10


def test_repeated_query_ids(spark, vectors):
    """The smallest usable vector of a repeated id is the query, however the rows lie."""
    rows, df = vectors
    plain = df.select("vec_id", "embedding")
    more = [(0, [-9.0, 1.0, 1.0, 1.0]), (0, [9.0, 0.0, 0.0, 1.0]), (0, [float("-inf"), 0.0, 0.0, 0.0]), (0, None), (0, [-9.0, 1.0, 1.0, 2.0])]
    extra = spark.createDataFrame(more, plain.schema)
    for run in (topk.top_k, forest.nearest):
        alone = plain.where("vec_id != 0").unionByName(spark.createDataFrame(more[:1], plain.schema))
        want = sorted(map(tuple, run(plain, alone.where("vec_id = 0")).collect()))
        for part in (1, 5):
            asked = plain.where("vec_id = 0").unionByName(extra).repartition(part)
            assert sorted(map(tuple, run(plain, asked).collect())) == want


def test_registered_types(spark):
    kinds = {
        "op2_nearest_neighbours": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}, "op9_exact_top_k": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
        "op5_url_filters": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    }
    for name, kind in kinds.items():
        found = dict(queries.QUERIES[name](spark, "/root/testdata/sf0.001").dtypes)
        assert {c: found[c] for c in kind} == kind


def test_long_urls_and_clashing_columns(spark):
    path = "/en/" + "a" * 1_200_000
    html = "<p>" + "x" * 1_200_000 + "</p><link rel='canonical' href='http://blocked.org/es/1'>"
    rows = [(1, f"http://a.com{path}?q", "", "c", "c", "c"), (2, "http://alias.io/p", html, "c", "c", "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, rule string, verdict string")
    got = {r.page_id: (r.host, len(r.path), r.rule, r.verdict) for r in urlfilter.judge(df).collect()}
    assert got == {1: ("a.com", len(path), "com/en/", "block"), 2: ("alias.io", 2, None, "block")}


def test_long_texts_of_licences_and_languages(spark):
    filler = "lorem ipsum dolor " * 70_000
    texts = [filler + "\nReleased under the MIT License.\n" + filler, filler]
    df = spark.createDataFrame([(k, t, "c", "c") for k, t in enumerate(texts)], "doc_id long, text string, digest string, license string")
    found = {r.doc_id: (r.digest, r.license, r.n_notice_lines) for r in licenses.scan(df).collect()}
    form = " ".join(filler.split())
    assert found[1] == (hashlib.md5(form.encode()).hexdigest(), None, 0) and found[0][2] == 1
    words = {"en": "the and of to in is", "fr": "le la les des une est"}
    rows = [(k, " ".join(words[lang].split()[(k + j) % 6] for j in range(40)), lang) for k in range(60) for lang in words]
    docs = spark.createDataFrame([(2 * k + (lang == "fr"), t, lang) for k, t, lang in rows], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    long = spark.createDataFrame([(1, "le la les des une est " * 60_000), (2, "the and of to in is " * 60_000)], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in langid.predict(long, model, keep=["doc_id"]).collect()} == {1: "fr", 2: "en"}
