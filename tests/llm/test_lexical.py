"""Ranked search against plain loops and SQL."""

import collections
import math
import random
import re

import duckdb
import numpy as np
import pytest

from corpuslens.llm import lexical, queries

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
rng = random.Random(12)
WORDS = [f"w{k}" for k in range(60)] + ["été", "ÉTÉ", "中文", "The", "the", "a-b", "it's", "x_y", "٣"]


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    own = [(i, terms(t)) for i, t in docs]
    own = [(i, collections.Counter(t), len(t)) for i, t in own if t]
    many, length = len(own), sum(n for *_, n in own)
    df = collections.Counter(t for _, c, _ in own for t in c)
    merged = collections.defaultdict(set)
    for i, t in items:
        if t is not None:
            merged[i].add(t)
    out = []
    for item, texts in merged.items():
        asked = collections.Counter(t for text in texts for t in terms(text))
        found = []
        for i, c, n in own:
            m = 100 - 25 + (25 * n * many) // length
            s = sum(times * math.floor(1000 * math.log((2 * many + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t, times in asked.items() if c[t])
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def made(n):
    docs = [(k, " ".join(rng.choices(WORDS, k=rng.randint(1, 40)))) for k in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, " .,!\n"), (None, "w1 w2 w3 the"), (n + 3, docs[3][1]), (n + 4, docs[3][1]), (5, docs[5][1]), (n + 5, "w7 " * 30_000)]
    items = [(k, " ".join(rng.choices(WORDS, k=rng.randint(1, 25)))) for k in range(12)] + [(100, None), (101, ""), (102, "nowhere"), (1, "w1 w2"), (2, "w9 w9 w9 été")]
    return docs, [*items, items[0]]


@pytest.mark.parametrize("item_bytes", [4_000_000, 700])
def test_search(spark, monkeypatch, item_bytes):
    monkeypatch.setattr(lexical, "ITEM_BYTES", item_bytes)  # several blocks of items
    docs, items = made(400)
    d = spark.createDataFrame([(*r, 1, "clash", 2, "clash") for r in docs], "doc_id long, text string, n long, terms string, score int, item string")
    q = spark.createDataFrame([(*r, 1, 2) for r in items], "item_id long, text string, rank int, doc_id int")
    got = sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in lexical.search(d, q, 20).collect()), key=str)
    assert got == brute(docs, items, 20)


def test_shards_prune_and_agree(monkeypatch):
    monkeypatch.setattr(lexical, "LEAF", 4)
    monkeypatch.setattr(lexical, "AT_ONCE", 2)
    gen = np.random.default_rng(1)
    size, vocabulary = 4000, 500
    items = lexical.Items({k: [" ".join(f"t{x}" for x in gen.zipf(1.3, 12) % vocabulary)] for k in range(6)})
    width = len(items.vocabulary)
    weight = gen.integers(0, 6000, width)
    search, whole = lexical.Search(items, weight, 5), []
    for part in range(3):
        cells = np.unique(gen.integers(0, size * width, 9000))
        doc, term, times = cells // width, cells % width, gen.integers(1, 9, len(cells))
        ids, n = np.arange(size) * 3 + part, gen.integers(5, 400, size)
        shard = lexical.Shard(ids, n, doc, term, times, weight, (3 * size, 3 * size * 200))
        search.run(shard)
        score = np.zeros((6, size), np.int64)
        m = 75 + 25 * n * 3 * size // (3 * size * 200)
        impact = weight[term] * (10**9 * times // (1000 * times + 12 * m[doc]))
        for i in range(6):
            for t, many in zip(items.term[items.start[i] : items.start[i + 1]], items.times[items.start[i] : items.start[i + 1]], strict=True):
                np.add.at(score[i], doc[term == t], many * impact[term == t])
        whole.append((score, ids))
    for i in range(6):
        pairs = sorted((-int(s), int(d)) for score, ids in whole for s, d in zip(score[i], ids, strict=True) if s)[:5]
        own = search.top[0] == i
        assert list(zip((-search.top[1][own]).tolist(), search.top[2][own].tolist(), strict=True)) == pairs
    assert search.scored < 6 * 3 * size / 2  # bounds leave most documents unscored


def test_empty_tables(spark):
    docs, items = made(8)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame(items, "item_id long, text string")
    assert lexical.search(d.where("false"), q).count() == 0
    assert lexical.search(d, q.where("false")).count() == 0
    strings = spark.createDataFrame([("b", "w1"), ("a", "w1"), (None, "w2")], "item_id string, text string")
    got = lexical.search(d, strings, 1).collect()
    assert {r.item_id for r in got} <= {"a", "b", None} and got


def test_sql(spark):
    folder = "/root/testdata/sf0.001"
    out = queries.op12_ranked_search(spark, folder)
    assert dict(out.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"create view {name} as from '{folder}/{name}.parquet'")
    assert sorted(map(tuple, out.collect())) == sorted(con.sql(queries.SEARCH_SQL).fetchall())
