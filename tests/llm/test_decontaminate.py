"""Decontamination against plain loops and SQL."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from corpuslens.llm import decontaminate, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
rng = random.Random(13)


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def some(n, many=40):
    return " ".join(f"v{rng.randint(0, many)}" for _ in range(n))


ITEMS = [(k, some(rng.randint(11, 60))) for k in range(8)]
ITEMS += [(20, None), (21, " .;"), (22, "Rare short one"), (23, "été 中文 x_y"), (24, ITEMS[0][1]), (25, "lead " + ITEMS[1][1]), (26, "zz " * 30), (None, ITEMS[2][1]), (3, "second text of an item " + some(9))]
DOCS = [(k, some(rng.randint(1, 200), 60)) for k in range(40)]
DOCS += [(100 + k, some(30) + "\n" + (t or "").upper().replace(" ", ", ") + " " + some(20)) for k, (_, t) in enumerate(ITEMS)]
DOCS += [(200, None), (201, ""), (202, "rare SHORT-one! été, 中文; x y"), (203, "zz " * 400), (204, ITEMS[0][1] + " " + ITEMS[0][1]), (None, ITEMS[1][1]), (100, DOCS[40][1]), (205, some(9) + " " + " ".join(words(ITEMS[0][1])[:9]))]
DOCS += [(206, some(120_000, 3000) + " " + ITEMS[4][1])]


def brute(docs, items, width=10):
    windows = {}
    for item, text in items:
        own = words(text)
        n = min(width, len(own))
        for i in range(len(own) - n + 1) if own and item is not None else ():
            windows.setdefault(tuple(own[i : i + n]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for key, text in docs:
        own, hit, ids = words(text), set(), set()
        for n in sizes:
            for i in range(len(own) - n + 1):
                if tuple(own[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    ids |= windows[tuple(own[i : i + n])]
        out.append((key, len(own), len(hit), len(ids), ",".join(sorted(ids)), bool(hit)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(*r, 1, "a", [1]) for r in DOCS], "doc_id long, text string, n_words int, low string, ids array<int>")
    return docs, spark.createDataFrame([(*r, 5, "b") for r in ITEMS], "item_id long, text string, doc_id int, ids string")


@pytest.mark.parametrize(("item_bytes", "shard"), [(4_000_000, 4_000_000), (600, 3000)])
def test_scan(tables, monkeypatch, item_bytes, shard):
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", item_bytes)
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", shard)
    docs, items = tables
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, ",".join(r["items"]), r.contaminated) for r in decontaminate.scan(docs, items).collect()), key=str)
    want = brute(DOCS, ITEMS)
    assert got == want and 15 < sum(r[5] for r in want) < len(want) - 15
    left = decontaminate.clean(docs, items)
    assert left.columns == docs.columns
    assert sorted((str(r.doc_id), r.text or "") for r in left.collect()) == sorted((str(k), t or "") for k, t in DOCS if not brute([(k, t)], ITEMS)[0][5])


def test_longest_matches(tables):
    docs, items = tables
    got = {(r.item_id, r.item_at): r for r in decontaminate.matches(docs, items.where("item_id < 3")).collect()}
    texts = [(k, words(t)) for k, t in DOCS]
    for item, text in ITEMS[:3]:
        own = words(text)
        for i in range(len(own) - 9):
            best = (0, 0, 0)
            for k, doc in texts:
                if k is None:
                    continue
                for j in range(len(doc)):
                    n = 0
                    while i + n < len(own) and j + n < len(doc) and own[i + n] == doc[j + n]:
                        n += 1
                    best = min(best, (-n, k, j))
            found = got[(str(item), i)]
            if found.doc_id is not None:
                assert (-found.length, found.doc_id, found.doc_at) == best
            else:
                assert found.length == -best[0]


def test_suffix_array():
    gen = np.random.default_rng(2)
    for alphabet, n in ((2, 60), (5, 200), (1, 40)):
        text = gen.integers(0, alphabet + 1, n)
        text[-1] = 0
        order = decontaminate.suffix_array(text).tolist()
        suffix = {p: tuple(text[p : p + list(text[p:]).index(0)].tolist()) for p in range(n) if text[p]}
        assert sorted(order) == sorted(suffix) and [suffix[p] for p in order] == sorted(suffix.values())
    assert len(decontaminate.suffix_array(np.zeros(3, np.int64))) == 0


def test_empty_tables(tables):
    docs, items = tables
    assert decontaminate.scan(docs.where("false"), items).count() == 0
    rows = decontaminate.scan(docs, items.where("false")).collect()
    assert len(rows) == len(DOCS) and not any(r.contaminated or r.n_hit or r["items"] for r in rows)
    assert decontaminate.matches(docs.where("false"), items).count() == 0


def test_sql(spark):
    folder = "/root/testdata/sf0.001"
    out = queries.op13_decontamination(spark, folder)
    assert dict(out.dtypes) == {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"}
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"create view {name} as from '{folder}/{name}.parquet'")
    rows = sorted(map(tuple, out.collect()))
    assert rows == sorted(con.sql(queries.LEAKS_SQL).fetchall()) and any(r[5] for r in rows)
    given = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert rows == [(k, n, h, i, hashlib.sha256(ids.encode()).hexdigest(), c) for k, n, h, i, ids, c in sorted(brute(given, items), key=lambda r: r[0])]
