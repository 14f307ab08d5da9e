"""The training-data operators on small tables: nulls, empty and long texts, ties, repeats, empty tables, odd columns."""

import base64
import collections
import hashlib
import pathlib
import random
import re
import time
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from corpuslens.llm import bpe, forest, langid, licenses, neardup, packing, queries, suffix, topk, toxicity, urlfilter
from corpuslens.llm.common import column_bytes
from corpuslens.llm.components import connected_components
from corpuslens.llm.pretokens import split_texts

rng = random.Random(4)
LONG = " ".join(rng.choice("alpha beta gamma delta été ñandú it's 12 ,.! \n".split(" ")) for _ in range(9000))
BASE = " ".join(f"w{rng.randint(0, 400)}" for _ in range(220))
TEXTS = [None, "", " \n\t ", "one", "two words", BASE, BASE, BASE + " tail", BASE.upper(), LONG, "x" * 700, "<|endoftext|> naïve 中文 ½ \x1c \xa0 y", "q" + BASE[50:600] + "z"]
DOCS_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, task int, n long, text_a string, carried string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en" if k % 2 else "fr", "s", len(t or ""), 0.5, 1, 2, "clash", "c") for k, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[5]], DOCS_SCHEMA)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("false")


def test_bpe(spark, docs, nothing):
    with open(bpe.ranks_file(), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in bpe.digest_round_trip(docs, bpe.ranks_file()).collect()}
    for k, t in enumerate(TEXTS):
        ids = own.encode_ordinary(t or "")
        assert got[k].n_tokens == len(ids)
        assert got[k].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    encoded = bpe.encode_column(docs, bpe.ranks_file())
    decoded = {r.doc_id: bytes(r.decoded) for r in bpe.decode_column(encoded, bpe.ranks_file()).collect()}
    assert decoded == {k: (t or "").encode() for k, t in enumerate(TEXTS)}
    assert bpe.digest_round_trip(nothing, bpe.ranks_file()).count() == 0
    model, alphabet = bpe.encoder(bpe.ranks_file()), list("ab c'stremvld  \n\t.!,1éª²ñ’—×÷ʰ") + ["\x1c", "\xa0", "\x85", "中", "'ll", "՘", " ×"]
    for _ in range(400):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30)))
        assert model.encode(t) == own.encode_ordinary(t)


def test_ids_of_all_characters():
    """Every code point below U+2100 and a sample of the others, beside contractions, digits, letters and blanks."""
    with open(bpe.ranks_file(), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    library, json_path = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), public_tokenizers.path("byte_bpe_50k.json")
    model = bpe.encoder(bpe.ranks_file())
    points = [*range(0x2100), *rng.sample(range(0x2100, 0xD800), 800), *rng.sample(range(0xE000, 0x32000), 800)]
    for ch in map(chr, points):
        t = f"3{ch}'s {ch}'ll a{ch}b  {ch}1{ch}{ch} x{ch}\n{ch} 've'{ch}"
        ids = own.encode_ordinary(t)
        assert model.encode(t) == ids == library.encode(t, add_special_tokens=False).ids
        words, number, _ = split_texts(*column_bytes(pa.array([t])), 0, 1)
        made = packing._word_ids(words, json_path)
        assert np.frombuffer(b"".join(made[k] for k in number.tolist()), "<u4").tolist() == ids


def test_long_words():
    """A match of a megabyte takes seconds: merges touch their neighbours only."""
    with open(bpe.ranks_file(), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    model, began = bpe.MergeReplay(bpe.ranks_file()), time.process_time()
    for t in ("".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEF") for _ in range(1_000_000)), "=" * 1_000_000, "中文字" * 100_000):
        assert model.encode(t) == own.encode_ordinary(t)
    assert time.process_time() - began < 60


def test_packing(docs, nothing):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    rows = packing.pack(docs).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for k, t in enumerate(TEXTS):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        own = sorted(by_doc[k], key=lambda r: (r.piece, r.sequence_id))
        own = own[::2] if k == 5 else own
        assert sum(r.length for r in own) == len(ids) and all(r.length == 1024 for r in own[1:])
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert packing.pack(nothing).count() == 0
    assert packing.pack(docs, tokens=True).where(F.size("ids") != F.col("length")).count() == 0


@pytest.mark.parametrize("lengths", [[], [600] * 50, [3] * 1000 + [700] * 10, [1024] * 5, list(range(1, 1025))])
def test_plan_uses_every_piece(lengths):
    histogram = np.bincount(np.array(lengths, int), minlength=1025)
    used = np.zeros(1025, int)
    for own, n in packing.pack_histogram(histogram):
        assert sum(own) <= 1024
        for x in own:
            used[x] += n
    assert (used == histogram).all()


def test_packing_added_tokens(spark, tmp_path):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = [*TEXTS, f"ab {end} cd", end, f"{end}{end} ", f"a{end}", f" 's{end}'s  {end}\n中{end} ½", "<|endof", "text|>", "<|endoftext|", (f"w {end}" * 3000)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for rows in (queries.op1_best_fit_packing(spark, str(tmp_path)).collect(), corpus_pipeline.packed(spark, df, str(tmp_path)).collect()):
        by_doc = collections.defaultdict(list)
        for r in rows:
            by_doc[r.doc_id].append(r)
        for k, t in enumerate(texts):
            ids = library.encode(t or "", add_special_tokens=False).ids + [2]
            assert sum(r.length for r in by_doc[k]) == len(ids)
            for r in by_doc[k]:
                assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())


def test_packing_of_a_large_corpus(docs, monkeypatch):
    lengths = np.arange(1025)
    many = (1e5 * np.exp(-lengths / 500) * (1 + 0.05 * np.random.default_rng(1).normal(size=1025))).astype(np.int64)
    many[0], many[1024] = 0, 10_000_000
    chosen = packing.pack_histogram(many)
    plan, used = packing.plan_ranges(chosen), np.zeros(1025, np.int64)
    assert many.sum() > 50_000_000 and 204_800 < len(plan["length"]) < 353_794
    ends = np.cumsum([n for _, n in chosen])
    for own, n in chosen:
        for x in own:
            used[x] += n
    assert (used == many).all()
    taken = []
    for x in (1, 5, 340, 512, 700, 1024):  # all places of these lengths: in their sequences, at offsets of such a piece, none twice
        sequence, offset = packing.place(plan, np.full(many[x], x), np.arange(many[x]))
        taken.append(sequence * 1024 + offset)
        first = np.searchsorted(ends, sequence, side="right")
        for k, at in set(zip(first[::997].tolist(), offset[::997].tolist(), strict=True)):
            assert at in {sum(chosen[k][0][:j]) for j, y in enumerate(chosen[k][0]) if y == x}
    taken = np.concatenate(taken)
    assert len(np.unique(taken)) == len(taken)
    monkeypatch.setattr(packing, "pack_histogram", lambda own, capacity, real=packing.pack_histogram: real(own + many, capacity))
    rows = packing.pack(docs).collect()
    assert {r.doc_id for r in rows} == set(range(len(TEXTS))) and len({(r.sequence_id, r.offset) for r in rows}) == len(rows)


def test_suffix_array():
    for _ in range(300):
        s = [rng.randint(1, rng.choice([1, 2, 8])) for _ in range(rng.randint(0, 30))] + [0]
        assert suffix.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


@pytest.mark.parametrize("most", [1000, 1])
def test_repeats(docs, nothing, most, monkeypatch):
    monkeypatch.setattr(suffix, "MOST", most)
    texts = [*TEXTS, TEXTS[5]]
    seen = collections.Counter(t.encode()[i : i + 200] for t in texts if t for i in range(len(t.encode()) - 199))
    got = {r.doc_id: r for r in suffix.strip_repeats(docs, 200).collect()}
    for k, t in enumerate(TEXTS):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        assert (got[k].n_bytes, got[k].n_removed, got[k].n_spans, got[k].kept_sha256) == (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    assert suffix.strip_repeats(nothing).count() == 0


def brute_groups(rows, width, percent):
    sets = {}
    for k, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[k] = {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else ({tuple(words)} if words else set())
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(s), find(k)) for k, s in sets.items()}


def test_near_duplicates(spark, docs, nothing):
    near = [(100 + i, " ".join(w if rng.random() > 0.03 * (i % 4) else "zz" for w in BASE.split())) for i in range(40)]
    table = docs.select("doc_id", "text", "n").unionByName(spark.createDataFrame([(k, t, 1) for k, t in near], "doc_id long, text string, n long"))
    for width, percent in ((3, 85), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.link(table, width, percent).collect()}
        assert got == brute_groups([*enumerate(TEXTS), *near], width, percent)
    assert neardup.link(nothing).count() == 0
    odd = neardup.link(spark.createDataFrame([(None, "a b c d"), (1, "a b c d")], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.kept) for r in odd} == {(None, True), (1, True)}


def vectors(spark):
    g = np.random.default_rng(3)
    rows = [(k, g.normal(size=8).tolist()) for k in range(300)]
    rows += [(k, rows[7][1]) for k in range(300, 340)] + [(400, None), (450, [0.0] * 8), (401, [float("nan")] + [1.0] * 7), (402, [None] + [1.0] * 7), (403, []), (500, [1.0, 2.0])]
    return rows, spark.createDataFrame([(k, v, 1.0) for k, v in rows], "vec_id long, embedding array<double>, score double")


def test_top_k(spark):
    rows, df = vectors(spark)
    good = [(k, np.floor(256 * np.array(v, float))) for k, v in rows if v and None not in v and np.isfinite(v).all()]
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(df, df.where("vec_id % 50 = 0")).collect()}
    want = {}
    for q, x in good:
        if q % 50 == 0:
            best = sorted((-int(x @ y), k) for k, y in good if k != q and len(y) == len(x))[:5]
            want |= {(q, i + 1): (k, -s) for i, (s, k) in enumerate(best)}
    assert got == want
    assert topk.top_k(df.where("false"), df.where("false")).count() == 0


def test_top_k_of_large_components(spark):
    g = np.random.default_rng(5)
    rows = [(k, [float(x) for x in g.normal(size=3) * 10.0 ** g.integers(-3, 12)]) for k in range(120)]
    rows += [(200, [1e300, -1e300, 1e290]), (201, [1.7e308, 0.0, 0.0]), (250, [1e18, 1.0, -1.0]), (300, [-1e300, 1e300, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    end = 2**63 - 1
    whole = {k: [int(min(max(np.floor(256 * np.longdouble(x)), -np.finfo(float).max), np.finfo(float).max)) for x in v] for k, v in rows}
    want = {}
    for q in whole:
        if q % 50 == 0:
            best = sorted((-max(-end, min(end, sum(a * b for a, b in zip(whole[q], whole[k], strict=True)))), k) for k in whole if k != q)[:5]
            want |= {(q, i + 1): (k, -s) for i, (s, k) in enumerate(best)}
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(df, df.where("vec_id % 50 = 0")).collect()}
    assert got == want


def test_forest(spark):
    rows, df = vectors(spark)
    good = [(k, np.array(v, float)) for k, v in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    got = collections.defaultdict(list)
    for r in forest.nearest(df, df.where("vec_id % 50 = 0")).collect():
        got[r.query_id].append((-r.score, r.vec_id))
    hits = total = 0
    for q, x in good:
        if q % 50 == 0:
            best = sorted((-float(x @ y) / np.linalg.norm(x) / np.linalg.norm(y), k) for k, y in good if k != q and len(y) == len(x))[:5]
            hits += len({k for _, k in best} & {k for _, k in got[q]})
            total += len(best)
    assert hits >= 0.9 * total
    assert forest.nearest(df.where("false"), df.where("false")).count() == 0


def test_urls(spark):
    page = "<link rel='canonical' href='http://blocked.org/es/1'>"
    rows = [(1, "http://A.Example.com/en/7?x", ""), (2, "https://x.com/en/", None), (3, None, None), (4, "no scheme", ""), (5, "http://alias.io/p#f", page), (6, "http://other.io/", "<meta http-equiv=refresh content='0; url=http://alias.io/p'>"), (7, "http://notcom/en/", ""), (8, "ftp://h.example.net/de/81", ""), (9, "http://EXAMPLE.net/de/9", "")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(df).collect()}
    assert got == {
        1: ("a.example.com", "/en/7", "example.com/en/7", "allow"), 2: ("x.com", "/en/", "com/en/", "block"), 3: ("", "", None, "allow"), 4: ("", "", None, "allow"),
        5: ("alias.io", "/p", None, "block"), 6: ("other.io", "/", None, "block"), 7: ("notcom", "/en/", None, "allow"), 8: ("h.example.net", "/de/81", "example.net/de/8", "block"), 9: ("example.net", "/de/9", "net/de/", "allow"),
    }
    allowed = df.unionByName(spark.createDataFrame([(10, "http://example.net/de/x", page, "clash")], df.schema))  # an explicit allow in the component
    assert {r.page_id: r.verdict for r in urlfilter.judge(allowed).collect() if r.page_id in (5, 6, 10)} == {5: "allow", 6: "allow", 10: "allow"}
    assert urlfilter.judge(df.where("false")).count() == 0
    many = urlfilter.RULES + [(f"h{k}.zz", "/", "block") for k in range(600)]
    assert {r.page_id: r.verdict for r in urlfilter.judge(df, many).collect()} == {k: v[3] for k, v in got.items()}


def test_relative_links(spark):
    def link(*targets):
        return "".join(f'<LINK href="{t}" rel=canonical>' for t in targets)

    def go(*targets):
        return "".join(f"<meta http-equiv='refresh' content='0; URL={t}'>" for t in targets)

    rows = [
        (1, "http://a.org/es/1", ""), (2, "http://a.org/de/2", link("/es/1")), (3, "http://a.org/x/y.html?q=1", go("../es/./1")), (4, "http://b.io/q", link("//a.org/es/1")),
        (5, "https://b.io/two", link("http://other.io/", "http://a.org/es/1")), (6, "https://b.io/three", go("two#f", "nowhere")), (7, "http://b.io", go("three")), (8, "http://b.io/d/", "<base href='/'>" + link("q")),
        (9, "http://c.io/a/b?x=1", link("?x=2")), (10, "http://c.io/a/b?x=2", link("http://a.org/es/1")), (11, "http://c.io/a/c", link("javascript:void(0)", "#top", "mailto:a@b.org")), (12, None, link("/es/1")), (13, "no scheme", link("/es/1", "http://a.org/es/1")),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.verdict for r in urlfilter.judge(df).collect()} == {**{k: "block" for k in range(1, 11)}, 11: "allow", 12: "allow", 13: "allow"}
    g = "http://a/b/c/d?q"
    cases = {"g": "b/c/g", "./g": "b/c/g", "g/": "b/c/g/", "/g": "g", "?y": "b/c/d?y", "g?y": "b/c/g?y", "#s": "b/c/d?q#s", "g#s": "b/c/g#s", ".": "b/c/", "./": "b/c/", "..": "b/", "../g": "b/g", "../..": "", "../../g": "g", "../../../g": "g", "/../g": "g", "g..": "b/c/g..", "./g/.": "b/c/g/", "g/../h": "b/c/h", "g?y/../x": "b/c/g?y/../x"}
    got = spark.createDataFrame([(g, t) for t in [*cases, "//g", "ftp://z/1", "mailto:x"]], "b string, t string").select("t", urlfilter.resolve(F.col("b"), F.col("t"))).collect()
    assert dict(map(tuple, got)) == {**{t: f"http://a/{w}" for t, w in cases.items()}, "//g": "http://g", "ftp://z/1": "ftp://z/1", "mailto:x": None}


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(50, k) for k in range(60, 90)] + [(None, 1), (7, 7)], "a long, b long")
    got = dict(connected_components(edges).collect())
    assert got == {**{k: 0 for k in range(31)}, 50: 50, **{k: 50 for k in range(60, 90)}}


def test_licences(spark, docs, nothing):
    mit = "Copyright (c) 2020 Someone\n\n" + licenses.MIT.replace(" ", "\n").replace("sublicense", "sub-license").upper()
    df = spark.createDataFrame([(1, mit), (2, licenses.MIT + " more"), (3, "x\nReleased under the MIT Licence.\ny"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: (r.license, r.n_notice_lines) for r in licenses.scan(df).collect()}
    assert got == {1: ("MIT", 0), 2: (None, 0), 3: (None, 1), 4: (None, 0)}
    assert licenses.scan(docs).count() == docs.count() and licenses.scan(nothing).count() == 0


BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

%s Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
%s Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
%s
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""


def test_common_licences(spark, tmp_path):
    third = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    texts = [
        ("BSD-2-Clause", 0, "Copyright (c) 2020, Someone\n\n" + BSD % ("1.", "2.", "")), ("BSD-3-Clause", 0, "BSD 3-Clause License\n\nCopyright (c) 2020\nAll rights reserved.\n" + BSD % ("*", "*", "* " + third)),
        ("MIT", 0, "The MIT License (MIT)\n\nCopyright (c) 2020 Someone\n\n" + licenses.MIT), ("MIT (titled)", 0, "MIT License\n" + licenses.MIT), (None, 0, BSD % ("1.", "2.", "3. Pay.")),
        (None, 5, "Licensed under the Mozilla Public License, version 2.0\nx\nSPDX-License-Identifier: Apache-2.0\nThis software is licensed under the GNU Affero General Public License, version 3 or later.\nReleased under CC BY-SA 4.0\nReleased under the MIT License."),
        (None, 0, "Licensed under my own terms"),
    ]
    folder = pathlib.Path("/usr/share/common-licenses")
    found = [(n, 0, (folder / f).read_text()) for f, n in {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}.items() if (folder / f).exists()]
    texts += found + [(n, k, re.sub(r"END OF TERMS AND CONDITIONS[\s\S]*", "END OF TERMS AND CONDITIONS\n", t)) for n, k, t in found]
    spark.createDataFrame([(k, t) for k, (_, _, t) in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.license, r.n_notice_lines) for r in queries.op8_license_scans(spark, str(tmp_path)).collect()}
    assert got == {k: (name, n) for k, (name, n, _) in enumerate(texts)}
    every = [d for own in licenses.DIGESTS.values() for d in own]
    assert len(every) == len(set(every))


def test_toxicity(spark, docs, nothing):
    bad = ["grob", "schnark"]
    texts = [" ".join(f"w{rng.randint(0, 300)}" for _ in range(60)) for _ in range(240)]
    labels = [k % 4 == 0 for k in range(240)]
    texts = [t + " " + rng.choice(bad) + " end" if y else t for t, y in zip(texts, labels, strict=True)]
    model = toxicity.train(texts, [int(y) for y in labels])
    fresh = docs.sparkSession.createDataFrame([(1, "a quiet w1 w2 w3 text"), (2, "w5 w6 grob w9"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(fresh, model).collect()}
    assert got[2] > 0.5 > got[1] and got[3] == 0
    assert toxicity.score(docs, model).count() == docs.count() and toxicity.score(nothing, model).count() == 0
    none = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}


def test_toxicity_against_plain_loops(spark):
    """Scores equal a loop over words with the network's own numbers."""
    texts = [" ".join(f"w{rng.randint(0, 60)}" for _ in range(rng.randint(1, 130))) + (" grob" if k % 3 == 0 else "") for k in range(60)]
    model = toxicity.train(texts, [int(k % 3 == 0) for k in range(60)], steps=20)
    p, h = {k: v.astype(float) for k, v in model.network.p.items()}, toxicity.HIDDEN
    inputs = {w: model.network.word_inputs(toxicity.gram_codes([w.encode()]), model.tables)[0].astype(float) for t in texts for w in t.split()}

    def soft(x):
        return x / (1 + np.abs(x))

    def states(words, side):
        state, out = np.zeros(h), []
        for w in words if side == 0 else words[::-1]:
            x = (inputs[w] @ p["wx"] + p["bx"])[side * 3 * h : (side + 1) * 3 * h]
            recur = state @ p["ub" if side else "uf"]
            update, reset = ((1 + soft(x[a : a + h] + recur[a : a + h])) / 2 for a in (0, h))
            state = state + update * (soft(x[2 * h :] + reset * recur[2 * h :]) - state)
            out.append(state)
        return np.array(out if side == 0 else out[::-1])

    want = []
    for t in texts:
        words, best = t.split(), 0.0
        for a in range(0, max(1, len(words) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE):
            part = words[a : a + toxicity.WINDOW]
            both = np.hstack([states(part, 0), states(part, 1)])
            weight = np.exp(both @ p["att"])
            best = max(best, 1 / (1 + np.exp(-((weight / weight.sum()) @ both @ p["out"] + p["bias"][0]))))
            if a + toxicity.WINDOW >= len(words):
                break
        want.append(best)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.score for r in toxicity.score(df, model).orderBy("doc_id").collect()]
    assert np.allclose(got, want, atol=1e-4)


def test_toxicity_gradients():
    net, g = toxicity.Network(), np.random.default_rng(0)
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    args = (g.normal(size=(30, 13)), g.integers(0, 30, (4, 6)), np.array([6, 3, 1, 5]), np.array([1, 0, 1, 0.0]), np.ones(4))
    _, grads, _ = net.gradients(*args)
    for name in ("wx", "uf", "ub", "att", "out"):
        at = tuple(g.integers(0, s) for s in net.p[name].shape)
        old, loss = net.p[name][at], []
        for step in (1e-4, -1e-4):
            net.p[name][at] = old + step
            loss.append(net.gradients(*args)[0])
        net.p[name][at] = old
        assert abs((loss[0] - loss[1]) / 2e-4 - grads[name][at]) < 1e-3


def test_language(spark, docs, nothing):
    words = {"aa": ["thorn", "bering", "oust"], "bb": ["éçan", "oiche", "queuré"]}
    rows = [(" ".join(rng.choice(words[k]) for _ in range(30)), k) for k in words for _ in range(30)]
    model = langid.train([t for t, _ in rows], [k for _, k in rows])
    df = spark.createDataFrame([(1, "thorn bering"), (2, "QUEURÉ oiche"), (3, "12 34"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score > 0.5) for r in langid.predict(df, model).collect()}
    assert got == {1: ("aa", True), 2: ("bb", True), 3: ("und", False), 4: ("und", False)}
    assert langid.predict(nothing, langid.fit(nothing)).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, langid.fit(docs)).collect()} <= {"en", "fr", "und"}


def test_language_against_plain_sets():
    """Kernels and scores equal those of sets of cells."""
    words = {"aa": ["thorn", "bering", "oust"], "bb": ["éçan", "oiche", "queuré"]}
    rows = [(" ".join(rng.choice(words[k]) for _ in range(rng.randint(1, 20))), k) for k in words for _ in range(20)]
    model = langid.train([t for t, _ in rows], [k for _, k in rows])

    def cells(text):
        data, out = text.lower().encode() + b"\0" * (langid.LONGEST - 1), set()
        for i in range(len(data) - langid.LONGEST + 1):
            code = 0
            for k in range(langid.LONGEST):
                code = (code * 0x01000193 + data[i + k] + 1) % (1 << 32)
                out.add((code * 0x9E3779B1 % (1 << 32)) >> 17)
        return out

    for text in ("thorn oust", "QUEURÉ", "x", ""):
        own = cells(text)
        kernel = np.array([sum(model.landmarks[c, j] for c in own) for j in range(model.landmarks.shape[1])]) / np.sqrt(max(1, len(own)))
        want = kernel @ model.coefficients[:-1] + model.coefficients[-1]
        got = model.scores(langid.presence(*column_bytes(pa.array([text.lower()])), 0, 1))[0]
        assert np.allclose(got, want, atol=1e-3)


SF = "/root/testdata/sf0.01"


def test_held_out_scores(spark):
    """op6 and op7 as registered: columns, held-out rows, and what they reach on rows that they do not learn from."""
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    six = queries.op6_toxicity(spark, SF)
    assert dict(six.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    rows = {r.doc_id: r for r in six.collect()}
    assert {k: r.held_out for k, r in rows.items()} == held and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic is not null").collect() if held[r.doc_id]}
    good, bad = [rows[k].score for k, y in toxic.items() if y == 0], [rows[k].score for k, y in toxic.items() if y == 1]
    assert np.mean([(b > g) + (b == g) / 2 for b in bad for g in good]) > 0.7 and np.mean(np.array(good) < 0.5) > 0.9
    seven = queries.op7_language_id(spark, SF)
    assert dict(seven.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"}
    rows = {r.doc_id: r for r in seven.collect()}
    assert {k: r.held_out for k, r in rows.items()} == held and all(0 <= r.score <= 1 for r in rows.values())
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang is not null").collect() if held[r.doc_id] and rows[r.doc_id].lang_pred != "und"}
    assert np.mean([rows[k].lang_pred == x for k, x in lang.items()]) > 0.97


def test_recall_of_nearest(spark):
    """op2 as registered, against brute force, each query of sf0.01."""
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    ids, cells = np.array([k for k, _ in rows]), np.array([v for _, v in rows])
    unit = cells / np.linalg.norm(cells, axis=1, keepdims=True)
    got = collections.defaultdict(set)
    for r in queries.op2_nearest_neighbours(spark, SF).collect():
        got[r.query_id].add(r.vec_id)
    share = []
    for q in np.flatnonzero(ids % 50 == 0):
        cosine = unit @ unit[q]
        cosine[q] = -2
        share.append(len(set(ids[np.lexsort((ids, -cosine))[:5]].tolist()) & got[int(ids[q])]) / 5)
    assert np.mean(share) >= 0.9


CLASHING = ["score", "lang_pred", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", "carried", "turn", "component_id", "kept", "low", "high", "doc", "th", "sequence_id", "offset", "piece", "length", "held_out", "toxic"]


def test_stages_with_clashing_columns(spark, tmp_path):
    """Columns with the names that stages use inside come through every stage as they were."""
    texts = [*TEXTS[:9], "tail " + TEXTS[5], *(f"th{k} oust bering thorn {k}" for k in range(30))]
    rows = [(k, t, "en", "s", len(t or ""), *(f"{c}{k}" for c in CLASHING)) for k, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, (None, "no id", *rows[3][2:]), rows[4]], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING))
    spark.createDataFrame([(k, int(k == 3)) for k in range(20)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns, name
        for r in after.collect():
            assert r.doc_id is None or [r[c] for c in CLASHING] == [f"{c}{r.doc_id}" for c in CLASHING]
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0
    assert corpus_pipeline.packed(spark, docs, str(tmp_path)).select("doc_id").distinct().count() == len(texts) + 1
    for out in (suffix.strip_repeats(docs), neardup.link(docs), bpe.digest_round_trip(docs, bpe.ranks_file()), licenses.scan(docs)):
        assert out.count() == docs.count() and len(set(out.columns)) == len(out.columns)


def test_texts_beyond_a_slice(spark):
    """Texts longer than what a task works on at once are read whole by every operator."""
    words = [f"{rng.choice('abcdefgh')}{rng.randint(0, 5000)}" for _ in range(250_000)]
    long = " ".join(words)
    edge = suffix.SEGMENT
    assert len(long) > 1_000_000 > edge
    copy = long[edge - 700 : edge + 700]  # a passage across the edge of a segment
    rows = [(1, long), (2, "start " + copy + " end"), (3, "grob " + long[:900_000]), (4, " ".join(words[:-300] + words[-299:]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seen = collections.Counter(hash(t[i : i + 200]) for _, t in rows for i in range(len(t) - 199))
    got = {r.doc_id: r for r in suffix.strip_repeats(df).collect()}
    for k, t in rows:
        gone = np.zeros(len(t) + 1, np.int64)
        at = np.flatnonzero(np.fromiter((seen[hash(t[i : i + 200])] > 1 for i in range(len(t) - 199)), bool))
        np.add.at(gone, at, 1)
        np.add.at(gone, at + 200, -1)
        assert got[k].n_removed == int((np.cumsum(gone[:-1]) > 0).sum())
    groups = {r.doc_id: r.component_id for r in neardup.link(df).collect()}
    assert groups == {1: 1, 2: 2, 3: 3, 4: 1}
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {k: own.encode(t, add_special_tokens=False).ids for k, t in rows}
    digests = {r.doc_id: r for r in bpe.digest_round_trip(df, bpe.ranks_file()).collect()}
    assert all(digests[k].ids_sha256 == hashlib.sha256(" ".join(map(str, ids[k])).encode()).hexdigest() for k, _ in rows)
    lengths = collections.Counter()
    for r in packing.pack(df).collect():
        lengths[r.doc_id] += r.length
    assert lengths == {k: len(x) + 1 for k, x in ids.items()}
    model = toxicity.train([" ".join(words[k : k + 60]) + (" grob" if k % 2 else "") for k in range(0, 6000, 61)], [k % 2 for k in range(0, 6000, 61)])
    assert set(toxicity.score(df, model).toPandas().doc_id) == {1, 2, 3, 4}


def test_ids_with_several_texts(spark):
    """An id that repeats with other texts is one document that all of them link."""
    a, b = (" ".join(f"{x}{rng.randint(0, 99)}" for _ in range(60)) for x in "ab")
    df = spark.createDataFrame([(1, a), (2, a), (2, b), (3, b), (4, "else where")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in neardup.link(df).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_sql_of_the_queries(spark):
    """The registered queries with SQL, on sf0.001 and on rows made for them."""
    con = duckdb.connect()
    for p in pathlib.Path("/root/testdata/sf0.001").glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    for name, sql in queries.ORACLE_SQL.items():
        rows = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
        found = con.sql(f"SELECT {', '.join(rows.columns)} FROM ({sql})").fetchall()
        assert sorted(map(tuple, rows.collect()), key=repr) == sorted(found, key=repr), name


def test_pipeline(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.columns == docs.columns
        docs = spark.createDataFrame(after.toArrow()) if after.count() else after
    out = corpus_pipeline.run(spark, sf)
    assert 0 < out.select("doc_id").distinct().count() <= docs.count()


def test_pipeline_rows(spark, tmp_path):
    own, library = random.Random(9), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    vocabulary = {"en": [f"th{a}{b}" for a in "bdfglmnprst" for b in ("ow", "ing", "ess", "ound")], "fr": [f"é{a}{b}" for a in "bdfglmnprst" for b in ("que", "oir", "eau", "ille")]}

    def words(lang, n=120):
        return [own.choice(vocabulary[lang]) for _ in range(n)]

    rows = {k: (" ".join(words("en" if k % 2 else "fr")), "en" if k % 2 else "fr") for k in range(200)}
    toxic = {k for k in range(200) if k % 8 in (0, 3)}  # as often in both languages
    for k in toxic:
        w = rows[k][0].split()
        w[own.randrange(120)] = own.choice(["grob", "schnark"])
        rows[k] = (" ".join(w), rows[k][1])
    unknown = {300: ("12 34 , 56", "en"), 301: ("", "fr"), 302: (None, "en")}
    for k, base in ((310, 1), (311, 1), (312, 2)):  # near copies: one word differs
        w = rows[base][0].split()
        w[60] = "zzz"
        rows[k] = (" ".join(w), rows[base][1])
    shared = " ".join(words("en", 50))
    for k in (320, 321):
        rows[k] = (" ".join([*words("en"), shared, *words("en")]), "en")
    rows[322] = (shared, "en")
    rows[323] = (" ".join(words("en", 3000)), "en")
    table = [(k, t, lang, "s", len(t or "")) for k, (t, lang) in {**rows, **unknown}.items()]
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k in toxic)) for k in range(200)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    want = [{r[0]: r for r in table}]
    want.append({k: r for k, r in want[-1].items() if k not in toxic})
    want.append({k: r for k, r in want[-1].items() if k not in unknown})
    groups = brute_groups([(k, r[1]) for k, r in want[-1].items()], 5, 80)
    want.append({k: r for k, r in want[-1].items() if groups[k][1] == k})
    seen, after = collections.Counter(r[1].encode()[i : i + 200] for r in want[-1].values() for i in range(len(r[1].encode()) - 199)), {}
    for k, r in want[-1].items():
        b = r[1].encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        if not gone.all():
            text = np.frombuffer(b, np.uint8)[~gone].tobytes().decode()
            after[k] = (k, text, *r[2:4], len(text))
    want.append(after)
    assert [len(x) for x in want] == [210, 160, 157, 154, 153] and len(after[320][1]) < len(rows[320][0]) - 200

    for (name, stage), before, kept in zip(corpus_pipeline.STAGES, want, want[1:]):
        given = spark.createDataFrame(list(before.values()), docs.schema)
        got = sorted(map(tuple, stage(spark, given, str(tmp_path)).collect()))
        assert ([r[0] for r in got], name) == (sorted(kept), name) and got == sorted(kept.values())
    pieces = set()
    for k, r in after.items():
        ids, at, j = library.encode(r[1], add_special_tokens=False).ids + [2], 0, 0
        while at < len(ids):
            part = ids[at : at + (1024 if at else (len(ids) - 1) % 1024 + 1)]
            pieces.add((k, j, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
            at, j = at + len(part), j + 1
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(out) == len(pieces) and {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out} == pieces
    ends = collections.Counter()
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 1024


def test_slow_texts_match_fast():
    from corpuslens.llm.pretokens import slow_split

    texts = ["it's  a\n\ntest 'll's", " lead", "tail  ", "é—x 9²", "\n", "a'b''s"]
    data, offsets = column_bytes(pa.array(texts))
    words, number, by = split_texts(data, offsets, 0, len(texts))
    for k, t in enumerate(texts):
        assert [words[i] for i in number[by[k] : by[k + 1]]] == slow_split(t.encode())
