"""Words that every polynomial hash modulo 2**64 takes for equal: bytes must decide (Thue-Morse words)."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from corpuslens.llm import bpe, queries
from corpuslens.llm.common import SpanHash, distinct_spans, equal_spans


def thue_morse(n: int, a: str, b: str) -> str:
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """documents with pairs of such words, long enough for a shingle of one word and for windows of 200 bytes."""
    rows, k = [], 0
    for n in (1024, 2048, 4096):
        for a, b in ("ab", "ba"):
            rows.append((k, thue_morse(n, a, b)))
            rows.append((k + 1, " ".join(f"{k}w{i}" for i in range(40)) + " " + thue_morse(n, a, b)))
            k += 2
    path = tmp_path_factory.mktemp("words")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return str(path), dict(rows)


def test_spans():
    words = [thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")] * 3
    data = np.frombuffer("".join(words).encode(), np.uint8)
    starts = np.arange(6) * 1024
    assert len(set(SpanHash(data)(starts, starts + 1024).tolist())) == 1
    found, number = distinct_spans(data, starts, starts + 1024)
    assert [found[k].decode() for k in number] == words and len(found) == 2
    assert equal_spans(data, starts, np.zeros(6, np.int64), np.full(6, 1024)).tolist() == [True, False] * 3


def test_registered_tokens(spark, folder):
    path, texts = folder
    with open(bpe.ranks_file(), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = queries.op3_byte_bpe(spark, path)
    assert dict(out.dtypes) == {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}
    got = {r.doc_id: r for r in out.collect()}
    for k, text in texts.items():
        ids = own.encode_ordinary(text)
        assert (got[k].n_tokens, got[k].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert got[k].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    pieces = {}
    for r in queries.op1_best_fit_packing(spark, path).collect():
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    for k, text in texts.items():
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], "<u4")
        own_pieces = sorted(pieces[k])
        assert sum(p[2] for p in own_pieces) == len(ids)
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == crc for _, s, n, crc in own_pieces)


def test_registered_near_duplicates(spark, folder):
    path, texts = folder
    out = queries.op10_minhash_near_dedup(spark, path)
    assert dict(out.dtypes) == {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"}
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(texts)
    for k, r in got.items():
        assert (r.component_id, r.kept, r.n_shingles) == (k, True, max(1, len(texts[k].split()) - 2))


def test_registered_repeats(spark, folder):
    path, texts = folder
    places = {}
    for k, text in texts.items():
        for i in range(len(text) - 199):
            places.setdefault(text[i : i + 200], []).append((k, i))
    gone = {k: np.zeros(len(t), bool) for k, t in texts.items()}
    for own in places.values():
        for k, i in own if len(own) > 1 else ():
            gone[k][i : i + 200] = True
    out = queries.op4_suffix_dedup(spark, path)
    assert dict(out.dtypes) == {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"}
    for r in out.collect():
        kept = "".join(c for c, g in zip(texts[r.doc_id], gone[r.doc_id], strict=True) if not g)
        assert (r.n_removed, r.kept_sha256) == (int(gone[r.doc_id].sum()), hashlib.sha256(kept.encode()).hexdigest())
