"""Whitening against exact arithmetic and a library's eigenvectors."""

import math
from fractions import Fraction

import numpy as np
import pytest

from corpuslens.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, n long, component string, size int, vector string"


def table(spark, rows):
    return spark.createDataFrame([(k, v, 1, "clash", 2, "clash") for k, v in rows], SCHEMA)


def expected(rows):
    """The usable rows' integers, exact deviations and the true covariance."""
    own = [(k, v) for k, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in own]
    n, sums = len(x), [sum(col) for col in zip(*x, strict=True)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    d = len(sums)
    cov = np.array([[float(Fraction(sum((n * r[i] - sums[i]) * (n * r[j] - sums[j]) for r in x), n**3)) for j in range(d)] for i in range(d)])
    return [k for k, _ in own], np.array(x), n, deviation, cov


def check(got, rows, most=32):
    ids, x, n, deviation, cov = expected(rows)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    kept = [k for k in range(min(most, len(values))) if values[k] > 1e-11 * values[0] > 0]
    assert len(got) == len(ids) * len(kept)
    assert {(r.vec_id, r.component) for r in got} == {(k, c + 1) for k in ids for c in kept}
    assert all(r.n == n and abs(r.identity_error) <= 1e-8 for r in got)
    w = np.zeros((len(ids), len(kept)))
    place = {k: i for i, k in enumerate(ids)}
    for r in got:
        assert r.deviation == deviation[place[r.vec_id]]
        assert abs(r.explained - values[r.component - 1] / np.trace(cov)) <= 1e-12
        w[place[r.vec_id], r.component - 1] = r.whitened
    mean = x.astype(float).mean(axis=0)
    for j, c in enumerate(kept):
        gap = min([abs(values[c] - values[o]) for o in range(len(values)) if o != c], default=1)
        if gap > 1e-6 * values[0]:
            plain = (x - mean) @ vectors[:, c] / np.sqrt(values[c])
            sign = np.sign(plain @ w[:, j])
            assert np.allclose(w[:, j], sign * plain, atol=1e-6)
    assert np.abs(np.cov(w.T, bias=True) - np.eye(len(kept))).max() < 1e-6


def test_registered_query(spark, tmp_path):
    out = queries.op11_embedding_whitening(spark, "/root/testdata/sf0.001")
    assert dict(out.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    given = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    check(out.collect(), [(r.vec_id, r.embedding) for r in given.collect()])


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=6).tolist()) for k in range(40)]
    rows += [(50, None), (51, []), (52, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (53, [float("nan")] * 6), (54, [float("inf")] + [0.0] * 5), (55, [0.0] * 6)]
    good = table(spark, rows)
    check(whitening.whiten(good).collect(), rows)
    assert len(whitening.whiten(good, 2).collect()) == 2 * 41
    # Other lengths than the commonest are left out; a null id stays; an id may repeat.
    more = good.unionByName(table(spark, [(60, [1.0, 2.0])])).unionByName(table(spark, [(None, [0.5] * 6), (0, rows[0][1])]))
    got = whitening.whiten(more).collect()
    assert len(got) == 6 * 43 and sum(r.vec_id is None for r in got) == 6 and sum(r.vec_id == 0 for r in got) == 12
    assert whitening.whiten(good.where("false")).count() == 0
    assert whitening.whiten(table(spark, [(k, [1.0, 2.0]) for k in range(5)])).count() == 0  # no variance


def test_dependent_and_large_entries(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(-50, 50, size=(30, 3))
    rows = [(k, [float(a), float(b), float(a + b), float(c), float(c)]) for k, (a, b, c) in enumerate(base.tolist())]
    got = whitening.whiten(table(spark, rows)).collect()
    assert {r.component for r in got} == {1, 2, 3}
    check(got, rows)
    large = [(k, [float(np.float32(x)) for x in (rng.normal(size=3) * 1e16).tolist()]) for k in range(12)]
    model = whitening.fit(table(spark, large))
    _, x, n, _, cov = expected(large)
    assert model.n == n and np.allclose(model.covariance, cov, rtol=1e-12)
    beyond = whitening.whiten(table(spark, [(0, [1e30, 1.0]), (1, [-1e30, 2.0]), (2, [0.0, 5.0])])).collect()
    assert {r.vec_id for r in beyond} == {0, 1, 2} and max(r.deviation for r in beyond) == (1 << 63) - 1


@pytest.mark.parametrize("spectrum", [[5, 4, 3, 2, 1], [7, 7, 7, 2, 2], [1, 1 - 1e-13, 0.5, 0, 0], [0, 0, 0], [3, 3 - 1e-9, 3 - 2e-9, 1]])
def test_slicing(spectrum):
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.normal(size=(len(spectrum),) * 2))[0]
    matrix = q @ np.diag(np.array(spectrum, float)) @ q.T
    matrix = (matrix + matrix.T) / 2
    for shift in (-1.0, 0.25, 1.5, 2.5, 10.0):
        assert whitening.count_above(matrix, shift) == sum(s > shift for s in spectrum)
    values, vectors = whitening.leading(matrix, 4)
    k = len(values)
    assert np.allclose(values, sorted(spectrum, reverse=True)[:k], atol=1e-12)
    assert np.allclose(vectors.T @ vectors, np.eye(k), atol=1e-12) and np.allclose(matrix @ vectors, vectors * values, atol=1e-11)


def test_indefinite_pivots():
    assert whitening.count_above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 20):
        a = rng.normal(size=(n, n))
        a = a + a.T
        for shift in rng.normal(size=5):
            assert whitening.count_above(a, shift) == int((np.linalg.eigvalsh(a) > shift).sum())
