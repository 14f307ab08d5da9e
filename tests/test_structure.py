"""Tag structures and exact ranks on made tables: hubs, large thresholds, many distinct values."""

import random

import numpy as np
import pytest

from corpuslens.operators import ranks as R
from corpuslens.operators import rhythm as H
from corpuslens.operators import tagstructure as G


def test_triangles(spark):
    rng = random.Random(3)
    edges = {tuple(sorted(rng.sample(range(30), 2))) for _ in range(120)}
    names = [(f"t{a:02d}", f"t{b:02d}") for a, b in edges]
    got = {r.tag: r.closed for r in G.triangles(spark.createDataFrame(names, "left string, right string")).collect()}
    near = {}
    for a, b in names:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {t: sum(1 for a in n for b in n if a < b and b in near[a]) for t, n in near.items()}
    assert got == {t: k for t, k in want.items() if k}


def test_wedges_of_a_hub(spark, most_rows):
    """A hub with 20,000 neighbours has 200,000,000 wedges; from low to high degree next to none are met."""
    n = 20_000
    hub = spark.range(1, n).selectExpr("'hub' AS left", "concat('t', lpad(id, 6, '0')) AS right")
    ring = spark.range(1, n - 1).selectExpr("concat('t', lpad(id, 6, '0')) AS left", "concat('t', lpad(id + 1, 6, '0')) AS right")
    found = G.triangles(hub.union(ring))
    assert most_rows(found) <= 5 * n
    rows = {r.tag: r.closed for r in found.where("tag in ('hub', 't000001', 't000500')").collect()}
    assert rows == {"hub": n - 2, "t000001": 1, "t000500": 2}


def test_ranks(spark):
    gen = np.random.default_rng(5)
    cells = {}
    for g in range(3):
        for v in np.unique(np.concatenate([gen.integers(0, 5, 3), gen.integers(0, 1 << 20, 40), gen.integers(0, (1 << 48) - 1, 40)])).tolist():
            cells[g, v] = int(gen.integers(1, 6)), int(gen.integers(1, 1000))
    df = spark.createDataFrame([(g, v, n, w) for (g, v), (n, w) in cells.items()], "g int, key long, n long, weight long")
    goals = []
    for g in range(3):
        n, w = (sum(c[k] for (h, _), c in cells.items() if h == g) for k in range(2))
        goals += [(g, f"n{k}", "n", float(x)) for k, x in enumerate((1, 2, n // 3, n - 1, n))] + [(g, "half", "weight", w / 2)]
    got = {(r.g, r["rank"]): r.value for r in R.search(df, spark.createDataFrame(goals, "g int, rank string, kind string, goal double"), ["g"]).collect()}
    for g, rank, kind, goal in goals:
        run = 0
        for v, c in sorted((v, c) for (h, v), c in cells.items() if h == g):
            run += c[kind == "weight"]
            if run >= goal:
                assert got[g, rank] == v
                break
    assert len(got) == len(goals)


def test_lag_ranks_in_parallel(spark):
    """Median, 90th percentile and weighted median of 30,000 different lags; no task sorts all of them."""
    rng = np.random.default_rng(1)
    lags = np.unique(rng.integers(1, 10**11, 30_000))
    words = rng.integers(0, 500, len(lags))
    made = spark.createDataFrame(list(zip((lags / 86_400_000).tolist(), words.tolist(), strict=True)), "lag_days double, word_count long")
    found = H.lag_ranks(made)
    row = found.first()
    assert row.median_lag == pytest.approx(np.percentile(lags, 50) / 86_400_000, abs=1e-9) and row.p90_lag == pytest.approx(np.percentile(lags, 90) / 86_400_000, abs=1e-9)
    weight = np.cumsum(np.maximum(1, words))
    assert row.half_life == pytest.approx(lags[np.argmax(weight >= weight[-1] / 2)] / 86_400_000, abs=1e-9)
    plan = found._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("bin" in line for line in windows) and "percentile" not in plan
    assert H.lag_ranks(made.where("false")).count() == 0


def test_season_and_leaders(spark):
    rows = [(2020, 1, 18262, 10, 1.0, ["a"]), (2020, 7, 18444, 10, None, ["a", "b"]), (2021, 7, 18809, 90, None, ["b"]), (2023, 1, 19358, 1, None, ["b"])]
    e = spark.createDataFrame(rows, "year int, month int, epoch_day int, word_count long, lag_days double, tags array<string>")
    assert [r.dominant_season for r in H.temporal(e, "year").orderBy("year").collect()] == ["Winter", "Summer", "Winter"]
    assert {(r.leader, r.tag) for r in G.persistence_leaders(e).collect()} == {("most persistent", "b"), ("longest lifespan", "b")}
    # A silence is a day shorter than the gap between two days, and counts as long from 30 days on.
    days = spark.createDataFrame([(2020, 1, d, 1, None, []) for d in (1, 31, 62)], "year int, month int, epoch_day int, word_count long, lag_days double, tags array<string>")
    row = H.temporal(days).first()
    assert (row.longest_gap, row.long_silences) == (30, 0.5) and row.p90_gap == pytest.approx(29.9)
