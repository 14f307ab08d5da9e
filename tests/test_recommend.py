"""Recommendations for all notes against plain loops, and the rows that a hub, a common tag and a common folder make."""

import random

import pytest

from corpuslens.config import RecommendConfig
from corpuslens.operators import recommend as R

SCHEMA = "path string, links array<string>, tags array<string>, folder string"


def brute(notes, config):
    out = {}
    known = {p for p, *_ in notes}
    for p, links, tags, folder in notes:
        rows = []
        for q, links2, tags2, folder2 in notes:
            if p == q:
                continue
            score = config.out_link * (q in (links or [])) + config.back_link * (p in (links2 or []))
            score += config.shared_tag * sum(t in (tags2 or []) for t in tags or []) + config.shared_neighbour * sum(n in (links2 or []) for n in links or [])
            score += config.same_folder * bool(folder and folder == folder2)
            if score > 0:
                rows.append((-score, q))
        out[p] = [(q, -s) for s, q in sorted(rows)[: config.limit]]
    assert known == set(out)
    return out


def made(n, seed):
    rng = random.Random(seed)
    names = [f"n{k:03d}.md" for k in range(n)]
    common = ["all", "same", "half", "third"]
    notes = []
    for k, name in enumerate(names):
        tags = ["all", "same"] + [t for t in common[2:] if rng.random() < 0.5] + rng.choices([f"t{j}" for j in range(12)], k=rng.randint(0, 3))
        tags += rng.choices(tags, k=rng.randint(0, 1))  # repeats count again
        links = [names[0]] * rng.randint(0, 2) + rng.choices(names + ["nowhere"], k=rng.randint(0, 4))
        notes.append((name, links, tags, rng.choice(["", "a", "a/b"])))
    notes += [("none.md", None, None, None), ("self.md", ["self.md"], ["alone"], "own"), ("wide.md", names[:6], [*common, *(f"t{j}" for j in range(12))], "a")]
    return notes


@pytest.mark.parametrize(("light", "most", "wide"), [(256, 10, 64), (3, 10, 64), (3, 3, 1), (1, 4, 200), (0, 10, 0)])
def test_all_notes(spark, monkeypatch, light, most, wide):
    for name, value in (("LIGHT", light), ("MOST", most), ("WIDE", wide)):
        monkeypatch.setattr(R, name, value)
    notes = made(70, light + most)
    config = RecommendConfig(limit=4)
    got = {p: [] for p, *_ in notes}
    for r in sorted(R.recommend_all(spark.createDataFrame(notes, SCHEMA), config).collect(), key=lambda r: r["rank"]):
        got[r.src].append((r.dst, r.score))
    assert got == brute(notes, config)


def test_other_weights(spark, monkeypatch):
    monkeypatch.setattr(R, "LIGHT", 4)
    notes = made(40, 9)
    for config in (RecommendConfig(limit=3, shared_tag=0.0), RecommendConfig(limit=3, same_folder=-1.0), RecommendConfig(limit=50, out_link=0.5)):
        got = {p: [] for p, *_ in notes}
        for r in sorted(R.recommend_all(spark.createDataFrame(notes, SCHEMA), config).collect(), key=lambda r: r["rank"]):
            got[r.src].append((r.dst, r.score))
        assert got == brute(notes, config)


@pytest.mark.parametrize("kind", ["hub", "tag", "folder"])
def test_rows_stay_linear(spark, most_rows, kind):
    """20,000 notes with one thing in common: 400,000,000 pairs, of which no plan node sees more than a few a note."""
    n = 20_000
    notes = spark.range(n).selectExpr(
        "concat('n', lpad(id, 6, '0'), '.md') AS path",
        "array('n000000.md', concat('only', id)) AS links" if kind == "hub" else "array(concat('only', id)) AS links",
        "array('common', concat('own', id)) AS tags" if kind == "tag" else "array(concat('own', id)) AS tags",
        "'common' AS folder" if kind == "folder" else "concat('f', id) AS folder",
    )
    found = R.recommend_all(notes, RecommendConfig(limit=3))
    assert most_rows(found) <= 12 * n
    rows = {r["rank"]: r.dst for r in found.where("src = 'n019999.md'").collect()}
    assert rows == {1: "n000000.md", 2: "n000001.md", 3: "n000002.md"}


def diverse(notes, config):
    """Greedy selection by plain loops over the brute-force pool."""
    pool = brute(notes, RecommendConfig(**{**config.__dict__, "limit": max(config.limit, config.diverse_pool)}))
    traits = {p: {"#" + t for t in tags or []} | {"@" + x for x in links or []} for p, links, tags, _ in notes}
    out = {}
    for p, ranked in pool.items():
        left, picked = list(enumerate(ranked)), []
        while left and len(picked) < config.limit:
            cost = lambda c: c[1][1] - 10 * config.diversity * max((len(traits[c[1][0]] & traits[q]) / len(traits[c[1][0]] | traits[q]) if traits[c[1][0]] | traits[q] else 0 for q in picked), default=0)  # noqa: B023, E731
            best = max(left, key=lambda c: (round(cost(c), 9), -c[0]))
            if picked and cost(best) < 0:
                break
            picked.append(best[1][0])
            left.remove(best)
        out[p] = picked
    return out


def test_diverse_selection(spark):
    notes = made(30, 2)
    config = RecommendConfig(limit=4, diversity=0.4, diverse_pool=12)
    got = {p: [] for p, *_ in notes}
    for r in sorted(R.recommend_all(spark.createDataFrame(notes, SCHEMA), config).collect(), key=lambda r: r["rank"]):
        got[r.src].append(r.dst)
    want = diverse(notes, config)
    assert got == want and want != {p: [q for q, _ in x] for p, x in brute(notes, RecommendConfig(limit=4)).items()}


def resolved(notes):
    """Q-10, not strict, by plain loops."""
    paths = [p for p, *_ in notes]
    bare = lambda p: p.rsplit(".", 1)[0] if "." in p.rsplit("/", 1)[-1] else p
    folders = lambda p: p.split("/")[:-1]
    out = {}
    for p, links in notes:
        own = []
        for link in links or []:
            text = link.split("#")[0].strip()
            found = [q for q in paths if q == text] or sorted(q for q in paths if bare(q) == text)
            if not found and text and "/" not in text:
                near = []
                for q in paths:
                    if bare(q.rsplit("/", 1)[-1]) == bare(text):
                        a, b = folders(p), folders(q)
                        same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
                        near.append((len(a) + len(b) - 2 * same, q))
                found = [min(near)[1]] if near else []
            own.append(found[0] if found else link)
        out[p] = own if links is not None else None
    return out


def test_links_are_resolved(spark):
    from corpuslens.operators.links import resolve_links

    rng = random.Random(10)
    places = ["", "a/", "a/b/", "a/b/c/", "a/d/", "e/", "e/f/"]
    paths = sorted({rng.choice(places) + rng.choice(["index", "note", "plan", "x.y"]) + ".md" for _ in range(22)})
    texts = [*paths, *(p[:-3] for p in paths), "index", "note", "plan#head", "x.y", "x.y.md", "index.md", "missing", "", "#only", " note "]
    notes = [(p, rng.choices(texts, k=rng.randint(0, 8)) if k else None) for k, p in enumerate(paths)]
    df = spark.createDataFrame([(p, x, "kept") for p, x in notes], "path string, links array<string>, other string")
    out = resolve_links(df)
    assert out.columns == df.columns
    assert {r.path: r.links for r in out.collect()} == resolved(notes)


def test_a_common_name_stays_linear(spark, most_rows):
    """10,000 folders with an index each, which all notes link to by name."""
    from corpuslens.operators.links import resolve_links

    notes = spark.range(10_000).selectExpr("concat('top/f', id, '/index.md') AS path", "array('index') AS links")
    out = resolve_links(notes)
    assert most_rows(out) <= 8 * 10_000
    assert out.where("links[0] = path").count() == 10_000
