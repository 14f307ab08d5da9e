"""The feature store: snapshots, bytes in proportion to changes, crashes, pruning; and the stream that follows files."""

import os
import pathlib

import pytest
from pyspark.sql import functions as F

from corpuslens.config import AnalysisConfig
from corpuslens.sources import notes as N
from corpuslens.sources.store import ConflictError, FeatureStore
from corpuslens.streaming import activity as S
from corpuslens.streaming import notes as L

STAMP = "timestamp'2024-01-01 00:00:00'"


def files_of(spark, versions: dict):
    rows = [(p, f"---\ncreated at: 2021-01-{1 + k % 28:02d}\ntags: [t{k % 3}]\n---\nbody of {p} {v}", v) for k, (p, v) in enumerate(versions.items())]
    made = spark.createDataFrame(rows, "path string, content string, v int")
    return made.select("path", "content", F.lit(None).cast("timestamp").alias("ctime"), (F.expr(STAMP) + F.make_interval(hours=F.col("v"))).alias("mtime"), F.length("content").cast("long").alias("size"))


def state(facts):
    return sorted((r.path, r.mtime, r.size, r.word_count, tuple(r.tags), r.signature) for r in facts.collect())


def rebuilt(files, config):
    return state(N.parse(files, config).withColumn("signature", F.lit(config.signature())))


def data_bytes(root):
    return sum(f.stat().st_size for f in pathlib.Path(root).rglob("*.parquet"))


def test_changes_write_their_buckets_only(spark, tmp_path):
    config = AnalysisConfig()
    store = FeatureStore(spark, str(tmp_path), config, buckets=16)
    assert store.load() is None and store.current() is None
    versions = {f"n{k:03d}.md": 0 for k in range(200)}
    facts, counts = store.update(files_of(spark, versions))
    assert (counts["refreshed"], counts["reused"], counts["dropped"], counts["buckets"]) == (200, 0, 0, 16)
    assert state(facts) == rebuilt(files_of(spark, versions), config)
    whole = data_bytes(tmp_path)
    versions["n007.md"] = 5
    facts, counts = store.update(files_of(spark, versions))
    assert (counts["refreshed"], counts["reused"], counts["dropped"], counts["buckets"]) == (1, 199, 0, 1)
    assert data_bytes(tmp_path) - whole < whole / 6
    assert state(store.load()) == rebuilt(files_of(spark, versions), config)
    assert next(r.mtime.hour for r in store.load(0).collect() if r.path == "n007.md") == 0  # the version before is still there
    before = data_bytes(tmp_path)
    assert store.update(files_of(spark, versions))[1]["buckets"] == 0 and data_bytes(tmp_path) == before
    # Another signature makes every fact stale.
    other = FeatureStore(spark, str(tmp_path), AnalysisConfig(tag_mode="leaf"))
    assert other.refresh(files_of(spark, versions))[1].first().refreshed == 200
    assert store.vacuum() == 0  # both commits are named by the newest version
    assert state(store.load()) == rebuilt(files_of(spark, versions), config) and len(store.versions()) == 1
    store.clear()
    assert store.load() is None


def test_prune_against_all_files(spark, tmp_path):
    """Q-16: a note that leaves the scope keeps its fact, a deleted one does not."""
    store = FeatureStore(spark, str(tmp_path), AnalysisConfig(), buckets=4)
    every = files_of(spark, {f"n{k}.md": 0 for k in range(10)})
    store.update(every, every)
    scope, live = every.where("path < 'n4.md'"), every.where("path != 'n9.md'")
    facts, counts = store.update(scope, live)
    assert (counts["reused"], counts["refreshed"], counts["dropped"]) == (4, 0, 1)
    assert facts.count() == 4 and store.load().count() == 9
    assert tuple(store.refresh(every, every)[1].first()) == (9, 1, 0)
    gone, counts = store.update(every.where("false"), every.where("false"))
    assert counts["dropped"] == 9 and gone.count() == 0 and store.load() is None


@pytest.mark.parametrize("step", ["write", "publish", "torn"])
def test_a_crash_leaves_the_version_before(spark, tmp_path, monkeypatch, step):
    config = AnalysisConfig()
    store = FeatureStore(spark, str(tmp_path), config, buckets=4)
    versions = {f"n{k}.md": 0 for k in range(12)}
    store.update(files_of(spark, versions))
    before = state(store.load())
    versions |= {"n1.md": 3, "new.md": 1}

    def fail(*_):
        raise RuntimeError("killed")

    if step == "torn":  # half a manifest was written

        def half(manifest):
            path = tmp_path / "v4" / "manifest" / f"{manifest['version']:010d}.json"
            path.write_text('{"version": 1, "buck')
            fail()

        monkeypatch.setattr(store, "_publish", half)
    elif step == "publish":
        monkeypatch.setattr(store, "_publish", fail)
    else:
        monkeypatch.setattr(store, "_read", fail)
    with pytest.raises(RuntimeError, match="killed"):
        store.commit(N.parse(files_of(spark, versions), config).withColumn("signature", F.lit(config.signature())))
    monkeypatch.undo()
    assert state(store.load()) == before
    store.update(files_of(spark, versions))
    assert state(store.load()) == rebuilt(files_of(spark, versions), config)
    store.vacuum()
    assert state(store.load()) == rebuilt(files_of(spark, versions), config)
    assert not (tmp_path / "v4" / "staged").exists()


def test_two_commits_at_a_time(spark, tmp_path):
    store = FeatureStore(spark, str(tmp_path), AnalysisConfig(), buckets=2)
    store.update(files_of(spark, {"a.md": 0}))
    manifest = store.current()
    with pytest.raises(ConflictError):
        store._publish(manifest)
    assert store.load().count() == 1


def put(root, arrival, notes):
    for path, (text, mtime) in notes.items():
        file = pathlib.Path(root) / arrival / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(text)
        os.utime(file, (mtime, mtime))


def test_stream_of_files(spark, tmp_path):
    """Three arrivals: new notes; a change; a late version of a changed note and a late note. State equals a rebuild."""
    day, start = 86_400, 1_700_006_400
    root, config = tmp_path / "in.coming+1", AnalysisConfig()
    store = FeatureStore(spark, str(tmp_path / "store"), config, buckets=4)
    arrivals = [
        {"a.md": ("---\ncreated at: 2021-02-03\ntags: [x]\n---\none", start), "d/b.md": ("two words", start)},
        {"a.md": ("---\ncreated at: 2021-02-03\ntags: [x, y]\n---\none two three", start + 20 * day), "c.md": ("c", start + 20 * day)},
        {"a.md": ("late and old", start + 2 * day), "e.md": ("late but new", start + day), "c.md": ("newest c now", start + 21 * day)},
    ]
    every = {}
    for k, notes in enumerate(arrivals):
        put(root, f"arrival{k}", notes)
        query = L.follow(L.note_stream(spark, str(root)), store, str(tmp_path / "checkpoint"))
        assert query.awaitTermination(120) and query.exception() is None
        for path, (text, mtime) in notes.items():
            if path not in every or every[path][1] < mtime:
                every[path] = text, mtime
        whole = spark.createDataFrame([(p, t, m, len(t)) for p, (t, m) in every.items()], "path string, content string, m long, size long")
        whole = whole.select("path", "content", F.lit(None).cast("timestamp").alias("ctime"), F.timestamp_seconds("m").alias("mtime"), "size")
        assert state(store.load()) == rebuilt(whole, config)
    assert {r.path: r.word_count for r in store.load().collect()} == {"a.md": 3, "d/b.md": 2, "c.md": 3, "e.md": 3}
    # A batch that is delivered again is not put in again.
    version = store.current()["version"]
    assert store.commit(store.load().where("false"), source=("notes", 0))["version"] == version == store.current()["version"]


def test_watermark_of_edits(spark, tmp_path):
    """A day that the watermark has closed takes no late version; the store does (above)."""
    day, start = 86_400, 1_700_006_400
    root = tmp_path / "edits"
    for k, notes in enumerate([{"a.md": ("x", start), "b.md": ("x", start)}, {"c.md": ("x", start + 20 * day)}, {"d.md": ("late", start), "e.md": ("x", start + 40 * day)}]):
        put(root, f"arrival{k}", notes)
        writer = L.edit_activity(L.note_stream(spark, str(root))).writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "edits-checkpoint"))
        assert writer.trigger(availableNow=True).start().awaitTermination(120)
    rows = {r.window_start.timestamp(): r.events for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rows == {start: 2, start + 20 * day: 1}


def test_streams_equal_batches(spark, tmp_path):
    """windowed_activity and session_activity over a stream of events, run to its end, give the rows of the batch."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(3)
    events.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events"))
    for name, run in (("windows", lambda df: S.windowed_activity(df, late="3650 days")), ("sessions", lambda df: S.session_activity(df, late="3650 days"))):
        query = run(stream).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, run(events).collect()))


def test_scan_of_odd_roots(spark, tmp_path):
    root = tmp_path / "plain.v1+(x)"
    (root / "in").mkdir(parents=True)
    (root / "in" / "y.md").write_text("hello")
    assert [r.path for r in N.scan(spark, f"{root}/").collect()] == ["in/y.md"]
    listed = spark.createDataFrame([("in/y.md", "2020-01-02 03:04:05")], "path string, ctime string")
    assert N.scan(spark, str(root), listed).first().ctime.year == 2020
