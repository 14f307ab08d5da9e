"""The feature store: parsed notes in buckets of their paths' hash, under a manifest for each version.

    <root>/v<format>/data/<commit>/bucket=<k>/*.parquet    the facts of a bucket, as a commit wrote them
    <root>/v<format>/manifest/<version>.json               which commit holds each bucket

A commit writes the buckets in which a note came, changed or went, and nothing else; then its manifest, which is created
only if that version does not exist yet and ends with a checksum. Readers take the newest whole manifest and read the
files that it names, so they see one snapshot: a commit that was interrupted at any step leaves the version before it,
and of two commits at a time one fails (ConflictError) and can be repeated. vacuum() deletes what no kept version names.

Bytes written follow the changes: a changed note costs its bucket. Buckets are fixed when the store is made; take as
many as keep a bucket at some hundred megabytes.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.config import CACHE_VERSION, AnalysisConfig
from corpuslens.sources.notes import parse

BUCKETS = 64


class ConflictError(RuntimeError):
    """Another commit has taken the version."""


class FeatureStore:
    """S11-S17, J1, J2, Q-16. Facts keyed by path; a fact is reused while path, mtime, size and the settings' signature agree."""

    def __init__(self, spark: SparkSession, root: str, config: AnalysisConfig, buckets: int = BUCKETS):
        self.spark, self.config, self.buckets = spark, config, buckets
        self.path = f"{root.rstrip('/')}/v{CACHE_VERSION}"
        self._fs = spark._jvm.org.apache.hadoop.fs
        self._files = self._fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # --- versions ---

    def versions(self) -> list[int]:
        """The numbers of all manifests, whole or not, ascending."""
        folder = self._fs.Path(f"{self.path}/manifest")
        if not self._files.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())

    def manifest(self, version: int) -> dict | None:
        """A version's manifest; None where it is not whole (its commit was interrupted)."""
        rows = self.spark.read.text(f"{self.path}/manifest/{version:010d}.json", wholetext=True).collect()
        body, _, check = (rows[0][0] if rows else "").rstrip("\n").rpartition("\n")
        return json.loads(body) if body and hashlib.sha256(body.encode()).hexdigest() == check else None

    def current(self) -> dict | None:
        """The newest whole manifest."""
        for version in reversed(self.versions()):
            found = self.manifest(version)
            if found:
                return found
        return None

    def _publish(self, manifest: dict) -> None:
        body = json.dumps(manifest, sort_keys=True)
        path = self._fs.Path(f"{self.path}/manifest/{manifest['version']:010d}.json")
        try:
            out = self._files.create(path, False)
        except Exception as error:
            if "AlreadyExists" in str(error) or "already exists" in str(error):
                raise ConflictError(f"version {manifest['version']} exists") from error
            raise
        out.write(bytearray(f"{body}\n{hashlib.sha256(body.encode()).hexdigest()}\n".encode()))
        out.close()

    # --- reading ---

    def _read(self, manifest: dict, buckets=None) -> DataFrame | None:
        """The facts of all or some buckets of a snapshot, or None if they hold none."""
        wanted = manifest["buckets"] if buckets is None else {b: manifest["buckets"][b] for b in buckets if b in manifest["buckets"]}
        if not wanted:
            return None
        return self.spark.read.parquet(*(f"{self.path}/data/{commit}/bucket={b}" for b, commit in sorted(wanted.items())))

    def load(self, version: int | None = None) -> DataFrame | None:
        """S12, S15. The facts of the newest (or a given) version; None without one. Rows without path, mtime or size are no facts."""
        manifest = self.current() if version is None else self.manifest(version)
        facts = self._read(manifest) if manifest else None
        return None if facts is None else facts.where("path is not null and mtime is not null and size is not null and signature is not null")

    # --- writing ---

    def _bucket(self, buckets: int):
        return F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int")

    def refresh(self, files: DataFrame, live: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """Facts of the files in scope (stored ones reused, the rest parsed) and counts reused, refreshed, dropped; writes nothing.

        live: all files there are. A stored note is dropped if it is not among them, not if it only left the scope.
        """
        stored, signature = self.load(), F.lit(self.config.signature())
        live = files if live is None else live
        if stored is None:
            facts = parse(files, self.config).withColumn("signature", signature)
            return facts, facts.agg(F.lit(0).cast("long").alias("reused"), F.count("*").alias("refreshed"), F.lit(0).cast("long").alias("dropped"))
        keys = ["path", "mtime", "size"]
        valid = stored.where(F.col("signature") == signature)
        reused = valid.join(files.select(*keys), keys, "left_semi")
        fresh = parse(files.join(valid.select(*keys), keys, "left_anti"), self.config).withColumn("signature", signature)
        gone = stored.join(live.select("path"), "path", "left_anti")
        kinds = [rows.select(F.lit(k).alias("kind")) for k, rows in (("reused", reused), ("refreshed", fresh), ("dropped", gone))]
        counts = kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("reused", "refreshed", "dropped")))
        return reused.unionByName(fresh), counts

    def update(self, files: DataFrame, live: DataFrame | None = None) -> tuple[DataFrame, dict]:
        """refresh() and commit(): the facts of the files in scope as the new version holds them, and the counts."""
        stored, signature = self.load(), F.lit(self.config.signature())
        keys = ["path", "mtime", "size"]
        fresh, gone = files, None
        if stored is not None:
            fresh = files.join(stored.where(F.col("signature") == signature).select(*keys), keys, "left_anti")
            gone = stored.select("path").join((files if live is None else live).select("path"), "path", "left_anti")
        counts = self.commit(parse(fresh, self.config).withColumn("signature", signature), gone)
        facts = self.load()
        facts = parse(files.where("false"), self.config).withColumn("signature", signature) if facts is None else facts.join(files.select("path"), "path", "left_semi")
        return facts, counts | {"reused": facts.count() - counts["refreshed"]}

    def commit(self, facts: DataFrame, gone: DataFrame | None = None, newest: bool = False, source: tuple[str, int] | None = None) -> dict:
        """Put facts (one a path) in, take the paths `gone` out, and publish the next version; counts refreshed, dropped, version, buckets.

        newest: a fact replaces a stored one only if its (mtime, size) is larger, so that late versions change nothing.
        source: a stream's name and batch; a batch that is already in a version is not put in again.
        """
        manifest = self.current()
        buckets = manifest["of"] if manifest else self.buckets
        sources = dict(manifest["sources"]) if manifest else {}
        version = max([-1, *self.versions()]) + 1
        if source and sources.get(source[0], -1) >= source[1]:
            return {"refreshed": 0, "dropped": 0, "version": manifest["version"], "buckets": 0}
        commit = uuid.uuid4().hex
        staged = f"{self.path}/staged/{commit}"
        marked = facts.withColumn("bucket", self._bucket(buckets)).withColumn("taken", F.lit(False))
        if gone is not None:
            out = gone.select("path").withColumn("bucket", self._bucket(buckets)).withColumn("taken", F.lit(True))
            marked = marked.unionByName(out, allowMissingColumns=True)
        marked.write.parquet(staged)
        changes = self.spark.read.schema(marked.schema).parquet(staged)
        touched = [r.bucket for r in changes.select("bucket").distinct().collect()]  # at most as many as there are buckets
        old = self._read(manifest, list(map(str, touched))) if manifest else None
        new = changes.where("not taken").drop("taken")
        if old is not None:
            kept = old.withColumn("bucket", self._bucket(buckets))
            if newest:
                late = new.select("path", "mtime", "size").join(kept.select("path", F.struct("mtime", "size").alias("held")), "path").where(F.struct("mtime", "size") <= F.col("held")).select("path")
                new = new.join(late, "path", "left_anti")
                changes = changes.join(late, "path", "left_anti")
            new = kept.join(changes.select("path").distinct(), "path", "left_anti").unionByName(new, allowMissingColumns=True)
        counts = changes.agg(F.count_if(~F.col("taken")).alias("refreshed"), F.count_if("taken").alias("dropped")).first()
        if touched:
            new.repartition(F.col("bucket")).write.partitionBy("bucket").parquet(f"{self.path}/data/{commit}")
        folder = self._fs.Path(f"{self.path}/data/{commit}")
        names = [s.getPath().getName() for s in self._files.listStatus(folder)] if touched else []
        written = {n.removeprefix("bucket="): commit for n in names if n.startswith("bucket=")}
        held = {b: c for b, c in (manifest["buckets"] if manifest else {}).items() if int(b) not in set(touched)}
        if source:
            sources[source[0]] = source[1]
        self._publish({"version": version, "of": buckets, "buckets": held | written, "sources": sources})
        self._files.delete(self._fs.Path(staged), True)
        return {"refreshed": counts.refreshed, "dropped": counts.dropped, "version": version, "buckets": len(touched)}

    def vacuum(self, keep: int = 1) -> int:
        """Delete older versions than the newest `keep` whole ones, and every commit that none of these names; how many commits went.

        Nothing else may be writing: a commit that is under way has no manifest yet.
        """
        whole = [m for m in map(self.manifest, self.versions()) if m][-keep:]
        named = {c for m in whole for c in m["buckets"].values()}
        last = {m["version"] for m in whole}
        for version in self.versions():
            if version not in last:
                self._files.delete(self._fs.Path(f"{self.path}/manifest/{version:010d}.json"), False)
        gone = 0
        folder = self._fs.Path(f"{self.path}/data")
        for status in self._files.listStatus(folder) if self._files.exists(folder) else ():
            if status.getPath().getName() not in named:
                self._files.delete(status.getPath(), True)
                gone += 1
        self._files.delete(self._fs.Path(f"{self.path}/staged"), True)
        return gone

    def clear(self) -> None:
        """S17."""
        self._files.delete(self._fs.Path(self.path), True)
