"""Extension: a feature store that follows a stream of note files.

Files arrive in folders of their own below a root, <root>/<arrival>/<path of the note>, so that a changed note is a new
file (a file stream reads each file once). Every micro-batch keeps the newest version of each note it brings, parses it
and puts it into the store, where a version replaces only an older one: late files change nothing, or fill in a note
that was not there yet. The batch's number is part of the version that it makes, so a batch that is tried again after a
failure is put in once. Whatever the order of arrival, the store holds what a rebuild from all files would.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpuslens.sources.notes import below, parse
from corpuslens.sources.store import ConflictError, FeatureStore
from corpuslens.streaming.activity import windowed_activity

ATTEMPTS = 5
_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def note_stream(spark: SparkSession, root: str, most_files: int = 10_000, late: str = "3650d") -> DataFrame:
    """path, content, ctime, mtime, size of the .md files that arrive; at most so many a micro-batch.

    late: a file whose time lies further behind the newest one's is not read; the source remembers the names within.
    """
    read = spark.readStream.schema(_SCHEMA).format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", True)
    files = read.option("maxFilesPerTrigger", most_files).option("maxFileAge", late).load(root)
    path = below(spark, root, F.col("path"), 1)
    return files.select(path.alias("path"), F.col("content").cast("string").alias("content"), F.lit(None).cast("timestamp").alias("ctime"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))


def newest(files: DataFrame) -> DataFrame:
    """The version of each note with the largest time and size."""
    best = F.max_by(F.struct("content", "ctime", "mtime", "size"), F.struct("mtime", "size"))
    return files.groupBy("path").agg(best.alias("one")).select("path", "one.*")


def follow(files: DataFrame, store: FeatureStore, checkpoint: str, name: str = "notes", **trigger) -> StreamingQuery:
    """Keep the store up to date with a stream of files; trigger: as DataStreamWriter.trigger takes it (availableNow by default)."""

    def put(batch: DataFrame, number: int) -> None:
        facts = parse(newest(batch), store.config).withColumn("signature", F.lit(store.config.signature()))
        for attempt in range(ATTEMPTS):
            try:
                store.commit(facts, newest=True, source=(name, number))
                return
            except ConflictError:  # another writer was faster: its version is the ground now
                if attempt == ATTEMPTS - 1:
                    raise

    writer = files.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(put)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def edit_activity(files: DataFrame, late: str = "7 days", width: str = "1 day") -> DataFrame:
    """Versions of notes by the day of their file time. A stream's watermark closes a day `late` after it; what comes later is not counted."""
    return windowed_activity(files, "mtime", late, width)
