"""Shared plumbing: tables, materialisation in the shared folder, text columns as numpy bytes."""

from __future__ import annotations

import ctypes
import hashlib
import os
import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task works on at once; a single longer text is a slice of its own.
SLICE_BYTES = 1_000_000
#: Bytes of a batch that Spark hands to Python, at most (a longer row is a batch of its own).
BATCH_BYTES = 8_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a local one only where that is unset in local mode (tests)."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        known = f"file://{tempfile.gettempdir()}/corpuslens-shared"
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write a table into the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._corpuslens_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of materialize() that nothing will read again."""
    path = getattr(df, "_corpuslens_path", None)
    if path:
        spark = df.sparkSession
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def give_back() -> None:
    """Hand freed memory back to the system: else a worker keeps the most that any of its tasks has needed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim is not None:
        trim(0)


def map_arrow(df: DataFrame, run: Callable, schema, release: bool = False) -> DataFrame:
    """mapInArrow with batches of bounded size: the session's bound on their bytes is lowered where it is higher.

    Workers serve the tasks of all stages: with `release` each task gives back the memory that it has freed. Steps
    that keep their words for the next task and come last (packing) go without, as that costs them CPU time.
    """
    conf = df.sparkSession.conf
    known = conf.get("spark.sql.execution.arrow.maxBytesPerBatch").removesuffix("b")
    if not known.isdigit() or not 0 < int(known) <= BATCH_BYTES:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(task if release else run, schema)


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores behind it as long as a column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fit_in_task(rows: DataFrame, fit: Callable[[list[tuple]], Any]) -> Any:
    """fit(sorted distinct rows) in one task: the sample, whose bound the caller states, never enters the driver."""

    def run(batches):
        found = {row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)}
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(sorted(found)))], pa.binary())], ["model"])

    made = map_arrow(rows.repartition(1), run, "model binary", release=True).first()
    return pickle.loads(made[0]) if made else fit([])


def held_out(doc_id: str = "doc_id"):
    """True for the fifth of the documents that no model learns from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary column and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of about `most` bytes of text each."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def joined(data: np.ndarray, offsets: np.ndarray, first: int, last: int, gap: bytes = b"\n") -> tuple[np.ndarray, np.ndarray]:
    """Texts first..last-1, each followed by `gap`; and the starts of the texts, with the total length last."""
    lengths = np.diff(offsets[first : last + 1])
    starts = np.zeros(last - first + 1, np.int64)
    np.cumsum(lengths + len(gap), out=starts[1:])
    out = np.empty(int(starts[-1]), np.uint8)
    for k in range(last - first):
        a, b = starts[k], starts[k + 1] - len(gap)
        out[a:b] = data[offsets[first + k] : offsets[first + k + 1]]
    for j, byte in enumerate(gap):
        out[starts[1:] - len(gap) + j] = byte
    return out, starts


_POWERS: list[np.ndarray] = []
_BASE = 0x9E3779B97F4A7C15 | 1
_UNBASE = pow(_BASE, -1, 1 << 64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        out = []
        for base in (_BASE, _UNBASE):
            p = np.full(max(n, SLICE_BYTES + 200_000), base, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        _POWERS[:] = out
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class SpanHash:
    """64-bit hashes of any spans of a byte array: polynomial prefix sums modulo 2**64, finalised."""

    def __init__(self, data: np.ndarray):
        self.up, self.down = _powers(len(data) + 1)
        scrambled = _SCRAMBLE[data]
        scrambled *= self.up[: len(data)]
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(scrambled, out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = self.sums[ends] - self.sums[starts]
        h *= self.down[starts]
        h += (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return mix(h)


_SCRAMBLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def word_spans(data: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that `in_word` (256 booleans) marks; data must end outside a word."""
    inside = in_word[data]
    change = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        change = np.concatenate([[0], change])
    return change[0::2], change[1::2]


def equal_spans(data: np.ndarray, starts: np.ndarray, others: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether the span at each start has the bytes of the span of the same length at the other place."""
    out = np.ones(len(starts), bool)
    edge = np.cumsum(lengths)
    for first, last in slices(np.concatenate([[0], edge])):
        size = lengths[first:last]
        begin = np.cumsum(size) - size
        here = np.arange(int(size.sum())) + np.repeat(starts[first:last] - begin, size)
        there = here + np.repeat(others[first:last] - starts[first:last], size)
        unlike = np.flatnonzero(data[here] != data[there])
        out[first + np.searchsorted(begin + size, unlike, side="right")] = False
    return out


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct spans as bytes, and for each span the number of its distinct form.

    A hash only brings spans together; their bytes decide which of them are equal.
    """
    if not len(starts):
        return [], np.empty(0, np.int64)
    hashes = SpanHash(data)(starts, ends)
    _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    inverse = inverse.ravel()
    whole = data.tobytes()
    words = [whole[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
    own = first[inverse]
    size = ends - starts
    same = size == size[own]
    held = np.flatnonzero(same)
    same[held] = equal_spans(data, starts[held], starts[own[held]], size[held])
    if not same.all():  # one hash of different spans: these get numbers of their own
        more: dict[bytes, int] = {}
        for k in np.flatnonzero(~same).tolist():
            inverse[k] = len(words) + more.setdefault(whole[starts[k] : ends[k]], len(more))
        words += more
    return words, inverse


class Recent:
    """A dictionary of bounded size that forgets what has not been asked for of late: two generations, each of `most` entries."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def get(self, key):
        """The value, or None; what the old generation knows moves to the young one."""
        value = self.young.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        self.young[key] = value


_SALT = b"corpuslens-spans"


def digests(spans: list[bytes]) -> np.ndarray:
    """A 64-bit salted BLAKE2 digest of each span."""
    blake = hashlib.blake2b
    return np.frombuffer(b"".join([blake(x, digest_size=8, salt=_SALT).digest() for x in spans]), np.uint64)
