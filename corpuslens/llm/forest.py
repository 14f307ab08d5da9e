"""Approximate nearest neighbours: hash-prefix forest (operator 2).

Every tree has its own random hyperplanes; a vector's string in a tree is the row of sides it lies on, kept as
`DEPTH` bits. A shard of the index (the vectors of a task, in blocks) holds the strings of each tree in a sorted
array. A query descends by binary search to the entries that share its longest prefix, in all trees; then all
trees ascend together, one bit at a time, until together they offer at least `share` of the shard. These
candidates are measured exactly, and the best of all shards are merged. Every vector is indexed in every tree.

The share is what recall needs where neighbours hardly stand out (random vectors); see the README for figures.

Null, zero and non-finite vectors take no part, nor do vectors of another length than the query's. Equal
vectors have equal strings, so ties are found together; rows with the query's own id are the query's own.
Of a repeated query id the smallest vector counts; repeated candidates are each a candidate. Queries with fewer than
k candidates return all; an empty table gives an empty result. Other columns are left aside, so their names cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import map_arrow
from corpuslens.llm.vectors import query_blocks, ranked, shards, union_all

TREES, DEPTH, SHARE, LEAST = 64, 24, 0.45, 64


def planes(size: int, trees: int = TREES, depth: int = DEPTH, seed: int = 20) -> np.ndarray:
    """Hyperplanes [size, trees * depth], the same for the same arguments."""
    return np.random.default_rng(seed + size).normal(size=(size, trees * depth)).astype(np.float32)


def strings(cells: np.ndarray, hyperplanes: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """[trees, n] hash strings as integers, the first hyperplane in the highest bit."""
    out = np.empty((hyperplanes.shape[1] // depth, len(cells)), np.uint32)
    unit = (cells / np.linalg.norm(cells, axis=1, keepdims=True)).astype(np.float32)
    for t in range(len(out)):
        sides = unit @ hyperplanes[:, t * depth : (t + 1) * depth] > 0
        out[t] = sides @ (np.uint32(1) << np.arange(depth - 1, -1, -1, dtype=np.uint32))
    return out


class Forest:
    """The sorted arrays of one shard."""

    def __init__(self, cells: np.ndarray, hyperplanes: np.ndarray, depth: int = DEPTH):
        codes = strings(cells, hyperplanes, depth)
        self.depth, self.n = depth, len(cells)
        self.order = np.argsort(codes, axis=1, kind="stable")
        self.sorted = np.take_along_axis(codes, self.order, axis=1)

    def ranges(self, codes: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """[trees, queries] bounds of the entries that share the first `level` bits."""
        shift = np.uint64(self.depth - level)
        low = (codes.astype(np.uint64) >> shift) << shift
        high = low + (np.uint64(1) << shift)
        a, b = np.empty(codes.shape, np.int64), np.empty(codes.shape, np.int64)
        for t in range(len(codes)):
            own = self.sorted[t].astype(np.uint64)
            a[t], b[t] = np.searchsorted(own, low[t]), np.searchsorted(own, high[t])
        return a, b

    def candidates(self, codes: np.ndarray, wanted: int):
        """For each query the entries of the trees' nodes, all trees at one level: the deepest that offers `wanted`."""
        wanted = min(wanted, self.n)
        done = np.zeros(codes.shape[1], bool)
        for level in range(self.depth, -1, -1):
            left = np.flatnonzero(~done)
            if not len(left):
                return
            a, b = self.ranges(codes[:, left], level)
            enough = np.flatnonzero((b - a).sum(axis=0) >= wanted)  # with repeats: no fewer than the distinct ones
            for j in enough.tolist():
                mark = np.zeros(self.n, bool)
                for t, (x, y) in enumerate(zip(a[:, j].tolist(), b[:, j].tolist(), strict=True)):
                    mark[self.order[t, x:y]] = True
                found = np.flatnonzero(mark)
                if len(found) >= wanted:
                    done[left[j]] = True
                    yield int(left[j]), found


def measure(query: np.ndarray, cells: np.ndarray, lengths: np.ndarray, ids: np.ndarray, k: int):
    """The k nearest by cosine in double precision: a product picks those near the top, sums decide."""
    length = np.sqrt((query * query).sum())
    rough = cells @ query / (lengths * length)
    if len(rough) > k:
        edge = np.partition(rough, len(rough) - k)[len(rough) - k]
        near = np.flatnonzero(rough >= edge - 1e-9)
    else:
        near = np.arange(len(rough))
    score = (cells[near] * query).sum(axis=1) / (lengths[near] * length)
    best = np.lexsort((ids[near], -score))[:k]
    return near[best], score[best]


def nearest(candidates: DataFrame, queries: DataFrame, k: int = 5, share: float = SHARE, key: str = "vec_id", vector: str = "embedding", trees: int = TREES) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest candidates that the forest finds."""
    spark = candidates.sparkSession
    rows = candidates.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    parts = []
    for block in query_blocks(queries.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("vector")), False):
        shared = spark.sparkContext.broadcast(block)  # a block of bounded size

        def run(batches, shared=shared):
            block = shared.value
            made: dict[int, tuple] = {}
            for ids, cells in shards(batches, False):
                size = cells.shape[1]
                if size not in block:
                    continue
                query_ids, queries = block[size]
                if size not in made:
                    made[size] = (planes(size, trees), strings(queries, planes(size, trees)))
                hyperplanes, codes = made[size]
                forest = Forest(cells, hyperplanes)
                lengths = np.sqrt((cells * cells).sum(axis=1))
                found_q, found_v, found_s = [], [], []
                for q, found in forest.candidates(codes, max(LEAST, int(np.ceil(share * len(ids))))):
                    found = found[ids[found] != query_ids[q]]
                    at, score = measure(queries[q], cells[found], lengths[found], ids[found], k)
                    found_q.append(np.full(len(at), query_ids[q]))
                    found_v.append(ids[found[at]])
                    found_s.append(score)
                if found_q:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (found_q, found_v, found_s)], ["query_id", "vec_id", "score"])

        parts.append(map_arrow(rows, run, "query_id long, vec_id long, score double"))
    return ranked(union_all(parts, lambda: spark.createDataFrame([], "query_id long, vec_id long, score double")), k)
