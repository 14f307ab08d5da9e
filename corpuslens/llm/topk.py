"""Exact top-k by integer inner product: distributed histogram selection (operator 9).

Components x become floor(scale * x). Queries are taken in blocks of bounded size; for a block every candidate
is scored in every pass. Passes count scores into `BINS` equal bins of an interval for each query; the counts of
all tasks are added up, the bin that holds the kth largest score becomes the next interval, and so on until bins
are one unit wide: then the kth score is known exactly. A last pass keeps what is above it, and at it the
smallest ids, of which a task needs k at most, so that it can cut them before anything is shuffled.

Rows with a null id or vector, or null or non-finite components take no part; the zero vector does. Every finite
component takes part: products beyond 2**53 are made of Python's integers, and scores beyond a long's range stand at
its ends, +-(2**63 - 1), where the smaller id comes first. Vectors of another length than the query's are no candidates.
Rows with the query's own id are the query's own; of a repeated query id the smallest vector counts. Repeated candidates are
each a candidate. Queries with fewer than k candidates return all. Other columns are left aside, so their names cannot
clash; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import map_arrow
from corpuslens.llm.vectors import query_blocks, ranked, shards, union_all

BINS = 64
#: Scores that a task holds at once.
CELLS = 2_000_000


#: Scores beyond the range of a long stand at its ends.
MOST = (1 << 63) - 1


def quantise(cells: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x), as doubles; what is beyond the largest double stands there."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(cells * scale), -np.finfo(float).max, np.finfo(float).max)


def _scores(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Integer inner products; doubles are exact below 2**53, beyond that Python's integers."""
    with np.errstate(over="ignore"):
        bound = float(np.abs(queries).sum(axis=1).max(initial=0)) * float(np.abs(candidates).max(initial=0))
    if bound < 2.0**53:
        return (queries @ candidates.T).astype(np.int64)
    whole = [np.array([[int(x) for x in row] for row in cells.tolist()], object).reshape(cells.shape) for cells in (queries, candidates)]
    return np.clip(whole[0] @ whole[1].T, -MOST, MOST).astype(np.int64)


def _blocks(queries, candidates, own_ids, ids):
    """Score blocks, which cells are a query's own row, and the candidates' ids."""
    width = max(1, CELLS // max(1, len(queries)))
    for a in range(0, len(candidates), width):
        score = _scores(queries, candidates[a : a + width])
        yield score, own_ids[:, None] == ids[None, a : a + width], ids[a : a + width]


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best candidates."""
    spark = candidates.sparkSession
    rows = candidates.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    parts = []
    for block in query_blocks(queries.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("vector")), True):
        for size, (query_ids, cells) in block.items():
            parts.append(_select(spark, rows, size, query_ids, quantise(cells, scale), k, scale))
    return ranked(union_all(parts, lambda: spark.createDataFrame([], "query_id long, vec_id long, score long")), k)


def _apart(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """high - low of longs, exact beyond their range too; of no meaning where high < low."""
    return high.astype(np.int64).view(np.uint64) - np.ascontiguousarray(low).view(np.uint64)


def _select(spark, rows: DataFrame, size: int, query_ids: np.ndarray, queries: np.ndarray, k: int, scale: float) -> DataFrame:
    shared = spark.sparkContext.broadcast((query_ids, queries))  # a block of bounded size

    def largest(batches):
        most = 0.0
        for _, cells in shards(batches, True):
            if cells.shape[1] == size:
                most = max(most, float(np.abs(quantise(cells, scale)).max()))
        yield pa.RecordBatch.from_arrays([pa.array([most])], ["most"])

    most = int(map_arrow(rows, largest, "most double").agg(F.max("most")).first()[0] or 0.0)
    # No score is beyond the query's sum of sizes times the largest component.
    reach = np.array([min(MOST - 1, most * sum(abs(int(x)) for x in row)) + 1 for row in queries.tolist()], np.int64)
    low, width = -reach, np.array([-(-(2 * r + 1) // BINS) for r in reach.tolist()], np.int64)
    last = reach
    above = np.zeros(len(query_ids), np.int64)
    while True:
        counts = _count(rows, shared, size, low, last, width, scale)
        # From the highest bin down: the bin that holds the kth largest score, or the lowest of all.
        down = above[:, None] + np.cumsum(counts[:, ::-1], axis=1)
        bin_down = np.where((down >= k).any(axis=1), (down >= k).argmax(axis=1), BINS - 1)
        above = np.where(bin_down > 0, np.take_along_axis(down, np.maximum(bin_down - 1, 0)[:, None], axis=1)[:, 0], above)
        low = low + (BINS - 1 - bin_down) * width
        last = low + np.minimum(_apart(last, low), (width - 1).astype(np.uint64)).astype(np.int64)  # what lies higher is counted in `above`
        if (width == 1).all():
            break
        width = np.maximum(1, -(-width // BINS))
    return _keep(rows, shared, size, low, k, scale)


def _count(rows: DataFrame, shared, size: int, low: np.ndarray, last: np.ndarray, width: np.ndarray, scale: float) -> np.ndarray:
    """Scores by query and bin, over all candidates."""

    def run(batches):
        query_ids, queries = shared.value
        total = np.zeros((len(query_ids), BINS), np.int64)
        base = np.arange(len(query_ids), dtype=np.int64)[:, None] * BINS
        for ids, cells in shards(batches, True):
            if cells.shape[1] != size:
                continue
            for score, own, _ in _blocks(queries, quantise(cells, scale), query_ids, ids):
                good = (score >= low[:, None]) & (score <= last[:, None]) & ~own
                at = _apart(score, low[:, None]) // width[:, None].astype(np.uint64)
                total += np.bincount((base + at.astype(np.int64))[good], minlength=total.size).reshape(total.shape)
        used = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *(pa.array(total[used, j]) for j in range(BINS))], ["q", *(f"c{j}" for j in range(BINS))])

    schema = ", ".join(["q int", *(f"c{j} long" for j in range(BINS))])
    summed = map_arrow(rows, run, schema).groupBy("q").agg(*(F.sum(f"c{j}").alias(f"c{j}") for j in range(BINS)))
    out = np.zeros((len(low), BINS), np.int64)
    found = summed.toArrow()
    if found.num_rows:
        out[found["q"].to_numpy()] = np.column_stack([found[f"c{j}"].to_numpy() for j in range(BINS)])
    return out


def _keep(rows: DataFrame, shared, size: int, kth: np.ndarray, k: int, scale: float) -> DataFrame:
    """All scores above the kth and, at it, each task's smallest ids."""

    def run(batches):
        query_ids, queries = shared.value
        for ids, cells in shards(batches, True):
            if cells.shape[1] != size:
                continue
            for score, own, part in _blocks(queries, quantise(cells, scale), query_ids, ids):
                q, c = np.nonzero((score >= kth[:, None]) & ~own)
                s = score[q, c]
                order = np.lexsort((part[c], -s, q))
                q, c, s = q[order], c[order], s[order]
                turn = np.arange(len(q)) - np.searchsorted(q, q)
                few = turn < k
                yield pa.RecordBatch.from_arrays([pa.array(query_ids[q[few]]), pa.array(part[c[few]]), pa.array(s[few])], ["query_id", "vec_id", "score"])

    return map_arrow(rows, run, "query_id long, vec_id long, score long")
