"""Vector tables in numpy blocks, for the two nearest-neighbour operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries that are held (and broadcast) at once: a fixed bound, whatever the table.
QUERY_BLOCK = 4096
#: Candidate vectors that a task holds at once.
SHARD = 16_384


def vector_batches(batch: pa.RecordBatch, zero_too: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and double vectors of the usable rows, one block for each length of vector.

    Unusable: null id or vector, null or non-finite components, no component; the zero vector unless zero_too.
    """
    ids, lists = batch.column(0), batch.column(1)
    ok = np.logical_and(ids.is_valid().to_numpy(zero_copy_only=False), lists.is_valid().to_numpy(zero_copy_only=False))
    size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    for n in np.unique(size[ok]).tolist():
        rows = np.flatnonzero(ok & (size == n))
        if not n:
            continue
        part = lists.take(pa.array(rows))
        flat = part.flatten()
        cells = flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(-1, n)
        good = np.isfinite(cells).all(axis=1)
        if not zero_too:
            good &= (cells != 0).any(axis=1)
        if good.any():
            yield ids.take(pa.array(rows[good])).to_numpy(zero_copy_only=False).astype(np.int64), cells[good]


def shards(batches, zero_too: bool, most: int = SHARD) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A task's vectors in blocks of about `most`, of one length each."""
    held: dict[int, list] = {}
    for batch in batches:
        for ids, cells in vector_batches(batch, zero_too):
            own = held.setdefault(cells.shape[1], [])
            own.append((ids, cells))
            if sum(len(x) for x, _ in own) >= most:
                yield np.concatenate([x for x, _ in own]), np.concatenate([y for _, y in own])
                held[cells.shape[1]] = []
    for own in held.values():
        if own:
            yield np.concatenate([x for x, _ in own]), np.concatenate([y for _, y in own])


def query_blocks(queries: DataFrame, zero_too: bool) -> Iterator[dict[int, tuple[np.ndarray, np.ndarray]]]:
    """The usable queries, at most QUERY_BLOCK at a time: by length of vector, ids and vectors.

    Of a repeated id the smallest usable vector counts, entry by entry from the first.
    """
    key, vector = queries.columns
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col(key).isNotNull() & F.col(vector).isNotNull() & ~bad
    if not zero_too:
        usable &= F.exists(vector, lambda x: x != 0)
    queries = queries.where(usable).groupBy(key).agg(F.min(vector).alias(vector))
    n = queries.count()
    blocks = max(1, -(-n // (QUERY_BLOCK // 2)))
    for k in range(blocks):
        own = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == k)
        batch = own.toArrow()
        out: dict[int, list] = {}
        for part in batch.combine_chunks().to_batches():
            for ids, cells in vector_batches(part, zero_too):
                out.setdefault(cells.shape[1], []).append((ids, cells))
        yield {size: (np.concatenate([a for a, _ in own]), np.concatenate([b for _, b in own])) for size, own in out.items()}


def ranked(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k best found of each query, ties to the smaller vec_id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.select("query_id", "vec_id", "score", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def union_all(parts: list[DataFrame], empty: Callable[[], DataFrame]) -> DataFrame:
    """All rows of the parts."""
    if not parts:
        return empty()
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
