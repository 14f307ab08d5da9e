"""Ranked lexical search through range-maximum tables over posting lists (operator 12).

One pass over the texts keeps, for each document, its number of terms and the counts of those terms that any item has;
Spark adds up the corpus' statistics from that table. A second pass takes documents in shards of about `POSTINGS`
postings. In a shard every posting has its impact (the part of a score that it gives), and one table answers, for any
range of a term's posting list, where its largest impact is (sparse table of positions: two overlapping powers of two).

An item's search keeps open intervals of documents, each with a bound: the sum over its terms of the largest impact in
the interval. Intervals are taken best first. A long one is split at the document of the largest impact in it, which is
scored; a short one is scored whole. What cannot reach the item's kth score any more is dropped. All items of a block
search a shard side by side, so that each step is a few numpy operations; a task carries the kth scores on from shard
to shard. Tasks return k documents an item at most, and Spark ranks those.

Items are read in blocks of at most `ITEM_BYTES` of text, which go to every task; a block reads the texts once.

Null texts and texts without a term take no part in the statistics and are never found. Every row of docs is a document
of its own, so repeated rows are all counted and ranked; equal scores go by id, null ids last. Rows of one item id are
one item with the terms of all its distinct texts; items without a term find nothing. Texts of any length are read
whole. Other columns are left aside, so their names cannot clash. Empty tables give an empty result.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.llm.common import column_bytes, discard, distinct_spans, joined, map_arrow, materialize, slices, word_spans

#: Postings of a shard; a longer document is a shard of its own.
POSTINGS = 1_000_000
#: Text of a block of items, at most (a longer item is a block of its own).
ITEM_BYTES = 4_000_000
#: Documents of an interval that is scored whole, and intervals of an item that are taken at once.
LEAF, AT_ONCE = 64, 8
#: Postings that are scored, and pairs of interval and term that are bounded, at once.
CELLS = 2_000_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TERM = np.zeros(256, bool)
_TERM[48:58] = _TERM[65:91] = _TERM[97:123] = _TERM[128:] = True
_NO_ID = np.iinfo(np.int64).max


def terms_of(data: np.ndarray, offsets: np.ndarray, first: int, last: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Texts first..last-1: distinct terms, the number of each term in order, and the text that it stands in."""
    buffer, starts = joined(data, offsets, first, last)
    buffer = _LOWER[buffer]
    a, b = word_spans(buffer, _TERM)
    words, number = distinct_spans(buffer, a, b)
    return words, number, np.searchsorted(starts, a, side="right") - 1


class Items:
    """A block of items: the vocabulary, and each item's distinct terms with their repeats."""

    def __init__(self, texts: dict):
        self.ids = sorted(texts, key=lambda x: (x is None, x))
        self.vocabulary: dict[bytes, int] = {}
        start, term, times = [0], [], []
        for item in self.ids:
            own: dict[int, int] = {}
            for text in sorted(texts[item]):
                data = np.frombuffer(text.encode(), np.uint8)
                words, number, _ = terms_of(data, np.array([0, len(data)]), 0, 1)
                for word, many in zip(words, np.bincount(number, minlength=len(words)).tolist(), strict=True):
                    k = self.vocabulary.setdefault(word, len(self.vocabulary))
                    own[k] = own.get(k, 0) + many
            term += own.keys()
            times += own.values()
            start.append(len(term))
        self.start, self.term, self.times = np.array(start), np.array(term, np.int64), np.array(times, np.int64)


def _counts(docs: DataFrame, items, key: str, text: str) -> DataFrame:
    """key, n, terms, times: of every document with a term its number of terms and the counts of the items' terms."""

    def run(batches):
        vocabulary = items.value.vocabulary
        width = max(1, len(vocabulary))
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            for first, last in slices(offsets):
                words, number, own = terms_of(data, offsets, first, last)
                n = np.bincount(own, minlength=last - first)
                known = np.fromiter((vocabulary.get(w, -1) for w in words), np.int64, len(words))[number]
                held = known >= 0
                cells, times = np.unique(own[held] * width + known[held], return_counts=True)
                doc, term = cells // width, cells % width
                rows = np.flatnonzero(n)
                edge = pa.array(np.append(np.searchsorted(doc, rows), len(doc)).astype(np.int32))
                ids = batch.column(0).slice(first, last - first).take(pa.array(rows))
                lists = [pa.ListArray.from_arrays(edge, pa.array(x.astype(np.int32))) for x in (term, times)]
                yield pa.RecordBatch.from_arrays([ids, pa.array(n[rows]), *lists], ["doc_id", "n", "terms", "times"])

    return map_arrow(docs.select(F.col(key).cast("long").alias("doc_id"), text), run, "doc_id long, n long, terms array<int>, times array<int>")


class Shard:
    """Posting lists of some documents, in one array by term and document, with positions of largest impacts."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, doc: np.ndarray, term: np.ndarray, times: np.ndarray, weight: np.ndarray, total: tuple[int, int]):
        many, length = total
        order = np.argsort(ids, kind="stable")
        self.ids, self.size = ids[order], len(ids)
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        bound = 25 * many * int(n.max(initial=0))
        share = (25 * many * n) // length if bound < 1 << 63 else np.array([25 * many * int(x) // length for x in n.tolist()], np.int64)
        m = (75 + share)[doc]
        key = term * self.size + place[doc]
        by_key = np.argsort(key)
        self.key = key[by_key]
        tf = times[by_key].astype(np.int64)
        self.impact = weight[term[by_key]] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[by_key]))
        longest = int(np.bincount(term, minlength=1).max(initial=0))
        level = np.arange(len(key), dtype=np.int32)
        self.levels = [level]
        step = 1
        while 2 * step <= longest:
            a, b = level[:-step], level[step:]
            level = np.append(np.where(self.impact[a] >= self.impact[b], a, b), level[len(level) - step :]).astype(np.int32)
            self.levels.append(level)
            step *= 2
        self.levels = np.stack(self.levels)

    def ranges(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The postings of the terms in the documents low..high-1."""
        base = term * self.size
        return np.searchsorted(self.key, base + low), np.searchsorted(self.key, base + high)

    def largest(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The posting of the largest impact among a..b-1 (not empty)."""
        level = np.frexp((b - a).astype(float))[1] - 1
        one, two = self.levels[level, a], self.levels[level, b - (1 << level)]
        return np.where(self.impact[one] >= self.impact[two], one, two)


def _expand(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of these sizes: the group of every member, and its turn in it."""
    group = np.repeat(np.arange(len(count)), count)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(count) - count, count)


def _in_parts(cost: np.ndarray, most: int):
    """Runs of about `most` of cost."""
    edge = np.concatenate([[0], np.cumsum(cost)])
    return slices(edge, most)


class Search:
    """The best k documents of every item of a block, over the shards of a task."""

    def __init__(self, items: Items, weight: np.ndarray, k: int):
        self.items, self.k = items, k
        useful = weight[items.term] > 0
        owner = np.repeat(np.arange(len(items.ids)), np.diff(items.start))[useful]
        self.term, self.times = items.term[useful], items.times[useful]
        self.start = np.searchsorted(owner, np.arange(len(items.ids) + 1))
        self.most = float((weight[self.term] * self.times.astype(float) * 1e6).sum())
        none = np.empty(0, np.int64)
        self.top = (none, none, none)  # item, score, id: by item, best first
        self.kth, self.kth_id = np.ones(len(items.ids), np.int64), np.full(len(items.ids), _NO_ID)
        self.scored = 0

    def _terms(self, item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each given item its terms: position in the list of items, term, repeats."""
        group, turn = _expand(self.start[item + 1] - self.start[item])
        at = self.start[item][group] + turn
        return group, self.term[at], self.times[at]

    def _bounds(self, shard: Shard, item: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bound of each interval, and the document of its largest impact."""
        bound, split = np.zeros(len(item), np.int64), low.copy()
        for x, y in _in_parts(self.start[item + 1] - self.start[item], CELLS):
            group, term, times = self._terms(item[x:y])
            a, b = shard.ranges(term, low[x:y][group], high[x:y][group])
            full = np.flatnonzero(a < b)
            if not len(full):
                continue
            group, at = group[full], shard.largest(a[full], b[full])
            value = shard.impact[at] * times[full]
            head = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            bound[x + group[head]] = np.add.reduceat(value, head)
            best = np.lexsort((value, group))[np.append(head[1:], len(group)) - 1]
            split[x + group[best]] = shard.key[at[best]] % shard.size
        return bound, split

    def _score(self, shard: Shard, item: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Score whole intervals and keep what belongs to the best."""
        width = high - low
        for x, y in _in_parts((self.start[item + 1] - self.start[item]) * width, CELLS):
            group, term, times = self._terms(item[x:y])
            a, b = shard.ranges(term, low[x:y][group], high[x:y][group])
            pair, turn = _expand(b - a)
            at = a[pair] + turn
            first = np.cumsum(width[x:y]) - width[x:y]
            cell = first[group[pair]] + shard.key[at] % shard.size - low[x:y][group[pair]]
            value = shard.impact[at] * times[pair]
            cells = int(width[x:y].sum())
            if self.most < 2.0**53:
                total = np.bincount(cell, value, cells).astype(np.int64)
            else:
                total = np.zeros(cells, np.int64)
                np.add.at(total, cell, value)
            self.scored += cells
            own, turn = _expand(width[x:y])
            who = item[x:y][own]
            good = np.flatnonzero((total > 0) & (total >= self.kth[who]))
            self._keep(who[good], total[good], shard.ids[low[x:y][own[good]] + turn[good]])

    def _keep(self, item: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(item):
            return
        item, score, ids = (np.concatenate(p) for p in zip(self.top, (item, score, ids), strict=True))
        order = np.lexsort((ids, -score, item))
        item, score, ids = item[order], score[order], ids[order]
        kept = np.arange(len(item)) - np.searchsorted(item, item) < self.k
        self.top = item[kept], score[kept], ids[kept]
        item, score, ids = self.top
        last = np.searchsorted(item, np.arange(len(self.kth)), side="right") - 1
        full = np.flatnonzero((last >= self.k - 1) & (np.bincount(item, minlength=len(self.kth)) == self.k))
        self.kth[full], self.kth_id[full] = score[last[full]], ids[last[full]]

    def run(self, shard: Shard) -> None:
        """Best-first search of every item over a shard."""
        if not shard.size or not len(shard.key):
            return
        item = np.flatnonzero(np.diff(self.start))
        low, high = np.zeros(len(item), np.int64), np.full(len(item), shard.size)
        open_ = (item, low, high, *self._bounds(shard, item, low, high))
        while True:
            item, low, high, bound, split = open_
            # An equal bound may hold an equal score of a smaller id.
            alive = (bound > self.kth[item]) | (bound == self.kth[item]) & (shard.ids[np.minimum(low, shard.size - 1)] <= self.kth_id[item])
            order = np.flatnonzero(alive)
            if not len(order):
                return
            order = order[np.lexsort((-bound[order], item[order]))]
            item, low, high, bound, split = (x[order] for x in (item, low, high, bound, split))
            taken = np.arange(len(item)) - np.searchsorted(item, item) < AT_ONCE
            left = tuple(x[~taken] for x in (item, low, high, bound, split))
            item, low, high, split = item[taken], low[taken], high[taken], split[taken]
            short = high - low <= LEAF
            a, b = np.where(short, low, split), np.where(short, high, split + 1)
            self._score(shard, item, a, b)
            long = ~short
            item, low, high, split = (x[long] for x in (item, low, high, split))
            child = np.concatenate([item, item]), np.concatenate([low, split + 1]), np.concatenate([split, high])
            some = child[1] < child[2]
            child = tuple(x[some] for x in child)
            child = (*child, *self._bounds(shard, *child))
            open_ = tuple(np.concatenate(p) for p in zip(left, child, strict=True))


def _search(counts: DataFrame, shared, k: int) -> DataFrame:
    """item, doc_id, score: each task's best k documents of each item (a position in the block)."""

    def run(batches):
        items, weight, total = shared.value
        search = Search(items, weight, k)
        held, size = [], 0

        def shard():
            rows = pa.Table.from_batches(held)
            ids = rows["doc_id"].fill_null(_NO_ID).to_numpy()
            doc = np.repeat(np.arange(len(ids)), np.concatenate([c.value_lengths().to_numpy() for c in rows["terms"].chunks]))
            term, times = (np.concatenate([c.flatten().to_numpy() for c in rows[x].chunks]).astype(np.int64) for x in ("terms", "times"))
            return Shard(ids, rows["n"].to_numpy(), doc, term, times, weight, total)

        for batch in batches:
            lengths = batch.column(2).value_lengths().to_numpy()
            for a, b in _in_parts(lengths, POSTINGS):
                held.append(batch.slice(a, b - a))
                size += int(lengths[a:b].sum())
                if size >= POSTINGS:
                    search.run(shard())
                    held, size = [], 0
        if held:
            search.run(shard())
        item, score, ids = search.top
        yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(ids, mask=ids == _NO_ID), pa.array(score)], ["item", "doc_id", "score"])

    return map_arrow(counts, run, "item int, doc_id long, score long")


def search(docs: DataFrame, queries: DataFrame, k: int = 20, key: str = "doc_id", text: str = "text", item: str = "item_id", query: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: each item's k documents of the highest score above 0."""
    spark = docs.sparkSession
    asked = queries.select(F.col(item).alias("item_id"), F.col(query).alias("text")).where("text is not null").distinct()
    kind = queries.schema[item].dataType
    blocks = max(1, -(-int(asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // ITEM_BYTES))
    parts, used = [], []
    for b in range(blocks):
        texts: dict = {}
        own = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        for row in own.toLocalIterator():
            texts.setdefault(row.item_id, []).append(row.text)
        items = Items(texts)
        if not items.vocabulary:
            continue
        counts = materialize(_counts(docs, spark.sparkContext.broadcast(items), key, text))
        used.append(counts)
        many, length = counts.agg(F.count("*"), F.sum("n")).first()
        if not many:
            continue
        found = counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toArrow()
        weight = np.zeros(len(items.vocabulary), np.int64)  # at most one row a term of the block
        weight[found["term"].to_numpy()] = [math.floor(1000 * math.log((2 * many + 2) / (2 * df + 1))) for df in found["df"].to_pylist()]
        names = spark.createDataFrame(pa.table({"item": pa.array(range(len(items.ids)), pa.int32()), "item_id": pa.array(items.ids)}))
        best = _search(counts, spark.sparkContext.broadcast((items, weight, (many, length))), k)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        parts.append(ranked.join(F.broadcast(names), "item").select(F.col("item_id").cast(kind).alias("item_id"), "rank", "doc_id", "score"))
    if not parts:
        return spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    out = materialize(reduce(DataFrame.unionByName, parts))
    for table in used:
        discard(table)
    return out
