"""Benchmark decontamination through suffix arrays of the training texts (operator 13).

Items become sequences of word numbers. A document's words that no item has become 0; runs of words that all occur in
items, and are long enough to hold the shortest window, are what can match, and over them each shard (a slice of texts)
gets a suffix array of word numbers, sorted by doubling prefixes. Every suffix of an item is then searched for in the
shard: one binary search for each further word narrows its range of the array, all suffixes at once, until the range is
empty (its longest verbatim match) or the item ends. The range at the length of a window holds the window's locations.

A window is `width` consecutive words of an item; an item of fewer words, but at least one, is one window. Equal
windows are located once, and items with the same windows in a document are counted once. scan() returns each
document's hits, matches() each item's longest matches and where they stand, clean() the documents without a hit.

Items are read in blocks of at most `ITEM_BYTES` of text, which go to every task; with several blocks the texts pass
through one after another and their spans and items are brought together. Null texts have no word; null items and
items without a word have no window; items without an id are left out; rows of one item id are one item. Repeated rows
and null ids of documents are documents of their own. Texts of any length are read whole, at least a text at a time;
a shard's array is as long as its texts have words of items. Other columns of docs are only carried by clean(), whatever
their names. Empty tables give empty or clean results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslens.llm.common import column_bytes, distinct_spans, free_name, joined, map_arrow, slices, word_spans

WIDTH = 10
#: Text of a block of items, at most (a longer item is a block of its own), and text of a shard.
ITEM_BYTES, SHARD_BYTES = 4_000_000, 4_000_000
#: Text whose words are told apart at once.
WORD_BYTES = 1_000_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def words_of(data: np.ndarray, offsets: np.ndarray, first: int, last: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Texts first..last-1: distinct words, the number of each word in order, and how many words each text has."""
    buffer, starts = joined(data, offsets, first, last)
    buffer = _LOWER[buffer]
    a, b = word_spans(buffer, _WORD)
    words, number = distinct_spans(buffer, a, b)
    return words, number, np.diff(np.searchsorted(a, starts))


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The suffixes of integers > 0 that end before the next 0, in order: ranks of doubled prefixes, sorted until none splits."""
    live = np.flatnonzero(text)
    rank = np.zeros(len(text) + 1, np.int64)
    rank[:-1] = text
    _, inverse = np.unique(rank[live], return_inverse=True)
    rank[live] = inverse.ravel() + 1
    classes, step = int(rank.max(initial=0)), 1
    ends = np.append(np.flatnonzero(text == 0), len(text))
    end = ends[np.searchsorted(ends, live)]
    while classes < len(live):
        # Beyond its own 0 a suffix has ended: what follows there must not count.
        ahead = np.minimum(live + step, len(text))
        key = rank[live] * (classes + 1) + np.where(end > live + step, rank[ahead], 0)
        _, inverse = np.unique(key, return_inverse=True)
        rank[live] = inverse.ravel() + 1
        now, step = int(rank.max(initial=0)), 2 * step
        if now == classes:
            break
        classes = now
    return live[np.argsort(rank[live], kind="stable")]


class Items:
    """A block of items: vocabulary, all their words in a row with a 0 behind each text, and their windows."""

    def __init__(self, texts: dict[str, list[str]], width: int = WIDTH):
        self.ids = sorted(texts)
        self.vocabulary: dict[bytes, int] = {}
        words, owner, at, size = [], [], [], []
        length = 0
        for k, item in enumerate(self.ids):
            for text in sorted(set(texts[item])):
                data = np.frombuffer(text.encode(), np.uint8)
                found, number, _ = words_of(data, np.array([0, len(data)]), 0, 1)
                names = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in found], np.int64)
                own = names[number] if len(number) else np.empty(0, np.int64)
                if not len(own):
                    continue
                wide = min(width, len(own))
                begin = length + np.arange(len(own) - wide + 1)
                words += [own, np.zeros(1, np.int64)]
                owner.append(np.full(len(begin), k))
                at.append(begin)
                size.append(np.full(len(begin), wide))
                length += len(own) + 1
        none = np.empty(0, np.int64)
        self.words, self.owner, self.at, self.size = (np.concatenate([none, *x]) for x in (words, owner, at, size))
        self.shortest = int(self.size.min(initial=width))
        self._name_windows()

    def _name_windows(self) -> None:
        """Number equal windows alike; for each distinct one its items, and the number of its set of items."""
        names: dict[bytes, int] = {}
        window = [names.setdefault(self.words[a : a + n].tobytes(), len(names)) for a, n in zip(self.at.tolist(), self.size.tolist(), strict=True)]
        self.window = np.array(window, np.int64)
        self.first = np.unique(self.window, return_index=True)[1]
        pairs = np.unique(np.stack([self.window, self.owner]), axis=1) if len(window) else np.empty((2, 0), np.int64)
        edge = np.searchsorted(pairs[0], np.arange(len(names) + 1))
        sets: dict[bytes, int] = {}
        self.set_of = np.array([sets.setdefault(pairs[1, a:b].tobytes(), len(sets)) for a, b in zip(edge[:-1], edge[1:], strict=True)], np.int64)
        self.sets = [np.frombuffer(x, np.int64) for x in sets]


class Shard:
    """The suffix array of some texts' words, and binary searches in it."""

    def __init__(self, numbers: np.ndarray, counts: np.ndarray, shortest: int):
        """numbers: a word's number among the items' words or 0, text after text; counts: words of each text."""
        text_end = np.cumsum(counts)
        text = np.zeros(len(numbers) + len(counts), np.int64)
        own = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(len(numbers)) + own
        text[place] = numbers
        # Runs that are too short for the shortest window cannot match.
        live = np.concatenate([[False], text > 0, [False]])
        begin, end = np.flatnonzero(live[1:] & ~live[:-1]), np.flatnonzero(~live[1:] & live[:-1])
        long = end - begin >= shortest
        begin, end = begin[long], end[long]
        size = end - begin + 1  # with a 0 behind it
        turn = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        self.place = np.repeat(begin, size) + turn  # in `text`
        self.text = text[self.place] if len(turn) else np.empty(0, np.int64)
        if len(turn):
            self.text[np.cumsum(size) - 1] = 0
        self.text_start = np.concatenate([[0], text_end]) + np.arange(len(counts) + 1)
        self.order = suffix_array(self.text)

    def _narrow(self, low: np.ndarray, high: np.ndarray, word: np.ndarray, depth: int, upper: bool) -> np.ndarray:
        """The first suffix of each range whose word at `depth` is not smaller (upper: larger) than the given one."""
        low, high = low.copy(), high.copy()
        active = np.flatnonzero(low < high)
        while len(active):
            middle = (low[active] + high[active]) >> 1
            found = self.text[self.order[middle] + depth]
            right = (found <= word[active]) if upper else (found < word[active])
            low[active[right]] = middle[right] + 1
            high[active[~right]] = middle[~right]
            active = active[low[active] < high[active]]
        return low

    def search(self, words: np.ndarray, at: np.ndarray, size: np.ndarray, whole: bool = False):
        """Ranges of the suffixes that begin with the `size` words at `at`; if whole, also the longest match and its range.

        Words of a suffix are looked at one after another; a 0 ends the item. With `whole` a range that is known to
        match is followed on as long as its first and last suffix do.
        """
        n = len(at)
        low, high = np.zeros(n, np.int64), np.full(n, len(self.order))
        at_width = np.zeros((2, n), np.int64)
        longest, best = np.zeros(n, np.int64), np.zeros((2, n), np.int64)
        active, depth = np.arange(n), 0
        while len(active):
            word = words[at[active] + depth]
            a = self._narrow(low[active], high[active], word, depth, False)
            b = self._narrow(a, high[active], word, depth, True)
            going = (a < b) & (word > 0)
            active = active[going]
            low[active], high[active] = a[going], b[going]
            depth += 1
            longest[active] = depth
            best[0, active], best[1, active] = low[active], high[active]
            done = size[active] == depth
            at_width[:, active[done]] = low[active[done]], high[active[done]]
            active = active if whole else active[~done]
        return at_width, longest, best

    def texts(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text and position in it (both from 0) of places in the array's text."""
        place = self.place[places]
        text = np.searchsorted(self.text_start, place, side="right") - 1
        return text, place - self.text_start[text]


def _expand(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges: the range of every member, and the member."""
    size = high - low
    group = np.repeat(np.arange(len(size)), size)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)


def _shards(data: np.ndarray, offsets: np.ndarray, items: Items) -> Iterator[tuple[int, int, np.ndarray, Shard]]:
    """First and last + 1 row, words of each text, and the shard of these rows."""
    for first, last in slices(offsets, SHARD_BYTES):
        numbers, counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for a, b in slices(offsets[first : last + 1], WORD_BYTES):
            words, number, count = words_of(data, offsets, first + a, first + b)
            known = np.fromiter((items.vocabulary.get(w, 0) for w in words), np.int64, len(words))
            numbers.append(known[number] if len(words) else number)
            counts.append(count)
        counts = np.concatenate(counts)
        yield first, last, counts, Shard(np.concatenate(numbers), counts, items.shortest)


def _item_blocks(benchmark: DataFrame, item: str, text: str, width: int) -> list:
    """Broadcast blocks of items."""
    spark = benchmark.sparkSession
    asked = benchmark.select(F.col(item).cast("string").alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")
    blocks = max(1, -(-int(asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // ITEM_BYTES))
    out = []
    for b in range(blocks):
        texts: dict[str, list[str]] = {}
        own = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)
        for row in own.toLocalIterator():
            texts.setdefault(row.id, []).append(row.text)
        items = Items(texts, width)
        if len(items.words) or not out:
            out.append(spark.sparkContext.broadcast(items))
    return out


def _spans(docs: DataFrame, blocks: list, text: str, into: tuple[str, str, str, str]) -> DataFrame:
    """docs with four more columns: number of words, firsts and ends of hit spans, ids of the items."""
    count, low, high, ids = into
    places = T.ArrayType(T.IntegerType())
    more = [(count, T.LongType()), (low, places), (high, places), (ids, T.ArrayType(T.StringType()))]
    out, schema = docs, T.StructType([*docs.schema.fields, *(T.StructField(name, kind) for name, kind in more)])
    for turn, block in enumerate(blocks):

        def run(batches, block=block, first_turn=turn == 0):
            items = block.value
            at, size = items.at[items.first], items.size[items.first]
            for batch in batches:
                data, offsets = column_bytes(batch.column(text))
                many = np.zeros(batch.num_rows, np.int64)
                found: list[list] = [[], [], []]  # row, first word, end of hit spans
                named: list[tuple[np.ndarray, np.ndarray]] = []  # row, item
                for first, last, counts, shard in _shards(data, offsets, items):
                    many[first:last] = counts
                    (a, b), _, _ = shard.search(items.words, at, size)
                    window, member = _expand(a, b)
                    row, begin = shard.texts(shard.order[member])
                    row += first
                    for x, y in zip(found, (row, begin, begin + size[window]), strict=True):
                        x.append(y)
                    pairs = np.unique(row * max(1, len(items.sets)) + items.set_of[window]) if len(row) else row
                    of_set = [items.sets[k] for k in (pairs % max(1, len(items.sets))).tolist()]
                    owner = np.repeat(pairs // max(1, len(items.sets)), [len(x) for x in of_set])
                    named.append((owner, np.concatenate([np.empty(0, np.int64), *of_set])))
                row, begin, end = (np.concatenate([np.empty(0, np.int64), *x]) for x in found)
                owner, item = (np.concatenate([np.empty(0, np.int64), *x]) for x in (zip(*named, strict=True) if named else ((), ())))
                cells = np.unique(owner * max(1, len(items.ids)) + item) if len(owner) else owner
                owner, item = cells // max(1, len(items.ids)), cells % max(1, len(items.ids))
                rows, begins, ends = _merged(row, begin, end)
                parts = [(pa.array(begins.astype(np.int32)), rows), (pa.array(ends.astype(np.int32)), rows), (pa.array([items.ids[k] for k in item.tolist()], pa.string()), owner)]
                lists = [pa.ListArray.from_arrays(pa.array(np.searchsorted(own, np.arange(batch.num_rows + 1)).astype(np.int32)), values) for values, own in parts]
                columns = [*batch.columns[: len(batch.columns) - (0 if first_turn else 4)]]
                if not first_turn:
                    lists = [_appended(batch.column(len(columns) + 1 + k), own) for k, own in enumerate(lists)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(many), *lists], schema.names)

        out = map_arrow(out, run, schema)
    return out


def _appended(one: pa.Array, two: pa.Array) -> pa.Array:
    """Row by row, the members of both lists."""
    return pa.array([a + b for a, b in zip(one.to_pylist(), two.to_pylist(), strict=True)], two.type)


def _merged(row: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping and touching spans of a row become one."""
    if not len(row):
        return row, begin, end
    order = np.lexsort((begin, row))
    row, begin, end = row[order], begin[order], end[order]
    # Far apart by row, so that one running maximum serves all rows.
    apart = row * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + apart)
    head = np.append(True, begin[1:] + apart[1:] > reach[:-1])
    last = np.append(np.flatnonzero(head)[1:], len(row)) - 1
    return row[head], begin[head], (reach - apart)[last]


def _n_hit(low: str, high: str):
    """The number of words in the union of a row's spans."""
    spans = F.array_sort(F.arrays_zip(F.col(low).alias("a"), F.col(high).alias("b")))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("sum"))
    return F.aggregate(
        spans, start,
        lambda s, x: F.struct(F.greatest(s["end"], x["b"]).alias("end"), (s["sum"] + F.greatest(F.lit(0), x["b"] - F.greatest(s["end"], x["a"]))).alias("sum")),
        lambda s: s["sum"],
    )


def scan(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """key, n_words, n_hit, n_items, items (ids as sorted strings), contaminated: every document's words inside windows of items."""
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    found = _spans(rows, _item_blocks(benchmark, item, item_text, width), "text", ("n_words", "low", "high", "ids"))
    items = F.array_sort(F.array_distinct("ids"))
    out = found.select(F.col("id").alias(key), "n_words", _n_hit("low", "high").alias("n_hit"), F.size("ids").cast("long").alias("n_items"), items.alias("items"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents, with all their columns, in which no window of an item occurs."""
    names = tuple(free_name(docs, x) for x in ("n_words", "low", "high", "ids"))
    found = _spans(docs, _item_blocks(benchmark, item, item_text, width), text, names)
    return found.where(F.size(names[1]) == 0).select(*docs.columns)


def matches(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id (as a string), item_at, length, key, doc_at: for every suffix of an item that begins with a window, its longest
    verbatim match in words and the first document and word (from 0) where that stands."""
    kind = docs.schema[key].dataType.simpleString()
    parts = None
    for block in _item_blocks(benchmark, item, item_text, width):

        def run(batches, block=block):
            items = block.value
            # An item's texts stand behind each other; positions count from the start of the suffix's own text.
            zero = np.concatenate([[-1], np.flatnonzero(items.words == 0)])
            start = items.at - zero[np.searchsorted(zero, items.at) - 1] - 1
            for batch in batches:
                data, offsets = column_bytes(batch.column(1))
                for first, _, _, shard in _shards(data, offsets, items):
                    (a, b), longest, best = shard.search(items.words, items.at, items.size, whole=True)
                    found = np.flatnonzero(a < b)
                    group, member = _expand(best[0, found], best[1, found])
                    row, begin = shard.texts(shard.order[member])
                    pick = np.lexsort((begin, row, group))
                    pick = pick[np.append(True, group[pick][1:] != group[pick][:-1])] if len(pick) else pick
                    ids = [items.ids[k] for k in items.owner[found].tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(start[found]), pa.array(longest[found]), batch.column(0).take(pa.array(row[pick] + first)), pa.array(begin[pick])], ["item_id", "item_at", "length", "key", "doc_at"])

        own = map_arrow(docs.select(key, text), run, f"item_id string, item_at long, length long, key {kind}, doc_at long")
        parts = own if parts is None else parts.unionByName(own)
    best = F.min(F.struct((-F.col("length")).alias("less"), "key", "doc_at")).alias("best")
    found = parts.groupBy("item_id", "item_at").agg(best)
    return found.select("item_id", "item_at", (-F.col("best.less")).alias("length"), F.col("best.key").alias(key), F.col("best.doc_at").alias("doc_at"))
