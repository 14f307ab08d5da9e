"""Best-fit packing by non-negative least squares over length patterns (operator 1).

1. Every document becomes pieces of at most `capacity` tokens; only longer documents are cut, and then the
   first piece takes the remainder. A document is its token ids and one end id, so no piece is empty.
2. The histogram of piece lengths (at most `capacity` counts, whatever the corpus) goes to the driver.
3. Patterns of one, two or three lengths that fill a sequence exactly are enumerated; non-negative least
   squares fits how often to repeat each, so that the repeats use up the histogram.
4. Repeats are rounded down. What they leave over is packed best-fit, longest first, on counts of lengths.
5. The plan lists (length, first rank, last rank) ranges and the sequence and offset they go to. Each piece
   finds its place from its rank among the pieces of its length; ranks come from per-task counts, so no
   length (and no hot group of one length) meets in one task.

The plan's size has a bound that no corpus changes: at most three rows a pattern (87,894 patterns at 1024), and
best fit opens at most two new groups of sequences a length, each with a row for each of its distinct lengths
(44 at most, as they sum to 1024): 353,794 rows of five longs, 14 MB.

Null texts count as empty (one end id). Ties and repeated rows need no care: every row is packed on its own, a
null key too. Texts of any length are packed whole. Columns but the key and the text are left aside, so their names
cannot clash. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
import zlib
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.llm.common import Recent, column_bytes, map_arrow, materialize, slices
from corpuslens.llm.pretokens import split_texts

CAPACITY = 1024
END_ID = 2
#: Words that a worker remembers, of so many bytes at most; the store is emptied beyond, which changes no result.
REMEMBERED, SHORT = 200_000, 64


# --- the plan -------------------------------------------------------------------------------------------


def patterns(capacity: int, lengths: np.ndarray) -> np.ndarray:
    """Rows (a >= b >= c, 0 for none) of one to three lengths that occur and sum to the capacity."""
    has = np.zeros(capacity + 1, bool)
    has[lengths] = True
    has[0] = False
    rows = [(capacity, 0, 0)] if has[capacity] else []
    for a in range(1, capacity):
        if not has[a]:
            continue
        b = capacity - a
        if b <= a and has[b]:
            rows.append((a, b, 0))
        second = np.arange(max(1, (capacity - a + 1) // 2), min(a, capacity - a - 1) + 1)
        third = capacity - a - second
        fits = has[second] & has[third] & (third <= second)
        rows += [(a, int(x), int(y)) for x, y in zip(second[fits], third[fits], strict=True)]
    return np.array(rows, np.int64).reshape(-1, 3)


def fit_repeats(table: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares: repeats x >= 0 that make sum_p x_p * pattern_p nearest to the histogram.

    Accelerated projected gradient. The matrix has at most three ones a column, so products are gathers and
    bincounts. Short lengths weigh less: they fill gaps later.
    """
    size = len(histogram)
    weight = np.clip(np.arange(size) / size, 0.05, None)
    weight[0] = 0.0
    target = histogram * weight
    flat = table.ravel()

    def forward(x):
        return weight * np.bincount(flat, weights=np.repeat(x, 3), minlength=size)

    def backward(r):
        return (weight * r)[table].sum(axis=1)

    v = np.ones(len(table))
    for _ in range(12):  # the largest singular value, for the step
        v = backward(forward(v))
        v /= np.linalg.norm(v) or 1.0
    step = 1.0 / max(1e-12, 1.05 * float(np.linalg.norm(backward(forward(v)))))
    x = np.zeros(len(table))
    y, t = x, 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, y - step * backward(forward(y) - target))
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / after * (new - x)
        if float(((y - new) * (new - x)).sum()) < 0:
            y, after = new, 1.0
        x, t = new, after
    return x


def best_fit(histogram: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Longest first into the fullest sequence with room, on counts: (lengths, how many such sequences)."""
    open_bins: dict[int, list[tuple[list[int], int]]] = {}
    room = np.zeros(capacity + 1, np.int64)  # sequences by free tokens
    for length in range(capacity, 0, -1):
        left = int(histogram[length])
        while left:
            fits = np.flatnonzero(room[length:])
            if not len(fits):
                # New sequences: as many as hold the rest, each filled with this length as often as it goes.
                each = max(1, min(capacity // length, left))
                n = left // each
                bins, used = [([length] * each, n)], each * n
                free = capacity - each * length
            else:
                free = int(fits[0]) + length
                lengths, n = open_bins[free].pop()
                each = min(free // length, left)
                take = min(n, left // each)
                if take < n:
                    open_bins[free].append((lengths, n - take))
                room[free] -= take
                bins, used = [(lengths + [length] * each, take)], each * take
                free -= each * length
            open_bins.setdefault(free, []).extend(bins)
            room[free] += sum(n for _, n in bins)
            left -= used
    return [x for bins in open_bins.values() for x in bins]


def pack_histogram(histogram: np.ndarray, capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Patterns and their whole repeats that together use every piece of the histogram exactly once."""
    histogram = np.asarray(histogram, np.int64).copy()
    chosen: list[tuple[list[int], int]] = []
    table = patterns(capacity, np.flatnonzero(histogram[: capacity + 1]))
    if len(table):
        repeats = np.floor(fit_repeats(table, histogram.astype(float)) + 1e-6).astype(np.int64)
        for p in np.argsort(-repeats, kind="stable"):
            lengths, n = [int(x) for x in table[p] if x], int(repeats[p])
            for length in set(lengths):
                n = min(n, int(histogram[length]) // lengths.count(length))
            if n <= 0:
                continue
            for length in lengths:
                histogram[length] -= n
            chosen.append((lengths, n))
    return chosen + best_fit(histogram, capacity)


def plan_ranges(chosen: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """Ranges of ranks by length: length, first rank, first sequence, offset, and how many ranks each sequence takes side by side; sorted."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, n in chosen:
        offset = 0
        for length, run in itertools.groupby(lengths):
            each = len(list(run))
            rows.append((length, used.get(length, 0), sequence, offset, each))
            used[length] = used.get(length, 0) + n * each
            offset += length * each
        sequence += n
    rows.sort()
    cells = np.array(rows, np.int64).reshape(-1, 5)
    return {"length": cells[:, 0], "rank": cells[:, 1], "sequence": cells[:, 2], "offset": cells[:, 3], "each": cells[:, 4]}


def place(plan: dict[str, np.ndarray], length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of the pieces with these lengths and ranks."""
    key = (plan["length"] << np.int64(44)) | plan["rank"]
    at = np.searchsorted(key, (length << np.int64(44)) | rank, side="right") - 1
    sequence, beside = np.divmod(rank - plan["rank"][at], plan["each"][at])
    return plan["sequence"][at] + sequence, plan["offset"][at] + beside * length


# --- pieces ---------------------------------------------------------------------------------------------


@functools.lru_cache(2)
def _engine(json_path: str):
    import os

    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work
    return Tokenizer.from_file(json_path)


_WORD_IDS = Recent(REMEMBERED)


def _word_ids(words: list[bytes], json_path: str) -> list[bytes]:
    """The library's ids of each word; a match of its pattern alone is one match again, so they are those in a text."""
    out = [_WORD_IDS.get(w) for w in words]
    fresh = [k for k, ids in enumerate(out) if ids is None]
    made = _engine(json_path).encode_batch_fast([words[k].decode() for k in fresh], add_special_tokens=False)
    for k, encoding in zip(fresh, made, strict=True):
        ids = out[k] = array("I", encoding.ids).tobytes()
        if len(words[k]) <= SHORT:
            _WORD_IDS.put(words[k], ids)
    return out


def added_tokens(json_path: str | None = None) -> dict[str, int]:
    """Added tokens of a tokenizers file and their ids: the library cuts texts at them before anything else."""
    with open(json_path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        return {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}


def _cut_at(added: dict[str, int], data: np.ndarray, offsets: np.ndarray, first: int, last: int) -> tuple[np.ndarray, list[int], dict[int, bytes]]:
    """Texts first..last-1 cut at added tokens: offsets of the parts, first part of each text (n + 1), ids of parts that are an added token."""
    find = re.compile(b"|".join(re.escape(t.encode()) for t in sorted(added, key=len, reverse=True)))
    if not added or not find.search(data[offsets[first] : offsets[last]]):
        return offsets[first : last + 1], list(range(last - first + 1)), {}
    cuts, parts, ids = [], [0], {}
    for a, b in zip(offsets[first:last].tolist(), offsets[first + 1 : last + 1].tolist(), strict=True):
        cuts.append(a)
        for m in find.finditer(data[a:b].tobytes()):
            ids[len(cuts)] = np.array([added[m[0].decode()]], "<u4").tobytes()
            cuts += [a + m.start(), a + m.end()]
        parts.append(len(cuts))
    return np.array([*cuts, offsets[last]], np.int64), parts, ids


def token_pieces(df: DataFrame, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, json_path: str | None = None, tokens: bool = False, added: dict[str, int] | None = None) -> DataFrame:
    """Cut documents into pieces: key, piece, start, length, ids_crc32, task, task_rank (and the ids, if asked for).

    task_rank counts the pieces of this length that the task has made before. The ids are made by the `tokenizers`
    library from its file, distinct word by distinct word: a whole text takes it many times as long.
    With added_tokens() as `added` they are the library's by default, where the text of an added token is that
    token; without, those with encode_special_tokens set, where it is plain text.
    """
    path = json_path or public_tokenizers.path("byte_bpe_50k.json")
    kind = df.schema[key].dataType.simpleString()
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            for a, b in slices(offsets):
                cuts, parts, special = _cut_at(added or {}, data, offsets, a, b)
                words, number, by_part = split_texts(data, cuts, 0, len(cuts) - 1)
                ids, number, by = _word_ids(words, path), number.tolist(), by_part.tolist()
                row, piece, start, length, crc, own = [], [], [], [], [], []
                for k in range(b - a):
                    if special:
                        whole = b"".join([special.get(p) or b"".join([ids[x] for x in number[by[p] : by[p + 1]]]) for p in range(parts[k], parts[k + 1])]) + end
                    else:
                        whole = b"".join([ids[x] for x in number[by[k] : by[k + 1]]]) + end
                    total = len(whole) // 4
                    at, size, j = 0, (total - 1) % capacity + 1, 0
                    while at < total:
                        part = whole[4 * at : 4 * (at + size)]
                        row.append(a + k)
                        piece.append(j)
                        start.append(at)
                        length.append(size)
                        crc.append(zlib.crc32(part))
                        if tokens:
                            own.append(np.frombuffer(part, "<i4"))
                        at, size, j = at + size, capacity, j + 1
                lengths = np.array(length, np.int64)
                order = np.argsort(lengths, kind="stable")
                ordered = lengths[order]
                within = np.arange(len(order)) - np.searchsorted(ordered, ordered)
                rank = np.empty(len(order), np.int64)
                rank[order] = within + seen[ordered]
                seen += np.bincount(lengths, minlength=capacity + 1)
                columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(lengths), pa.array(crc, pa.int64()), pa.array(np.full(len(row), task, np.int32)), pa.array(rank)]
                names = [key, "piece", "start", "length", "ids_crc32", "task", "task_rank"]
                if tokens:
                    columns.append(pa.array(own, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"{key} {kind}, piece int, start long, length long, ids_crc32 long, task int, task_rank long" + ", ids array<int>" * tokens
    return map_arrow(df.select(key, text), run, schema)


def pack(df: DataFrame, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, json_path: str | None = None, tokens: bool = False, added: dict[str, int] | None = None) -> DataFrame:
    """Pack every document: the columns of token_pieces() and sequence_id, offset.

    The pieces are written once, since a rank must stay what it was when its task is run again.
    """
    spark = df.sparkSession
    pieces = materialize(token_pieces(df, text, key, capacity, json_path, tokens, added))
    by_task = materialize(pieces.groupBy("task", "length").count())
    histogram = np.zeros(capacity + 1, np.int64)
    for row in by_task.groupBy("length").agg(F.sum("count").alias("n")).collect():  # capacity rows at most
        histogram[row["length"]] = row["n"]
    plan = plan_ranges(pack_histogram(histogram, capacity))
    shared = spark.sparkContext.broadcast(plan)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_task.select("task", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("task_start"))
    ranked = pieces.join(starts, ["task", "length"])

    def run(batches):
        plan = shared.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("task_rank").to_numpy() + batch.column("task_start").to_numpy()
            sequence, offset = place(plan, length, rank)
            keep = [n for n in batch.schema.names if n not in ("task", "task_rank", "task_start")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], [*keep, "sequence_id", "offset"])

    kept = [f for f in ranked.schema if f.name not in ("task", "task_rank", "task_start")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "sequence_id long", "offset long"])
    return map_arrow(ranked, run, schema).select(*[f.name for f in pieces.schema if f.name not in ("task", "task_rank")], "sequence_id", "offset")
