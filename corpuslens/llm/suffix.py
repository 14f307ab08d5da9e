"""Exact substring deduplication with suffix arrays built by linear grouping (operator 4).

Matches of at least `length` bytes are found in three steps.

1. Anchors. The smallest hash among the `K`-byte strings of a window of `length` bytes is its anchor, so equal
   windows have equal anchors at equal offsets. The windows of an anchor form a stretch of text. Anchors that
   occur once have no repeated window; equal stretches (equal BLAKE2 digests at an equal anchor) repeat in
   all their windows.
2. Different stretches at equal anchors may share some windows only. They are cut into blocks of `BLOCK` bytes from
   the anchor on, and a suffix array of the block strings of many anchors is built by linear grouping: suffixes are
   grouped by their Lyndon prefixes, groups are processed in descending order with previous-smaller pointers, then
   every group's order is emitted, without recursive renaming. Neighbours in the array that share as many whole
   blocks as any window must hold form families; the windows around a family's blocks are all that can repeat,
   and those whose bytes are equal do. Blocks and windows are compared byte by byte.
3. An anchor with more than `MOST` different stretches would be too much for one task: it is a hot group, and its
   windows are dealt out and counted by their BLAKE2 digests instead, which finds the same windows.

Only anchors whose stretches differ get a suffix array, since one costs about 5 microseconds a symbol in Python:
over every byte of a corpus that is some 5,000 CPU seconds a GB.

Null and empty texts have no bytes; shorter texts no window. Texts of any length are read whole, a segment at a time
(segments share `length` - 1 bytes, so each window is in exactly one). Matches never cross documents. Repeated rows
are copies of each other; rows with a null key count like others. Columns of docs cannot clash: results have their own
names and carried columns stay in a struct. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslens.llm.common import SpanHash, column_bytes, digests, discard, map_arrow, materialize, mix, slices

K, BLOCK, MOST = 80, 16, 1000
#: Symbols of a suffix array, at least; a task builds one after another.
SYMBOLS = 60_000
#: Bytes whose anchors a task looks for at once, and windows whose bytes it compares at once.
SEGMENT, COMPARED = 300_000, 20_000
_POSITION = np.uint64((1 << 28) - 1)


def suffix_array(text: list[int]) -> list[int]:
    """The suffix array of integers whose last one is smaller than all others."""
    n = len(text)
    symbols = np.array(text)
    order = np.argsort(symbols, kind="stable")
    ranked = symbols[order]
    fresh = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    heads = np.flatnonzero(fresh)
    head_of = heads[np.cumsum(fresh) - 1]
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    group = np.empty(n, np.int64)  # a group is named by its first place
    group[order] = head_of
    last = np.zeros(n, np.int64)
    last[heads] = np.append(heads[1:], n) - 1
    rows, place, group, last = order.tolist(), place.tolist(), group.tolist(), last.tolist()
    smaller = [-1] * n  # the previous suffix of a lower group

    def split(moved: list[int], head: int) -> None:
        """Make some of a group's suffixes the group that follows it directly."""
        end = last[head]
        if len(moved) == end - head + 1:
            return
        new = end - len(moved) + 1
        for j in moved:
            at, other = place[j], rows[end]
            rows[at], place[other] = other, at
            rows[end], place[j] = j, end
            group[j] = new
            end -= 1
        last[new] = last[head]
        last[head] = end

    i = n - 1
    while i >= 0:
        head = group[rows[i]]
        if head == i:
            own = rows[i]
            j = own - 1
            while j >= 0 and group[j] >= head:
                j = smaller[j]
            smaller[own] = j
            if j >= 0:
                split([j], group[j])
        else:
            pointed: dict[int, int] = {}
            for own in sorted(rows[head : i + 1]):
                j = own - 1
                while j >= 0 and group[j] >= head:
                    j = smaller[j]
                smaller[own] = j
                if j >= 0:
                    pointed[j] = pointed.get(j, 0) + 1
            # The more of the group's prefixes follow, the larger the suffix.
            parts: dict[tuple[int, int], list[int]] = {}
            for j, times in pointed.items():
                parts.setdefault((-times, group[j]), []).append(j)
            for key in sorted(parts):
                split(parts[key], key[1])
        i = head - 1
    out, next_free = [0] * n, list(range(n))
    placed = bytearray(n)
    out[0] = n - 1
    placed[n - 1] = 1
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not placed[j]:
            head = group[j]
            out[next_free[head]] = j
            next_free[head] += 1
            placed[j] = 1
            j = smaller[j]
    return out


def families(contents: list[bytes], anchors: list[int], run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks, cut from the anchors on, that begin `run` blocks in a row which the suffix array has side by side with
    equal ones: their content, the block's first byte in it, and the number of their family."""
    parts, owner, begin = [], [], []
    for k, (text, at) in enumerate(zip(contents, anchors, strict=True)):
        first = at % BLOCK
        count = (len(text) - first) // BLOCK
        parts.append(text[first : first + count * BLOCK])
        owner.append(np.full(count, k))
        begin.append(first + BLOCK * np.arange(count))
    blocks = np.frombuffer(b"".join(parts), np.uint64).reshape(-1, BLOCK // 8)
    none = np.empty(0, np.int64)
    if not len(blocks):
        return none, none, none
    owner, begin = np.concatenate(owner), np.concatenate(begin)
    by_value = np.lexsort(blocks.T)
    ordered = blocks[by_value]
    symbol = np.empty(len(blocks), np.int64)
    symbol[by_value] = np.cumsum(np.append(True, (ordered[1:] != ordered[:-1]).any(axis=1)))
    # One string: symbols from 2 on, 1 between contents, 0 at the end.
    ends = owner[1:] != owner[:-1]
    where = np.arange(len(owner))
    where[1:] += np.cumsum(ends)
    text = np.ones(len(owner) + int(ends.sum()) + 1, np.int64)
    text[where] = symbol + 1
    text[-1] = 0
    content = np.full(len(text), -1)
    content[where] = owner
    first_byte = np.zeros(len(text), np.int64)
    first_byte[where] = begin
    if len(text) <= run:
        return none, none, none
    order = np.array(suffix_array(text.tolist()))
    # Runs of blocks that stay inside their content.
    whole = np.zeros(len(text), bool)
    whole[: len(text) - run + 1] = (content[: len(text) - run + 1] >= 0) & (content[: len(text) - run + 1] == content[run - 1 :])
    runs = np.lib.stride_tricks.sliding_window_view(text, run)
    above, below = order[:-1], order[1:]
    equal = whole[above] & whole[below]
    at = np.flatnonzero(equal)
    for a in range(0, len(at), COMPARED):
        part = at[a : a + COMPARED]
        equal[part] = (runs[above[part]] == runs[below[part]]).all(axis=1)
    family = np.cumsum(np.append(True, ~equal))
    member = np.append(equal, False) | np.append(False, equal)
    return content[order[member]], first_byte[order[member]], family[member]


def equal_windows(data: np.ndarray, at: np.ndarray, family: np.ndarray, length: int) -> np.ndarray:
    """Which of the windows at these places have the same bytes as another one of their family."""
    code = mix(SpanHash(data)(at, at + length) + family.astype(np.uint64))
    _, first, inverse, count = np.unique(code, return_index=True, return_inverse=True, return_counts=True)
    inverse = inverse.ravel()
    twice = count[inverse] > 1
    view = np.lib.stride_tricks.sliding_window_view(data, length)
    rows = np.flatnonzero(twice)
    other = np.zeros(len(count), bool)  # classes in which a hash stands for different bytes
    for a in range(0, len(rows), COMPARED):
        part = rows[a : a + COMPARED]
        same = (view[at[part]] == view[at[first[inverse[part]]]]).all(axis=1)
        other[inverse[part[~same]]] = True
    if other.any():
        rows = np.flatnonzero(other[inverse])
        strings = [(f, data[a : a + length].tobytes()) for f, a in zip(family[rows].tolist(), at[rows].tolist(), strict=True)]
        times = Counter(strings)
        twice[rows] = [times[x] > 1 for x in strings]
    return twice


def repeated_windows(contents: list[bytes], anchors: np.ndarray, length: int) -> list[np.ndarray]:
    """For each content the starts of its windows that stand elsewhere in the contents, at an equal offset from the blocks."""
    out = [np.empty(0, np.int64)] * len(contents)
    content, block, family = families(contents, anchors.tolist(), (length - BLOCK + 1) // BLOCK)
    if not len(content):
        return out
    size = np.fromiter(map(len, contents), np.int64, len(contents))
    # A window belongs to the first block that begins inside it.
    start = (block[:, None] - np.arange(BLOCK)[None, :]).ravel()
    content, family = np.repeat(content, BLOCK), np.repeat(family, BLOCK)
    inside = (start >= 0) & (start + length <= size[content])
    start, content, family = start[inside], content[inside], family[inside]
    data = np.frombuffer(b"".join(contents), np.uint8)
    twice = equal_windows(data, (np.cumsum(size) - size)[content] + start, family, length)
    start, content = start[twice], content[twice]
    order = np.lexsort((start, content))
    start, content = start[order], content[order]
    edge = np.searchsorted(content, np.arange(len(contents) + 1))
    return [start[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]


def segments(offsets: np.ndarray, length: int, most: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last byte + 1 of pieces of the texts, such that each window of a text lies in exactly one piece."""
    size = np.diff(offsets)
    pieces = np.maximum(0, -(-(size - length + 1) // most))
    row = np.repeat(np.arange(len(size)), pieces)
    low = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * most
    return row, low, np.minimum(low + most + length - 1, size[row])


def anchors_of(texts: list[np.ndarray], length: int):
    """Anchors of texts: text, anchor hash, stretch hash, first window, number of windows, anchor's offset in it."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.concatenate([[0], np.cumsum(size)])
    buffer = np.concatenate([*texts, np.empty(0, np.uint8)])
    wide = length - K + 1
    if len(buffer) < length:
        return [np.empty(0, np.int64)] * 6
    span = SpanHash(buffer)
    at = np.arange(len(buffer) - K + 1)
    code = span(at, at + K)
    key = (code & ~_POSITION) | at.astype(np.uint64)
    del at
    # The smallest of every `wide` keys in a row, from the minima of blocks read in both directions.
    m = len(key)
    padded = np.full(m + (-m) % wide, ~np.uint64(0))
    padded[:m] = key
    padded = padded.reshape(-1, wide)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    chosen = (np.minimum(back[: m - wide + 1], ahead[wide - 1 : m]) & _POSITION).astype(np.int64)
    del key, padded, ahead, back
    text = np.searchsorted(starts, np.arange(len(chosen)), side="right") - 1
    window = np.flatnonzero(np.arange(len(chosen)) + length <= starts[text + 1])
    chosen, text = chosen[window], text[window]
    if not len(window):
        return [np.empty(0, np.int64)] * 6
    fresh = np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1])])
    head = np.flatnonzero(fresh)
    low, high = window[head], window[np.append(head[1:], len(window)) - 1]
    anchor, text = chosen[head], text[head]
    whole = buffer.tobytes()
    stretch = digests([whole[i:j] for i, j in zip(low.tolist(), (high + length).tolist(), strict=True)])
    stretch = mix(stretch + mix((anchor - low).astype(np.uint64)))
    return text, code[anchor].view(np.int64), stretch.view(np.int64), low - starts[text], high - low + 1, anchor - low


_PLACE = "doc long, th long, low int, windows int, at int"


def _with_text(rows: DataFrame, docs: DataFrame, how: str = "inner") -> DataFrame:
    return docs.join(rows, docs["doc"].eqNullSafe(rows["doc"]) & (docs["th"] == rows["th"]), how).drop(rows["doc"]).drop(rows["th"])


def repeated_spans(docs: DataFrame, length: int) -> DataFrame:
    """doc, th, low, high: first and last start of runs of windows that also start elsewhere. docs: doc, th, text."""

    def find(batches):
        for batch in batches:
            data, offsets = column_bytes(batch.column(2))
            row, begin, end = segments(offsets, length)
            for a, b in slices(np.concatenate([[0], np.cumsum(end - begin)]), SEGMENT):
                texts = [data[offsets[r] + x : offsets[r] + y] for r, x, y in zip(row[a:b].tolist(), begin[a:b].tolist(), end[a:b].tolist(), strict=True)]
                text, anchor, stretch, low, windows, at = anchors_of(texts, length)
                low = low + begin[a:b][text]
                who = pa.array(row[a:b][text])
                yield pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64()), pa.array(stretch, pa.int64()), batch.column(0).take(who), batch.column(1).take(who), *(pa.array(x.astype(np.int32)) for x in (low, windows, at))], ["a", "e", "doc", "th", "low", "windows", "at"])

    found = map_arrow(docs, find, f"a long, e long, {_PLACE}", release=True)
    # Written, so that the join has plain exchanges on both sides, whose hot anchors can be split.
    often = materialize(found.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a"))
    shared = materialize(found.join(often, "a"))
    discard(often)
    stretches = shared.groupBy("a", "e").agg(F.count("*").alias("copies"), F.min(F.struct("doc", "th", "low", "windows", "at")).alias("one"))
    stretches = materialize(stretches)
    whole = shared.join(stretches.where("copies > 1").select("a", "e"), ["a", "e"]).select("doc", "th", "low", F.expr("low + windows - 1").alias("high"))
    kinds = stretches.groupBy("a").agg(F.count("*").alias("kinds")).where("kinds > 1")
    unlike = stretches.join(kinds, "a").select("a", "copies", "kinds", "one.*")
    # A text is read once for all its stretches.
    by_text = unlike.groupBy("doc", "th").agg(F.collect_list(F.struct("a", "copies", "kinds", "low", "windows", "at")).alias("own"))

    def cut(batches):
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            own = batch.column("own")
            own = own.combine_chunks() if isinstance(own, pa.ChunkedArray) else own
            count = own.value_lengths().to_numpy(zero_copy_only=False)
            rows = np.repeat(np.arange(batch.num_rows), count)
            cells = own.flatten()
            field = {x: cells.field(x) for x in ("a", "copies", "kinds", "low", "windows", "at")}
            low = offsets[rows] + field["low"].to_numpy()
            size = field["windows"].to_numpy() + length - 1
            parts = [data[i : i + n].tobytes() for i, n in zip(low.tolist(), size.tolist(), strict=True)]
            who = pa.array(rows)
            columns = {"a": field["a"], "copies": field["copies"], "kinds": field["kinds"], "doc": batch.column("doc").take(who), "th": batch.column("th").take(who), "low": field["low"], "at": field["at"], "content": pa.array(parts, pa.binary())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    read = docs.join(by_text.withColumnsRenamed({"doc": "doc_", "th": "th_"}), F.col("doc").eqNullSafe(F.col("doc_")) & (F.col("th") == F.col("th_"))).select("doc", "th", "text", "own")
    contents = materialize(map_arrow(read, cut, "a long, copies long, kinds long, doc long, th long, low int, at int, content binary", release=True))

    def search(batches):
        held, size, last = [], 0, None
        for batch in batches:
            # Rows come ordered by anchor; a suffix array is built when an anchor is complete and there is enough.
            keys = batch.column("a").to_numpy()
            lengths = np.diff(column_bytes(batch.column("content"))[1]) // BLOCK
            edge = 0
            for i in np.flatnonzero(keys != np.append(last if last is not None else keys[0] if len(keys) else 0, keys[:-1])).tolist():
                held.append(batch.slice(edge, i - edge))
                size += int(lengths[edge:i].sum())
                edge = i
                if size >= SYMBOLS:
                    yield from solve(held)
                    held, size = [], 0
            held.append(batch.slice(edge))
            size += int(lengths[edge:].sum())
            last = keys[-1] if len(keys) else last
        yield from solve(held)

    def solve(held):
        group = pa.Table.from_batches(held) if held else None
        if group is None or not group.num_rows:
            return
        found = repeated_windows(group["content"].to_pylist(), group["at"].to_numpy().astype(np.int64), length)
        low, single = group["low"].to_numpy(), group["copies"].to_numpy() == 1
        row, first, final = [], [], []
        for k, starts in enumerate(found):
            if len(starts) and single[k]:
                gap = np.flatnonzero(np.diff(starts) > 1)
                a, b = np.concatenate([[0], gap + 1]), np.append(gap, len(starts) - 1)
                row += [k] * len(a)
                first += (low[k] + starts[a]).tolist()
                final += (low[k] + starts[b]).tolist()
        who = pa.array(row, pa.int64())
        docs_, hashes = group["doc"].combine_chunks().take(who), group["th"].combine_chunks().take(who)
        yield pa.RecordBatch.from_arrays([docs_, hashes, pa.array(first, pa.int32()), pa.array(final, pa.int32())], ["doc", "th", "low", "high"])

    few = map_arrow(contents.where(f"kinds <= {MOST}").drop("kinds").repartition("a").sortWithinPartitions("a"), search, "doc long, th long, low int, high int", release=True)

    def spell(batches):
        for batch in batches:
            data, offsets = column_bytes(batch.column("content"))
            for a, b in slices(offsets, 200_000):
                count = np.diff(offsets[a : b + 1]) - length + 1
                own = np.repeat(np.arange(a, b), count)
                start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                part = data[offsets[a] : offsets[b]]
                at = offsets[own] - offsets[a] + start
                place = batch.column("at").to_numpy()[own] - start
                string = part.tobytes()
                code = mix(digests([string[i : i + length] for i in at.tolist()]) + batch.column("a").to_numpy()[own].view(np.uint64) + mix(place.astype(np.uint64)))
                who = pa.array(own)
                yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), batch.column("doc").take(who), batch.column("th").take(who), pa.array((batch.column("low").to_numpy()[own] + start).astype(np.int32))], ["w", "doc", "th", "low"])

    many = map_arrow(contents.where(f"kinds > {MOST}"), spell, "w long, doc long, th long, low int", release=True)
    twice = many.groupBy("w").agg(F.count("*").alias("n")).where("n > 1").select("w")
    hot = many.join(twice, "w").select("doc", "th", "low", F.col("low").alias("high"))
    spans = materialize(whole.unionByName(few).unionByName(hot).groupBy("doc", "th").agg(F.collect_list("low").alias("low"), F.collect_list("high").alias("high")))
    for used in (shared, stretches, contents):
        discard(used)
    return spans


def strip_repeats(docs: DataFrame, length: int = 200, key: str = "doc_id", text: str = "text", keep_text: bool = False, carry: list[str] | None = None) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256; kept_text, if asked for (a character cut in two goes whole); if asked for, `carried`, a struct of the columns `carry`."""
    columns = {"doc": F.col(key).cast("long"), "th": F.xxhash64(F.coalesce(text, F.lit(""))), "text": F.coalesce(text, F.lit(""))}
    if carry:
        columns["carried"] = F.struct(*carry)
    named = docs.select(*(column.alias(name) for name, column in columns.items()))
    spans = repeated_spans(named.select("doc", "th", "text"), length)

    def run(batches):
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            lows, highs = batch.column("low"), batch.column("high")
            removed, spans, sha, kept_texts = [], [], [], []
            for k in range(batch.num_rows):
                own = data[offsets[k] : offsets[k + 1]]
                low = lows[k].values
                if low is not None and len(low):
                    edge = np.zeros(len(own) + 1, np.int32)
                    np.add.at(edge, low.to_numpy(zero_copy_only=False), 1)
                    np.add.at(edge, highs[k].values.to_numpy(zero_copy_only=False) + length, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    removed.append(int(gone.sum()))
                    spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                    kept = own[~gone].tobytes()
                else:
                    removed.append(0)
                    spans.append(0)
                    kept = own.tobytes()
                sha.append(hashlib.sha256(kept).hexdigest())
                if keep_text:
                    kept_texts.append(kept.decode("utf-8", "ignore"))
            columns = {key: batch.column("doc"), "n_bytes": pa.array(np.diff(offsets)), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(sha, pa.string())}
            if keep_text:
                columns["kept_text"] = pa.array(kept_texts, pa.string())
            if carry:
                columns["carried"] = batch.column("carried")
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    fields = [T.StructField(key, T.LongType()), *(T.StructField(x, T.LongType()) for x in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType())]
    if keep_text:
        fields.append(T.StructField("kept_text", T.StringType()))
    if carry:
        fields.append(named.schema["carried"])
    wanted = ["doc", "text", "low", "high", *["carried"] * bool(carry)]
    return map_arrow(_with_text(spans, named, "left").select(*wanted), run, T.StructType(fields), release=True)
