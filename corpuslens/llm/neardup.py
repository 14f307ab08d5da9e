"""Near-duplicates by fast similarity sketching, banding and exact verification (operator 10).

A text's set holds the hashes of its distinct `width`-word shingles (words are runs of non-space, A-Z lowered).
Sketch: rounds throw every element into one of `t` bins; in the first t rounds the bin is random, then round t + j
throws all into bin j, so that every bin is filled at last; a bin keeps its smallest (round, value). `rows` bins
make a band; the number of bands makes a pair at the threshold be missed with a chance below one in a million.

1. Texts with equal sets become classes; one representative of each goes on.
2. In each band bucket the smallest class is the pivot; all others are compared with it on full sets, at most about
   `BLOCK` in a group: a pivot with more members is repeated for each group of them.
3. Connected components join what is linked. Only buckets that still hold several components can hide a link
   between two of their members; there, full sets are compared in blocks of members, and the links that join
   two components are added. No bucket is cut off, and no bucket meets in one task.

Texts without words (null, empty, only spaces) have an empty set, link with nothing and stay their own component.
Rows with a null id take part in no link and are kept. Repeated rows are copies; an id with several texts is one
document that all of them link. Texts of any length are read whole. Other columns are left aside, so their names
cannot clash. An empty table gives none.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import column_bytes, digests, discard, distinct_spans, joined, map_arrow, materialize, mix, slices, word_spans
from corpuslens.llm.components import connected_components

ROWS = 5
#: Members of an unresolved bucket that are compared at once.
BLOCK = 256
_WORD = np.ones(256, bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def bands_for(percent: int) -> int:
    """Bands of ROWS bins that miss a pair at the threshold with a chance below 1e-6."""
    return math.ceil(math.log(1e-6) / math.log(1 - (percent / 100) ** ROWS))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, first: int, last: int, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, made of its words' BLAKE2 digests."""
    buffer, starts = joined(data, offsets, first, last)
    buffer = _LOWER[buffer]
    a, b = word_spans(buffer, _WORD)
    edges = np.searchsorted(a, starts)
    words, number = distinct_spans(buffer, a, b)
    word = digests(words)[number]
    code = word.copy()
    for k in range(1, width):
        code = code[: max(0, len(word) - k)]
        code = mix(code * _GOLD + word[k:])
    out = []
    for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if j - i >= width:
            out.append(np.unique(code[i : j - width + 1]))
        elif j > i:  # fewer words: the whole sequence is the one shingle
            whole = np.array([j - i], np.uint64)
            for x in range(i, j):
                whole = mix(whole * _GOLD + word[x : x + 1])
            out.append(whole)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def _thrown(elements: np.ndarray, i: int, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Bins and (round, value) keys of the elements in round i."""
    v = mix(elements + np.array([i + 1], np.uint64) * _GOLD)
    bins = ((v >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if i < t else np.full(len(v), i - t)
    return bins, np.uint64(i) << np.uint64(32) | v & np.uint64(0xFFFFFFFF)


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """[texts, t] fast similarity sketches; rows of empty sets stay all ones."""
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full((len(sets), t), empty, np.uint64)
    active = np.array([k for k, s in enumerate(sets) if len(s)], np.int64)
    i = 0
    while len(active) and i < 2 * t:
        size = np.array([len(sets[k]) for k in active])
        if i >= 8 and size.max() <= 400:
            break
        bins, keys = _thrown(np.concatenate([sets[k] for k in active]), i, t)
        np.minimum.at(out.reshape(-1), np.repeat(active, size) * t + bins, keys)
        active = active[(out[active] == empty).any(axis=1)]
        i += 1
    for k in active.tolist():  # small sets need many rounds: all rounds of a text at once
        own, row = sets[k], out[k]
        rounds = np.arange(i, 2 * t, dtype=np.uint64)
        v = mix((own[None, :] + (rounds[:, None] + np.uint64(1)) * _GOLD).ravel()).reshape(len(rounds), len(own))
        free = rounds < t
        bins = np.where(free[:, None], (v >> np.uint64(32)) * np.uint64(t) >> np.uint64(32), rounds[:, None] - np.uint64(t) * (~free[:, None])).astype(np.int64)
        np.minimum.at(row, bins.ravel(), (rounds[:, None] << np.uint64(32) | v & np.uint64(0xFFFFFFFF)).ravel())
    return out


def _records(docs: DataFrame, width: int, bands: int, key: str, text: str) -> DataFrame:
    """key, n, sig_a, sig_b (128 bits that stand for the set), bands."""
    t = bands * ROWS

    def run(batches):
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            for first, last in slices(offsets, 8_000_000):
                sets = []
                for a, b in slices(offsets[first : last + 1]):
                    sets += shingle_sets(data, offsets, first + a, first + b, width)
                keys = sketches(sets, t)
                code = np.zeros((len(sets), bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)[None, :]
                for r in range(ROWS):
                    code = mix((code * _GOLD + keys[:, r::ROWS]).ravel()).reshape(code.shape)
                n = np.array([len(s) for s in sets], np.int64)
                sig_a = np.array([mix(s).sum(dtype=np.uint64) if len(s) else np.uint64(0) for s in sets], np.uint64).view(np.int64)
                sig_b = np.array([np.bitwise_xor.reduce(mix(s ^ _GOLD)) if len(s) else np.uint64(0) for s in sets], np.uint64).view(np.int64)
                rows = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands), pa.array(code.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(n), pa.array(sig_a), pa.array(sig_b), rows], [key, "n", "sig_a", "sig_b", "bands"])

    return map_arrow(docs.select(F.col(key).cast("long").alias(key), text), run, f"{key} long, n long, sig_a long, sig_b long, bands array<long>", release=True)


def verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int, key: str, text: str) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null")
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("parts"))
    members = pairs.join(parts, "a").select(F.col("b").alias("id"), "a", F.pmod(F.xxhash64("b"), "parts").alias("part"), F.lit(1).alias("kind"))
    pivots = parts.select(F.col("a").alias("id"), "a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"))
    # Both sides grow with the corpus, so neither is broadcast at any size.
    rows = members.unionByName(pivots).hint("merge").join(texts, "id").select("a", "part", "kind", F.col("id").alias("b"), "text")

    def run(batches):
        known, own = None, []
        for batch in batches:
            ids, part, kind = (batch.column(x).to_numpy() for x in ("a", "part", "kind"))
            ok = np.zeros(len(ids), bool)
            data, offsets = column_bytes(batch.column("text"))
            for first, last in slices(offsets):
                for k, other in enumerate(shingle_sets(data, offsets, first, last, width), first):
                    if known != (ids[k], part[k]):  # a group's pivot comes first
                        known, own = (ids[k], part[k]), []
                    if kind[k] == 0:
                        own.append(other)
                        continue
                    for mine in own:
                        n = len(np.intersect1d(mine, other, assume_unique=True))
                        ok[k] |= n > 0 and 100 * n >= percent * (len(mine) + len(other) - n)
            found = pa.array(np.flatnonzero(ok))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(found), batch.column("b").take(found)], ["a", "b"])

    return map_arrow(rows.repartition("a", "part").sortWithinPartitions("a", "part", "kind"), run, "a long, b long", release=True).distinct()


def _linked_in_blocks(members: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between members (bucket, id, n, component, text) of a bucket that lie in two components.

    Full sets are compared inside a block of the bucket; what leaves it are links that join two components, at most
    one for each member, so the rows stay in proportion to the members however large a bucket is.
    """
    counted = members.join(members.groupBy("bucket").agg(F.count("*").alias("many")), "bucket")
    parts = F.ceil(F.col("many") / F.lit(BLOCK))
    placed = counted.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    blocks = placed.withColumn("other", other).select("bucket", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "id", "n", "component", "text")

    def run(group: pa.Table) -> pa.Table:
        ids, n, comp = (group[x].to_numpy() for x in ("id", "n", "component"))
        far = (comp[:, None] != comp[None, :]) & (100 * np.minimum(n[:, None], n[None, :]) >= percent * np.maximum(n[:, None], n[None, :]))
        found = []
        if far.any():
            data, offsets = column_bytes(group["text"])
            sets = []
            for a, b in slices(offsets):
                sets += shingle_sets(data, offsets, a, b, width)
            owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            _, element = np.unique(np.concatenate(sets), return_inverse=True)
            edge = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
            mark = np.zeros(int(element.max()) + 1, bool)
            comp = comp.copy()
            for k in np.flatnonzero(far.any(axis=1)).tolist():
                if not (far[k] & (comp != comp[k])).any():
                    continue
                mine = element[edge[k] : edge[k + 1]]
                mark[mine] = True
                shared = np.bincount(owner[mark[element]], minlength=len(sets))
                mark[mine] = False
                linked = np.flatnonzero((100 * shared >= percent * (n[k] + n - shared)) & (comp != comp[k]))
                for j in linked.tolist():
                    if comp[j] != comp[k]:
                        found.append((min(ids[k], ids[j]), max(ids[k], ids[j])))
                        comp[comp == comp[j]] = comp[k]
        cells = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": cells[:, 0], "b": cells[:, 1]})

    return blocks.groupBy("bucket", "p", "q").applyInArrow(run, "a long, b long").distinct()


def _with_own_sets(edges: DataFrame, classes: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """The edges, and for an id with several sets (repeated rows of other texts) edges between their classes and the id."""
    several = records.where(F.col(key).isNotNull() & (F.col("n") > 0)).groupBy(key).agg(F.min(F.struct("sig_a", "sig_b", "n")).alias("low"), F.max(F.struct("sig_a", "sig_b", "n")).alias("high")).where("low != high").select(key)
    own = records.join(several, key, "left_semi").select(F.col(key).alias("a"), "sig_a", "sig_b", "n").join(classes, ["sig_a", "sig_b", "n"]).select("a", F.col("class").alias("b")).where("a != b").distinct()
    return edges.unionByName(own)


def link(docs: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id (smallest id reachable), kept (it is its own component's smallest)."""
    bands = bands_for(percent)
    records = materialize(_records(docs, width, bands, key, text))
    real = records.where(F.col(key).isNotNull() & (F.col("n") > 0))
    classes = materialize(real.groupBy("sig_a", "sig_b", "n").agg(F.min(key).alias("class")))
    # By set as well as id: an id with several texts has several sets.
    chosen = classes.select("sig_a", "sig_b", "n", F.col("class").alias(key))
    reps = materialize(records.join(chosen, [key, "sig_a", "sig_b", "n"], "left_semi").dropDuplicates([key, "sig_a", "sig_b", "n"]).select(F.col(key).alias("id"), "n", "bands"))
    rows = reps.select("id", "n", F.explode("bands").alias("bucket")).distinct()
    pivots = rows.groupBy("bucket").agg(F.min(F.struct("id", "n")).alias("pivot"), F.count("*").alias("many")).where("many > 1")
    starred = rows.join(pivots.select("bucket", F.col("pivot.id").alias("a"), F.col("pivot.n").alias("n_a")), "bucket").where("id != a")
    near_size = F.expr(f"100 * least(n, n_a) >= {int(percent)} * greatest(n, n_a)")
    pairs = materialize(starred.where(near_size).select("a", F.col("id").alias("b")).distinct())
    edges = materialize(verified(pairs, docs, width, percent, key, text))
    joined_classes = materialize(connected_components(_with_own_sets(edges, classes, records, key)))
    # Buckets of more than two classes that several components share: a link may hide between two non-pivots.
    crowded = rows.join(pivots.where("many > 2").select("bucket"), "bucket").select("id", "n", "bucket")
    labelled = crowded.join(joined_classes.withColumnRenamed("node", "id"), "id", "left").select("id", "n", "bucket", F.coalesce("component", "id").alias("component"))
    labelled = materialize(labelled)
    mixed = labelled.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("bucket")
    members = labelled.join(mixed, "bucket")
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null")
    more = materialize(_linked_in_blocks(members.hint("merge").join(texts, "id"), width, percent))
    if not more.isEmpty():
        discard(joined_classes)
        joined_classes = materialize(connected_components(_with_own_sets(edges.unionByName(more), classes, records, key)))
    by_class = classes.join(joined_classes.withColumnRenamed("node", "class"), "class", "left").select("sig_a", "sig_b", "n", F.coalesce("component", "class").alias("found"))
    out = records.select(key, "sig_a", "sig_b", "n").join(by_class, ["sig_a", "sig_b", "n"], "left")
    component = F.when(F.col(key).isNull() | (F.col("n") == 0), F.col(key)).otherwise(F.col("found"))
    done = materialize(out.select(key, F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col(key) == component, F.lit(True)).alias("kept")))
    for used in (records, classes, reps, pairs, edges, joined_classes, labelled, more):
        discard(used)
    return done
