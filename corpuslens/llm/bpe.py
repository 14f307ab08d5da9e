"""Byte-level BPE by corpus-level merge replay (operator 3).

The distinct words of a chunk of the corpus are encoded together. An inverted index leads from a token pair (by
the rank of its merge) to the positions, in any word, where that pair stands. Merges are applied in rank order: the
lowest rank's positions are taken, leftmost first, and each merge there updates its two neighbours only, whose new
pairs enter the index. Positions whose pair has changed meanwhile are passed over. So a word of n bytes takes up to
n merges and 2n new index entries, however long it is.

Null texts count as empty: no tokens. Repeated rows and equal words have equal results; texts and words of any
length are encoded whole. Other columns are left aside, so their names cannot clash. An empty table gives none.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from corpuslens.llm.common import column_bytes, map_arrow, slices
from corpuslens.llm.pretokens import split_texts

NONE = (1 << 31) - 1
#: Words that a worker remembers, of so many bytes at most; the store is emptied beyond, which changes no result.
REMEMBERED, SHORT = 250_000, 64


class MergeReplay:
    """A rank file's encoder and decoder."""

    def __init__(self, ranks_path: str):
        with open(ranks_path, "rb") as file:
            pairs = [line.split() for line in file if line.strip()]
        rank = {base64.b64decode(a): int(b) for a, b in pairs}
        self.token_bytes = {v: k for k, v in rank.items()}
        self.of_byte = np.array([rank[bytes([k])] for k in range(256)], np.int64)
        keys, values = [], []
        for token, r in rank.items():
            for cut in range(1, len(token)):
                left, right = rank.get(token[:cut]), rank.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(r)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.values = np.array(keys, np.int64)[order], np.array(values, np.int64)[order]
        self.merges = dict(zip(keys, values, strict=True))
        self.memory: dict[bytes, np.ndarray] = {}

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge, or NONE."""
        key = left << np.int64(32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], NONE)

    def replay(self, words: list[bytes]) -> list[np.ndarray]:
        """Token ids of each word; no word is empty."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        cells = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        n = len(cells)
        begin = np.concatenate([[0], np.cumsum(lengths)])
        following, preceding = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        following[begin[1:] - 1] = n  # n and -1: beyond the word
        preceding[begin[:-1]] = -1
        found = np.full(n, NONE, np.int32)
        inner = np.flatnonzero(following < n)
        found[inner] = self.pair_ranks(cells[inner], cells[inner + 1])
        # The index: positions by rank, each list ascending at first; its ranks are a heap.
        order = np.argsort(found, kind="stable")[: int((found < NONE).sum())]
        ranks, edge = np.unique(found[order], return_index=True)
        index = {r: own.tolist() for r, own in zip(ranks.tolist(), np.split(order, edge[1:]), strict=True)} if len(order) else {}
        heap = list(index)
        token, after, before, rank = (array("i", x.astype(np.int32).tobytes()) for x in (cells, following, preceding, found))
        alive = bytearray(b"\1") * n
        merges = self.merges

        def file(at: int, pair: int) -> int:
            """Enter a position under its new pair."""
            new = rank[at] = merges.get(pair, NONE)
            if new != NONE:
                own = index.get(new)
                if own is None:
                    index[new] = [at]
                    heapq.heappush(heap, new)
                else:
                    own.append(at)
            return new

        while heap:
            r = heapq.heappop(heap)
            spots = index.pop(r)
            spots.sort()
            for k, at in enumerate(spots, 1):
                if rank[at] != r:
                    continue
                gone = after[at]
                follow = after[at] = after[gone]
                token[at], rank[gone], alive[gone] = r, NONE, 0
                lowest = NONE
                if follow < n:
                    before[follow] = at
                    lowest = file(at, r << 32 | token[follow])
                else:
                    rank[at] = NONE
                left = before[at]
                if left >= 0:
                    lowest = min(lowest, file(left, token[left] << 32 | r))
                if lowest < r and k < len(spots):  # that merge comes before the other positions
                    index[r] = spots[k:] + index.get(r, [])
                    heapq.heappush(heap, r)
                    break
        lives = np.frombuffer(alive, np.uint8) > 0
        kept = np.concatenate([[0], np.cumsum(lives)])[begin]
        ids = np.frombuffer(token, np.int32)[lives].astype("<u4")
        return [ids[a:b] for a, b in zip(kept[:-1].tolist(), kept[1:].tolist(), strict=True)]

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of distinct words; short words met before are remembered."""
        fresh = [w for w in words if w not in self.memory]
        made = dict(zip(fresh, self.replay(fresh), strict=True)) if fresh else {}
        out = [made[w] if w in made else self.memory[w] for w in words]
        if len(self.memory) + len(fresh) > REMEMBERED:
            self.memory = {}
        self.memory.update((w, ids.copy()) for w, ids in made.items() if len(w) <= SHORT)
        return out

    def decode(self, ids) -> bytes:
        """The bytes that the ids stand for."""
        table = self.token_bytes
        return b"".join([table[k] for k in (ids.tolist() if isinstance(ids, np.ndarray) else ids)])

    def encode(self, text: str | None) -> list[int]:
        """Ids of one text."""
        data = np.frombuffer((text or "").encode(), np.uint8)
        if not len(data):
            return []
        words, number, _ = split_texts(data, np.array([0, len(data)]), 0, 1)
        ids = self.encode_words(words)
        return np.concatenate([ids[k] for k in number.tolist()]).tolist()


@functools.lru_cache(2)
def encoder(ranks_path: str) -> MergeReplay:
    """One encoder for each worker process and rank file."""
    return MergeReplay(ranks_path)


def encode_column(df: DataFrame, ranks_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, ids array<int>: each whole text's token ids."""

    def run(batches):
        model = encoder(ranks_path)
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            for a, b in slices(offsets):
                words, number, by_text = split_texts(data, offsets, a, b)
                ids = [x.tobytes() for x in model.encode_words(words)]
                number = number.tolist()
                rows = [np.frombuffer(b"".join([ids[k] for k in number[by_text[i] : by_text[i + 1]]]), "<u4").astype(np.int32) for i in range(b - a)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(rows, pa.list_(pa.int32()))], [key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return map_arrow(df.select(key, text), run, f"{key} {kind}, ids array<int>")


def decode_column(df: DataFrame, ranks_path: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """key, decoded binary: the bytes of each row's ids (null: none)."""

    def run(batches):
        model = encoder(ranks_path)
        for batch in batches:
            rows = [model.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], [key, "decoded"])

    kind = df.schema[key].dataType.simpleString()
    return map_arrow(df.select(key, ids), run, f"{key} {kind}, decoded binary")


def digest_round_trip(df: DataFrame, ranks_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256: encodes each whole text and decodes its ids again."""

    def run(batches):
        model = encoder(ranks_path)
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            for a, b in slices(offsets):
                words, number, by_text = split_texts(data, offsets, a, b)
                ids = model.encode_words(words)
                size = np.fromiter(map(len, ids), np.int64, len(ids))
                flat = (np.concatenate(ids) if ids else np.empty(0, "<u4")).tolist()
                edge = np.concatenate([[0], np.cumsum(size)]).tolist()
                names, parts = list(map(str, flat)), [model.token_bytes[k] for k in flat]
                shown = [" ".join(names[i:j]).encode() for i, j in zip(edge[:-1], edge[1:], strict=True)]
                read = [b"".join(parts[i:j]) for i, j in zip(edge[:-1], edge[1:], strict=True)]
                totals = np.concatenate([[0], np.cumsum(size[number])])
                number, by = number.tolist(), by_text.tolist()
                hashes, decoded = [], []
                for i, j in zip(by[:-1], by[1:], strict=True):
                    own = number[i:j]
                    hashes.append(hashlib.sha256(b" ".join([shown[k] for k in own])).hexdigest())
                    decoded.append(hashlib.sha256(b"".join([read[k] for k in own])).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(np.diff(totals[by_text]), pa.int64()), pa.array(hashes), pa.array(decoded)], [key, "n_tokens", "ids_sha256", "decoded_sha256"]
                )

    kind = df.schema[key].dataType.simpleString()
    return map_arrow(df.select(key, text), run, f"{key} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def ranks_file() -> str:
    """The public rank file's place."""
    return public_tokenizers.path("byte_bpe_50k.tiktoken")
