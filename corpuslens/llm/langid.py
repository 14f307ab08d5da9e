"""Language identification by string kernels (operator 7).

A text's blended spectrum is the set of its byte n-grams of 1 to `LONGEST` bytes (lower case), hashed into `WIDTH`
cells; the kernel of two texts is the size of their sets' intersection over the root of the product of sizes. It
is approximated from a few landmark texts (Nystroem): with K the landmarks' kernel matrix, a text's features are
its kernels with the landmarks times K**-1/2. One ridge regression against the rest is fitted for each language.
Batches of texts are scored by matrix products: presence x landmarks, then x coefficients.

Learned in one task from a bounded sample (`MOST_ROWS` texts, alike for each language, of at most `MOST_BYTES`
bytes; `LANDMARKS` of them landmarks). Null texts and texts without a letter give `und` and score 0. An empty
training sample gives `und` throughout. Of languages with equal scores the first by name is
given. Repeated rows are treated alike; texts of any length are read whole. Kept
columns with the names of the results give way to them; other columns cannot clash. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslens.llm.common import column_bytes, fit_in_task, joined, map_arrow, slices

LONGEST = 4
WIDTH = 1 << 15
MOST_ROWS, LANDMARKS, MOST_BYTES = 1200, 96, 8_192
RIDGE = 1e-3
#: Texts whose presence rows are held at once.
ROWS = 256


def presence(data: np.ndarray, offsets: np.ndarray, first: int, last: int) -> np.ndarray:
    """Rows of 0 and 1: which cells hold an n-gram of the text (the end of a text counts as three zero bytes)."""
    out = np.zeros((last - first) * WIDTH, np.uint8)
    buffer, starts = joined(data, offsets, first, last, b"\0" * (LONGEST - 1))
    n = len(buffer) - (LONGEST - 1)
    row = np.repeat(np.arange(last - first, dtype=np.int64) * WIDTH, np.diff(starts))[:n]
    code = np.zeros(n, np.uint32)
    for k in range(LONGEST):
        code = code * np.uint32(0x01000193) + buffer[k : k + n] + np.uint32(1)
        out[row + ((code * np.uint32(0x9E3779B1)) >> np.uint32(17))] = 1
    return out.reshape(last - first, WIDTH)


class Model:
    """Landmarks and coefficients."""

    def __init__(self, languages: list[str], landmarks: np.ndarray, coefficients: np.ndarray):
        self.languages, self.landmarks, self.coefficients = languages, landmarks, coefficients

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """One score for each text and language."""
        size = np.maximum(rows.sum(axis=1, dtype=np.int64), 1)
        kernel = rows.astype(np.float32) @ self.landmarks / np.sqrt(size)[:, None].astype(np.float32)
        return kernel @ self.coefficients[:-1] + self.coefficients[-1]

    def predict(self, data: np.ndarray, offsets: np.ndarray, first: int, last: int) -> tuple[list[str], np.ndarray]:
        """The likeliest language of each text (lower case) and its share, 0 to 1."""
        if not self.languages:
            return ["und"] * (last - first), np.zeros(last - first)
        names, shares = [], []
        for a in range(first, last, ROWS):
            s = self.scores(presence(data, offsets, a, min(last, a + ROWS))).astype(np.float64)
            e = np.exp(6 * (s - s.max(axis=1, keepdims=True)))
            best = s.argmax(axis=1)
            names += [self.languages[k] for k in best.tolist()]
            shares.append((e / e.sum(axis=1, keepdims=True))[np.arange(len(s)), best])
        return names, np.concatenate(shares)


def train(texts: list[str], languages: list[str]) -> Model:
    """Fit on texts and their languages."""
    names = sorted(set(languages))
    if not names:
        return Model([], np.empty((WIDTH, 0), np.float32), np.empty((1, 0), np.float32))
    data, offsets = column_bytes(pc.utf8_lower(pa.array(texts, pa.string())))
    wanted = np.array([names.index(x) for x in languages])
    # Landmarks: evenly from each language, in the sample's order.
    turn = np.empty(len(wanted), np.int64)
    for k in range(len(names)):
        own = np.flatnonzero(wanted == k)
        turn[own] = np.arange(len(own))
    chosen = np.lexsort((wanted, turn))[:LANDMARKS]
    marks = np.concatenate([presence(data, offsets, int(k), int(k) + 1) for k in chosen]).astype(np.float32)
    marks /= np.sqrt(np.maximum(marks.sum(axis=1, keepdims=True), 1))
    gram = (marks @ marks.T).astype(np.float64)
    values, vectors = np.linalg.eigh(gram)
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
    kernel = []
    for a in range(0, len(texts), ROWS):
        rows = presence(data, offsets, a, min(len(texts), a + ROWS))
        kernel.append(rows.astype(np.float32) @ marks.T / np.sqrt(np.maximum(rows.sum(axis=1, dtype=np.int64), 1))[:, None])
    features = np.concatenate(kernel).astype(np.float64) @ root
    targets = np.where(wanted[:, None] == np.arange(len(names))[None, :], 1.0, -1.0)
    mean, level = features.mean(axis=0), targets.mean(axis=0)
    centred = features - mean
    weights = np.linalg.solve(centred.T @ centred / len(texts) + RIDGE * np.eye(len(root)), centred.T @ (targets - level) / len(texts))
    return Model(names, np.ascontiguousarray(marks.T), np.vstack([root @ weights, level - mean @ weights]).astype(np.float32))


def sample(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """The rows to learn from: key, text, lang; at most MOST_ROWS, alike for each language, the same for the same table."""
    from pyspark.sql import Window

    free = docs.where(F.col(key).isNotNull() & F.col(lang).isNotNull() & (F.crc32(F.col(key).cast("string").cast("binary")) % 5 != 0))
    # Ids first, without texts: the first rows of each language in the order of a hash of the id.
    languages = free.groupBy(lang).count().orderBy(F.desc("count"), lang).limit(LANDMARKS).count() or 1
    turn = Window.partitionBy(lang).orderBy(F.xxhash64(key), key)
    ids = free.where(F.octet_length(text).between(1, MOST_BYTES)).select(key, lang, F.row_number().over(turn).alias("turn")).where(F.col("turn") <= max(1, MOST_ROWS // languages)).orderBy("turn", lang).limit(MOST_ROWS)
    return docs.where(F.octet_length(text) <= MOST_BYTES).select(key, lang, F.col(text).alias("text")).join(F.broadcast(ids.select(key, lang).distinct()), [key, lang]).select(key, "text", lang)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model:
    """Train on the sample, in a task."""
    return fit_in_task(sample(docs, text, lang, key), lambda rows: train([r[1] for r in rows], [r[2] for r in rows]))


def _has_letter(lowered: pa.Array) -> np.ndarray:
    return pc.match_substring_regex(lowered, r"\p{L}").to_numpy(zero_copy_only=False)


def predict(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns `keep` of docs (all, if not given), the language and its share, named `into`; kept columns of these names give way."""
    results = {x.lower() for x in into}
    names = [c for c in (keep if keep is not None else docs.columns) if c.lower() not in results]
    taken = docs.select(*names) if text in names else docs.select(*names, text)
    place = taken.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed: landmarks x cells

    def run(batches):
        model = shared.value
        for batch in batches:
            for a, b in slices(column_bytes(batch.column(place))[1]):
                part = batch.slice(a, b - a)
                column = pc.utf8_lower(part.column(place).fill_null(""))
                found, share = model.predict(*column_bytes(column), 0, b - a)
                own = _has_letter(column)
                found = [x if ok else "und" for x, ok in zip(found, own.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(found, pa.string()), pa.array(np.where(own, share, 0.0))], [*names, *into])

    return map_arrow(taken, run, T.StructType([*taken.schema.fields[: len(names)], T.StructField(into[0], T.StringType()), T.StructField(into[1], T.DoubleType())]), release=True)
