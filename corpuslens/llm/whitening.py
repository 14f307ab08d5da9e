"""Whitening of embeddings by spectrum slicing (operator 11).

Entries c become the integers x = floor(64 * c) + 1,000,000. Spark adds up, exactly and in integers, the rows, their
sums and the products of what is left of x when the whole number nearest to the mean is taken away; the rest of the
centring (less than one unit) is exact too, so the covariance is the true one, rounded once.

The covariance has one row and column for each dimension and is solved on the driver. The number of eigenvalues above
a shift is the number of positive pivots of an LDL' factorisation of the shifted matrix (Sylvester's law of inertia);
bisection by these counts slices the spectrum until each leading eigenvalue has an interval of its own, in which
Rayleigh quotient iteration, which converges cubically, finds it. Counts on both sides of what was found certify its
number. Eigenvalues too close to be told apart (repeated ones) are found together by block inverse iteration.

Rows whose vector is null, empty or holds null or non-finite entries are left out; so are vectors of another length
than the commonest one (of several, the shortest). Rows with a null id are kept, repeated rows count as often as they
stand there. Integers beyond +-2**62 stand there, deviations beyond a long at its end. Components whose eigenvalue is
below 1e-11 of the largest are not numerically different from zero and are left out, so equal rows give no row, as an
empty table does. Other columns are left aside, so their names cannot clash.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import discard, map_arrow, materialize

COMPONENTS, SCALE, ORIGIN = 32, 64.0, 1_000_000
#: Integers stand at these ends, at most.
END = 1 << 62
#: Eigenvalues below this share of the largest count as zero.
LEAST = 1e-11
#: Rows that a task works on at once.
ROWS = 2048
#: A sum of products is carried in LIMBS parts of 30 bits, the last one with its sign.
LIMBS = 7
_EPS = np.finfo(float).eps


def integers(lists: pa.Array, size: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and integer vectors of the usable rows, by length of vector (or of one length only)."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    for n in np.unique(lengths).tolist() if size is None else [size]:
        rows = np.flatnonzero(lengths == n)
        if not n or not len(rows):
            continue
        cells = lists.take(pa.array(rows)).flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(-1, n)
        good = np.isfinite(cells).all(axis=1)
        with np.errstate(over="ignore"):
            whole = np.clip(np.floor(SCALE * cells[good]), -float(END), float(END))
        x = np.minimum(whole.astype(np.int64), END - ORIGIN) + ORIGIN
        for a in range(0, len(x), ROWS):
            yield rows[good][a : a + ROWS], x[a : a + ROWS]


# --- the symmetric eigenproblem, on the driver ---


def count_above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix lie above the shift: positive pivots of LDL' (Bunch-Kaufman)."""
    a = matrix - shift * np.eye(len(matrix))
    n, k, above, alpha = len(a), 0, 0, (1 + 17**0.5) / 8

    def swap(i: int, j: int) -> None:
        if i != j:
            a[[i, j]] = a[[j, i]]
            a[:, [i, j]] = a[:, [j, i]]

    while k < n:
        own, below, two = abs(a[k, k]), np.abs(a[k + 1 :, k]), False
        most = below.max(initial=0.0)
        if most > 0 and own < alpha * most:
            r = k + 1 + int(below.argmax())
            column = np.abs(a[k:, r])
            column[r - k] = 0
            other = column.max()
            if own * other >= alpha * most * most:
                pass
            elif abs(a[r, r]) >= alpha * other:
                swap(k, r)
            else:
                swap(k + 1, r)
                two = True
        if two:  # a block of both signs
            above += 1
            left = a[k + 2 :, k : k + 2].copy()
            a[k + 2 :, k + 2 :] -= left @ np.linalg.solve(a[k : k + 2, k : k + 2], left.T)
            k += 2
            continue
        pivot = a[k, k]
        above += pivot > 0
        if pivot != 0:
            column = a[k + 1 :, k].copy()
            a[k + 1 :, k + 1 :] -= np.outer(column, column / pivot)
        k += 1
    return int(above)


def _solve(matrix: np.ndarray, shift: float, right: np.ndarray, nudge: float) -> np.ndarray:
    for _ in range(8):
        try:
            out = np.linalg.solve(matrix - shift * np.eye(len(matrix)), right)
            if np.isfinite(out).all():
                return out
        except np.linalg.LinAlgError:
            pass
        shift += nudge
        nudge *= 2
    raise ArithmeticError("no shift near the eigenvalue can be solved for")


def _iterate(matrix: np.ndarray, low: float, high: float, start: np.ndarray, small: float) -> tuple[float, np.ndarray] | None:
    """Rayleigh quotient iteration from the middle of an interval; None where it leaves the interval."""
    v = start / np.linalg.norm(start)
    for _ in range(2):
        v = _solve(matrix, (low + high) / 2, v, small)
        v /= np.linalg.norm(v)
    for _ in range(12):
        value = float(v @ matrix @ v)
        if not low < value <= high:
            return None
        if np.linalg.norm(matrix @ v - value * v) <= small:
            return value, v
        v = _solve(matrix, value, v, small)
        v /= np.linalg.norm(v)
    return None


def leading(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors as columns; certified by counts."""
    n = len(matrix)
    most = min(most, n)
    norm = float(np.abs(matrix).sum(axis=1).max(initial=0.0))
    if not norm:
        return np.empty(0), np.empty((n, 0))
    small = 4 * n**0.5 * _EPS * norm
    rng = np.random.default_rng(11)
    counts: dict[float, int] = {}

    def above(x: float) -> int:
        if x not in counts:
            counts[x] = count_above(matrix, x)
        return counts[x]

    ends = -norm * (1 + 1e-3), norm * (1 + 1e-3)
    open_, found = [(*ends, n, 0)], {}
    while open_:
        low, high, at_low, at_high = open_.pop()  # eigenvalues at_high + 1 to at_low lie in it
        if at_low == at_high or at_high >= most:
            continue
        if at_low - at_high == 1:
            pair = _iterate(matrix, low, high, rng.standard_normal(n), small)
            if pair and above(pair[0] + 4 * small) <= at_high and above(pair[0] - 4 * small) >= at_low:
                found[at_low] = pair
                continue
        middle = (low + high) / 2
        if high - low <= 4 * small or not low < middle < high:
            block = rng.standard_normal((n, at_low - at_high))
            for _ in range(4):
                block = np.linalg.qr(_solve(matrix, middle, np.linalg.qr(block)[0], small))[0]
            for j in range(block.shape[1]):
                found[at_high + 1 + j] = float(block[:, j] @ matrix @ block[:, j]), block[:, j]
            continue
        inside = above(middle)
        open_.append((low, middle, at_low, inside))
        open_.append((middle, high, inside, at_high))
    vectors = np.empty((n, len(found)))
    for j, number in enumerate(sorted(found)):
        v = found[number][1]
        for _ in range(2):
            v = v - vectors[:, :j] @ (vectors[:, :j].T @ v)
            v /= np.linalg.norm(v)
        vectors[:, j] = v
    values = np.einsum("ij,ij->j", vectors, matrix @ vectors)
    order = np.argsort(-values, kind="stable")[:most]
    return values[order], vectors[:, order]


# --- fitting and applying ---


@dataclasses.dataclass(frozen=True)
class Whitening:
    """What applying needs: rows of the fit, their exact sums, a whole number near each mean, and the components."""

    size: int
    n: int
    sums: tuple[int, ...]
    near: np.ndarray
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @property
    def explained(self) -> np.ndarray:
        """Each component's share of the total variance."""
        return self.values / np.trace(self.covariance)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n as doubles."""
        rest = np.array([(s - self.n * m) / self.n for s, m in zip(self.sums, self.near.tolist(), strict=True)])
        return (x - self.near).astype(float) - rest

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Projections on the components, over the roots of their eigenvalues."""
        return self.centred(x) @ self.vectors / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """The sum over dimensions of (n * x - S) ** 2, exact."""
        rest = [s - self.n * m for s, m in zip(self.sums, self.near.tolist(), strict=True)]
        most = self.n * max(map(int, (np.abs(x - self.near).max(initial=0),))) + max(map(abs, rest))
        whole = np.int64 if self.size * most * most < 1 << 63 else object
        part = (x - self.near).astype(whole) * self.n - np.array(rest, whole)
        return np.minimum((part * part).sum(axis=1), (1 << 63) - 1).astype(np.int64)


def _products(y: np.ndarray) -> np.ndarray:
    """y' y of integers, as Python's integers; doubles multiply exactly while no sum passes 2**53."""
    most = int(np.abs(y).max(initial=0))
    out = np.zeros((y.shape[1],) * 2, object)
    if most < 1 << 26:
        step, cells = max(1, (1 << 53) // max(1, most * most)), y.astype(float)
        for a in range(0, len(y), step):
            out += (cells[a : a + step].T @ cells[a : a + step]).astype(np.int64).astype(object)
        return out
    cells = y.astype(object)
    return cells.T @ cells


def _rows(df: DataFrame, key: str, vector: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("vector"))


def _sums(rows: DataFrame) -> tuple[int, int, list[int]]:
    """Length of vector, rows and sums by dimension, of the commonest length."""

    def add(batches):
        total: dict[int, list] = {}
        for batch in batches:
            for _, x in integers(batch.column(1)):
                own = total.setdefault(x.shape[1], [0, np.zeros(x.shape[1], np.int64), np.zeros(x.shape[1], np.int64)])
                own[0] += len(x)
                own[1] += (x >> 32).sum(axis=0)
                own[2] += (x & 0xFFFFFFFF).sum(axis=0)
        for size, (n, high, low) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(size, size, np.int32)), pa.array(np.arange(size, dtype=np.int32)), pa.array(np.full(size, n)), pa.array(high), pa.array(low)], ["size", "at", "n", "high", "low"])

    parts = map_arrow(rows, add, "size int, at int, n long, high long, low long")
    totals = materialize(parts.groupBy("size", "at").agg(*(F.sum(F.col(x).cast("decimal(38,0)")).alias(x) for x in ("n", "high", "low"))))
    best = totals.where("at = 0").orderBy(F.desc("n"), "size").select("size").first()
    own = totals.where(F.col("size") == best[0]).orderBy("at").collect() if best else []  # one row a dimension
    discard(totals)
    return (best[0], int(own[0].n), [(int(r.high) << 32) + int(r.low) for r in own]) if own else (0, 0, [])


def _covariance(rows: DataFrame, size: int, n: int, sums: list[int], near: np.ndarray) -> np.ndarray:
    """The covariance, divisor n, rounded once: every product is of centred integers and exact."""
    upper = np.triu_indices(size)

    def multiply(batches):
        total = np.zeros((size, size), object)
        for batch in batches:
            for _, x in integers(batch.column(1), size):
                total += _products(x - near)
        cells = total[upper]
        limbs = [pa.array(((cells >> 30 * k) & ((1 << 30) - 1) if k < LIMBS - 1 else cells >> 30 * k).astype(np.int64)) for k in range(LIMBS)]
        yield pa.RecordBatch.from_arrays([pa.array(upper[0].astype(np.int32)), pa.array(upper[1].astype(np.int32)), *limbs], ["i", "j", *(f"g{k}" for k in range(LIMBS))])

    parts = map_arrow(rows, multiply, ", ".join(["i int, j int", *(f"g{k} long" for k in range(LIMBS))]))
    out = np.zeros((size, size))
    rest = [s - n * m for s, m in zip(sums, near.tolist(), strict=True)]
    # One row for each pair of dimensions, however many vectors there are.
    for r in parts.groupBy("i", "j").agg(*(F.sum(f"g{k}").alias(f"g{k}") for k in range(LIMBS))).toLocalIterator():
        product = sum(int(r[2 + k]) << 30 * k for k in range(LIMBS))
        out[r.i, r.j] = out[r.j, r.i] = (n * product - rest[r.i] * rest[r.j]) / (n * n)
    return out


def fit(df: DataFrame, components: int = COMPONENTS, key: str = "vec_id", vector: str = "embedding") -> Whitening:
    """Means, covariance and leading components of all usable vectors."""
    rows = _rows(df, key, vector)
    size, n, sums = _sums(rows)
    near = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    covariance = _covariance(rows, size, n, sums, near) if n else np.zeros((0, 0))
    values, vectors = leading(covariance, components)
    kept = values > LEAST * values.max(initial=0.0)
    return Whitening(size, n, tuple(sums), near, covariance, values[kept], vectors[:, kept])


def identity_error(df: DataFrame, model: Whitening, key: str = "vec_id", vector: str = "embedding") -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity; two passes, centred before multiplying."""
    k, size = len(model.values), model.size
    if not k:
        return 0.0
    rows = _rows(df, key, vector)

    def add(batches):
        total = np.zeros(k)
        for batch in batches:
            for _, x in integers(batch.column(1), size):
                total += model.whiten(x).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(total)], ["i", "s"])

    mean = np.zeros(k)
    for r in map_arrow(rows, add, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect():  # one row a component
        mean[r.i] = r.s / model.n

    def multiply(batches):
        total = np.zeros((k, k))
        for batch in batches:
            for _, x in integers(batch.column(1), size):
                w = model.whiten(x) - mean
                total += w.T @ w
        cells = np.arange(k * k, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total.ravel())], ["cell", "s"])

    own = map_arrow(rows, multiply, "cell int, s double").groupBy("cell").agg((F.sum("s") / F.lit(model.n)).alias("c"))
    return float(own.agg(F.max(F.abs(F.col("c") - F.when(F.col("cell") % (k + 1) == 0, 1.0).otherwise(0.0)))).first()[0])


def transform(df: DataFrame, model: Whitening, error: float, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: one row for each usable vector and component."""
    k, explained = len(model.values), model.explained if len(model.values) else np.empty(0)

    def run(batches):
        for batch in batches:
            for rows, x in integers(batch.column(1), model.size) if k else ():
                m = len(rows)
                columns = {
                    "vec_id": batch.column(0).take(pa.array(np.repeat(rows, k))), "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), "n": pa.array(np.full(m * k, model.n)),
                    "deviation": pa.array(np.repeat(model.deviation(x), k)), "whitened": pa.array(model.whiten(x).ravel()), "explained": pa.array(np.tile(explained, m)), "identity_error": pa.array(np.full(m * k, error)),
                }
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return map_arrow(_rows(df, key, vector), run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whiten(df: DataFrame, components: int = COMPONENTS, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """fit() and transform() over the same table."""
    model = fit(df, components, key, vector)
    return transform(df, model, identity_error(df, model, key, vector), key, vector)
