"""Toxicity scores by a bidirectional gated recurrent network with attention pooling (operator 6).

A word enters the network with word inputs (its log-odds of toxicity in the training sample and a learned
embedding of its hash) and character inputs (the largest, mean and smallest log-odds of its 3- to 5-grams and
the mean of their learned embeddings). Windows of `WINDOW` words, one every `STRIDE` words, cover every whole
text with overlaps, so a passage of up to `WINDOW` - `STRIDE` + 1 words is seen whole; learning uses one every
`LEARN_STRIDE`, since neighbours that share most words teach little. Two gated recurrent layers read a window forwards and backwards (gates in softsign form),
attention pools their states, and a text's score is its highest window score. All of it is trained in numpy
in one task, from a bounded sample (`MOST_TOXIC`, `MOST_CLEAN`, `MOST_BYTES`) of labelled rows.

Null texts and texts without a word score 0; texts of any length are scored whole. Rows with a null or repeated
doc_id are scored like any other; equal texts score alike. Without a toxic and a clean row to learn from, every score
is 0. A kept column with the name of the score gives way to it; other columns cannot clash. An empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslens.llm.common import column_bytes, distinct_spans, fit_in_task, joined, map_arrow, mix, slices, word_spans

#: Words of a window; words between the starts of two windows when scoring and when learning.
WINDOW, STRIDE, LEARN_STRIDE = 40, 8, 32
#: The training sample: at most so many toxic and clean rows, none of a text of more bytes.
MOST_TOXIC, MOST_CLEAN, MOST_BYTES = 1000, 2000, 16_384
HIDDEN, EMBED, WORD_ROWS, GRAM_ROWS = 6, 4, 1 << 13, 1 << 13
BUCKETS = 1 << 18
BATCH, STEPS = 128, 160
#: Words whose grams or inputs, and windows whose ranks are made at once.
WORDS_AT_ONCE, WINDOWS_AT_ONCE = 8192, 4096

_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


# --- inputs ---------------------------------------------------------------------------------------------


def read_words(data: np.ndarray, offsets: np.ndarray, first: int, last: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words, the number of each word in order, and n + 1 offsets by text."""
    buffer, starts = joined(data, offsets, first, last)
    a, b = word_spans(buffer, _IN_WORD)
    words, number = distinct_spans(buffer, a, b)
    return words, number, np.searchsorted(a, starts)


def read_words_by_slice(data: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """read_words() of all texts, a slice at a time: its work arrays take 40 bytes for every byte of text."""
    known: dict[bytes, int] = {}
    numbers, edges = [np.empty(0, np.int32)], [np.zeros(1, np.int64)]
    for first, last in slices(offsets, 250_000):
        words, number, by_text = read_words(data, offsets, first, last)
        numbers.append(np.array([known.setdefault(w, len(known)) for w in words], np.int32)[number])
        edges.append(by_text[1:] + edges[-1][-1])
    return list(known), np.concatenate(numbers), np.concatenate(edges)


def gram_codes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the 3- to 5-grams of <word>, grouped by word, the n + 1 offsets, and the words' own hashes."""
    flat = np.frombuffer(b"".join([b"<" + w + b">" for w in words]), np.uint8).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    begin = np.concatenate([[0], np.cumsum(lengths)])
    base = np.uint64(1_000_003)
    code = flat + np.uint64(1)
    owner = np.repeat(np.arange(len(words)), lengths)
    codes, owners = [], []
    for n in (2, 3, 4, 5):
        if len(flat) < n:
            break
        code = code[:-1] * base + flat[n - 1 :] + np.uint64(1)
        if n == 2:
            continue
        inside = owner[: len(code)] == owner[n - 1 :]
        codes.append(code[inside] + np.uint64(n))
        owners.append(owner[: len(code)][inside])
    if not codes:
        return np.empty(0, np.uint64), np.zeros(len(words) + 1, np.int64), np.empty(0, np.uint64)
    owners = np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    hashes = mix(np.concatenate(codes)[order])
    edges = np.searchsorted(owners[order], np.arange(len(words) + 1))
    power = np.full(int(lengths.max()), base, np.uint64)
    power[0] = 1
    scaled = (flat + np.uint64(1)) * np.cumprod(power)[np.arange(len(flat)) - np.repeat(begin[:-1], lengths)]
    return hashes, edges, mix(np.add.reduceat(scaled, begin[:-1]))


def gram_codes_by_part(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """gram_codes() of many words, some at a time; of a gram's hash only the bits that tell buckets apart are kept."""
    hashes, edges, own = [np.empty(0, np.uint32)], [np.zeros(1, np.int64)], [np.empty(0, np.uint64)]
    for a in range(0, len(words), WORDS_AT_ONCE):
        part, ends, codes = gram_codes(words[a : a + WORDS_AT_ONCE])
        hashes.append((part % np.uint64(BUCKETS)).astype(np.uint32))
        edges.append(ends[1:] + edges[-1][-1])
        own.append(codes)
    return np.concatenate(hashes), np.concatenate(edges), np.concatenate(own)


def log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float) -> np.ndarray:
    """How much likelier toxic texts have it, in standard errors, within -2 and 2 after scaling."""
    odds = np.log((toxic + 0.5) / (n_toxic - toxic + 0.5)) - np.log((clean + 0.5) / (n_clean - clean + 0.5))
    return (np.clip(odds / np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5)), -6, 6) / 3).astype(np.float32)


class Evidence:
    """Numbers of toxic and clean sample texts that have a word or gram, by hash bucket."""

    def __init__(self):
        self.words = np.zeros((2, BUCKETS), np.float64)
        self.grams = np.zeros((2, BUCKETS), np.float64)
        self.texts = np.zeros(2)

    def add(self, label: int, word_buckets: np.ndarray, gram_buckets: np.ndarray) -> None:
        self.words[label, word_buckets] += 1
        self.grams[label, gram_buckets] += 1
        self.texts[label] += 1

    def tables(self, without: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds by bucket; `without`: as if one text of that label, which has the bucket, were not there."""
        own = np.array([without == 0, without == 1], float)
        n = self.texts - own
        out = []
        for counts in (self.words, self.grams):
            clean, toxic = np.maximum(counts - own[:, None], 0)
            out.append(log_odds(toxic, clean, n[1], n[0]))
        return out[0], out[1]


# --- the network ----------------------------------------------------------------------------------------


def soft(x):
    return x / (1 + np.abs(x))


def soft_slope(y):
    return (1 - np.abs(y)) ** 2


def scatter_add(n: int, index: np.ndarray, values: np.ndarray) -> np.ndarray:
    """n rows, each the sum of the values with its index."""
    return np.column_stack([np.bincount(index, weights=column, minlength=n) for column in values.T]).astype(values.dtype)


class Network:
    """Two gated recurrent layers, attention pooling, one logit; forward and backward passes in numpy."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        inputs, h = 5 + 2 * EMBED, HIDDEN
        self.p = {
            "word": rng.normal(0, 0.05, (WORD_ROWS, EMBED)), "gram": rng.normal(0, 0.05, (GRAM_ROWS, EMBED)),
            "wx": rng.normal(0, 0.4, (inputs, 6 * h)), "bx": np.zeros(6 * h),
            "uf": rng.normal(0, 0.3, (h, 3 * h)), "ub": rng.normal(0, 0.3, (h, 3 * h)),
            "att": rng.normal(0, 0.3, 2 * h), "out": rng.normal(0, 0.3, 2 * h), "bias": np.array([-2.0]),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self._sides = ()

    def word_inputs(self, codes, tables) -> np.ndarray:
        """The input vector of each distinct word."""
        hashes, edges, own = codes
        word_odds, gram_odds = tables
        out = np.empty((len(own), 5 + 2 * EMBED), np.float32)
        for a in range(0, len(own), WORDS_AT_ONCE):
            ends, names = edges[a : a + WORDS_AT_ONCE + 1], own[a : a + WORDS_AT_ONCE]
            part, at, size = hashes[ends[0] : ends[-1]], ends[:-1] - ends[0], np.diff(ends).astype(np.float32)
            odds = gram_odds[(part % np.uint64(BUCKETS)).astype(np.int64)]
            grams = np.add.reduceat(self.p["gram"][(part % np.uint64(GRAM_ROWS)).astype(np.int64)], at, axis=0) / size[:, None]
            out[a : a + WORDS_AT_ONCE] = np.column_stack([
                word_odds[(names % np.uint64(BUCKETS)).astype(np.int64)], np.maximum.reduceat(odds, at), np.add.reduceat(odds, at) / size, np.minimum.reduceat(odds, at),
                np.log(size) / 3, self.p["word"][(names % np.uint64(WORD_ROWS)).astype(np.int64)], grams,
            ])
        return out

    def _scan(self, x, u, keep):
        """One direction: x [T, N, 3h] projected inputs, keep [T, N, 1] 1 inside the window."""
        h = HIDDEN
        state = np.zeros((x.shape[1], h), np.float32)
        out = np.empty((x.shape[0], x.shape[1], h), np.float32)
        trace = []
        for t in range(x.shape[0]):
            recur = state @ u
            gates = soft(x[t, :, : 2 * h] + recur[:, : 2 * h])
            z, r = 0.5 + 0.5 * gates[:, :h], 0.5 + 0.5 * gates[:, h:]
            c = soft(x[t, :, 2 * h :] + r * recur[:, 2 * h :])
            new = state + keep[t] * z * (c - state)
            trace.append((state, gates, z, r, c, recur[:, 2 * h :]))
            state = out[t] = new
        return out, trace

    def forward(self, projected, numbers, counts):
        """Window logits. projected [U, 6h] by distinct word; numbers [N, T] words of each window; counts [N]."""
        h, steps = HIDDEN, numbers.shape[1]
        keep = (np.arange(steps)[:, None] < counts[None, :]).astype(np.float32)[:, :, None]
        x = projected[numbers.T]
        ahead, trace_f = self._scan(x[:, :, : 3 * h], self.p["uf"], keep)
        back, trace_b = self._scan(x[::-1, :, 3 * h :], self.p["ub"], keep[::-1])
        states = np.concatenate([ahead, back[::-1]], axis=2)
        score = states @ self.p["att"]
        score = np.where(keep[:, :, 0] > 0, score, -30)
        weight = np.exp(score - score.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = (weight[:, :, None] * states).sum(axis=0)
        return pooled @ self.p["out"] + self.p["bias"][0], (x, keep, trace_f, trace_b, states, weight, pooled)

    def logits(self, numbers, counts, block: int = 4096) -> np.ndarray:
        """Window logits without what training needs, in blocks of windows."""
        out = np.empty(len(counts), np.float32)
        h = HIDDEN
        for a in range(0, len(counts), block):
            part, n = numbers[a : a + block], counts[a : a + block]
            steps = int(n.max())
            inside = np.arange(steps)[:, None] < n[None, :]
            full = inside.all(axis=1)
            states = np.empty((steps, len(n), 2 * h), np.float32)
            for side, u, order in ((0, self.p["uf"], range(steps)), (1, self.p["ub"], range(steps - 1, -1, -1))):
                state = np.zeros((len(n), h), np.float32)
                table = self._sides[side]
                for t in order:
                    x = table[part[:, t]]
                    recur = state @ u
                    g = x[:, : 2 * h] + recur[:, : 2 * h]
                    g /= 1 + np.abs(g)
                    g += 1
                    g *= 0.5
                    c = x[:, 2 * h :] + g[:, h:] * recur[:, 2 * h :]
                    c /= 1 + np.abs(c)
                    c -= state
                    c *= g[:, :h]
                    if not full[t]:
                        c *= inside[t][:, None]
                    state = state + c
                    states[t, :, side * h : side * h + h] = state
            score = np.where(inside, states @ self.p["att"], -30)
            weight = np.exp(score - score.max(axis=0))
            weight /= weight.sum(axis=0)
            out[a : a + block] = ((states @ self.p["out"]) * weight).sum(axis=0) + self.p["bias"][0]
        return out

    def project(self, inputs: np.ndarray) -> None:
        """Keep the projected inputs of the distinct words, by direction, for logits()."""
        self._sides = tuple(np.empty((len(inputs), 3 * HIDDEN), np.float32) for _ in range(2))
        for a in range(0, len(inputs), WORDS_AT_ONCE):
            both = inputs[a : a + WORDS_AT_ONCE] @ self.p["wx"] + self.p["bx"]
            self._sides[0][a : a + WORDS_AT_ONCE], self._sides[1][a : a + WORDS_AT_ONCE] = both[:, : 3 * HIDDEN], both[:, 3 * HIDDEN :]

    def _scan_back(self, grad_out, u, keep, trace):
        h = HIDDEN
        grad_u = np.zeros_like(u)
        grad_x = np.empty((len(trace), grad_out.shape[1], 3 * h), np.float32)
        carry = np.zeros((grad_out.shape[1], h), np.float32)
        for t in range(len(trace) - 1, -1, -1):
            state, gates, z, r, c, recur_c = trace[t]
            d = grad_out[t] + carry
            dk = d * keep[t]
            carry = d - dk * z
            grad_c = dk * z * soft_slope(c)
            grad_g = np.concatenate([dk * (c - state), grad_c * recur_c], axis=1) * 0.5 * soft_slope(gates)
            grad_x[t] = np.concatenate([grad_g, grad_c], axis=1)
            grad_recur = np.concatenate([grad_g, grad_c * r], axis=1)
            grad_u += state.T @ grad_recur
            carry += grad_recur @ u.T
        return grad_x, grad_u

    def gradients(self, inputs, numbers, counts, labels, weights):
        """Mean logistic loss, gradients of the parameters, and of the inputs of the distinct words."""
        projected = inputs @ self.p["wx"] + self.p["bx"]
        logit, (x, keep, trace_f, trace_b, states, weight, pooled) = self.forward(projected, numbers, counts)
        chance = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        loss = float(-(weights * np.log(np.where(labels > 0, chance, 1 - chance) + 1e-7)).mean())
        d = (weights * (chance - labels) / len(labels)).astype(np.float32)
        g = {"out": pooled.T @ d, "bias": np.array([d.sum()])}
        grad_pooled = d[:, None] * self.p["out"]
        grad_weight = (states * grad_pooled).sum(axis=2)
        grad_score = weight * (grad_weight - (weight * grad_weight).sum(axis=0))
        g["att"] = np.einsum("tnh,tn->h", states, grad_score)
        grad_states = weight[:, :, None] * grad_pooled + grad_score[:, :, None] * self.p["att"]
        grad_f, g["uf"] = self._scan_back(grad_states[:, :, :HIDDEN], self.p["uf"], keep, trace_f)
        grad_b, g["ub"] = self._scan_back(grad_states[::-1, :, HIDDEN:], self.p["ub"], keep[::-1], trace_b)
        grad_x = np.concatenate([grad_f, grad_b[::-1]], axis=2).reshape(-1, 6 * HIDDEN)
        grad_projected = scatter_add(len(projected), numbers.T.ravel(), grad_x)
        g["wx"], g["bx"] = inputs.T @ grad_projected, grad_projected.sum(axis=0)
        return loss, g, grad_projected @ self.p["wx"].T


def windows(by_text: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and number of words of each window; every word of a text is in one at least."""
    n = np.diff(by_text)
    each = np.where(n > 0, np.maximum(1, -(-(n - WINDOW) // stride) + 1), 0)
    text = np.repeat(np.arange(len(n)), each)
    k = np.arange(len(text)) - np.repeat(np.cumsum(each) - each, each)
    first = by_text[:-1][text] + k * stride
    return text, first, np.minimum(WINDOW, by_text[1:][text] - first)


def window_numbers(number: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Words of each window; beyond its end any word, since it is masked."""
    cells = first[:, None] + np.minimum(np.arange(WINDOW)[None, :], count[:, None] - 1)
    return number[cells]


class Model:
    """A trained network and the log-odds that its inputs need."""

    def __init__(self, network: Network | None, tables):
        self.network, self.tables = network, tables

    def score(self, data: np.ndarray, offsets: np.ndarray, first: int, last: int) -> np.ndarray:
        """Scores of texts first..last-1 (lower case)."""
        out = np.zeros(last - first)
        words, number, by_text = read_words(data, offsets, first, last)
        if self.network is None or not words:
            return out
        self.network.project(self.network.word_inputs(gram_codes(words), self.tables))
        text, begin, count = windows(by_text, STRIDE)
        for a in range(0, len(text), 16_384):
            part = slice(a, a + 16_384)
            logits = self.network.logits(window_numbers(number, begin[part], count[part]), count[part])
            np.maximum.at(out, text[part], 1 / (1 + np.exp(-np.clip(logits.astype(np.float64), -30, 30))))
        return out


def train(texts: list[str], labels: list[int], steps: int = STEPS) -> Model:
    """Train on labelled texts: each toxic text by its likeliest window, each clean one by its worst and another."""
    labels = np.array(labels)
    if not (labels == 1).any() or not (labels == 0).any():
        return Model(None, None)
    column = pc.utf8_lower(pa.array([t or "" for t in texts], pa.string()))
    data, offsets = column_bytes(column)
    words, number, by_text = read_words_by_slice(data, offsets)
    if not words:
        return Model(None, None)
    codes = gram_codes_by_part(words)
    hashes, edges, own = codes
    word_bucket = (own % np.uint64(BUCKETS)).astype(np.int64)
    evidence = Evidence()
    for k in range(len(texts)):
        mine = np.unique(number[by_text[k] : by_text[k + 1]])
        size = edges[mine + 1] - edges[mine]
        cells = np.arange(size.sum()) + np.repeat(edges[mine] - (np.cumsum(size) - size), size)
        evidence.add(int(labels[k]), np.unique(word_bucket[mine]), np.unique(hashes[cells] % np.uint64(BUCKETS)).astype(np.int64))
    net, rng = Network(), np.random.default_rng(11)
    text, begin, count = windows(by_text, LEARN_STRIDE)
    numbers = window_numbers(number, begin, count)
    own_tables = [evidence.tables(0), evidence.tables(1)]
    window_label = labels[text]
    n_words = len(words)
    # A word has other inputs in toxic than in clean texts, since a text's own label must not tell.
    numbers += (window_label * n_words).astype(np.int32)[:, None]
    both = lambda: np.concatenate([net.word_inputs(codes, own_tables[k]) for k in (0, 1)])
    inputs = both()
    strength = np.maximum(inputs[:, 0], inputs[:, 1])
    rank = np.empty(len(count), np.float32)
    for a in range(0, len(count), WINDOWS_AT_ONCE):
        inside, odds = np.arange(WINDOW)[None, :] < count[a : a + WINDOWS_AT_ONCE, None], strength[numbers[a : a + WINDOWS_AT_ONCE]]
        rank[a : a + WINDOWS_AT_ONCE] = np.where(inside, odds, -9).max(axis=1) + np.where(inside, np.maximum(odds - 1, 0), 0).sum(axis=1)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    rounds = 4
    step = 0
    for turn in range(rounds):
        if turn:
            inputs = both()
            net.project(inputs)
            rank = net.logits(numbers, count)
            net._sides = ()  # of the sample's words; scoring projects its own
        order = np.lexsort((-rank, text))
        leaders = order[np.concatenate([[True], text[order][1:] != text[order][:-1]])]
        positive = leaders[window_label[leaders] == 1]
        others = np.flatnonzero(window_label == 0)
        negative = np.concatenate([leaders[window_label[leaders] == 0], rng.choice(others, min(len(others), len(leaders)), replace=False)])
        for _ in range(steps // rounds):
            step += 1
            half = BATCH // 2
            chosen = np.concatenate([rng.choice(positive, half), rng.choice(negative, half)])
            local, inverse = np.unique(numbers[chosen], return_inverse=True)
            truth = window_label[chosen].astype(np.float32)
            # Every second drawn window is toxic; the weights give the loss the sample's own shares, softened.
            weights = np.where(truth > 0, 0.6, 1.4).astype(np.float32)
            _, g, grad_inputs = net.gradients(inputs[local], inverse.reshape(len(chosen), WINDOW), count[chosen], truth, weights)
            base = local % n_words
            g["word"] = scatter_add(WORD_ROWS, (own[base] % np.uint64(WORD_ROWS)).astype(np.int64), grad_inputs[:, 5 : 5 + EMBED])
            size = edges[base + 1] - edges[base]
            cells = np.arange(size.sum()) + np.repeat(edges[base] - (np.cumsum(size) - size), size)
            g["gram"] = scatter_add(GRAM_ROWS, (hashes[cells] % np.uint64(GRAM_ROWS)).astype(np.int64), np.repeat(grad_inputs[:, 5 + EMBED :] / size[:, None], size, axis=0))
            rate = 0.06 * min(1.0, step / 20) * (1 - 0.8 * step / steps)
            for k, v in net.p.items():
                m, s = moment[k]
                pace = rate / 20 if k in ("word", "gram") else rate  # a few texts must not be learned by heart
                m += 0.1 * (g[k] - m)
                s += 0.01 * (g[k] ** 2 - s)
                v -= (pace * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6) + rate * 1e-3 * v).astype(np.float32)
    return Model(net, evidence.tables())


def sample(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The labelled rows to learn from: text, toxic; the same rows for the same tables."""
    free = labels.where(F.col(key).isNotNull() & F.col("toxic").isin(0, 1) & (F.crc32(F.col(key).cast("string").cast("binary")) % 5 != 0)).groupBy(key).agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64(key), F.col(key)]
    chosen = free.where("toxic = 1").orderBy(*order).limit(2 * MOST_TOXIC).unionByName(free.where("toxic = 0").orderBy(*order).limit(2 * MOST_CLEAN))
    short = docs.where(F.octet_length(text) <= MOST_BYTES).select(key, F.col(text).alias("text"))
    # Twice as many ids are drawn as are used, for those whose text is long; both bounds are fixed.
    return short.join(F.broadcast(chosen.select(F.col(key).alias("__key"), "toxic")), F.col(key) == F.col("__key")).select(key, "text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", steps: int = STEPS) -> Model:
    """Train on the sample, in a task."""

    def learn(rows: list[tuple]) -> Model:
        toxic, clean = [r for r in rows if r[0] == 1][:MOST_TOXIC], [r for r in rows if r[0] == 0][:MOST_CLEAN]
        return train([r[2] for r in toxic + clean], [r[0] for r in toxic + clean], steps)

    return fit_in_task(sample(docs, labels, text, key).select("toxic", key, "text"), learn)


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, into: str = "score") -> DataFrame:
    """The columns `keep` of docs (all, if not given) and the score, named `into`; a kept column of that name gives way."""
    names = [c for c in (keep if keep is not None else docs.columns) if c.lower() != into.lower()]
    taken = docs.select(*names) if text in names else docs.select(*names, text)
    at = taken.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed: about 2 MB

    def run(batches):
        model = shared.value
        for batch in batches:
            for a, b in slices(column_bytes(batch.column(at))[1]):
                part = batch.slice(a, b - a)
                data, offsets = column_bytes(pc.utf8_lower(part.column(at)))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(model.score(data, offsets, 0, b - a))], [*names, into])

    return map_arrow(taken, run, T.StructType([*taken.schema.fields[: len(names)], T.StructField(into, T.DoubleType())]), release=True)
