"""Toxicity: a bidirectional GRU with attention pooling over character and word inputs, in numpy.

A word enters as the embedding of its hash bucket beside the scaled sum of
the embeddings of its character n-grams (with word-edge marks). Windows of
``WINDOW`` words start every ``STRIDE`` words, so all of a text is covered and
neighbours overlap; a GRU reads each window in both directions, attention
pools the states, a logistic unit scores the pooled vector. A document's score
is that of its highest-scoring window, over all windows of its whole text.

Training (on the driver, Adam with backpropagation through time written out
here) takes a bounded sample of labelled rows: ``max_rows`` by a hash of
doc_id. Labels belong to documents, so each step learns from the windows that
currently score highest in their document; the first steps, while scores mean
nothing, learn from one window drawn from each.

Edge cases: null or empty text is one window without words, scored by the
bias alone; equal texts get equal scores; without labelled rows of both kinds
every score is 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .columnar import Words, columns, slices
from .quality import labelled_rows

WINDOW, STRIDE = 32, 16
HIDDEN, WORD_DIM, CHAR_DIM, ATTENTION = 8, 8, 12, 8
WORD_BUCKETS, CHAR_BUCKETS = 1 << 13, 1 << 15
GRAMS = (3, 4, 5, 6)
_EDGES = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_BATCH = 4096


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Inputs:
    """Bucket numbers of distinct words: ``word`` and, flattened, the character n-grams from ``first`` on."""

    def __init__(self, words: list[bytes]):
        n = len(words)
        plain = [b"<" + w.lower().strip(_EDGES) + b">" for w in words]
        size = np.fromiter(map(len, plain), np.int64, n)
        data = np.frombuffer(b"".join(plain), np.uint8).astype(np.uint64)
        start = np.cumsum(size) - size
        place = (np.arange(len(data)) - np.repeat(start, size)).astype(np.int32)
        left = np.repeat(size.astype(np.int32), size) - place  # bytes from here to the end of the word
        owner = np.repeat(np.arange(n, dtype=np.int32), size)
        with np.errstate(over="ignore"):
            powers = np.multiply.accumulate(np.full(int(size.max()) if n else 1, 1099511628211, np.uint64))
            whole = np.add.reduceat(data * powers[place], start) if n else np.empty(0, np.uint64)
            self.word = self._bucket(whole, WORD_BUCKETS)
            codes, owners = [], []
            for order in GRAMS:
                at = np.flatnonzero(left >= order)
                code = np.full(len(at), order, np.uint64)
                for k in range(order):
                    code = code * np.uint64(257) + data[at + k]
                codes.append(self._bucket(code, CHAR_BUCKETS))
                owners.append(owner[at])
        owners = np.concatenate(owners)
        self.grams = np.concatenate(codes)[np.argsort(owners, kind="stable")]
        self.counts = np.bincount(owners, minlength=n)
        self.first = np.cumsum(self.counts) - self.counts
        self.owner = np.repeat(np.arange(n, dtype=np.int32), self.counts)
        self.scale = (1 / np.sqrt(np.maximum(self.counts, 1))).astype(np.float32)

    def some(self, words: np.ndarray) -> "Inputs":
        """The inputs of the words with these (ascending) numbers only."""
        part = object.__new__(Inputs)
        part.word, part.counts, part.scale = self.word[words], self.counts[words], self.scale[words]
        part.first = np.cumsum(part.counts) - part.counts
        part.owner = np.repeat(np.arange(len(words)), part.counts)
        part.grams = self.grams[np.arange(len(part.owner)) - part.first[part.owner] + self.first[words][part.owner]]
        return part

    @staticmethod
    def _bucket(code: np.ndarray, buckets: int) -> np.ndarray:
        code = (code ^ (code >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return (code >> np.uint64(64 - buckets.bit_length() + 1)).astype(np.int32)

    def vectors(self, p: dict) -> np.ndarray:
        """One row of inputs a word, and a last row of zeros for places after a text's end."""
        n = len(self.word)
        x = np.zeros((n + 1, WORD_DIM + CHAR_DIM), np.float32)
        x[:n, :WORD_DIM] = p["word"][self.word]
        full = np.flatnonzero(self.counts)  # a short word can lack n-grams
        for at in range(0, len(full), _BATCH):  # blocks bound the gathered rows
            some = full[at:at + _BATCH]
            low, high = self.first[some[0]], self.first[some[-1]] + self.counts[some[-1]]
            sums = np.add.reduceat(p["char"][self.grams[low:high]], self.first[some] - low, axis=0)
            x[some, WORD_DIM:] = sums * self.scale[some, None]
        return x


def windows(counts: np.ndarray, rows: np.ndarray, codes: np.ndarray, blank: int) -> tuple[np.ndarray, np.ndarray]:
    """(windows as word codes, ``blank`` after the end; row of each) of all overlapping windows of every row."""
    n = np.maximum(1, 1 + np.ceil((counts - WINDOW) / STRIDE).astype(np.int64))
    row = np.repeat(np.arange(len(counts), dtype=np.int32), n)
    first = ((np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * STRIDE).astype(np.int32)
    padded = np.append(codes, blank).astype(np.int32)
    out = np.empty((len(row), WINDOW), np.int32)
    for k in range(WINDOW):  # a column at a time: no wide temporaries
        at = np.where(first + k < counts[row], rows[:-1][row] + first + k, len(codes))
        out[:, k] = padded[at]
    return out, row


def start(seed: int = 4) -> dict:
    rng = np.random.default_rng(seed)
    d, h = WORD_DIM + CHAR_DIM, HIDDEN

    def normal(*shape, scale):
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    p = {"word": normal(WORD_BUCKETS, WORD_DIM, scale=0.1), "char": normal(CHAR_BUCKETS, CHAR_DIM, scale=0.1),
         "attend": normal(2 * h, ATTENTION, scale=0.3), "attend_b": np.zeros(ATTENTION, np.float32),
         "query": normal(ATTENTION, scale=0.3), "out": normal(2 * h, scale=0.3), "out_b": np.full(1, -1.0, np.float32)}
    for side in "fb":
        p["x" + side] = normal(d, 3 * h, scale=d ** -0.5)
        p["h" + side] = normal(h, 3 * h, scale=h ** -0.5)
        p["b" + side] = np.zeros(3 * h, np.float32)
    return p


def _gru(p: dict, side: str, projected: np.ndarray, codes: np.ndarray, live: np.ndarray, keep: bool):
    """States [time, window, hidden]; ``projected``: inputs of each word for this direction; caches if ``keep``."""
    steps, count, h = codes.shape[0], codes.shape[1], HIDDEN
    states = np.zeros((steps, count, h), np.float32)
    state, cache = np.zeros((count, h), np.float32), []
    for t in (range(steps) if side == "f" else range(steps - 1, -1, -1)):
        x = projected[codes[t]]
        u = state @ p["h" + side]
        gates = _sigmoid(x[:, :2 * h] + u[:, :2 * h])
        new = np.tanh(x[:, 2 * h:] + gates[:, h:] * u[:, 2 * h:])
        after = new + gates[:, :h] * (state - new)
        after = np.where(live[t][:, None], after, state)
        if keep:
            cache.append((t, state, gates, new, u[:, 2 * h:]))
        state = states[t] = after
    return states, cache


def forward(p: dict, x: np.ndarray, codes: np.ndarray, blank: int, keep: bool = False, projected=None):
    """Logit of every window; ``codes``: windows by time."""
    codes = np.ascontiguousarray(codes.T)
    live = codes != blank
    projected = projected or {s: x @ p["x" + s] + p["b" + s] for s in "fb"}
    forth, cache_f = _gru(p, "f", projected["f"], codes, live, keep)
    back, cache_b = _gru(p, "b", projected["b"], codes, live, keep)
    states = np.concatenate([forth, back], 2)
    hidden = np.tanh(states @ p["attend"] + p["attend_b"])
    weight = np.where(live, hidden @ p["query"], np.float32(-1e9))
    weight = np.exp(weight - weight.max(0)) * live
    weight = weight / np.maximum(weight.sum(0), 1e-9)
    pooled = np.einsum("tb,tbh->bh", weight, states)
    logit = pooled @ p["out"] + p["out_b"]
    return logit, (codes, live, states, hidden, weight, pooled, cache_f, cache_b) if keep else None


def backward(p: dict, x: np.ndarray, inputs: Inputs, kept, slope: np.ndarray) -> dict:
    """Gradients of sum(slope * logit)."""
    codes, live, states, hidden, weight, pooled, cache_f, cache_b = kept
    h, g = HIDDEN, {}
    g["out"], g["out_b"] = pooled.T @ slope, slope.sum(keepdims=True)
    d_pooled = slope[:, None] * p["out"]
    d_states = weight[:, :, None] * d_pooled
    along = np.einsum("tbh,bh->tb", states, d_pooled)
    d_weight = weight * (along - (weight * along).sum(0))
    d_hidden = d_weight[:, :, None] * p["query"] * (1 - hidden ** 2)
    g["query"] = np.einsum("tbk,tb->k", hidden, d_weight)
    g["attend"], g["attend_b"] = np.einsum("tbh,tbk->hk", states, d_hidden), d_hidden.sum((0, 1))
    d_states = d_states + d_hidden @ p["attend"].T
    d_x = np.zeros_like(x)
    for side, cache, part in (("f", cache_f, slice(0, h)), ("b", cache_b, slice(h, 2 * h))):
        d_next = np.zeros((codes.shape[1], h), np.float32)
        g_h, g_in = np.zeros_like(p["h" + side]), np.zeros((len(x), 3 * h), np.float32)
        for t, before, gates, new, u in reversed(cache):
            d = d_states[t][:, part] + d_next
            on = live[t][:, None]
            d_after = d * on
            z, r = gates[:, :h], gates[:, h:]
            d_new = d_after * (1 - z) * (1 - new ** 2)
            d_z = d_after * (before - new) * z * (1 - z)
            d_r = d_new * u * r * (1 - r)
            d_u = np.concatenate([d_z, d_r, d_new * r], 1)
            np.add.at(g_in, codes[t], np.concatenate([d_z, d_r, d_new], 1))
            g_h += before.T @ d_u
            d_next = d * ~on + d_after * z + d_u @ p["h" + side].T
        g["h" + side], g["b" + side], g["x" + side] = g_h, g_in.sum(0), x.T @ g_in
        d_x += g_in @ p["x" + side].T
    g["word"], g["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
    d_words = d_x[:-1]
    touched = np.flatnonzero(np.abs(d_words).sum(1))
    np.add.at(g["word"], inputs.word[touched], d_words[touched, :WORD_DIM])
    is_touched = np.zeros(len(d_words), bool)
    is_touched[touched] = True
    at = np.flatnonzero(is_touched[inputs.owner])
    owner = inputs.owner[at]
    np.add.at(g["char"], inputs.grams[at], d_words[owner, WORD_DIM:] * inputs.scale[owner][:, None])
    return g


def train(texts: list, toxic: np.ndarray, epochs: int = 12, min_steps: int = 360, rate: float = 0.01,
          batch: int = 128, seed: int = 4) -> dict | None:
    """Parameters learnt from whole texts and their labels; None unless both labels occur."""
    toxic = np.asarray(toxic, bool)
    if not toxic.any() or toxic.all():
        return None
    words = Words(pa.array([t or "" for t in texts], pa.large_string()))
    inputs, blank = Inputs(words.distinct.to_pylist()), len(words.distinct)
    codes, row = windows(words.counts, words.rows, words.codes, blank)
    p, rng = start(seed), np.random.default_rng(seed)
    first, second = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    step, bounds = 0, np.searchsorted(row, np.arange(len(texts) + 1))
    balance = np.where(toxic, min(4.0, (~toxic).sum() / toxic.sum()), 1.0).astype(np.float32)
    epochs = max(epochs, -(-min_steps * batch // len(texts)))  # few rows: the same steps, more often over them
    warm, fresh = epochs // 4, max(1, epochs // 6)
    for epoch in range(epochs):
        if epoch < warm:
            pick = rng.integers(bounds[:-1], bounds[1:])
        elif (epoch - warm) % fresh == 0:
            logit = logits(p, inputs, codes, blank)
            pick = np.lexsort((-logit, row))[bounds[:-1]]
        order = rng.permutation(len(texts))
        pace = rate * (1 - epoch / epochs) + 0.001
        for at in range(0, len(order), batch):
            docs = order[at:at + batch]
            used, mine = np.unique(codes[pick[docs]], return_inverse=True)
            used = used[used != blank]
            part = inputs.some(used)
            x = part.vectors(p)
            logit, kept = forward(p, x, mine.reshape(len(docs), WINDOW), len(used), keep=True)
            slope = (_sigmoid(logit) - toxic[docs]) * (balance[docs] if epoch < warm else 1) / len(docs)
            step += 1
            for k, d in backward(p, x, part, kept, slope.astype(np.float32)).items():
                first[k] += 0.1 * (d - first[k])
                second[k] += 0.01 * (d * d - second[k])
                p[k] -= pace * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-6)
    return p


def logits(p: dict, inputs: Inputs, codes: np.ndarray, blank: int) -> np.ndarray:
    """Logits of all windows."""
    x = inputs.vectors(p)
    projected = {s: x @ p["x" + s] + p["b" + s] for s in "fb"}
    return np.concatenate([forward(p, x, codes[i:i + _BATCH], blank, projected=projected)[0]
                           for i in range(0, len(codes), _BATCH)])


def score_texts(p: dict | None, texts: pa.Array) -> np.ndarray:
    """The highest window score of every text."""
    if p is None:
        return np.zeros(len(texts))
    words = Words(texts)
    inputs, blank = Inputs(words.distinct.to_pylist()), len(words.distinct)
    codes, row = windows(words.counts, words.rows, words.codes, blank)
    best = np.full(len(texts), -np.inf)
    np.maximum.at(best, row, logits(p, inputs, codes, blank).astype(float))
    return 1 / (1 + np.exp(-best))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 3000, max_text_bytes: int = 256 << 10, **how) -> dict | None:
    """Parameters learnt from at most ``max_rows`` labelled documents of at most ``max_text_bytes``."""
    short = docs.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= max_text_bytes)
    rows = labelled_rows(short, labels, "toxic", max_rows).toPandas().sort_values(["doc_id", "text"], kind="stable")
    return train(rows["text"].tolist(), rows["toxic"].to_numpy() == 1, **how)


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id and score of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score_texts(shared.value, b.column(1)))],
                                             ["doc_id", "score"])

    return columns(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, score double")
