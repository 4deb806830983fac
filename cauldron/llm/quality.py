"""Quality rules: an isolation forest over each document's rule statistics.

Base statistics are those of the usual web-text rules (words, symbols,
repeated lines and five-word windows); two of them fail a document outright.
For the others an isolation forest gives the verdict: trees of random splits,
grown on small subsamples, in which an odd document is alone after few
splits. The forest is grown on labelled rows of good quality, and the anomaly
score beyond which a document goes is calibrated on labelled rows of both
kinds: the score that best separates them, but never one that would drop more
than ``max_good_lost`` of the good ones.

The labelled rows are a bounded sample (``max_rows`` expected, by a hash of
doc_id); statistics, scores and verdicts cover every document's whole text.

Edge cases: null or empty text has no words and fails the base rule. Without
labelled rows there is no verdict: all that pass the base rules are kept. A
document labelled twice counts once, as bad if any label says so.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .columnar import WHITE, Words, columns, slices

WINDOW = 5
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEATED = 10, 20
TREES, SUBSAMPLE = 128, 256
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("word_length", "symbols", "repeats", "capitals", "marks", "variety")
_LINE_WHITE = WHITE.decode()


def _marked(values: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


_IS_SYMBOL = _marked(SYMBOLS)
_IS_CAPITAL = _marked(bytes(range(65, 91)))
_IS_MARK = _marked(bytes(c for c in range(33, 127) if not chr(c).isalnum()))
_STARTS = _marked(bytes([*range(0, 0x80), *range(0xC0, 256)])) & ~_marked(WHITE)


def repeated_words(codes: np.ndarray, rows: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each row (``rows``: n + 1 offsets) its words inside windows that the row has twice or more."""
    n, counts = len(codes), np.diff(rows)
    row = np.repeat(np.arange(len(counts)), counts)
    size = n - window + 1
    if size <= 0:
        return np.zeros(len(counts), np.int64)
    alike, base = codes[:size], int(codes.max()) + 1
    for k in range(1, window):
        alike = np.unique(alike * base + codes[k:k + size], return_inverse=True)[1]
    inside = np.flatnonzero(row[:size] == row[window - 1:])
    _, again, times = np.unique(alike[inside] * len(counts) + row[inside], return_inverse=True, return_counts=True)
    first = inside[times[again] > 1]
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, first, 1)
    np.add.at(cover, first + window, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
    return covered[rows[1:]] - covered[rows[:-1]]


def statistics(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(STATISTICS, FEATURES) of every row of a text array."""
    words = Words(texts)
    bounds, data = words.bounds, words.data

    def per_row(mask):
        total = np.concatenate([[0], np.cumsum(mask[data])])
        return total[bounds[1:]] - total[bounds[:-1]]

    n, chars, symbols = words.counts, per_row(_STARTS), per_row(_IS_SYMBOL)
    dup = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts.to_pylist()):
        if text and "\n" in text:
            full = [line for line in text.split("\n") if line.strip(_LINE_WHITE)]
            dup[i] = len(full) - len(set(full))
    repeats = repeated_words(words.codes, words.rows)
    row = np.repeat(np.arange(len(texts)), n)
    distinct = np.bincount(np.unique(row * (len(words.distinct) + 1) + words.codes) // (len(words.distinct) + 1),
                           minlength=len(texts)) if len(row) else np.zeros(len(texts))
    w, c = np.maximum(n, 1), np.maximum(chars, 1)
    features = np.stack([
        chars / w, symbols / w, repeats / w, per_row(_IS_CAPITAL) / c, per_row(_IS_MARK) / c,
        np.log(np.maximum(distinct, 1)) / np.log(np.maximum(n, 2))], 1)
    return np.stack([n, chars, symbols, dup, repeats], 1), features


def base_failed(stats: np.ndarray) -> np.ndarray:
    n, repeats = stats[:, 0], stats[:, 4]
    return (n < MIN_WORDS) | (100 * repeats > MAX_REPEATED * n)


def _expected_depth(n) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1),
                    np.where(n == 2, 1.0, 0.0))


class Forest:
    """Trees as arrays (feature, value, left, right, path length at a leaf) and the calibrated score.

    Splits are drawn over a box that spans all labelled rows, not only the
    good ones that a tree holds: a statistic that is the same in all good rows
    can then still part an odd document from them.
    """

    def __init__(self, rows: np.ndarray, box: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.limit, self.box = np.inf, np.quantile(box, [0.002, 0.998], axis=0)
        size = min(subsample, len(rows))
        self.norm = max(float(_expected_depth(size)), 1.0)
        rows = np.clip(rows, *self.box)
        self.trees = [self._grow(rows[rng.choice(len(rows), size, replace=False)], rng) for _ in range(trees)]

    def _grow(self, rows: np.ndarray, rng) -> np.ndarray:
        nodes: list[list] = []
        todo = [(rows, *self.box, 0, -1, 2)]
        deepest = max(1, int(np.ceil(np.log2(max(2, len(rows))))))
        while todo:
            mine, low, high, depth, parent, side = todo.pop()
            at = len(nodes)
            if parent >= 0:
                nodes[parent][side] = at
            open_ = np.flatnonzero(high > low)
            if depth >= deepest or len(mine) <= 1 or not len(open_):
                nodes.append([-1, 0.0, at, at, depth + float(_expected_depth(len(mine)))])
                continue
            f = int(rng.choice(open_))
            value = float(rng.uniform(low[f], high[f]))
            nodes.append([f, value, at, at, 0.0])
            left = mine[:, f] < value
            below, above = high.copy(), low.copy()
            below[f] = above[f] = value
            todo += [(mine[left], low, below, depth + 1, at, 2), (mine[~left], above, high, depth + 1, at, 3)]
        return np.array(nodes)

    def score(self, features: np.ndarray) -> np.ndarray:
        """0 to 1; the higher, the fewer splits it takes to be alone."""
        features = np.clip(features, *self.box)
        total = np.zeros(len(features))
        for tree in self.trees:
            at = np.zeros(len(features), np.int64)
            feature, value = tree[:, 0].astype(np.int64), tree[:, 1]
            left, right = tree[:, 2].astype(np.int64), tree[:, 3].astype(np.int64)
            for _ in range(64):
                f = feature[at]
                if (f < 0).all():
                    break
                below = features[np.arange(len(at)), np.maximum(f, 0)] < value[at]
                at = np.where(f < 0, at, np.where(below, left[at], right[at]))
            total += tree[at, 4]
        return 2.0 ** (-total / len(self.trees) / self.norm)


def calibrate(score: np.ndarray, bad: np.ndarray, max_good_lost: float) -> float:
    """The score above which a document is anomalous: best bad share minus good share, within ``max_good_lost``."""
    if not bad.any() or bad.all():
        return float("inf")
    cuts = np.unique(score)
    lost_bad = 1 - np.searchsorted(np.sort(score[bad]), cuts, side="right") / bad.sum()
    lost_good = 1 - np.searchsorted(np.sort(score[~bad]), cuts, side="right") / (~bad).sum()
    allowed = lost_good <= max_good_lost
    gain = np.where(allowed, lost_bad - 4 * lost_good, -np.inf)
    best = int(np.argmax(gain))
    return float(cuts[best] + cuts[min(best + 1, len(cuts) - 1)]) / 2 if gain[best] > 0 else float("inf")


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """doc_id, text and ``label`` of at most ``max_rows`` labelled documents, chosen by a hash of doc_id.

    One row a doc_id: of rows that repeat it, the one whose text has the
    smallest hash. A document labelled 0 and 1 counts as 0.
    """
    known = columns(labels, doc_id="long", **{label: "int"}).where(f"doc_id IS NOT NULL AND {label} IS NOT NULL")
    known = known.groupBy("doc_id").agg(F.min(label).alias(label))
    # the limit bounds what is broadcast: 16 bytes a row
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = columns(docs, doc_id="long", text="string").join(F.broadcast(picked), "doc_id")
    # bounded before anything leaves the executors, however often an id is repeated
    one = rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("first"), F.min(label).alias(label))
    return one.select("doc_id", "first.text", label)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 10_000, max_good_lost: float = 0.005) -> Forest | None:
    """A forest calibrated on labelled rows (``quality`` 0 is bad); None if there are none of good quality."""

    def measure(batches):
        for b in slices(batches):
            stats, features = statistics(b.column(1))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(base_failed(stats)), pa.array(list(features), pa.list_(pa.float64()))],
                ["doc_id", "quality", "failed", "features"])

    rows = labelled_rows(docs, labels, "quality", max_rows).mapInArrow(
        measure, "doc_id long, quality int, failed boolean, features array<double>")
    found = rows.where("NOT failed").toPandas()
    if not len(found):
        return None
    found = found.sort_values("doc_id", kind="stable")
    features, bad = np.array(found["features"].tolist()), found["quality"].to_numpy() == 0
    if bad.all():
        return None
    forest = Forest(features[~bad], features)
    forest.limit = calibrate(forest.score(features), bad, max_good_lost)
    return forest


def judge(docs: DataFrame, forest: Forest | None) -> DataFrame:
    """doc_id, the base statistics, base_failed, score and kept of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches):
        forest = shared.value
        for b in slices(batches):
            stats, features = statistics(b.column(1))
            failed = base_failed(stats)
            score = forest.score(features) if forest else np.zeros(len(failed))
            kept = ~failed & (score <= forest.limit if forest else True)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(s) for s in stats.T), pa.array(failed), pa.array(kept), pa.array(score)],
                ["doc_id", *STATISTICS, "base_failed", "kept", "score"])

    longs = ", ".join(f"{name} long" for name in STATISTICS)
    return columns(docs, doc_id="long", text="string").mapInArrow(
        run, f"doc_id long, {longs}, base_failed boolean, kept boolean, score double")
