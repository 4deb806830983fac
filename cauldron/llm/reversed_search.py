"""Ranked lexical search turned round: the queries are indexed, the documents stream past them.

The items' terms form an inverted index (term -> items that hold it and how
often), which is broadcast in blocks of bounded size. One pass over the texts
counts, for each document, its terms and how often it holds each indexed term;
these counts are written, small and whole. Document frequencies, the number of
documents and the total length are aggregates over them. A second pass, over
the counts only, adds up the integer scores of a slice of documents against
all items of the block and updates one heap of k rows an item; the tasks'
heaps merge in a window with a partial limit.

A block holds at most ``BLOCK_BYTES`` of item text (an item larger than that
is a block of its own); each further block reads the documents once more.

Edge cases: a null or empty text has no terms: such a document counts nowhere
and such an item returns nothing. Very long texts are split in steps of
``STEP_BYTES``. Rows that repeat a doc_id are documents of their own; equal
scores go to the smaller doc_id, a null doc_id last. Rows that repeat an
item_id are items of their own, each with ranks from 1. Empty tables give no
rows. Other columns, clashing names included, are not looked at.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .columnar import columns, slices, stage

TERM_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BLOCK_BYTES = 4 << 20
ITEM_BYTES = 256  # what an item costs beside its text
STEP_BYTES = 4 << 20
CELLS = 1 << 21  # document x item scores held at once
_LAST = np.iinfo(np.int64).max
HITS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tf", pa.list_(pa.int64()))])
TOPS = pa.schema([("item_no", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])

#: Every byte of a term as it counts, every other byte a space; bytes of longer UTF-8 sequences are part of terms.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def term_counts(text: bytes) -> tuple[int, Counter]:
    """(number of terms, how often each occurs) of one UTF-8 text."""
    folded = text.translate(_FOLD)
    if len(folded) <= STEP_BYTES:
        words = folded.split()
        return len(words), Counter(words)
    total, counts, start = 0, Counter(), 0
    while start < len(folded):
        stop = folded.find(b" ", start + STEP_BYTES)
        stop = len(folded) if stop < 0 else stop
        words = folded[start:stop].split()
        total += len(words)
        counts.update(words)
        start = stop
    return total, counts


class ItemIndex:
    """The inverted index of one block of items: ``vocabulary`` (term -> number) and the postings of each term."""

    def __init__(self, items: list[tuple]):
        self.item_ids = [i for i, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        posted = []
        for number, (_, text) in enumerate(items):
            for term, times in term_counts((text or "").encode())[1].items():
                posted.append((self.vocabulary.setdefault(term, len(self.vocabulary)), number, times))
        posted.sort()
        table = np.array(posted, np.int64).reshape(-1, 3)
        self.starts = np.searchsorted(table[:, 0], np.arange(len(self.vocabulary) + 1))
        self.items, self.times = table[:, 1], table[:, 2]


def _counted(vocabulary):
    """Arrow batches of (doc_id, text) -> doc_id, n, numbers of the indexed terms held, and their counts."""

    def count(batches):
        known = vocabulary.value
        for batch in slices(batches):
            out = ([], [], [], [])
            texts = batch.column(1).cast(pa.binary())
            for doc_id, text in zip(batch.column(0).to_pylist(), texts.to_pylist()):
                n, counts = term_counts(text or b"")
                if n:
                    held = [(known[t], counts[t]) for t in counts.keys() & known.keys()]
                    for column, value in zip(out, (doc_id, n, [t for t, _ in held], [c for _, c in held])):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, HITS)], schema=HITS)

    return count


def document_factor(n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """m of each document: 25 plus 75 times its length against the mean, rounded down."""
    if not len(n) or 75 * int(n.max()) * documents < 1 << 63:
        return 25 + 75 * n * documents // max(1, length)
    return np.array([25 + 75 * int(x) * documents // length for x in n], np.int64)


class Heaps:
    """The k best (score, smaller doc_id first) of every item of a block."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.rows: list[list] = [[] for _ in range(items)]
        self.least = np.zeros(items, np.int64)  # a score has to exceed it, or to tie where the heap is full
        self.full = np.zeros(items, bool)

    def offer(self, scores: np.ndarray, ids: np.ndarray, absent: np.ndarray) -> None:
        """``scores``: items x documents; ``ids`` with ``absent`` where the doc_id is null."""
        wanted = (scores > self.least[:, None]) | ((scores == self.least[:, None]) & self.full[:, None])
        for item in np.flatnonzero(wanted.any(axis=1)):
            at, line = np.flatnonzero(wanted[item]), scores[item]
            if len(at) > self.k:
                best = np.lexsort((ids[at], absent[at], -line[at]))[:self.k]
                at = at[best]
            heap = self.rows[item]
            for i in at:
                entry = (int(line[i]), -int(absent[i]), -int(ids[i]))
                if len(heap) < self.k:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)
            if len(heap) == self.k:
                self.full[item], self.least[item] = True, heap[0][0]

    def batch(self) -> pa.RecordBatch:
        found = [(item, None if gone else -low, score) for item, heap in enumerate(self.rows) for score, gone, low in heap]
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in found], f.type) for j, f in enumerate(TOPS)], schema=TOPS)


def _ranked(index, documents: int, length: int, k: int):
    """Arrow batches of HITS rows -> the task's heaps as (item_no, doc_id, score)."""

    def rank(batches):
        starts, items, values, n_items = index.value
        heaps = Heaps(n_items, k)
        sizes = np.diff(starts)
        step = max(1, CELLS // max(1, n_items))
        for batch in batches:
            for low in range(0, batch.num_rows, step):
                part = batch.slice(low, step)
                ids, n = part.column(0), part.column(1).to_numpy()
                held = part.column(2)
                rows = np.repeat(np.arange(part.num_rows), held.value_lengths().to_numpy())
                terms = held.flatten().to_numpy().astype(np.int64)
                tf = part.column(3).flatten().to_numpy()
                gain = (1_000_000_000 * tf) // (1000 * tf + 8 * document_factor(n, documents, length)[rows])
                scores = np.zeros(n_items * part.num_rows, np.int64)
                start = 0
                ends = np.cumsum(sizes[terms])
                while start < len(terms):  # postings of a bounded number of (document, term) pairs at a time
                    base = ends[start - 1] if start else 0
                    stop = max(start + 1, int(np.searchsorted(ends, base + CELLS, side="right")))
                    many = sizes[terms[start:stop]]
                    first = np.repeat(starts[terms[start:stop]] - (np.cumsum(many) - many), many)
                    at = first + np.arange(int(many.sum()))
                    np.add.at(scores, items[at] * part.num_rows + np.repeat(rows[start:stop], many),
                              values[at] * np.repeat(gain[start:stop], many))
                    start = stop
                heaps.offer(scores.reshape(n_items, part.num_rows), ids.fill_null(_LAST).to_numpy(),
                            ids.is_null().to_numpy(zero_copy_only=False))
        yield heaps.batch()

    return rank


def blocks_of(items: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """``items`` with a ``block`` each, and the number of blocks: none above ``limit`` bytes unless it is one item."""
    size = F.octet_length("text") + ITEM_BYTES
    n = max(1, -(-2 * (items.agg(F.sum(size)).first()[0] or 0) // limit))
    while True:
        dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
        over = dealt.groupBy("block").agg(F.sum(size).alias("bytes"), F.count("*").alias("items"))
        if over.where((F.col("bytes") > limit) & (F.col("items") > 1)).isEmpty():
            return dealt, n
        n *= 2


def _search_block(docs: DataFrame, items: list[tuple], k: int) -> DataFrame:
    """item_no (place in ``items``), item_id, doc_id, score, rank: the k best of every item of one block."""
    spark, index = docs.sparkSession, ItemIndex(items)
    words = spark.sparkContext.broadcast(index.vocabulary)
    hits = stage(docs.mapInArrow(_counted(words), "doc_id long, n long, terms array<int>, tf array<long>"), "search-hits")
    total = hits.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    held = dict(hits.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # one row a term of the block
    weights = np.array([math.floor(1000 * math.log((2 * total.documents + 2) / (2 * held.get(t, 0) + 1)))
                        for t in range(len(index.vocabulary))], np.int64)
    values = index.times * np.repeat(weights, np.diff(index.starts))
    postings = spark.sparkContext.broadcast((index.starts, index.items, values, len(items)))
    found = hits.mapInArrow(_ranked(postings, total.documents, total.length, k), "item_no int, doc_id long, score long")
    best = Window.partitionBy("item_no").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def search(documents: DataFrame, benchmark: DataFrame, k: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of each item's k best documents with a score above 0."""
    spark = documents.sparkSession
    docs = columns(documents, doc_id="long", text="string").where("text IS NOT NULL")
    asked = columns(benchmark, item_id="long", text="string").where("text IS NOT NULL")
    items, blocks = blocks_of(stage(asked.distinct(), "search-items"), block_bytes)
    out = None
    for block in range(blocks):
        rows = [(r.item_id, r.text) for r in items.where(F.col("block") == block).select("item_id", "text").collect()]
        if rows:
            numbered = spark.createDataFrame([(no, i, t) for no, (i, t) in enumerate(rows)], "item_no int, item_id long, text string")
            found = _search_block(docs, rows, k).join(numbered, "item_no").select("item_id", "text", "rank", "doc_id", "score")
            out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    # every row of the benchmark has its list, repeated rows too
    same = asked["item_id"].eqNullSafe(out["item_id"]) & (asked["text"] == out["text"])
    return asked.join(out, same).select(asked["item_id"], F.col("rank").cast("int").alias("rank"), "doc_id", "score")
