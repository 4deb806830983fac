"""Token counts by a map-side two-tier lookup.

Tier one is a compact table of the corpus's frequent pre-tokens and their
token counts, broadcast to all tasks: a hash table of at most ``table_size``
rows. Tier two is a cache in each worker, filled by the library. No pre-token
is shuffled: to find the frequent ones every task goes through its whole input
and writes one row, a summary of at most ``summary_size`` pre-tokens with
counts. Written summaries are read back ``FAN_IN`` at a time and added up,
round by round, until at most that many are left for the driver.

The table is a cache: it changes the time, never a count.

Edge cases: null text is empty (0 bytes, 0 tokens); a very long text is a
slice of its own; texts with an added token's string are encoded whole by the
library, as its default does; equal counts of pre-tokens rank by their bytes;
repeated rows are counted one by one; an empty table gives no rows; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import pretokens
from .columnar import columns, data_of, slices, stage

TABLE_SIZE = 32_768
SUMMARY_SIZE = 2_048
#: Distinct pre-tokens that a task counts at a time; beyond it the rarer half goes.
COUNTER_SIZE = 1 << 17
#: Summaries that one task, or the driver at the end, adds up.
FAN_IN = 16
_SUMMARY = pa.struct([("token", pa.binary()), ("n", pa.int64())])


def _summary(counts: dict, size: int) -> pa.RecordBatch:
    """One row: the ``size`` most frequent of ``counts`` as an array of (token, n)."""
    top = heapq.nlargest(size, counts.items(), key=lambda x: (x[1], x[0]))
    return pa.RecordBatch.from_arrays(
        [pa.array([[{"token": t, "n": n} for t, n in top]], pa.list_(_SUMMARY))], ["summary"])


def _add(counts: dict, summary) -> None:
    for entry in summary:
        token = bytes(entry["token"])
        counts[token] = counts.get(token, 0) + entry["n"]


def frequent(docs: DataFrame, tokenizer: str, table_size: int = TABLE_SIZE, summary_size: int = SUMMARY_SIZE) -> dict:
    """The frequent pre-tokens of the whole corpus with their token counts."""

    def summarise(batches):
        counts: dict[bytes, int] = {}
        split = pretokens.load(tokenizer)
        for b in slices(batches):
            texts = [t if t and not split.has_added(t) else "" for t in b.column(0).to_pylist()]
            codes, distinct, _ = split.split(texts)
            for token, n in zip(distinct.to_pylist(), np.bincount(codes, minlength=len(distinct)).tolist()):
                counts[token] = counts.get(token, 0) + n
            if len(counts) > COUNTER_SIZE:
                counts = dict(heapq.nlargest(COUNTER_SIZE // 2, counts.items(), key=lambda x: (x[1], x[0])))
        if counts:
            yield _summary(counts, summary_size)

    def merge(batches):
        counts: dict[bytes, int] = {}
        for b in batches:
            for summary in b.column(0).to_pylist():
                _add(counts, summary)
        if counts:
            yield _summary(counts, table_size)

    kind = "summary array<struct<token: binary, n: bigint>>"
    found = stage(columns(docs, text="string").mapInArrow(summarise, kind), "token-summaries")
    n = found.count()
    while n > FAN_IN:
        n = -(-n // FAN_IN)
        # coalesce reads neighbouring files in one task: no exchange
        found = stage(found.coalesce(n).mapInArrow(merge, kind), "token-summaries")
    counts: dict[bytes, int] = {}
    for row in found.toLocalIterator():
        _add(counts, row.summary)
    split = pretokens.load(tokenizer)
    return {t: len(split.merge(t)) for t, _ in heapq.nlargest(table_size, counts.items(), key=lambda x: (x[1], x[0]))}


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024, **sizes) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every row of ``docs``."""
    rows = columns(docs, doc_id="long", text="string")
    shared = docs.sparkSession.sparkContext.broadcast(frequent(docs, tokenizer, **sizes))

    def run(batches):
        table, split = shared.value, pretokens.load(tokenizer)
        misses = split.lengths
        for b in slices(batches):
            texts = [t or "" for t in b.column(1).to_pylist()]
            whole = [i for i, t in enumerate(texts) if split.has_added(t)]
            odd = set(whole)
            codes, distinct, at = split.split(["" if i in odd else t for i, t in enumerate(texts)])
            tokens = distinct.to_pylist()
            size = np.empty(len(tokens), np.int64)
            for i, t in enumerate(tokens):
                n = table.get(t) or misses.get(t)
                if n is None:
                    if len(misses) >= split.cache_size:
                        misses.clear()
                    n = misses[t] = len(split.merge(t))
                size[i] = n
            total = np.concatenate([[0], np.cumsum(size[codes])])
            count = total[at[1:]] - total[at[:-1]]
            for i in whole:
                count[i] = len(split.tokenizer.encode(texts[i], add_special_tokens=False).ids)
            n_bytes = np.diff(data_of(b.column(1))[1])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_bytes), pa.array(count), pa.array(count > limit)],
                                             ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
