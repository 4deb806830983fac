"""Language identification with bit-sliced Bloom filters of character n-grams.

A slot of the filter holds one bit per language, eight languages a slice, so
one probe answers for all of them: the AND over an n-gram's slots is the set
of languages that (may) contain it. Per document the popcount of each
language's bit, corrected for that language's false-positive rate, estimates
how many n-grams it explains; the largest estimate decides.

``fit`` learns from a bounded sample of labelled rows (``max_docs`` expected
per language, chosen by a hash of doc_id); n-grams are counted on the
executors and only each language's ``max_grams`` most frequent reach the
driver. An n-gram enters a language only with at least ``min_ratio`` of the
relative frequency it has where it is most frequent, which keeps out what
mislabelled documents bring in.

Edge cases: null text or text without a letter gives ``und`` and score 0; a
text whose n-grams no language contains gets the language with the most
training documents and score 0; ties go to the first language in code-point
order; no labelled rows at all gives ``und`` for every document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .columnar import columns, ship_package, slices

UNKNOWN = "und"
ORDERS = (3, 4)
SLOTS_LOG2, PROBES = 18, 2
_MIX = np.uint64(0x9E3779B97F4A7C15)
_tables: dict = {}


def _folding() -> np.ndarray:
    """Code point -> its lower-case letter, or 32 for everything that is no letter."""
    if "fold" not in _tables:
        fold = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                fold[c] = ord(low) if len(low) == 1 else c
        _tables["fold"] = fold
    return _tables["fold"]


def grams(texts: list[str | None]):
    """Yield (row, code) arrays of all n-grams inside words (with the spaces beside them), order by order."""
    joined = "\n".join(t or "" for t in texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter((len(t or "") + 1 for t in texts), np.int64, len(texts))
    folded = np.empty(len(points) + 1, np.uint64)
    folded[0] = 32
    folded[1:] = _folding()[points]
    rows = np.empty(len(folded), np.int32)
    rows[0] = 0
    rows[1:] = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    keep = np.ones(len(folded), bool)
    keep[1:] = (folded[1:] != 32) | (folded[:-1] != 32)
    folded, rows = folded[keep], rows[keep]
    space = folded == 32
    for order in ORDERS:
        size = len(folded) - order + 1
        if size <= 0:
            continue
        code, inner = folded[:size].copy(), np.zeros(size, bool)
        for k in range(1, order):
            code *= np.uint64(2097169)
            code += folded[k:k + size]
            if k < order - 1:
                inner |= space[k:k + size]
        at = np.flatnonzero(~inner)
        yield rows[1:1 + size][at], (code[at] ^ np.uint64(order)) * _MIX


def _slots(codes: np.ndarray):
    for probe in range(PROBES):
        yield ((codes ^ (codes >> np.uint64(29 + probe))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * probe * 7919)
               >> np.uint64(64 - SLOTS_LOG2)).astype(np.int64)


class Filters:
    """The slices of the filter, the languages in bit order and their false-positive rates."""

    def __init__(self, members: dict[str, np.ndarray], fallback: str | None):
        self.languages, self.fallback = sorted(members), fallback
        self.slices = [np.zeros(1 << SLOTS_LOG2, np.uint8) for _ in range(-(-len(members) // 8))]
        for i, lang in enumerate(self.languages):
            for slot in _slots(members[lang]):
                np.bitwise_or.at(self.slices[i // 8], slot, np.uint8(1 << i % 8))
        fill = [(self.slices[i // 8] >> (i % 8) & 1).mean() for i in range(len(self.languages))]
        self.false_rate = np.array(fill) ** PROBES

    def explained(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(n-grams of each text, estimate per text and language of those that the language contains)."""
        n, langs = len(texts), len(self.languages)
        total, hits = np.zeros(n), np.zeros((n, 8 * len(self.slices)))
        bits = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(float)
        for rows, codes in grams(texts):
            total += np.bincount(rows, minlength=n)
            slots = list(_slots(codes))
            for k, table in enumerate(self.slices):
                mask = table[slots[0]]
                for slot in slots[1:]:
                    mask &= table[slot]
                seen = np.bincount(rows.astype(np.int64) * 256 + mask, minlength=n * 256).reshape(n, 256)
                hits[:, 8 * k:8 * k + 8] += seen @ bits
        hits = hits[:, :langs]
        return total, np.clip((hits - total[:, None] * self.false_rate) / (1 - self.false_rate), 0, None)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        total, hits = self.explained(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        best = hits.argmax(1)
        top = hits[np.arange(len(texts)), best]
        rest = hits.copy()
        rest[np.arange(len(texts)), best] = 0
        second = rest.max(1)
        score = np.divide(top, top + second, out=np.zeros(len(texts)), where=top > 0)
        names = [UNKNOWN if not t else self.fallback if not h else self.languages[b]
                 for t, h, b in zip(total, top, best)]
        return names, score


def fit(docs: DataFrame, max_docs: int = 3000, max_grams: int = 6000, min_ratio: float = 0.25) -> Filters:
    """Filters learnt from the rows of ``docs`` with a ``lang``."""
    rows = columns(docs, doc_id="long", text="string", lang="string").where("lang IS NOT NULL AND text IS NOT NULL")
    per = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not per:
        return Filters({}, None)
    share = F.create_map(*[F.lit(x) for lang, n in per.items() for x in (lang, min(1.0, max_docs / n))])
    picked = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))

    def count(batches):
        for b in slices(batches):
            langs = np.array(b.column(2).to_pylist(), object)
            names, index = np.unique(langs, return_inverse=True)
            for at, codes in grams(b.column(1).to_pylist()):
                for k, name in enumerate(names):
                    found, n = np.unique(codes[index[at] == k], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(found), pa.string()), pa.array(found.view(np.int64)), pa.array(n)],
                        ["lang", "gram", "n"])

    counted = picked.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    share_of = counted.withColumn("f", F.col("n") / F.sum("n").over(Window.partitionBy("lang")))
    likely = share_of.withColumn("top", F.max("f").over(Window.partitionBy("gram")))
    ranked = likely.where((F.col("f") >= min_ratio * F.col("top")) & (F.col("n") > 1)).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= max_grams)
    members = {lang: [] for lang in per}
    for r in ranked.select("lang", "gram").toLocalIterator():
        members[r.lang].append(r.gram)
    return Filters({k: np.array(v, np.int64).view(np.uint64) for k, v in members.items()},
                   max(sorted(per), key=per.get))


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, lang_pred and score of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches):
        for b in slices(batches):
            names, score = shared.value.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(score)],
                                             ["doc_id", "lang_pred", "score"])

    return columns(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(modulus: int = 5, remainder: int = 0):
    """Whether crc32(doc_id as text) mod ``modulus`` is ``remainder`` (a null id is not held out)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def least_share(labelled: DataFrame, filters: Filters, quantile: float = 0.01, part: float = 0.5) -> float:
    """The share of n-grams that a learned language has to explain: ``part`` of the ``quantile`` over labelled rows.

    All rows of ``labelled`` with a ``lang`` and a letter are counted, by share in steps of a thousandth.
    """
    shared = labelled.sparkSession.sparkContext.broadcast(filters)
    rows = columns(labelled, text="string", lang="string").where("lang IS NOT NULL AND text IS NOT NULL").select("text")

    def shares(batches):
        for b in slices(batches):
            total, hits = shared.value.explained(b.column(0).to_pylist())
            best = hits.max(1, initial=0)[total > 0] / total[total > 0]
            step, n = np.unique(np.floor(best * 1000).astype(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(step), pa.array(n)], ["step", "n"])

    counted = rows.mapInArrow(shares, "step long, n long").groupBy("step").agg(F.sum("n").alias("n"))
    steps = sorted((r.step, r.n) for r in counted.collect())
    upto, goal = 0, quantile * sum(n for _, n in steps)
    for step, n in steps:
        upto += n
        if upto >= goal:
            return part * step / 1000
    return 0.0


def keep_identified(docs: DataFrame, filters: Filters, share: float = 0.0) -> DataFrame:
    """The rows of ``docs``, all columns, whose language can be told.

    Of a text's n-grams a language explains some, and with one standard error
    (the root of their number) more it reaches ``share`` of them all.
    """
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    at = docs.columns.index("text")

    def run(batches):
        for b in slices(batches, "text"):
            total, hits = shared.value.explained(b.column(at).to_pylist())
            best = hits.max(1, initial=0)
            yield b.filter(pa.array((best > 0) & (best + np.sqrt(total) >= share * total)))

    return docs.mapInArrow(run, docs.schema)
