"""Substring dedup by hashing normalised units of lines.

A unit is a line, or a phrase of a longer line: cuts fall where a hash of two
adjacent words is the largest among its ``REACH`` neighbours on either side, so
they depend on the words around them only and a passage copied into the middle
of another line is cut alike there. Words are normalised (case folded, edge
punctuation stripped) before hashing; a character of a script without spaces
is a word. Digests are grouped globally; the first occurrence by (doc_id,
position) is kept. A run of later occurrences of ``min_words`` words or more
goes, with its original offsets returned; shorter runs (stock phrases,
headings) stay. ``min_words=1`` removes every unit that occurs earlier.

Within a slice of the input (about a megabyte) all but the first occurrence of
a digest are decided in place. A task also remembers the earliest occurrence
it has met of the digests in a table of fixed size: what comes after that one
is decided as well, so a line that a third of all rows share sends a few rows
a task to its group. One shuffle of digests follows, and one join of the
decided unit numbers with the texts.

Edge cases: null text comes back null with nothing removed, empty text empty,
a very long text is a slice of its own. Rows that agree in doc_id and text are
one document (each comes back, none removes the other's units); a null doc_id
ranks first. Ties can't occur: a position holds one unit. An empty table gives
no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, StructType

from .columnar import Words, columns, slices

REACH = 3
MIN_WORDS = 20
#: Digests that a task remembers with their earliest occurrence: time and shuffle only, never a result.
SEEN_LOG2 = 18
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "¿¡«»“”‘’…–—"
_MULT = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MULT
    return x ^ (x >> np.uint64(29))


class Units:
    """The units of every row of a text array: word offsets ``first`` (n + 1), digests, and n + 1 row offsets."""

    def __init__(self, texts: pa.Array):
        self.words = words = Words(texts, characters=True)
        n = len(words.codes)
        plain = [w.decode("utf-8", "replace").casefold().strip(_EDGES) for w in words.distinct.to_pylist()]
        h = np.array([xxhash.xxh64_intdigest(p) if p else 1 for p in plain], np.uint64)[words.codes]
        breaks = np.cumsum(words.data == 10)
        line = breaks[words.starts] if n else np.empty(0, np.int64)
        row = np.repeat(np.arange(len(texts)), words.counts)
        new = np.ones(n, bool)
        new[1:] = (line[1:] != line[:-1]) | (row[1:] != row[:-1])
        group = np.cumsum(new)
        after = np.append(h[1:], np.uint64(0))
        after[np.append(new[1:], True)] = 0  # a line's last word has no neighbour
        g = _mix(h * _STEP + after)
        cut = ~new
        for k in range(1, REACH + 1):
            together = group[k:] == group[:-k]
            cut[k:] &= ~together | (g[k:] > g[:-k])
            cut[:-k] &= ~together | (g[:-k] > g[k:])
        # a cut needs all its neighbours: near a line's edge the maximum would hang on where the line ends
        start = np.flatnonzero(new)
        place = np.arange(n) - start[group - 1] if n else np.empty(0, np.int64)
        cut &= place >= REACH
        begins = np.flatnonzero(new | cut)
        self.first = np.append(begins, n)
        size = np.diff(self.first)
        at = np.arange(n) - np.repeat(begins, size)
        powers = np.full(int(size.max()) if n else 0, _STEP, np.uint64)
        powers = np.multiply.accumulate(powers) if len(powers) else powers
        total = np.add.reduceat(_mix(h) * powers[at], begins) if n else np.empty(0, np.uint64)
        self.digests = _mix(total + size.astype(np.uint64))
        self.rows = np.searchsorted(begins, words.rows)
        self.size = size


class Earliest:
    """The earliest occurrence met of each digest, in a table where a digest has one place and the newest stays."""

    def __init__(self, log2: int = SEEN_LOG2):
        self.digest = np.arange(1 << log2, dtype=np.uint64) ^ np.uint64(1)  # none in its own place: all empty
        self.place = [np.zeros(1 << log2, np.int64) for _ in range(4)]

    def later(self, digest: np.ndarray, *place: np.ndarray) -> np.ndarray:
        """Whether an earlier occurrence is known of each of the (distinct) digests; the others are remembered."""
        slot = (digest & np.uint64(len(self.digest) - 1)).astype(np.int64)
        before, equal = np.zeros(len(digest), bool), self.digest[slot] == digest
        for known, own in zip(self.place, place):
            there = known[slot]
            before |= equal & (there < own)
            equal &= there == own
        new = np.flatnonzero(~before)
        slots, one = np.unique(slot[new], return_index=True)  # of two digests with one place either may stay
        new = new[one]
        self.digest[slots] = digest[new]
        for known, own in zip(self.place, place):
            known[slots] = own[new]
        return before


def _unit_rows(docs: DataFrame) -> DataFrame:
    """digest, doc_id, unit (its number), key (hash of the text) and later (an earlier occurrence is known)."""

    def run(batches):
        earliest = Earliest()
        for b in slices(batches):
            units = Units(b.column(2))
            n = len(units.digests)
            if not n:
                continue
            count = np.diff(units.rows)
            row = np.repeat(np.arange(b.num_rows), count)
            number = np.arange(n) - np.repeat(units.rows[:-1], count)
            ids = b.column(0)
            known = np.asarray(ids.is_valid().to_numpy(zero_copy_only=False))[row]
            doc = ids.fill_null(0).to_numpy()[row]
            text = b.column(1).to_numpy()[row]
            order = np.lexsort((text, number, doc, known, units.digests))
            ranked = units.digests[order]
            heads = np.maximum.accumulate(np.where(np.append(True, ranked[1:] != ranked[:-1]), np.arange(n), 0))
            head = order[heads]  # the first occurrence in the slice, for each unit in that order
            again = np.zeros(n, bool)
            again[order] = ((number[head] != number[order]) | (text[head] != text[order])
                            | (doc[head] != doc[order]) | (known[head] != known[order]))
            # heads of the slice against what the task has met in the slices before
            first = np.flatnonzero(heads == np.arange(n))
            own = order[first]
            known_before = earliest.later(units.digests[own], known[own].astype(np.int64), doc[own], number[own], text[own])
            again[order] |= np.repeat(known_before, np.diff(np.append(first, n)))
            # a row that is decided needs no group: any key spreads it
            spread = _mix(_mix(text.view(np.uint64) + number.astype(np.uint64)) * _STEP + doc.view(np.uint64))
            key = np.where(again, spread, units.digests)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(doc, mask=~known), pa.array(number.astype(np.int32)), pa.array(text),
                 pa.array(again)], ["digest", "doc_id", "unit", "key", "later"])

    rows = columns(docs, doc_id="long", text="string").where("text IS NOT NULL")
    return rows.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(
        run, "digest long, doc_id long, unit int, key long, later boolean")


def repeated_units(docs: DataFrame) -> DataFrame:
    """doc_id, key and the numbers of the units that occur earlier, for every document that has any."""
    rows = _unit_rows(docs)
    group = Window.partitionBy("digest", "later").orderBy("doc_id", "unit", "key")
    seen = rows.withColumn("nth", F.rank().over(group))  # equal rows share a rank
    return seen.where("later OR nth > 1").groupBy("doc_id", "key").agg(F.collect_list("unit").alias("units"))


def _cut(texts: pa.Array, chosen: list, min_words: int) -> tuple[pa.Array, ...]:
    """Arrays of (removed words, words, spans as code points, kept text; null where the text is)."""
    rows = list(zip(*_cut_rows(texts, chosen, min_words)))
    kept = pa.array(rows[3], pa.string(), mask=~texts.is_valid().to_numpy(zero_copy_only=False))
    spans = pa.array(rows[2], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
    return pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), spans, kept


def _cut_rows(texts: pa.Array, chosen: list, min_words: int):
    units = Units(texts)
    words = units.words
    lead = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])
    raw = words.data.tobytes()
    for i, numbers in enumerate(chosen):
        begin, end = int(words.bounds[i]), int(words.bounds[i + 1])
        total = int(words.counts[i])
        if numbers is None or not len(numbers):
            yield 0, total, [], raw[begin:end].decode("utf-8", "replace")
            continue
        base = units.rows[i]
        numbers = np.unique(np.asarray(numbers, np.int64))
        splits = np.flatnonzero(np.diff(numbers) > 1) + 1
        spans, kept, at, gone = [], [], begin, 0
        for run in np.split(numbers, splits):
            a, z = units.first[base + run[0]], units.first[base + run[-1] + 1]
            if z - a < min_words:
                continue
            start, stop = int(words.starts[a]), int(words.ends[z - 1])
            spans.append({"start": int(lead[start] - lead[begin]), "end": int(lead[stop] - lead[begin])})
            kept.append(raw[at:start])
            at, gone = stop, gone + int(z - a)
        kept.append(raw[at:end])
        yield gone, total, spans, b"".join(kept).decode("utf-8", "replace")


SPANS = ArrayType(StructType().add("start", "long").add("end", "long"))


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Every row of ``docs``: doc_id, n_words, n_removed, removed (spans in the original text) and the kept text."""
    schema = StructType().add("doc_id", "long").add("n_words", "long").add("n_removed", "long")
    schema = schema.add("removed", SPANS).add("text", "string")

    def run(batches):
        for b in slices(batches, "c1"):
            gone, words, spans, kept = _cut(b.column(1), b.column(2).to_pylist(), min_words)
            yield pa.RecordBatch.from_arrays([b.column(0), words, gone, spans, kept], schema.names)

    return _with_units(docs, columns(docs, doc_id="long", text="string")).mapInArrow(run, schema)


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs``, same columns, with repeated passages cut from ``text`` and ``n_chars`` (if there) of what is left."""
    names, schema = docs.columns, docs.schema
    at, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches):
        for b in slices(batches, f"c{at}"):
            gone, _, _, kept = _cut(b.column(at), b.column(len(names)).to_pylist(), min_words)
            out = list(b.columns[:-1])
            out[at] = kept
            if chars is not None:
                size = pc.utf8_length(kept).cast(out[chars].type)
                out[chars] = pc.if_else(pc.greater(gone, 0), size, out[chars])
            yield pa.RecordBatch.from_arrays(out, names)

    return _with_units(docs, docs).mapInArrow(run, schema)


def _with_units(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` with columns renamed c0, c1 ... (none can clash), and the numbers of their repeated units."""
    found = repeated_units(docs).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "units")
    doc, text = (f"c{rows.columns.index(name)}" for name in ("doc_id", "text"))
    rows = rows.withColumn("text", F.col("text").cast("string")).toDF(*[f"c{i}" for i in range(len(rows.columns))])
    key = F.xxhash64(rows[text])
    joined = rows.join(found, rows[doc].cast("long").eqNullSafe(found["_id"]) & (key == found["_key"]), "left")
    return joined.drop("_id", "_key")
