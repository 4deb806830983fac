"""Product codes of vectors: eight exact integer codebooks, fitted over Hilbert-sorted blocks.

Vectors become integers, floor(4096 x), and are cut into eight parts. Rows are
gathered into chunks of ``CHUNK_ROWS`` within their partition, without a
shuffle; in a chunk each part is sorted along a Hilbert curve and laid out in
flat blocks of ``BLOCK_ROWS``, each with the box (least and greatest component)
and the component sums of its points. The chunks are written once.

A round compares boxes with entries first: an entry whose least distance to
the box exceeds another's greatest distance can't be nearest to any point of
it. A block with one entry left adds its stored sums; the others' points are
measured against the entries on their block's list, in 64-bit integers, lower
index first. Tasks return at most 8 x 16 rows of sums, added up in decimals.

Edge cases: vectors that are null or hold null or non-finite components are
dropped. Shorter vectors are padded with zeros to the longest one, all to a
multiple of eight; empty vectors alone give empty parts. Fewer than 16 rows
give as many entries. Rows that repeat an id are rows of their own (as first
entries in order of their vectors); null ids come last. Ties go to the lower
entry. Null labels form one label. No rows give no rows. Components beyond the
range in which a distance fits 64 bits raise an error. Other columns, clashing
names included, are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .columnar import columns, stage

SCALE = 4096
PARTS, ENTRIES, ROUNDS = 8, 16, 6
CHUNK_ROWS, BLOCK_ROWS = 4_096, 32
SHARED_LABELS = 100_000
SALTS = 16
CHUNKS = pa.schema([("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.string())), ("data", pa.binary()),
                    ("places", pa.binary()), ("boxes", pa.binary()), ("sums", pa.binary())])
CHUNKS_DDL = "ids array<long>, labels array<string>, data binary, places binary, boxes binary, sums binary"


def integers(rows: list, width: int) -> np.ndarray:
    """floor(SCALE * x) of each row, padded with zeros to ``width``."""
    out = np.zeros((len(rows), width))
    for i, row in enumerate(rows):
        out[i, :len(row)] = row
    out = np.floor(out * SCALE)
    d = max(1, width // PARTS)
    if out.size and np.abs(out).max() >= (2.0 ** 61 / d) ** 0.5:
        raise ValueError("a component is too large: squared distances would not fit 64 bits")
    return out.astype(np.int64)


def hilbert_keys(points: np.ndarray) -> np.ndarray:
    """Place of each point on a Hilbert curve over the points' own box, by in-place axis reflections (Skilling)."""
    n, d = points.shape
    if not n or not d:
        return np.zeros(n, np.int64)
    d = min(d, 63)
    bits = max(1, min(16, 63 // d))
    low, span = points[:, :d].min(0), np.ptp(points[:, :d], axis=0)
    x = ((points[:, :d] - low) * ((1 << bits) - 1) / np.maximum(span, 1)).astype(np.int64).T.copy()
    bit = 1 << (bits - 1)
    while bit > 1:
        below = bit - 1
        for axis in range(d):
            turned = (x[axis] & bit) != 0
            swap = np.where(turned, 0, (x[0] ^ x[axis]) & below)
            x[0] ^= np.where(turned, below, swap)
            x[axis] ^= swap
        bit >>= 1
    for axis in range(1, d):
        x[axis] ^= x[axis - 1]
    flips, bit = np.zeros(n, np.int64), 1 << (bits - 1)
    while bit > 1:
        flips ^= np.where(x[d - 1] & bit, bit - 1, 0)
        bit >>= 1
    x ^= flips
    key = np.zeros(n, np.int64)
    for level in range(bits - 1, -1, -1):
        for axis in range(d):
            key = (key << 1) | ((x[axis] >> level) & 1)
    return key


def block_starts(n: int) -> np.ndarray:
    return np.arange(0, n, BLOCK_ROWS)


def lay_out(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(points along the curve, their row numbers, boxes as blocks x 2 x d, sums as blocks x d) of one part."""
    places = np.argsort(hilbert_keys(points), kind="stable")
    ordered, starts = points[places], block_starts(len(points))
    boxes = np.stack([np.minimum.reduceat(ordered, starts), np.maximum.reduceat(ordered, starts)], axis=1)
    return ordered, places, boxes, np.add.reduceat(ordered, starts)


def shortlists(boxes: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """blocks x entries: False where some entry is closer to every point of the block."""
    low, high, e = boxes[:, 0, None, :], boxes[:, 1, None, :], entries[None, :, :]
    least = (np.maximum(np.maximum(low - e, e - high), 0) ** 2).sum(-1)
    most = (np.maximum(np.abs(e - low), np.abs(high - e)) ** 2).sum(-1)
    return least <= most.min(axis=1, keepdims=True)


def nearest(ordered: np.ndarray, boxes: np.ndarray, entries: np.ndarray, measured: bool):
    """(entry of each point, its squared distance, blocks settled by their box alone).

    Distances of settled blocks are measured only if ``measured``.
    """
    n = len(ordered)
    lists = shortlists(boxes, entries)
    settled = lists.sum(axis=1) == 1
    found, distance = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max)
    block = np.arange(n) // BLOCK_ROWS
    for k, entry in enumerate(entries):
        rows = np.flatnonzero((lists[:, k] & (measured | ~settled))[block])
        gap = ordered[rows] - entry
        away = (gap * gap).sum(-1)
        closer = away < distance[rows]  # at a tie the lower entry stays
        found[rows[closer]], distance[rows[closer]] = k, away[closer]
    alone = settled[block]
    found[alone] = lists.argmax(axis=1)[block][alone]
    return found, distance, settled


class Chunk:
    """A written chunk: arrays of each part, viewed in its binary columns."""

    def __init__(self, row: dict, width: int):
        self.n, d = len(row["ids"]), width // PARTS
        blocks = len(block_starts(self.n))
        self.data = np.frombuffer(row["data"], np.int64).reshape(PARTS, self.n, d)
        self.places = np.frombuffer(row["places"], np.int32).reshape(PARTS, self.n)
        self.boxes = np.frombuffer(row["boxes"], np.int64).reshape(PARTS, blocks, 2, d)
        self.sums = np.frombuffer(row["sums"], np.int64).reshape(PARTS, blocks, d)


def _gather(width: int):
    """Arrow batches of (vec_id, label, embedding) -> one row a chunk."""

    def chunk(ids, labels, vectors):
        whole = integers(vectors, width)
        laid = [lay_out(part) for part in np.split(whole, PARTS, axis=1)]
        blobs = [np.stack([p[j] for p in laid]) for j in range(4)]
        values = [[ids], [labels], [blobs[0].tobytes()], [blobs[1].astype(np.int32).tobytes()], [blobs[2].tobytes()],
                  [blobs[3].tobytes()]]
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, CHUNKS)], schema=CHUNKS)

    def gather(batches):
        ids, labels, vectors = [], [], []
        for batch in batches:
            for low in range(0, batch.num_rows, CHUNK_ROWS):
                part = batch.slice(low, CHUNK_ROWS)
                for into, column in zip((ids, labels, vectors), part.columns):
                    into.extend(column.to_pylist())
                while len(ids) >= CHUNK_ROWS:
                    yield chunk(ids[:CHUNK_ROWS], labels[:CHUNK_ROWS], vectors[:CHUNK_ROWS])
                    del ids[:CHUNK_ROWS], labels[:CHUNK_ROWS], vectors[:CHUNK_ROWS]
        if ids:
            yield chunk(ids, labels, vectors)

    return gather


def _totals(books: np.ndarray, width: int):
    """Chunks -> (part, entry, n, sums) of the points nearest to each entry, one row an entry and task."""
    sums_type = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])

    def total(batches):
        many, d = books.shape[1], width // PARTS
        counts, sums = np.zeros((PARTS, many), np.int64), np.zeros((PARTS, many, d), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                c = Chunk(row, width)
                starts = block_starts(c.n)
                sizes = np.diff(np.append(starts, c.n))
                for p in range(PARTS):
                    found, _, settled = nearest(c.data[p], c.boxes[p], books[p], measured=False)
                    owner = found[starts[settled]]
                    np.add.at(sums[p], owner, c.sums[p][settled])
                    np.add.at(counts[p], owner, sizes[settled])
                    loose = ~np.repeat(settled, sizes)
                    np.add.at(sums[p], found[loose], c.data[p][loose])
                    np.add.at(counts[p], found[loose], 1)
        at = [(p, k) for p in range(PARTS) for k in range(many) if counts[p, k]]
        cells = [[p for p, _ in at], [k for _, k in at], [int(counts[i]) for i in at], [sums[i].tolist() for i in at]]
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(cells, sums_type)], schema=sums_type)

    return total


def _encode(books: np.ndarray, width: int):
    """Chunks -> vec_id, label, code, error of their rows."""
    made = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("code", pa.string()), ("error", pa.int64())])

    def encode(batches):
        for batch in batches:
            for row in batch.to_pylist():
                c = Chunk(row, width)
                codes, error = np.zeros((c.n, PARTS), np.uint8), np.zeros(c.n, np.int64)
                for p in range(PARTS):
                    found, distance, _ = nearest(c.data[p], c.boxes[p], books[p], measured=True)
                    codes[c.places[p], p] = found
                    error[c.places[p]] += distance
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["ids"], pa.int64()), pa.array(row["labels"], pa.string()),
                    pa.array([code.tobytes().hex() for code in codes], pa.string()), pa.array(error)], schema=made)

    return encode


def first_books(rows: DataFrame, width: int) -> np.ndarray:
    """The codebooks before the first round, parts x entries x components."""
    smallest = rows.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(ENTRIES).collect()
    whole = integers([r.embedding for r in smallest], width)
    return whole.reshape(len(smallest), PARTS, width // PARTS).transpose(1, 0, 2).copy()


def improve(books: np.ndarray, chunks: DataFrame, width: int) -> np.ndarray:
    """One round: each entry becomes the rounded-down mean of its points; unused entries stay."""
    d = width // PARTS
    told = chunks.mapInArrow(_totals(books, width), "part int, entry int, n long, sums array<long>")
    exact = [F.sum(F.get("sums", F.lit(i)).cast("decimal(38, 0)")).alias(f"s{i}") for i in range(d)]
    out = books.copy()
    for row in told.groupBy("part", "entry").agg(F.sum("n").alias("n"), *exact).collect():  # at most 8 x 16 rows
        out[row.part, row.entry] = [int(row[f"s{i}"]) // row.n for i in range(d)]
    return out


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, rounds: int = ROUNDS, shared_labels: int = SHARED_LABELS) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error and codebooks_sha256 of every usable row.

    ``vectors`` has vec_id, embedding and label; sums over labels come from a
    broadcast table up to ``shared_labels`` labels, beyond that from a salted
    join, as one label can hold a large share of all rows.
    """
    rows = columns(vectors, vec_id="long", label="string", embedding="array<double>").where("embedding IS NOT NULL")
    rows = rows.where(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    longest = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    width = -(-longest // PARTS) * PARTS
    books = first_books(rows, width)
    chunks = stage(rows.mapInArrow(_gather(width), CHUNKS_DDL), "vector-chunks")
    for _ in range(rounds if books.shape[1] else 0):
        books = improve(books, chunks, width)
    coded = stage(chunks.mapInArrow(_encode(books, width), "vec_id long, label string, code string, error long"), "vector-codes")
    labels = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "same")
    alike = F.col("label").eqNullSafe(F.col("same"))
    if labels.limit(shared_labels + 1).count() <= shared_labels:
        out = coded.join(F.broadcast(labels), alike)
    else:
        salted = labels.withColumn("told", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int")
        out = coded.withColumn("salt", salt).join(salted, alike & (F.col("salt") == F.col("told")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
