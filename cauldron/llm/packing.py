"""Packing documents into sequences by bounded-space online best-fit.

A document is its token ids and an end id. Only documents longer than a
sequence are cut: into full pieces, the first one shorter. Pieces are dealt by
a hash into groups of about ``group_pieces`` and packed group by group, online
in the order of that hash: a piece goes to the open bin with the least free
space that still holds it (one bit operation on a bitset with a bit for each
amount of free space), else to a new bin; when more than ``open_bins`` are
open, the fullest closes. The same input always gives the same sequences, also
after a retry.

Edge cases: null text is empty (the end id alone); a very long text is cut
like any other; a piece as long as a sequence is a sequence; bins with equal
free space are taken in the order of a stack, pieces of equal hash in the order
of doc_id (null first) and piece; repeated rows are packed as documents of
their own, and their number spreads them over groups; an empty table gives no
pieces; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import pretokens
from .columnar import columns, slices, stage

LENGTH, END_ID = 1024, 2
GROUP_PIECES, OPEN_BINS = 32_768, 64
#: Copies of one row that are numbered in one array.
COPIES = 1 << 16
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """The pieces of every document with the checksum of their ids."""

    def run(batches):
        split = pretokens.load(tokenizer)
        for b in slices(batches):
            ids = b.column(0).to_pylist()
            rows = ([], [], [], [], [])
            for doc, got in zip(ids, split.ids([t or "" for t in b.column(1).to_pylist()])):
                n = len(got) + 1
                raw = np.append(got, np.uint32(end_id)).astype("<u4").tobytes()
                first = (n - 1) % length + 1
                for piece, stop in enumerate(range(first, n + 1, length)):
                    start = max(0, stop - length)
                    rows[0].append(doc)
                    rows[1].append(piece)
                    rows[2].append(start)
                    rows[3].append(stop - start)
                    rows[4].append(zlib.crc32(raw[4 * start:4 * stop]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), *(pa.array(r, pa.int64()) for r in rows[2:])],
                ["doc_id", "piece", "start", "length", "ids_crc32"])

    return columns(docs, doc_id="long", text="string").mapInArrow(run, PIECES)


def best_fit(lengths, size: int = LENGTH, open_bins: int = OPEN_BINS) -> tuple[list[int], list[int]]:
    """(bin, offset) of every length in turn; bins are numbered as they open."""
    by_free: list[list[int]] = [[] for _ in range(size + 1)]
    bits = opened = used = 0
    bins, offsets = [], []
    for n in lengths:
        if n > size:
            raise ValueError("a piece is longer than a sequence")
        fits = bits >> n
        if fits:
            free = (fits & -fits).bit_length() - 1 + n  # the least free space that holds it
            at = by_free[free].pop()
            if not by_free[free]:
                bits &= ~(1 << free)
            opened -= 1
        else:
            at, free = used, size
            used += 1
        bins.append(at)
        offsets.append(size - free)
        free -= n
        if free:  # a full bin is closed
            by_free[free].append(at)
            bits |= 1 << free
            opened += 1
            if opened > open_bins:
                fullest = (bits & -bits).bit_length() - 1
                by_free[fullest].pop(0)
                if not by_free[fullest]:
                    bits &= ~(1 << fullest)
                opened -= 1
    return bins, offsets


def pack_pieces(found: DataFrame, length: int = LENGTH, open_bins: int = OPEN_BINS,
                group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``found`` (PIECES) with sequence_id and offset."""
    found = stage(found, "packing-pieces")
    groups = max(1, -(-found.count() // group_pieces))
    # pieces of rows repeated as a whole are equal: their number tells them apart, so that copies spread too
    copies = found.groupBy(*found.columns).agg(F.count(F.lit(1)).alias("copies"))
    # in two steps, so that no array grows with the copies of a row beyond copies / COPIES
    begun = copies.withColumn("begin", F.explode(F.sequence(F.lit(1).cast("long"), "copies", F.lit(COPIES).cast("long"))))
    last = F.least(F.col("copies"), F.col("begin") + (COPIES - 1))
    numbered = begun.withColumn("copy", F.explode(F.sequence("begin", last)))
    own = F.xxhash64("doc_id", "piece", "length", "ids_crc32")
    order = F.when(F.col("copy") == 1, own).otherwise(F.xxhash64("doc_id", "piece", "length", "ids_crc32", "copy"))
    keyed = numbered.select(*found.columns, order.alias("order"))
    keyed = keyed.withColumn("group", F.pmod("order", F.lit(groups)))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("order", "ascending"), ("doc_id", "ascending"), ("piece", "ascending")])
        bins, offsets = best_fit(table.column("length").to_pylist(), length, open_bins)
        group = table.column("group")[0].as_py()
        table = table.drop_columns(["order", "group"])
        table = table.append_column("sequence_id", pa.array(np.array(bins, np.int64) + (group << 32)))
        return table.append_column("offset", pa.array(offsets, pa.int64()))

    return keyed.groupBy("group").applyInArrow(pack, PACKED)


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID, **how) -> DataFrame:
    """PACKED: every piece of every document with its sequence and its place there."""
    return pack_pieces(pieces(docs, tokenizer, length, end_id), length, **how)
