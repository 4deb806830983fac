"""Exact top-k inner products by Fagin's threshold algorithm.

Vectors become integers, floor(scale * x). Rows are gathered within their
partition into shards of bounded size, each with one sorted list a dimension;
shards are written once, without a shuffle. Queries go to them in rounds: a
block of bounded size is broadcast and meets every shard. For a query the
lists are walked from their better ends (the top for a positive coordinate,
the bottom for a negative one) to growing depths; every row met is scored in
full. The sum of the query's coordinates times the values at the current depth
bounds all rows not met, so the walk ends when the k-th best score is above
that bound (or ties can't be lost), or when the lists end. The shards' k best
merge by a window with a partial limit.

Queries are a stated set; each meets each shard once, and no other pairs
exist. What is shuffled grows with the queries times the shards. Integers are
exact: products go through float64 only where all sums stay below 2^53, else
through int64, else through Python integers.

Edge cases: null vectors and vectors with a null or non-finite component take
no part; vectors of different lengths are compared as if padded with zeros; an
empty vector scores 0 with all; rows that repeat an id are rows of their own,
as candidates and as queries, each query row with ranks from 1 (a query's own
id never matches it); ties go to the smaller id. Empty tables give no rows.
Other columns, clashing names included, are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .columnar import columns, stage

SCALE = 1024
SHARD_ROWS, QUERY_BLOCK = 8_192, 16_384
FIRST_DEPTH = 32


def _padded(rows) -> np.ndarray:
    """Rows of doubles padded with zeros to one length."""
    out = np.zeros((len(rows), max((len(r) for r in rows), default=0)))
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


def _matrix(rows) -> np.ndarray:
    """Integer rows of one length; int64 where they fit, else Python integers."""
    out = rows if isinstance(rows, np.ndarray) else _padded(rows)
    if out.size and np.abs(out).max() >= 2.0 ** 52:  # such a double is a whole number, or small enough to scale
        return np.array([[int(v) * SCALE if abs(v) >= 2.0 ** 52 else int(np.floor(v * SCALE)) for v in r] for r in out],
                        object).reshape(out.shape)
    return np.floor(out * SCALE).astype(np.int64)


def _common(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = min(a.shape[1], b.shape[1])  # beyond it one side is zero
    a, b = a[:, :width], b[:, :width]
    if not width or not len(a) or not len(b):
        return a.astype(float), b.astype(float)
    most = int(np.abs(a).max()) * int(np.abs(b).max()) * width
    if most < 1 << 53:
        return a.astype(float), b.astype(float)
    return (a.astype(np.int64), b.astype(np.int64)) if most < 1 << 63 else (a.astype(object), b.astype(object))


def threshold_top(ids: np.ndarray, rows: np.ndarray, order: np.ndarray, query_id: int, query: np.ndarray, k: int):
    """(ids, scores) of the k best rows for one query; ``order``: row numbers of each dimension, ascending.

    ``rows`` and ``query`` are of one exact type.
    """
    n, width = rows.shape
    used = np.flatnonzero(query)
    down = query[used] > 0
    seen = np.zeros(n, bool)
    met, scores = np.empty(0, np.int64), np.empty(0, rows.dtype)
    depth, size = 0, FIRST_DEPTH
    while True:
        stop = min(n, depth + size)
        if len(used):
            parts = [order[n - stop:n - depth, j] if d else order[depth:stop, j] for j, d in zip(used, down)]
            fresh = np.zeros(n, bool)
            for part in parts:
                fresh[part] = True
            fresh &= ~seen
        else:  # all scores are zero
            fresh, stop = ~seen, n
        new = np.flatnonzero(fresh)
        seen[new] = True
        met = np.concatenate([met, new])
        scores = np.concatenate([scores, rows[new] @ query])
        depth, size = stop, size * 2
        own = ids[met] == query_id
        if depth == n:
            break
        if (~own).sum() >= k:
            edge = [rows[order[n - depth, j] if d else order[depth - 1, j], j] for j, d in zip(used, down)]
            bound = sum(int(e) * int(q) for e, q in zip(edge, query[used]))
            kth = np.partition(scores[~own], -k)[-k]
            if int(kth) > bound:  # at equality an unmet row could tie with a smaller id
                break
    met, scores = met[~own], scores[~own]
    if len(met) > 4 * k:  # nothing below the k-th score can be among the k best
        keep = scores >= np.partition(scores, -k)[-k]
        met, scores = met[keep], scores[keep]
    best = sorted(zip((-int(s) for s in scores), ids[met].tolist()))[:k]
    return [i for _, i in best], [-s for s, _ in best]


SHARDS = pa.schema([("ids", pa.list_(pa.int64())), ("width", pa.int64()), ("vectors", pa.binary()), ("order", pa.binary())])
FOUND = pa.schema([("query_no", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _gather(shard_rows: int):
    """Arrow batches of (vec_id, embedding) -> one row a shard: its vectors as doubles and its sorted lists."""

    def shard(ids, vectors):
        rows = _padded(vectors)
        order = np.argsort(np.floor(rows * SCALE), axis=0, kind="stable").astype(np.int32)
        values = [ids, rows.shape[1], rows.tobytes(), order.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, SHARDS)], schema=SHARDS)

    def gather(batches):
        ids, vectors = [], []
        for batch in batches:
            for low in range(0, batch.num_rows, shard_rows):
                part = batch.slice(low, shard_rows)
                ids += part.column(0).to_pylist()
                vectors += part.column(1).to_pylist()
                while len(ids) >= shard_rows:
                    yield shard(ids[:shard_rows], vectors[:shard_rows])
                    del ids[:shard_rows], vectors[:shard_rows]
        if ids:
            yield shard(ids, vectors)

    return gather


def _search(asked, k: int):
    """Shards -> the k best of each broadcast query (number, id, vector) in each shard."""

    def search(batches):
        numbers, query_ids, vectors = asked.value
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.array(row["ids"], np.int64)
                rows = np.frombuffer(row["vectors"], np.float64).reshape(len(ids), row["width"])
                data, wanted = _common(_matrix(rows), _matrix(vectors))
                order = np.frombuffer(row["order"], np.int32).reshape(len(ids), row["width"])
                found = ([], [], [], [])
                for number, query_id, query in zip(numbers, query_ids, wanted):
                    best = threshold_top(ids, data, order, query_id, query, k)
                    for column, values in zip(found, ([number] * len(best[0]), [query_id] * len(best[0]), *best)):
                        column.extend(values)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(found, FOUND)], schema=FOUND)

    return search


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, shard_rows: int = SHARD_ROWS,
          query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query row's k best rows of ``vectors`` (vec_id, embedding)."""

    def usable(df):
        rows = columns(df, vec_id="long", embedding="array<double>").where("vec_id IS NOT NULL AND embedding IS NOT NULL")
        return rows.where(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))

    spark = vectors.sparkSession
    shards = stage(usable(vectors).mapInArrow(_gather(shard_rows), "ids array<long>, width long, vectors binary, order binary"), "topk-shards")
    # the number is fixed by the write; every query row has its own list
    asked = stage(usable(queries).withColumn("query_no", F.monotonically_increasing_id()), "topk-queries")
    rounds = max(1, -(-2 * asked.count() // query_block))
    out = None
    for r in range(rounds):
        mine = asked if rounds == 1 else asked.where(F.pmod(F.xxhash64("query_no"), F.lit(rounds)) == r)
        rows = mine.select("query_no", "vec_id", "embedding").collect()  # about half a block
        if rows:
            block = spark.sparkContext.broadcast(([q.query_no for q in rows], [q.vec_id for q in rows], _padded([q.embedding for q in rows])))
            near = shards.mapInArrow(_search(block, k), "query_no long, query_id long, vec_id long, score long")
            out = near if out is None else out.unionByName(near)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best = Window.partitionBy("query_no").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
