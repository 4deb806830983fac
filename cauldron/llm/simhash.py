"""SimHash near-duplicates through vantage-point trees.

Fingerprints are 64-bit: a bit is set if it is set in more than half of the
XXH64 hashes (seed 42) of the text's word shingles.  Documents link at
``max_bits`` or fewer differing bits; a component is what links reach.

1. One pass over the texts makes fingerprints; equal ones collapse to a node
   with its smallest doc_id, so a group of exact copies of any size is one row.
2. A vantage-point tree over a bounded sample of nodes cuts Hamming space into
   shards.  A ball of radius ``mu`` around a vantage point also takes what
   lies up to ``max_bits`` outside it: by the triangle inequality two linked
   nodes then share a shard at every cut.
3. Each shard goes through the same split in its task until buckets are small,
   compares exactly there, and returns a spanning forest, not the pairs.
4. A shard that holds more than ``shard_bound`` nodes (a cluster so dense that
   the tree can't split it, or a tree sampled unluckily) is linked by shared
   neighbours instead: nodes within two bits share a fingerprint at one bit
   from each.  Each such key has at most 65 nodes, so no task grows.
5. Star contraction over the links gives the components.

Edge cases: null or empty text has fingerprint zero and links like any other;
texts with fewer words than a shingle give one shingle; null doc_id rows keep
their fingerprint, and count for component_id only where a group has no other.
Repeated rows come back once each.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .columnar import columns, stage

SEED = 42
#: Nodes that the vantage-point tree is built from, at most.
TREE_SAMPLE = 16_384
#: Nodes that a shard should hold, and those beyond which it is linked by shared neighbours.
SHARD_NODES, SHARD_BOUND = 16_384, 262_144
#: Nodes compared all with all at the end of a local split.
LEAF_NODES = 96
_CHUNK = 1 << 14


def fingerprint(text: str | None, shingle_words: int = 3) -> int:
    """The unsigned SimHash of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if n <= shingle_words:
        return digest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: n - shingle_words + 1].tolist()
    stops = ends[shingle_words - 1:].tolist()
    total, votes = len(starts), np.zeros(64, np.int64)
    for at in range(0, total, _CHUNK):
        pairs = zip(starts[at:at + _CHUNK], stops[at:at + _CHUNK])
        h = np.array([digest(joined[a:b], SEED) for a, b in pairs], "<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return int(np.packbits(votes * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = 3) -> DataFrame:
    """doc_id, text_key (a hash that tells texts of one doc_id apart) and fp (the 64 bits as a signed long)."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                fps = np.fromiter((fingerprint(t, shingle_words) for t in part.column(2).to_pylist()),
                                  np.uint64, part.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(fps.view(np.int64))], ["doc_id", "text_key", "fp"])

    rows = columns(docs, doc_id="long", text="string").select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return rows.mapInArrow(run, "doc_id long, text_key long, fp long")


def _distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


class Tree:
    """A vantage-point tree whose leaves are shards; ``inner`` rows: vantage, radius, inside, outside."""

    def __init__(self, sample: np.ndarray, shards: int, max_bits: int, seed: int = 7):
        self.max_bits, self.inner, self.leaves = max_bits, [], 0
        rng = np.random.default_rng(seed)
        depth = max(0, int(np.ceil(np.log2(max(1, shards)))))
        self.root = self._grow(np.unique(sample), depth, rng)

    def _grow(self, points: np.ndarray, depth: int, rng) -> int:
        """Index of an inner node, or -1 - shard."""
        if depth and len(points) > 8:
            # the candidate whose distances spread widest loses least to the overlap
            best = max((points[i] for i in rng.choice(len(points), 8, replace=False)),
                       key=lambda v: _distance(points, v).std())
            d = _distance(points, best)
            mu = int(np.median(d)) - 1
            if mu >= 0 and 0 < (inside := d <= mu).sum() < len(points):
                at = len(self.inner)
                self.inner.append(None)
                self.inner[at] = (int(best), mu, self._grow(points[inside], depth - 1, rng),
                                  self._grow(points[~inside], depth - 1, rng))
                return at
        self.leaves += 1
        return -self.leaves


def route(tree: tuple, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shard, index of the point) for every shard that each point belongs to; ``tree``: inner nodes, root, max_bits."""
    inner, root, max_bits = tree
    shards, indices, todo = [], [], [(root, np.arange(len(points)))]
    while todo:
        node, at = todo.pop()
        if node < 0:
            shards.append(np.full(len(at), -1 - node, np.int64))
            indices.append(at)
            continue
        vantage, mu, inside, outside = inner[node]
        d = _distance(points[at], np.uint64(vantage))
        todo.append((inside, at[d <= mu + max_bits]))
        todo.append((outside, at[d > mu]))
    return np.concatenate(shards), np.concatenate(indices)


class _Forest:
    """Union-find over array positions; ``links`` holds the joins that were new."""

    def __init__(self, n: int):
        self.parent, self.links = list(range(n)), []

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, a: int, b: int) -> None:
        x, y = self.find(a), self.find(b)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
            self.links.append((a, b))


def shard_links(points: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Positions linked in a spanning forest of all pairs within ``max_bits``; exact, no pair list is kept."""
    forest, rng = _Forest(len(points)), np.random.default_rng(len(points))
    todo = [(np.arange(len(points)), 0)]
    while todo:
        at, tries = todo.pop()
        mine = points[at]
        if len(at) <= LEAF_NODES or tries >= 3:
            for i in range(0, len(at), 512):  # blocks: at most 512 x a shard at a time
                block = mine[i:i + 512]
                rest = mine[i + 1:]
                for j in range(0, len(rest), 4096):
                    near = np.bitwise_count(block[:, None] ^ rest[None, j:j + 4096]) <= max_bits
                    rows, cols = np.nonzero(near)
                    cols = cols + i + 1 + j
                    keep = cols > rows + i
                    for a, b in zip(at[rows[keep] + i].tolist(), at[cols[keep]].tolist()):
                        forest.join(a, b)
            continue
        vantages = mine[rng.choice(len(at), 4, replace=False)]
        spread = [(_distance(mine, v), v) for v in vantages]
        d = max((s for s, _ in spread), key=lambda s: s.std())
        mu = int(np.median(d)) - 1
        inside, outside = at[d <= mu + max_bits], at[d > mu]
        # a cut that leaves almost everything on one side is tried again with other points, then given up
        stuck = max(len(inside), len(outside)) > 0.9 * len(at)
        if stuck and (mu < 0 or min(len(inside), len(outside)) == 0 or max(len(inside), len(outside)) == len(at)):
            todo.append((at, tries + 1))
            continue
        todo.append((inside, tries + 1 if stuck else 0))
        todo.append((outside, tries + 1 if stuck else 0))
    return forest.links


def links(nodes: DataFrame, max_bits: int = 2) -> DataFrame:
    """Links (a, b) between the distinct ``fp`` of ``nodes`` with the components of all pairs within ``max_bits``."""
    if not 0 <= max_bits <= 2:
        raise ValueError("max_bits must be 0, 1 or 2: dense shards are linked through neighbours at one bit")
    spark = nodes.sparkSession
    total = nodes.count()
    sample = [r.fp for r in nodes.orderBy(F.xxhash64("fp"), "fp").limit(TREE_SAMPLE).collect()]
    tree = Tree(np.array(sample, np.int64).view(np.uint64), -(-total // SHARD_NODES), max_bits)
    shared = spark.sparkContext.broadcast((tree.inner, tree.root, max_bits))

    def to_shards(batches):
        for b in batches:
            fps = b.column(0).to_numpy()
            shard, at = route(shared.value, fps.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(fps[at])], ["shard", "fp"])

    routed = stage(nodes.select("fp").mapInArrow(to_shards, "shard long, fp long"), "simhash-shards")
    dense = routed.groupBy("shard").count().where(F.col("count") > SHARD_BOUND).select("shard")

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        fps = np.sort(pdf["fp"].to_numpy())
        found = np.array(shard_links(fps.view(np.uint64), max_bits), np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": fps[found[:, 0]], "b": fps[found[:, 1]]})

    near = routed.join(dense, "shard", "left_anti").groupBy("shard").applyInPandas(search, "a long, b long")
    crowded = routed.join(dense, "shard", "left_semi").select("fp").distinct()
    if max_bits == 2:
        flips = F.array(F.lit(0).cast("long"), *[F.lit(1).cast("long") if i == 0 else
                                                 F.shiftleft(F.lit(1).cast("long"), i) for i in range(64)])
        keyed = crowded.select("fp", F.explode(F.transform(flips, lambda f: f.bitwiseXOR(F.col("fp")))).alias("key"))
        first = keyed.groupBy("key").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a <> z")
        far = keyed.join(first.select("key", "a"), "key").where("fp <> a").select("a", F.col("fp").alias("b"))
    else:
        pair = F.explode(F.array(*[F.shiftleft(F.lit(1).cast("long"), i) for i in range(64)])).alias("bit")
        keyed = crowded.select("fp", pair).select("fp", F.col("fp").bitwiseXOR(F.col("bit")).alias("b"))
        far = keyed.join(crowded.select(F.col("fp").alias("b")), "b").select(F.col("fp").alias("a"), "b")
        far = far.where("a < b") if max_bits else far.limit(0)
    return near.unionByName(far)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node that an edge (a, b) names; root is the smallest node that edges reach.

    Alternating large-star and small-star steps; each is one aggregation and
    one join, written to the shared folder.  Rounds grow with the logarithm of
    the nodes; running out of them is an error, never a partial answer.
    """
    edges = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                  .where("u <> v").distinct(), "components")
    state = None
    for _ in range(max_rounds):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("x"), "m").where("x <> m")
        small = small.select(F.col("x").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges = stage(small.distinct(), "components")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _labelled(docs: DataFrame, shingle_words: int, max_bits: int) -> DataFrame:
    """doc_id, text_key, fp, root (the component's smallest fingerprint) and component_id of every row."""
    fps = stage(fingerprints(docs, shingle_words), "simhash")
    nodes = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-nodes")
    reach = components(links(nodes, max_bits)).select(F.col("node").alias("fp"), "root")
    reach = reach.union(reach.select(F.col("root").alias("fp"), "root").distinct())
    rooted = nodes.join(reach, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first_id")
    lowest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return fps.join(rooted.select("fp", "root").join(lowest, "root"), "fp")


def near_duplicates(docs: DataFrame, shingle_words: int = 3, max_bits: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of ``docs``."""
    return _labelled(docs, shingle_words, max_bits).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, shingle_words: int = 3, max_bits: int = 2) -> DataFrame:
    """One row of ``docs``, all columns, for each component: that with its smallest doc_id.

    Rows with that doc_id but different texts: the one with the smallest text
    hash; rows repeated as a whole: any one of them. Null ids come last.
    """
    rows = stage(_labelled(docs, shingle_words, max_bits).select("doc_id", "text_key", "root"), "simhash-rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("k")
    keep = rows.groupBy("root").agg(first).select(F.col("k.doc_id").alias("_id"), F.col("k.text_key").alias("_key"))
    kept = docs.join(keep, docs["doc_id"].cast("long").eqNullSafe(keep["_id"])
                     & (F.xxhash64(docs["text"].cast("string")) == keep["_key"]), "left_semi")
    if rows.groupBy("doc_id", "text_key").count().where("count > 1").isEmpty():
        return kept
    return kept.dropDuplicates(["doc_id", "text"])
