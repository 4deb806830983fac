"""Boosted trees for many fits at once, from histograms built in shared jobs.

All fits read one table of chunks: features as bin numbers of at most 255
quantile edges, labels, and the rows each fit may see. A job finds, for every
tree node that some fit waits for, the sums of gradient, second derivative and
rows in each bin. The tasks' sums meet on the executors, a fit's in one place,
where the best split of each node is found; a few numbers a node are all that
the driver sees. So a level of all fits costs one job, however many fits there
are.

Trees grow best-first: of all nodes known, the ``leaves - 1`` with the largest
gain along their path (the least gain from the root to the node) are split,
which are the nodes that one-at-a-time best-first growth splits.

Partial sums of more than ``FAN_IN`` tasks are added up in groups before they
meet. A task needs the running scores of its rows: they are cached beside the
chunks and, every few trees, brought up to date in the job that counts next. A
task adds the trees since. Lost cache blocks are computed again from the
written chunks.

Histograms are counted over joint bins of several features (``packing``) and
added up over the features' own bins once a task.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.serializers import CPickleSerializer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import run_concurrently, ship_package, write_stage_table

MAX_EDGES = 254
QUANTILE_ACCURACY = 10_000
TASK_ROWS = 8_192  # a task is not worth its start below this
CHUNK_ROWS = 65_536
FAN_IN = 32
FINDERS = 4  # tasks that share a job's fits when their sums meet
GROUPS = 2  # chains of jobs that overlap
JOINT_BINS = 2_048  # of features that are counted together
REPLAY_ROWS = 2_000_000  # rows times fits of a task whose scores are brought up to date with every tree
STEPS = 20  # updates of cached scores before they are computed anew from the chunks
LEAST_GAIN = 1e-9


@dataclass(frozen=True)
class Growth:
    """How trees grow.

    ``second_order``: gains weigh a node by its second derivatives, else by
    its rows. Leaf values are Newton steps in both cases.
    """

    trees: int = 100
    depth: int = 4
    leaves: int = 31
    rate: float = 0.1
    min_leaf: int = 20
    min_split: int = 2
    min_hessian: float = 1e-3
    second_order: bool = True

    @property
    def most_splits(self) -> int:
        return self.leaves - 1 if self.depth <= 0 else min(self.leaves - 1, 2 ** self.depth - 1)


@dataclass(frozen=True)
class FitSpec:
    """One fit: a classifier (0/1 label, log loss) or regressor (squared error) on named features and some rows."""

    name: str
    kind: str
    features: tuple
    label: Column
    rows: Column | None = None


@dataclass
class BoostedTrees:
    """A fitted ensemble. A tree is its splits (leaf, feature, bin) in order, each giving the rows above the bin's
    edge a new leaf, numbered from 1; leaf 0 is where all rows start."""

    kind: str
    features: list
    edges: list
    init: float
    splits: np.ndarray
    values: np.ndarray

    def scores(self, columns: list[np.ndarray]) -> np.ndarray:
        """Predictions (probabilities of 1 for a classifier) from raw feature columns."""
        return self.binned_scores(np.stack([binned(x, e) for x, e in zip(columns, self.edges)]) if columns else np.zeros((0, 0), np.uint8))

    def binned_scores(self, bins: np.ndarray) -> np.ndarray:
        raw = np.full(bins.shape[1], self.init)
        add_trees(raw, bins, self.splits, self.values)
        return 1.0 / (1.0 + np.exp(-raw)) if self.kind == "classifier" else raw

    def as_dict(self) -> dict:
        return {"kind": self.kind, "features": list(self.features), "edges": [e.tolist() for e in self.edges], "init": self.init,
                "splits": self.splits.tolist(), "values": self.values.tolist()}

    @classmethod
    def from_dict(cls, d: dict) -> "BoostedTrees":
        trees = len(d["splits"])
        return cls(d["kind"], d["features"], [np.array(e, float) for e in d["edges"]], d["init"],
                   np.array(d["splits"], np.int16).reshape(trees, -1, 3), np.array(d["values"], float).reshape(trees, -1))


# ---- inside tasks --------------------------------------------------------------

def binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Number of edges below each value; a missing value is above them all."""
    return np.where(np.isnan(x), len(edges), np.searchsorted(edges, x, side="left")).astype(np.uint8)


def leaves_of(bins: np.ndarray, splits: np.ndarray) -> np.ndarray:
    """The leaf of every row under one tree (``splits``: rows of leaf, feature, bin; a negative leaf ends the list)."""
    leaf = np.zeros(bins.shape[1], np.uint8 if len(splits) < 255 else np.uint16)
    for i, (at, feature, edge) in enumerate(splits.tolist()):
        if at < 0:
            break
        above = bins[feature] > edge
        if i:
            above &= leaf == at
        leaf += above.view(np.uint8) * leaf.dtype.type(i + 1 - at)
    return leaf


def add_trees(raw: np.ndarray, bins: np.ndarray, splits: np.ndarray, values: np.ndarray) -> None:
    for tree, value in zip(splits, values):
        raw += value[leaves_of(bins, tree)]


class _Chunk:
    """The arrays of one chunk, and the scores its rows have so far (a row a fit), if any are known."""

    def __init__(self, row: dict, shape: tuple, inits: list):
        n, (features, labels, masks) = row["n"], shape
        self.n = n
        self.bins = np.frombuffer(row["bins"], np.uint8).reshape(features, n)
        self.labels = np.frombuffer(row["labels"], np.float64 if len(row["labels"]) > labels * n else np.uint8).reshape(labels, n)
        self.masks = np.frombuffer(row["masks"], np.bool_).reshape(masks, n)
        self.inits = inits
        self.raw = np.frombuffer(row["raw"], np.float64).reshape(len(inits), n) if row.get("raw") else None

    def scores(self, fit: int, splits: np.ndarray, values: np.ndarray) -> np.ndarray:
        """The fit's scores with these trees added."""
        if self.raw is not None and not len(splits):
            return self.raw[fit]
        raw = np.full(self.n, self.inits[fit], float) if self.raw is None else self.raw[fit].copy()
        add_trees(raw, self.bins, splits, values)
        return raw


_SETTLED = False


def _settle() -> None:
    """Once a worker process: what is loaded by now leaves the garbage collector's rounds, which run after every task."""
    global _SETTLED
    if not _SETTLED:
        import gc

        gc.freeze()
        _SETTLED = True


@dataclass
class _Wanted:
    """What a job is to count for one fit: its trees that the known scores lack, the splits of the tree in growth, and leaf -> slot."""

    fit: int
    kind: str
    features: list
    label: int
    mask: int
    splits: np.ndarray
    values: np.ndarray
    growing: np.ndarray
    slots: dict


def packing(widths: list, most: int = JOINT_BINS) -> list:
    """Groups of features (by place, narrowest first) whose joint bins are at most ``most``, or a single feature: first fit, widest first."""
    groups: list = []
    for f in sorted(range(len(widths)), key=lambda f: -widths[f]):
        for g in groups:
            if g[1] * widths[f] <= most:
                g[0].append(f)
                g[1] *= widths[f]
                break
        else:
            groups.append([[f], widths[f]])
    return [(tuple(places[::-1]), cells) for places, cells in groups]


class _Sums:
    """Sums of gradient, (of a classifier) second derivative, and rows, of each slot and joint bin."""

    def __init__(self, w: "_Wanted", widths: list, most: int = JOINT_BINS):
        self.w, self.widths = w, [widths[f] for f in w.features]
        self.groups = packing(self.widths, most)
        self.of = [np.zeros((3 if w.kind == "classifier" else 2, len(w.slots), cells)) for _, cells in self.groups]

    def codes(self, chunk: _Chunk) -> list:
        """The joint bin of each row in each group."""
        out = []
        for places, _ in self.groups:
            code = chunk.bins[self.w.features[places[0]]]
            for f in places[1:]:
                code = np.multiply(code, self.widths[f], dtype=np.uint16)
                code += chunk.bins[self.w.features[f]]
            out.append(code)
        return out

    def add(self, chunk: _Chunk, codes: list) -> None:
        w, many, slot = self.w, len(self.w.slots), None
        raw, y, seen = chunk.scores(w.fit, w.splits, w.values), chunk.labels[w.label], chunk.masks[w.mask]
        if len(w.growing):
            leaf = leaves_of(chunk.bins, w.growing)
            wanted = np.zeros(chunk.n, np.bool_)
            table = np.zeros(len(w.growing) + 1, np.intp)
            for at, place in w.slots.items():
                wanted |= leaf == at
                table[at] = place
            rows = np.flatnonzero(wanted & seen)
            if many > 1:
                slot = table.take(leaf.take(rows))
        else:
            rows = np.flatnonzero(seen)
        if len(rows) < chunk.n:
            raw, y, codes = raw.take(rows), y.take(rows), [c.take(rows) for c in codes]
        if w.kind == "classifier":
            p = np.negative(raw)
            np.exp(p, out=p)
            p += 1.0
            np.divide(1.0, p, out=p)
            weights = (p - y, p * (1.0 - p), None)
        else:
            weights = (raw - y, None)
        for code, (_, cells), of in zip(codes, self.groups, self.of):
            cell = code.astype(np.intp)
            if slot is not None:
                cell += slot * cells
            for total, weight in zip(of, weights):
                total += np.bincount(cell, weight, many * cells).reshape(many, cells)

    def histograms(self) -> np.ndarray:
        """(gradient, second derivative, rows) x slots x bins of the fit's features."""
        starts = np.concatenate([[0], np.cumsum(self.widths)]).astype(int)
        out = np.empty((3, len(self.w.slots), starts[-1]))
        sums = (0, 1, 2) if self.w.kind == "classifier" else (0, 2)
        for (places, _), rest in zip(self.groups, self.of):
            for f in reversed(places):
                rest = rest.reshape(len(sums), len(self.w.slots), -1, self.widths[f])
                out[sums, :, starts[f]:starts[f + 1]] = rest.sum(axis=2)
                rest = rest.sum(axis=3)
        if self.w.kind != "classifier":
            out[1] = out[2]
        return out


def histograms(chunk: _Chunk, w: _Wanted, widths: list) -> np.ndarray:
    """(gradient, second derivative, rows) x slots x bins of the fit's features, for one chunk."""
    sums = _Sums(w, widths)
    sums.add(chunk, sums.codes(chunk))
    return sums.histograms()


_PART = pa.schema([("fit", pa.int32()), ("task", pa.int32()), ("sums", pa.binary())])


def _table(parts: list) -> pa.Table:
    """Tuples of fit, task and the bytes of sums."""
    columns = zip(*parts) if parts else ((), (), ())
    return pa.table([pa.array(c, t.type) for c, t in zip(columns, _PART)], schema=_PART)


def _count(shape: tuple, inits: list, widths: list, most: int, wanted: list, finders: dict | None):
    """Chunks -> a tuple for each fit with the task's histograms; with ``finders``, as for the only task, with the best splits."""

    def count(rows):
        _settle()
        sums = None
        for row in rows:
            chunk, codes = _Chunk(row, shape, inits), {}
            sums = sums or [_Sums(w, widths, most) for w in wanted]
            for s in sums:
                key = tuple(s.w.features)
                if key not in codes:
                    codes[key] = s.codes(chunk)
                s.add(chunk, codes[key])
        for s in sums or ():
            found = s.histograms()
            yield s.w.fit, TaskContext.get().partitionId(), (found if finders is None else finders[s.w.fit](found)).tobytes()

    return count


def _scored(shape: tuple, inits: list, trees: dict):
    """Chunks -> chunks with the scores after the ``trees`` (splits, values) of each fit were added; a fit without is done."""

    def score(rows):
        _settle()
        for row in rows:
            chunk = _Chunk(row, shape, inits)
            raw = np.zeros((len(inits), chunk.n))
            for fit, (splits, values) in trees.items():
                raw[fit] = chunk.scores(fit, splits, values)
            yield {**row, "raw": raw.tobytes()}

    return score


def _totals(table: pa.Table) -> dict:
    """fit -> the sum of its tasks' histograms, added in the tasks' order."""
    out: dict = {}
    fits, tasks, sums = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table.columns)
    tasks = tasks.to_numpy()
    fits = fits.to_numpy()
    for i in np.argsort(tasks, kind="stable").tolist():
        part = np.frombuffer(sums[i].as_buffer())
        number = int(fits[i])
        if number in out:
            out[number] += part
        else:
            out[number] = part.copy()
    return out


def _add_groups(parts) -> list:
    """(fit, task, sums) of some fits and tasks, keyed -> one of each key."""
    held: dict = {}
    for key, part in parts:
        held.setdefault(key, []).append(part)
    out = []
    for (fit, _), group in held.items():
        out.append((fit, min(task for _, task, _ in group), _totals(_table(group))[fit].tobytes()))
    return out


class SplitFinder:
    """The best split of each node, from the nodes' histograms over one fit's bins."""

    def __init__(self, widths: list, growth: Growth):
        self.growth = growth
        self.starts = np.concatenate([[0], np.cumsum(widths)])[:-1].astype(int)
        self.feature = np.repeat(np.arange(len(widths)), widths)
        self.bin = np.arange(len(self.feature)) - self.starts[self.feature]
        self.last = self.bin == np.array(widths)[self.feature] - 1

    def __call__(self, hist: np.ndarray) -> np.ndarray:
        """Gain (0: no split), feature, bin, the left side's three sums and the node's, of each node (a row)."""
        g = self.growth
        hist = hist.reshape(3, -1, len(self.feature))
        run = np.cumsum(hist, axis=2)
        before = np.concatenate([np.zeros(run.shape[:2] + (1,)), run], axis=2)[:, :, self.starts]
        left = run - before[:, :, self.feature]
        total = hist[:, :, self.feature == 0].sum(axis=2)[:, :, None]
        right = total - left
        weight = 1 if g.second_order else 2
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = left[0] ** 2 / left[weight] + right[0] ** 2 / right[weight] - total[0] ** 2 / total[weight]
        fits = (left[2] >= g.min_leaf) & (right[2] >= g.min_leaf) & (left[1] >= g.min_hessian) & (right[1] >= g.min_hessian)
        fits &= ~self.last & (left[2] > 0) & (right[2] > 0) & np.isfinite(gain)
        gain = np.where(fits, gain, 0.0)
        # the first feature and bin at a tie, which sums in another order must not break
        best = (gain >= gain.max(axis=1, keepdims=True) * (1 - 1e-9)).argmax(axis=1)
        nodes = np.arange(len(best))
        return np.column_stack([gain[nodes, best], self.feature[best], self.bin[best], left[:, nodes, best].T, total[:, :, 0].T])


def _find(finders: dict):
    """The tasks' histograms of some fits, keyed by fit -> one row a fit with its nodes' best splits."""

    def find(parts):
        held = [part for _, part in parts]
        return [(fit, 0, finders[fit](total).tobytes()) for fit, total in _totals(_table(held)).items()] if held else []

    return find


def _label_bytes(columns: list) -> bytes:
    """A byte a label if all are whole numbers below 256 (0/1 labels), else eight."""
    small = all(((c >= 0) & (c < 256) & (c == np.floor(c))).all() for c in columns)
    return b"".join(c.astype(np.uint8 if small else np.float64).tobytes() for c in columns)


def _gather(edges: list, labels: int, masks: int):
    """Arrow batches of features, labels, masks -> one row a chunk of at most CHUNK_ROWS rows."""
    schema = pa.schema([("chunk", pa.string()), ("n", pa.int64()), ("bins", pa.binary()), ("labels", pa.binary()), ("masks", pa.binary())])

    def gather(batches):
        _settle()
        task, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def chunk():
            columns = [np.concatenate(c) for c in zip(*held)]
            f, n = len(edges), size
            values = [f"{task}-{number}", n, b"".join(c.tobytes() for c in columns[:f]),
                      _label_bytes(columns[f:f + labels]), b"".join(c.tobytes() for c in columns[f + labels:])]
            return pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(values, schema)], schema=schema)

        for batch in batches:
            for low in range(0, batch.num_rows, CHUNK_ROWS):
                part = batch.slice(low, CHUNK_ROWS)
                if held and size + part.num_rows > CHUNK_ROWS:
                    yield chunk()
                    held, size, number = [], 0, number + 1
                row = [binned(c.cast(pa.float64()).fill_null(np.nan).to_numpy(), e) for c, e in zip(part.columns, edges)]
                row += [c.fill_null(0.0).to_numpy() for c in part.columns[len(edges):len(edges) + labels]]
                row += [c.fill_null(False).to_numpy(zero_copy_only=False) for c in part.columns[len(edges) + labels:]]
                held.append(row)
                size += part.num_rows
        if size:
            yield chunk()

    return gather, "chunk string, n long, bins binary, labels binary, masks binary"


# ---- growth on the driver -----------------------------------------------------

class _Node:
    __slots__ = ("leaf", "depth", "sums", "gain", "rank", "split", "left", "children", "parent")

    def __init__(self, leaf, depth, sums, parent):
        self.leaf, self.depth, self.sums, self.parent = leaf, depth, sums, parent
        self.split = self.left = self.children = None
        self.gain, self.rank = 0.0, 0.0


class _Fit:
    """The state of one fit: finished trees and the tree in growth."""

    def __init__(self, number: int, spec: FitSpec, features: list, label: int, mask: int, init: float, rows: int, widths: list, growth: Growth):
        self.number, self.spec, self.features, self.label, self.mask = number, spec, features, label, mask
        self.init, self.growth, self.rows = init, growth, rows
        self.find = SplitFinder([widths[f] for f in features], growth) if features else None
        self.splits = np.empty((0, growth.most_splits, 3), np.int16)
        self.values = np.empty((0, growth.most_splits + 1))
        self.done = rows == 0 or growth.trees == 0 or not features
        self.start()

    def start(self) -> None:
        self.nodes, self.growing = [_Node(0, 0, None, None)], []
        self.asked = list(self.nodes)

    def wanted(self, have: int) -> _Wanted:
        return _Wanted(self.number, self.spec.kind, self.features, self.label, self.mask, self.splits[have:], self.values[have:],
                       np.array([(leaf, self.features[f], b) for leaf, f, b in self.growing], np.int16).reshape(-1, 3),
                       {node.leaf: slot for slot, node in enumerate(self.asked)})

    def take(self, found: np.ndarray) -> None:
        """The best splits of the nodes asked for (SplitFinder's rows): grow on."""
        for node, row in zip(self.asked, found):
            if node.sums is None:
                node.sums = row[6:]
            if self.may_split(node) and row[0] > LEAST_GAIN:
                node.gain, node.split, node.left = row[0], (int(row[1]), int(row[2])), row[3:6]
                node.rank = node.gain if node.parent is None else min(node.gain, node.parent.rank)
        self.grow()

    def may_split(self, node: _Node) -> bool:
        g = self.growth
        return (g.depth <= 0 or node.depth < g.depth) and node.sums[2] >= max(g.min_split, 2 * g.min_leaf, 2)

    def chosen(self) -> list:
        """The nodes that best-first growth splits, as far as nodes are known; parents before children."""
        able = [n for n in self.nodes if n.split is not None]
        return sorted(able, key=lambda n: -n.rank)[:self.growth.leaves - 1]  # stable, so a parent precedes its children

    def grow(self) -> None:
        """Split what is sure to be chosen by what is known; finish the tree when nothing more has to be counted."""
        self.asked = []
        for node in [n for n in self.chosen() if n.children is None]:
            self.growing.append((node.leaf, *node.split))
            left = _Node(node.leaf, node.depth + 1, node.left, node)
            right = _Node(len(self.growing), node.depth + 1, node.sums - node.left, node)
            node.children = (left, right)
            self.nodes += [left, right]
            self.asked += [c for c in node.children if self.may_split(c)]
        if not self.asked:
            self.finish()

    def finish(self) -> None:
        kept = self.chosen()
        splits = np.full((1, self.growth.most_splits, 3), -1, np.int16)
        values = np.zeros((1, self.growth.most_splits + 1))
        place = {id(self.nodes[0]): 0}
        ends = {0: self.nodes[0]}
        for i, node in enumerate(kept):
            at = place[id(node)]
            splits[0, i] = (at, self.features[node.split[0]], node.split[1])
            place[id(node.children[0])], place[id(node.children[1])] = at, i + 1
            ends[at], ends[i + 1] = node.children
        for leaf, node in ends.items():
            if node.sums[1] > 0:
                values[0, leaf] = -self.growth.rate * node.sums[0] / node.sums[1]
        if kept:
            self.splits, self.values = np.concatenate([self.splits, splits]), np.concatenate([self.values, values])
        # without a split no later tree would have one either
        self.done = not kept or len(self.splits) == self.growth.trees
        self.start()


def _edges_and_means(df: DataFrame, n_features: int, specs: list, labels: list, masks: list) -> tuple[list, list, list]:
    """Quantile edges of each feature; the label mean and the rows of each fit: one aggregation."""
    points = F.array(*[F.lit((i + 1) / (MAX_EDGES + 1)) for i in range(MAX_EDGES)])
    aggs = []
    for i in range(n_features):
        value = F.when(~F.isnan(f"f{i}"), F.col(f"f{i}"))
        aggs.append(F.array_sort(F.array_distinct(F.percentile_approx(value, points, QUANTILE_ACCURACY))).alias(f"e{i}"))
    for j, _ in enumerate(specs):
        aggs += [F.avg(F.when(F.col(f"m{masks[j]}"), F.col(f"l{labels[j]}"))).alias(f"mean{j}"),
                 F.count(F.when(F.col(f"m{masks[j]}"), 1)).alias(f"rows{j}")]
    row = df.agg(*aggs).first()
    edges = [np.array(row[f"e{i}"] if row[f"e{i}"] is not None else [], float) for i in range(n_features)]
    return edges, [row[f"mean{j}"] or 0.0 for j in range(len(specs))], [row[f"rows{j}"] for j in range(len(specs))]


def _numbered(items: list) -> tuple[list, list]:
    """Distinct items by their text, and each item's number among them."""
    seen: dict = {}
    numbers = [seen.setdefault(str(i), (len(seen), i))[0] for i in items]
    return [i for _, i in seen.values()], numbers


def _train(chunks: RDD, tasks: int, fits: list, shape: tuple, widths: list) -> None:
    """Grow all trees of ``fits`` (numbered from 0), a job for each level that any of them waits for."""
    inits, rows = [f.init for f in fits], max((f.rows for f in fits), default=0) // tasks
    every = max(1, isqrt(REPLAY_ROWS // max(1, rows * len(fits))))  # trees between updates of the cached scores
    most = min(JOINT_BINS, rows // 4)  # few rows are not worth many joint bins
    state, have, steps = None, [0] * len(fits), 0
    try:
        while active := [f for f in fits if not f.done]:
            old = None
            if state is None or sum(len(f.splits) - have[f.number] for f in active) >= every * len(active):
                old, anew = state, state is None or steps == STEPS
                known = [0] * len(fits) if anew else have
                update = _scored(shape, inits, {f.number: (f.splits[known[f.number]:], f.values[known[f.number]:]) for f in active})
                state = _unbatched((chunks if anew else old).mapPartitions(update, True)).persist(StorageLevel.MEMORY_AND_DISK_DESER)
                have, steps = [len(f.splits) for f in fits], 1 if anew else steps + 1
            finders = {f.number: f.find for f in active}
            wanted = [f.wanted(have[f.number]) for f in active]
            sums = state.mapPartitions(_count(shape, inits, widths, most, wanted, finders if tasks == 1 else None))
            groups = tasks
            while groups > FAN_IN:
                groups = -(-groups // FAN_IN)
                keyed = sums.map(lambda part, n=groups: ((part[0], part[1] % n), part))
                sums = keyed.partitionBy(groups * len(active), _place(groups)).mapPartitions(_add_groups)
            if tasks > 1:
                places = {f.number: i for i, f in enumerate(active)}
                sums = sums.map(lambda part: (part[0], part)).partitionBy(min(FINDERS, len(active)), places.get).mapPartitions(_find(finders))
            for number, found in _totals(_table(sums.collect())).items():
                fits[number].take(found.reshape(len(fits[number].asked), -1))
            if old is not None:
                old.unpersist()
    finally:
        if state is not None:
            state.unpersist()


def _place(groups: int):
    return lambda key: key[0] * groups + key[1]


def _unbatched(rdd: RDD) -> RDD:
    """A chunk is an object of its own: batches of them would be as large as a partition."""
    return rdd._reserialize(CPickleSerializer())


def fit_all(df: DataFrame, features: dict, specs: list[FitSpec], growth: Growth) -> dict[str, BoostedTrees]:
    """Fit every spec on ``df``; ``features`` maps names to Columns, missing values count as largest.

    ``df`` is read twice (edges, chunks): a written table, or cheap to compute.
    """
    spark, names = df.sparkSession, list(features)
    labels, label_no = _numbered([s.label for s in specs])
    masks, mask_no = _numbered([F.lit(True) if s.rows is None else s.rows for s in specs])
    narrow = df.select(*[features[n].cast("double").alias(f"f{i}") for i, n in enumerate(names)],
                       *[c.cast("double").alias(f"l{i}") for i, c in enumerate(labels)],
                       *[F.coalesce(c.cast("boolean"), F.lit(False)).alias(f"m{i}") for i, c in enumerate(masks)])
    edges, means, rows = _edges_and_means(narrow, len(names), specs, label_no, mask_no)
    widths = [len(e) + 1 for e in edges]
    fits = []
    for j, s in enumerate(specs):
        mean = min(max(means[j], 1e-12), 1 - 1e-12)
        init = float(np.log(mean / (1 - mean))) if s.kind == "classifier" else means[j]
        fits.append(_Fit(j // GROUPS, s, [names.index(f) for f in s.features], label_no[j], mask_no[j], init, rows[j], widths, growth))
    ship_package(spark)
    gather, ddl = _gather(edges, len(labels), len(masks))
    tasks = max(1, min(spark.sparkContext.defaultParallelism, -(-max(rows, default=0) // TASK_ROWS)))
    # RDDs from here: jobs without planning, and cached chunks reach the workers as they are
    chunks = write_stage_table(narrow.repartition(tasks).mapInArrow(gather, ddl), "chunks").rdd.map(lambda row: row.asDict())
    shape, tasks = (len(names), len(labels), len(masks)), chunks.getNumPartitions()
    # one group's jobs run while the driver picks the other's splits
    run_concurrently([lambda g=g: _train(chunks, tasks, fits[g::GROUPS], shape, widths) for g in range(min(GROUPS, len(fits)))], GROUPS)
    out = {}
    for f in fits:
        own = np.full(len(names) + 1, -1, np.int16)  # the place of a feature in the fit's own list; the last entry is for -1
        own[f.features] = range(len(f.features))
        splits = f.splits.copy()
        splits[:, :, 1] = own[splits[:, :, 1]]
        out[f.spec.name] = BoostedTrees(f.spec.kind, [names[i] for i in f.features], [edges[i] for i in f.features], f.init,
                                        splits, f.values)
    return out


def score_columns(df: DataFrame, models: list[tuple]) -> DataFrame:
    """``df`` with a prediction column for each (output name, BoostedTrees, {feature: Column}); one Arrow pass for all.

    A fourth item, a Column, names the rows that need the prediction; it is NaN in the others.
    """
    from pyspark.sql.functions import pandas_udf

    ship_package(df.sparkSession)
    inputs, numbers = _numbered([cols[f] for _, m, cols, *_ in models for f in m.features])
    wanted, places = _numbered([F.lit(True) if not rows else rows[0] for _, _, _, *rows in models])
    taken, at = [], 0
    for _, m, *_ in models:
        taken.append(numbers[at:at + len(m.features)])
        at += len(m.features)
    trees, some = [m for _, m, *_ in models], [bool(rows) for _, _, _, *rows in models]
    width = len(inputs)

    def predict(*columns):
        import pandas as pd

        _settle()
        values, n, kept, out = [c.to_numpy(float) for c in columns[:width]], len(columns[0]), {}, {}
        masks = [c.to_numpy(float) == 1 for c in columns[width:]]

        def bins(column, edges):  # the models of a run share their edges
            key = column, id(edges)
            if key not in kept:
                kept[key] = binned(values[column], edges)
            return kept[key]

        for i, (m, mine) in enumerate(zip(trees, taken)):
            if not mine:
                out[f"s{i}"] = np.full(n, m.init)
                continue
            found = np.stack([bins(j, e) for j, e in zip(mine, m.edges)])
            if some[i]:
                rows = np.flatnonzero(masks[places[i]])
                out[f"s{i}"] = np.full(n, np.nan)
                out[f"s{i}"][rows] = m.binned_scores(np.ascontiguousarray(found[:, rows]))
            else:
                out[f"s{i}"] = m.binned_scores(found)
        return pd.DataFrame(out)

    udf = pandas_udf(predict, ", ".join(f"s{i} double" for i in range(len(trees))))
    scored = df.select("*", udf(*[c.cast("double") for c in inputs + wanted]).alias("_scores"))
    return scored.select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(f"_scores.s{i}").alias(out) for i, (out, *_) in enumerate(models)])
