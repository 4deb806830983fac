"""Histogram boosting in shared jobs against a plain best-first grower."""

import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from cauldron.functions.scalar import hash_normal, hash_uniform
from cauldron.operators import boosting as bo


@pytest.fixture(scope="module")
def frame(spark):
    df = spark.range(1500).select("id", hash_normal("id", 1).alias("a"), F.round(hash_normal("id", 2), 1).alias("b"),
                                  F.floor(hash_uniform("id", 3, "c") * 3).alias("c"), F.lit(1.0).alias("same"))
    df = df.withColumn("p", 1 / (1 + F.exp(-(F.col("a") + F.col("b") * (F.col("c") - 1)))))
    df = df.withColumn("y", (hash_uniform("id", 4, "y") < F.col("p")).cast("int"))
    df = df.withColumn("z", F.col("a") * F.col("c") + 0.3 * hash_normal("id", 5))
    return df.checkpoint(eager=True)


FEATURES = ("a", "b", "c", "same")


def plain_fit(x, y, edges, kind, g):
    """Trees grown one split at a time, every node counted from its own rows."""
    bins = [bo.binned(c, e) for c, e in zip(x, edges)]
    mean = y.mean()
    raw = np.full(len(y), np.log(mean / (1 - mean)) if kind == "classifier" else mean)
    trees = []

    def best(rows, grad, hess, depth):
        if (g.depth > 0 and depth >= g.depth) or len(rows) < max(g.min_split, 2 * g.min_leaf, 2):
            return None
        weight = hess if g.second_order else np.ones(len(y))
        top = (bo.LEAST_GAIN, None)
        for f, b in enumerate(bins):
            for edge in range(len(edges[f])):
                low, high = rows[b[rows] <= edge], rows[b[rows] > edge]
                if min(len(low), len(high)) < max(1, g.min_leaf) or min(hess[low].sum(), hess[high].sum()) < g.min_hessian:
                    continue
                gain = sum(s * grad[r].sum() ** 2 / weight[r].sum() for s, r in ((1, low), (1, high), (-1, rows)))
                if gain > top[0] * (1 + 1e-9):
                    top = (gain, (f, edge, low, high))
        return top if top[1] else None

    for _ in range(g.trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = (p - y, p * (1 - p)) if kind == "classifier" else (raw - y, np.ones(len(y)))
        leaves, heap, count, made = {0: np.arange(len(y))}, [], 0, 0
        first = best(leaves[0], grad, hess, 0)
        if first:
            heap = [(-first[0], count, 0, 0, first[1])]
        while heap and len(leaves) < g.leaves:
            _, _, leaf, depth, (f, edge, low, high) = heapq.heappop(heap)
            made += 1
            new = made
            leaves[leaf], leaves[new] = low, high
            for at, rows in ((leaf, low), (new, high)):
                found = best(rows, grad, hess, depth + 1)
                if found:
                    count += 1
                    heapq.heappush(heap, (-found[0], count, at, depth + 1, found[1]))
        step = np.zeros(len(y))
        for rows in leaves.values():
            step[rows] = -g.rate * grad[rows].sum() / hess[rows].sum()
        raw = raw + step
        trees.append(len(leaves))
    return (1 / (1 + np.exp(-raw)) if kind == "classifier" else raw), trees


@pytest.mark.parametrize("growth", [
    bo.Growth(trees=4, depth=3, leaves=31, min_leaf=20),
    bo.Growth(trees=3, depth=0, leaves=7, min_leaf=15),
    bo.Growth(trees=3, depth=5, leaves=5, min_leaf=5),
    bo.Growth(trees=3, depth=3, leaves=8, min_leaf=1, min_split=10, min_hessian=0.0, second_order=False)])
def test_trees_equal_plain_growth(spark, frame, growth, monkeypatch):
    monkeypatch.setattr(bo, "TASK_ROWS", 400)  # several tasks, so sums meet
    half = F.col("id") % 2 == 0
    specs = [bo.FitSpec("y", "classifier", FEATURES, F.col("y")), bo.FitSpec("z", "regressor", FEATURES[:3], F.col("z")),
             bo.FitSpec("half", "classifier", ("b", "a"), F.col("y"), half)]
    models = bo.fit_all(frame, {f: F.col(f) for f in FEATURES}, specs, growth)
    rows = frame.orderBy("id").toPandas()
    for s in specs:
        m = models[s.name]
        seen = rows[rows.id % 2 == 0] if s.name == "half" else rows
        x = [seen[f].to_numpy(float) for f in s.features]
        want, leaves = plain_fit(x, seen["z" if s.name == "z" else "y"].to_numpy(float), m.edges, s.kind, growth)
        assert np.allclose(m.scores(x), want, atol=1e-9)
        assert [(t[:, 0] >= 0).sum() + 1 for t in m.splits] == leaves
    cols = {f: F.col(f) for f in FEATURES}
    got = bo.score_columns(frame, [("half", models["half"], cols)]).orderBy("id").toPandas()
    again = bo.BoostedTrees.from_dict(models["half"].as_dict())
    assert (again.scores([rows["b"].to_numpy(float), rows["a"].to_numpy(float)]) == got["half"]).all()
    assert np.allclose(got["half"], models["half"].scores([rows["b"].to_numpy(float), rows["a"].to_numpy(float)]))


def test_partial_sums_add_up_in_groups(spark, frame, monkeypatch):
    monkeypatch.setattr(bo, "TASK_ROWS", 300)
    spec = [bo.FitSpec("y", "classifier", FEATURES, F.col("y"))]
    cols, g = {f: F.col(f) for f in FEATURES}, bo.Growth(trees=2, depth=2)
    whole = bo.fit_all(frame, cols, spec, g)["y"]
    monkeypatch.setattr(bo, "FAN_IN", 2)
    grouped = bo.fit_all(frame, cols, spec, g)["y"]
    assert (whole.splits == grouped.splits).all() and np.allclose(whole.values, grouped.values)


def test_no_rows_no_features_missing_values(spark, frame):
    g = bo.Growth(trees=3, depth=2)
    cols = {"a": F.when(F.col("id") % 3 > 0, F.col("a")), "none": F.lit(None).cast("double")}
    specs = [bo.FitSpec("empty", "regressor", ("a",), F.col("z"), F.lit(False)), bo.FitSpec("bare", "classifier", (), F.col("y")),
             bo.FitSpec("gaps", "regressor", ("a", "none"), F.col("id") % 3 == 0)]
    models = bo.fit_all(frame, cols, specs, g)
    assert len(models["empty"].splits) == 0 and models["empty"].init == 0
    rate = frame.agg(F.avg("y")).first()[0]
    assert np.isclose(1 / (1 + np.exp(-models["bare"].init)), rate)
    gaps = models["gaps"]
    assert (gaps.splits[0, 0] == [0, 0, len(gaps.edges[0]) - 1]).all()  # the missing values part from all others


def test_a_worker_without_its_store_gives_the_same_sums():
    rng = np.random.default_rng(1)
    n, shape = 500, (2, 1, 1)
    row = {"n": n, "bins": rng.integers(0, 9, (2, n)).astype(np.uint8).tobytes(), "labels": rng.normal(size=n).tobytes(),
           "masks": np.ones(n, bool).tobytes()}
    splits = np.array([[[0, 0, 3], [1, 1, 5]], [[0, 1, 2], [-1, -1, -1]]], np.int16)
    values = rng.normal(size=(2, 3))
    wanted = lambda k: bo._Wanted(0, "regressor", [0, 1], 0, 0, splits[:k], values[:k], np.empty((0, 3), np.int16), {0: 0})
    step = bo._Chunk(row, shape, [0.5])
    bo.histograms(step, wanted(1), [9, 9])
    late = bo.histograms(step, wanted(2), [9, 9])
    assert (late == bo.histograms(bo._Chunk(row, shape, [0.5]), wanted(2), [9, 9])).all()
    assert (bo.histograms(step, wanted(1), [9, 9]) == bo.histograms(bo._Chunk(row, shape, [0.5]), wanted(1), [9, 9])).all()


@pytest.mark.parametrize("task_rows", [100, 400, 10_000])
def test_the_driver_sees_no_histograms(spark, frame, monkeypatch, task_rows):
    """A few numbers a node reach the driver, however many tasks and bins there are."""
    monkeypatch.setattr(bo, "TASK_ROWS", task_rows)
    seen, totals = [], bo._totals
    monkeypatch.setattr(bo, "_totals", lambda table: seen.append(sum(len(s.as_py()) for s in table.column("sums"))) or totals(table))
    specs = [bo.FitSpec("y", "classifier", FEATURES, F.col("y")), bo.FitSpec("z", "regressor", FEATURES, F.col("z"))]
    models = bo.fit_all(frame, {f: F.col(f) for f in FEATURES}, specs, bo.Growth(trees=2, depth=3))
    assert all(len(m.splits) == 2 for m in models.values()) and sum(len(e) for e in models["y"].edges) > 250
    assert seen and max(seen) <= 4 * 9 * 8  # of one fit (a chain each): nodes of the widest level, numbers, bytes


def test_tasks_add_few_trees_to_kept_scores(spark, frame, monkeypatch):
    """However many trees are grown, a task adds those since the last update of the cached scores; updates change no tree."""
    monkeypatch.setattr(bo, "TASK_ROWS", 400)
    specs = [bo.FitSpec("y", "classifier", FEATURES, F.col("y")), bo.FitSpec("z", "regressor", FEATURES, F.col("z"))]
    cols, g = {f: F.col(f) for f in FEATURES}, bo.Growth(trees=6, depth=2)
    whole = bo.fit_all(frame, cols, specs, g)
    added, count = [], bo._count
    monkeypatch.setattr(bo, "_count", lambda *args: added.extend(len(w.splits) for a in args if isinstance(a, list) for w in a
                                                                 if isinstance(w, bo._Wanted)) or count(*args))
    monkeypatch.setattr(bo, "REPLAY_ROWS", 0, raising=False)
    monkeypatch.setattr(bo, "STEPS", 2, raising=False)
    often = bo.fit_all(frame, cols, specs, g)
    assert added and max(added) == 0
    for name, m in whole.items():
        assert (m.splits == often[name].splits).all() and np.allclose(m.values, often[name].values, atol=1e-12)


def test_joint_bins_add_up_to_those_of_each_feature():
    rng = np.random.default_rng(2)
    n, widths = 3000, [5, 200, 2, 1, 30, 255, 2]
    bins = np.stack([rng.integers(0, w, n) for w in widths]).astype(np.uint8)
    y, raw, seen = rng.integers(0, 2, n).astype(float), rng.normal(size=n), rng.random(n) < 0.7
    row = {"n": n, "bins": bins.tobytes(), "labels": y.tobytes(), "masks": seen.tobytes(), "raw": raw.tobytes()}
    growing, at = np.array([[0, 1, 90], [0, 4, 9]], np.int16), [0, 1, 4, 5, 2, 6]
    leaf = np.where(bins[1] > 90, 1, np.where(bins[4] > 9, 2, 0))
    p = 1 / (1 + np.exp(-raw))
    groups = bo.packing([widths[f] for f in at])
    assert sorted(f for places, _ in groups for f in places) == list(range(len(at))) and len(groups) < len(at)
    for kind, g, h in (("classifier", p - y, p * (1 - p)), ("regressor", raw - y, np.ones(n))):
        wanted = bo._Wanted(0, kind, at, 0, 0, np.empty((0, 3, 3), np.int16), np.empty((0, 4)), growing, {2: 0, 1: 1})
        got, start = bo.histograms(bo._Chunk(row, (7, 1, 1), [0.0]), wanted, widths), 0
        for f in at:
            for slot, number in enumerate((2, 1)):
                rows = seen & (leaf == number)
                for sums, weight in zip(got, (g, h, np.ones(n))):
                    assert np.allclose(sums[slot, start:start + widths[f]], np.bincount(bins[f][rows], weight[rows], widths[f]))
            start += widths[f]


def test_predictions_only_where_wanted(spark, frame):
    specs = [bo.FitSpec("y", "classifier", FEATURES, F.col("y")), bo.FitSpec("z", "regressor", FEATURES[:2], F.col("z"))]
    cols = {f: F.col(f) for f in FEATURES}
    models, odd = bo.fit_all(frame, cols, specs, bo.Growth(trees=3, depth=2)), F.when(F.col("id") % 3 > 0, F.col("id") % 2 == 1)
    got = bo.score_columns(frame, [("y1", models["y"], cols), ("y2", models["y"], cols, odd), ("z2", models["z"], cols, ~odd)]).toPandas()
    x = [got[f].to_numpy(float) for f in FEATURES]
    wanted = ((got.id % 3 > 0) & (got.id % 2 == 1)).to_numpy()
    others = ((got.id % 3 > 0) & (got.id % 2 == 0)).to_numpy()
    assert np.allclose(got.y1, models["y"].scores(x)) and (got.y1[wanted] == got.y2[wanted]).all() and got.y2[~wanted].isna().all()
    assert (got.z2[others] == models["z"].scores(x[:2])[others]).all() and got.z2[~others].isna().all()
