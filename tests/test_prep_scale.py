"""Placebo circle and sparse one-hot vectors."""

import pytest
from pyspark.sql import functions as F

from cauldron.functions.scalar import hash_uniform
from cauldron.operators import prep as pp


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_every_row_gives_its_treatment_to_one_other(spark, n):
    df = spark.range(n).select(F.col("id").alias("customer_id"), F.col("id").alias("treatment_received"))
    got = [tuple(r) for r in pp.permute_treatment(df.repartition(3)).collect()]
    assert sorted(i for i, _ in got) == sorted(t for _, t in got) == list(range(n))
    if n > 1:
        assert all(i != t for i, t in got)
        at, seen = 0, set()
        follow = dict(got)
        while at not in seen:
            seen.add(at)
            at = follow[at]
        assert len(seen) == n  # one circle
    assert pp.permute_treatment(df, out="placebo").columns == ["customer_id", "treatment_received", "placebo"]


def test_missing_treatments_move_too(spark):
    df = spark.range(60).select(F.col("id").alias("customer_id"), F.when(F.col("id") % 3 > 0, F.col("id") % 2).alias("treatment_received"))
    count = lambda d: {r[0]: r[1] for r in d.groupBy("treatment_received").count().collect()}
    assert count(pp.permute_treatment(df)) == count(df)


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_whole_shuffle_joins_two_independent_orders(spark, n):
    df = spark.range(n).select(F.col("id").alias("customer_id"), (F.col("id") * 3).alias("treatment_received"), F.lit("x").alias("rest"))
    got = pp.permute_treatment(df.repartition(3), circle=False)
    assert got.columns == df.columns
    orders = [[r[0] for r in df.orderBy(hash_uniform("customer_id", 42, salt), "customer_id").collect()] for salt in ("perm1", "perm2")]
    assert sorted(tuple(r) for r in got.collect()) == sorted((i, 3 * j, "x") for i, j in zip(*orders))
    assert pp.permute_treatment(df, out="placebo", circle=False).columns == [*df.columns, "placebo"]


def test_whole_shuffle_keeps_missing_and_repeated_keys(spark):
    df = spark.range(90).select(F.when(F.col("id") % 5 > 0, F.col("id") % 20).alias("customer_id"),
                                F.when(F.col("id") % 3 > 0, F.col("id") % 2).alias("treatment_received"))
    of = lambda d, c: sorted(r[0] for r in d.select(F.col(c).cast("string").alias("v")).fillna("-").collect())
    got = pp.permute_treatment(df, circle=False)
    assert all(of(got, c) == of(df, c) for c in df.columns)


def test_refutations_shuffle_the_whole_treatment(spark, monkeypatch):
    from cauldron.operators import refute
    from cauldron.schema import ModelConfig

    asked = []

    def stop(*_, **named):
        asked.append(named.get("circle", True))
        raise InterruptedError

    monkeypatch.setattr(refute, "permute_treatment", stop)
    monkeypatch.setattr(refute, "mean_effect", lambda *_: 0.0)
    df = spark.range(3).select(F.col("id").alias("customer_id"))
    for base in ("lightgbm", "linear"):
        with pytest.raises(InterruptedError):
            refute.refit_means(df, ModelConfig(base_learner=base))
    assert asked == [False, False]


def test_sparse_one_hot_of_many_levels(spark):
    df = spark.range(100_000).select("id", F.concat(F.lit("level"), F.col("id")).alias("x"))
    coder = pp.SparseOneHot.fit(df, "x")
    assert coder.size == 100_000
    probe = spark.createDataFrame([(1, "level7"), (2, "other"), (3, None), (4, "level0")], "k int, x string")
    got = {r.k: r.v for r in coder.transform(probe, "v").collect()}
    order = sorted(f"level{i}" for i in range(100_000))
    assert got[1].size == 100_000 and got[1].indices.tolist() == [order.index("level7")] and got[4].indices.tolist() == [0]
    assert got[2].indices.tolist() == got[3].indices.tolist() == []
    plan = coder.transform(df, "v")._jdf.queryExecution().analyzed().toString()
    assert len(plan) < 20_000 and "level77" not in plan


def test_sparse_one_hot_without_levels(spark):
    df = spark.createDataFrame([(1, None)], "k int, x string")
    assert pp.SparseOneHot.fit(df, "x").transform(df, "v").first().v is None


def test_sparse_one_hot_joins_large_dictionaries(spark, monkeypatch):
    monkeypatch.setattr(pp.SparseOneHot, "SHARED_LEVELS", 2)
    df = spark.createDataFrame([(i, f"l{i % 5}") for i in range(50)], "k int, x string")
    rows = pp.SparseOneHot.fit(df, "x").transform(df, "v").collect()
    assert all(r.v.indices.tolist() == [r.k % 5] for r in rows)
