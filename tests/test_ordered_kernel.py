"""The prefix kernel against a plain window over the same total order."""

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cauldron.operators.ordered import exact_median, global_rank, running_totals


def plain(rows, desc):
    """(id -> (running sum, rank)) in the documented order: by key, ties by id, NULL and NaN last."""
    def order(r):
        missing = r[0] is None or (isinstance(r[0], float) and math.isnan(r[0]))
        return (1, 0, r[1]) if missing else (0, -r[0] if desc and not isinstance(r[0], str) else r[0], r[1])

    total, out = 0, {}
    for n, r in enumerate(sorted(rows, key=order)):
        total += r[2]
        out[r[1]] = (total, n + 1)
    return out


def kernel(df, **kw):
    got = running_totals(df, "k", "id", {"s": F.col("v")}, **kw)
    assert got.columns == ["k", "id", "v", "s", "rank"]
    return {r.id: (r.s, r["rank"]) for r in got.collect()}


@pytest.mark.parametrize("desc", [True, False])
@pytest.mark.parametrize("buckets", [1, 7, 300])
def test_double_keys_with_ties_nan_and_null(spark, desc, buckets):
    rnd = random.Random(4)
    keys = [None, float("nan"), float("inf"), -float("inf"), 0.0, 0.5, 0.5]
    rows = [(rnd.choice(keys) if i % 2 else rnd.random(), i, rnd.randrange(-9, 9)) for i in range(400)]
    df = spark.createDataFrame(rows, "k double, id long, v long").repartition(5)
    assert kernel(df, desc=desc, buckets=buckets) == plain(rows, desc)


@pytest.mark.parametrize("desc", [True, False])
def test_long_keys_beyond_doubles(spark, desc):
    rows = [((1 << 62) + i // 2, i, i) for i in range(200)] + [(-(1 << 63), 900, 1), ((1 << 63) - 1, 901, 1), (None, 902, 1)]
    df = spark.createDataFrame(rows, "k long, id long, v long")
    assert kernel(df, desc=desc, buckets=16) == plain(rows, desc)


def test_string_keys_ascend(spark):
    rows = [(random.Random(i).choice(["é", "a", "b", "", "zz"]), i, 1) for i in range(100)]
    df = spark.createDataFrame(rows, "k string, id long, v long")
    assert kernel(df, desc=False, buckets=9) == plain(rows, False)
    with pytest.raises(ValueError):
        running_totals(df, "k", "id", {}, desc=True)


@pytest.mark.parametrize("rows", [[], [(1.5, 1, 3)], [(None, 1, 3)]])
def test_few_rows(spark, rows):
    df = spark.createDataFrame(rows, "k double, id long, v long")
    assert kernel(df) == plain(rows, True)


def test_a_hot_key_is_spread_and_the_plan_has_no_single_window(spark):
    df = spark.range(6000).select(F.when(F.col("id") % 3 == 0, 1.0).otherwise(F.col("id") * 0.1).alias("k"),
                                  "id", F.lit(1).alias("v"))
    got = running_totals(df, "k", "id", {"s": F.col("v")}, buckets=60)
    assert got.where("s <> rank").count() == 0 and got.agg(F.max("rank")).first()[0] == 6000
    w = Window.orderBy(F.desc("k"), "id")
    want = df.select("id", F.row_number().over(w).alias("r"))
    assert got.join(want, "id").where("r <> rank").count() == 0


def test_partitioning_does_not_matter(spark):
    df = spark.range(500).select((F.col("id") % 17).alias("k"), "id", F.col("id").alias("v"))
    a = kernel(df, desc=False, buckets=9)
    assert a == kernel(df.repartition(3), desc=False, buckets=5)


def test_null_values_sum_as_nothing(spark):
    df = spark.createDataFrame([(1.0, 1, None), (2.0, 2, 5), (3.0, 3, None)], "k double, id long, v long")
    assert kernel(df, desc=False, buckets=3) == {1: (0, 1), 2: (5, 2), 3: (5, 3)}


def test_exact_median(spark):
    df = spark.createDataFrame([(float(x), i) for i, x in enumerate([5, 1, 4, 2, 3, 9])], "x double, id long")
    assert exact_median(df, "x", "id").collect()[0][0] == 3.5
    odd = df.where("id < 5")
    assert exact_median(odd, "x", "id").collect()[0][0] == 3.0
    assert exact_median(df.limit(0), "x", "id").collect()[0][0] is None
    assert global_rank(df, "x", "id", desc=False).orderBy("rank").first().x == 1.0
