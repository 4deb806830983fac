"""Committed snapshots: replaces that fail, readers during a change, upserts of some buckets, bucketed joins."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from cauldron.sources import io as sio
from cauldron.sources import snapshots as sn


def runs(spark, n):
    p = spark.range(n).selectExpr("id AS customer_id", "0.2D AS baseline_probability", "0.4D AS treatment_probability", "0.2D AS ite")
    return p, spark.range(n).selectExpr("id AS customer_id", "1D AS discount_cost", "9D AS net_revenue")


def test_a_replace_that_fails_leaves_the_old_run(spark):
    root = tempfile.mkdtemp() + "/runs"
    p, money = runs(spark, 10)
    sio.import_run(p, money, root, 1, "a", 4.0)
    before = sorted(sio.read_run_table(spark, root, "predictions").collect())
    late = F.when(F.col("customer_id") == 7, F.raise_error(F.lit("lost"))).otherwise(F.col("ite"))
    for broken, sums in ((p.drop("ite"), money), (p, money.drop("discount_cost")), (p.withColumn("ite", late), money)):
        with pytest.raises(Exception):
            sio.import_run(broken, sums, root, 2, "a", 4.0, replace=True)
        assert sorted(sio.read_run_table(spark, root, "predictions").collect()) == before
        assert [r.model_run_id for r in sio.read_runs(spark, root).collect()] == [1]
    sio.import_run(p.limit(3), money, root, 2, "a", 4.0, replace=True)
    assert {r.model_run_id for r in sio.read_run_table(spark, root, "predictions").collect()} == {2}


def test_a_reader_sees_one_version(spark):
    root = tempfile.mkdtemp() + "/t"
    for version in range(4):
        seen = sn.read(spark, root, "rows")
        sn.replace_table(spark.range(100).select("id", F.lit(version).alias("v")), root)
        if seen is not None:  # opened before the commit, read after it
            assert seen.agg(F.min("v"), F.max("v"), F.count("*")).first() == (version - 1, version - 1, 100)
    assert len(os.listdir(f"{root}/rows")) == sn.KEPT_COMMITS  # older versions are gone


def test_a_change_made_from_an_old_version_is_refused(spark):
    root = tempfile.mkdtemp() + "/t"
    sn.replace_table(spark.range(3), root)
    seen = sn.current(spark, root)
    sn.replace_table(spark.range(5), root)
    with pytest.raises(RuntimeError, match="changed"):
        sn.commit(spark, root, {"rows": "rows/none"}, seen)
    assert sn.read(spark, root, "rows").count() == 5


def test_upsert_touches_its_buckets_only(spark):
    root = tempfile.mkdtemp() + "/t"
    rows = spark.range(400).select(F.col("id").alias("customer_id"), F.lit(0).alias("v"), F.lit(0).alias("seq"))
    sn.upsert_table(rows, root, buckets=16, seq_col="seq")
    before = sn.current(spark, root)
    batch = spark.createDataFrame([(5, 1, 1), (5, 2, 2), (9999, 3, 1)], "customer_id long, v int, seq int")
    sn.upsert_table(batch, root, buckets=3, seq_col="seq")
    after = sn.current(spark, root)
    assert len(before) == len(after) == 16 and 1 <= sum(before[p] != after[p] for p in after) <= 2
    got = {r.customer_id: r.v for r in sn.read_upserted(spark, root).collect()}
    assert len(got) == 401 and got[5] == 2 and got[9999] == 3 and sum(got.values()) == 5
    sn.upsert_table(batch.limit(0), root)
    assert sn.current(spark, root) == after
    assert sn.read_upserted(spark, tempfile.mkdtemp()) is None


def test_joins_of_bucketed_tables_need_no_exchange(spark):
    from cauldron.operators.joins import join_scored

    root = tempfile.mkdtemp()
    c = sn.store_bucketed(spark.range(500).selectExpr("id AS customer_id", "id % 7 AS age"), "stored_customers", f"{root}/c", buckets=4)
    p = sn.store_bucketed(spark.range(300).selectExpr("id AS customer_id", "0.1D AS ite"), "stored_predictions", f"{root}/p", buckets=4)
    try:
        for plan in (join_scored(c.hint("merge"), p), c.groupBy("customer_id").count()):
            assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
        assert join_scored(c, p).count() == 300
    finally:
        spark.sql("DROP TABLE stored_customers")
        spark.sql("DROP TABLE stored_predictions")
