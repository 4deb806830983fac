"""Streaming upsert: order of arrival, whole-row quarantine, replay, compaction; streaming scoring."""

import tempfile

from pyspark.sql import functions as F

from cauldron.operators.allocate import uplift_segments
from cauldron.sources import derived
from cauldron.streaming import stream as st

from .conftest import SF_SMALL


def _run(spark, root):
    st.stream_upsert_customers(spark, f"{root}/inbox", f"{root}/table", f"{root}/quarantine", f"{root}/ckpt").awaitTermination()


def test_valid_rows_survive_bad_ones_of_the_same_id(spark):
    c = derived.customers(spark, SF_SMALL).orderBy("customer_id").limit(20).checkpoint(eager=True)
    root = tempfile.mkdtemp()
    c.coalesce(1).write.parquet(f"{root}/inbox")
    _run(spark, root)
    newer = c.withColumn("age", F.lit(77))
    broken = c.withColumn("customer_segment", F.lit("").cast("string")).withColumn("age", F.lit(13))
    nameless = c.limit(3).withColumn("customer_id", F.lit(None).cast("long"))
    broken.unionByName(newer).unionByName(nameless).coalesce(1).write.mode("append").parquet(f"{root}/inbox")
    _run(spark, root)
    current = st.read_current(spark, f"{root}/table")
    assert current.count() == 20 and current.where("age <> 77 OR customer_id IS NULL").count() == 0
    kept = spark.read.parquet(f"{root}/quarantine")
    assert kept.where("age = 13").count() == 20 and kept.where("customer_id IS NULL").count() == 3
    assert set(c.columns) <= set(kept.columns)


def test_later_rows_win_and_replays_change_nothing(spark):
    c = derived.customers(spark, SF_SMALL).orderBy("customer_id").limit(1).checkpoint(eager=True)
    root = tempfile.mkdtemp()
    versions = [c.withColumn("age", F.lit(30 + i)) for i in range(8)]
    one = versions[0]
    for v in versions[1:]:
        one = one.unionByName(v)
    one.coalesce(1).write.parquet(f"{root}/inbox")
    _run(spark, root)
    assert [r.age for r in st.read_current(spark, f"{root}/table").collect()] == [37]  # the file's last row
    stream = spark.read.parquet(f"{root}/inbox").withColumns(
        {"_time": F.lit("2000-01-01").cast("timestamp"), "_file": F.lit("f"), "_row": F.col("age").cast("long")})
    for parts in (1, 4):  # the same batch again, partitioned otherwise
        st.write_batch(stream.repartition(parts), 5, f"{root}/again", f"{root}/q")
        assert [r.age for r in st.read_current(spark, f"{root}/again").collect()] == [37]
        assert spark.read.parquet(f"{root}/again").count() == 8
    st.compact(spark, f"{root}/again", f"{root}/compact")
    assert spark.read.parquet(f"{root}/compact").count() == 1
    st.write_batch(stream.limit(1).withColumn("age", F.lit(50)), 6, f"{root}/compact", f"{root}/q")
    assert [r.age for r in st.read_current(spark, f"{root}/compact").collect()] == [50]


def test_stream_score_equals_batch(spark):
    base = derived.customer_base(spark, SF_SMALL)
    root = tempfile.mkdtemp()
    base.repartition(2).write.parquet(f"{root}/src")
    st.run_score_stream(spark, f"{root}/src", f"{root}/out", f"{root}/ckpt", derived.score_surrogate, schema=base.schema)
    got = {(r.customer_id, r.uplift_segment) for r in spark.read.parquet(f"{root}/out").collect()}
    want = {(r.customer_id, r.uplift_segment)
            for r in uplift_segments(derived.score_surrogate(base), baseline_threshold=0.25).collect()}
    assert got == want


def test_a_fitted_model_scores_a_stream(spark):
    """Each file is a batch of its own; the rows equal those of one batch transform."""
    import tempfile

    from cauldron.operators.allocate import uplift_segments
    from cauldron.operators.learners import CausalModel
    from cauldron.schema import ModelConfig
    from cauldron.sources import derived
    from cauldron.streaming import stream as st

    from .conftest import SF_SMALL

    c = derived.customers(spark, SF_SMALL).checkpoint(eager=True)
    fitted = CausalModel(ModelConfig(n_estimators=5)).fit(c)
    d = tempfile.mkdtemp()
    c.repartition(3).write.parquet(f"{d}/in")
    st.run_score_stream(spark, f"{d}/in", f"{d}/out", f"{d}/ckpt", fitted.transform, schema=c.schema, max_files_per_trigger=1)
    want = uplift_segments(fitted.transform(c), baseline_threshold=0.25)
    got = spark.read.parquet(f"{d}/out")
    cols = ["customer_id", "ite", "baseline_probability", "uplift_segment"]
    assert sorted(got.select(cols).collect()) == sorted(want.select(cols).collect())
