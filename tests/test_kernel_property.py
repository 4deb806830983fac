"""Property: the bucketed prefix kernel equals a single ordered window on random inputs."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from cauldron.operators.ordered import running_totals


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    keys=st.lists(st.sampled_from([0.0, 0.25, 0.5, 0.75, 1.0, -3.0, 7.5]), min_size=30, max_size=300),
    buckets=st.sampled_from([3, 17, 90]),
    desc=st.booleans(),
)
def test_kernel_matches_naive(spark, keys, buckets, desc):
    rows = [(i, k, (i * 31) % 11) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "id long, k double, v long")
    got = running_totals(df, "k", "id", {"s": F.col("v")}, desc=desc, buckets=buckets)
    order = F.col("k").desc() if desc else F.col("k").asc()
    w = Window.orderBy(order, F.col("id")).rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("id", F.sum("v").over(w).alias("s"), F.row_number().over(w).alias("rank"))
    assert sorted(tuple(r) for r in got.select("id", "s", "rank").collect()) == \
        sorted(tuple(r) for r in want.collect())
