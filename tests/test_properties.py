"""Properties over the derived customer table (sf0.001) and small frames."""

import pytest
from pyspark.sql import functions as F

from cauldron.operators import allocate as al
from cauldron.operators import metrics as mt
from cauldron.operators import prep as pp
from cauldron.sources import derived

from .conftest import SF_SMALL


@pytest.fixture(scope="module")
def scored(spark):
    return derived.scored(spark, SF_SMALL).checkpoint(eager=True)


def test_scenarios_monotone_and_within_budget(scored):
    rows = al.budget_scenarios(scored, (500, 1000, 2000, 4000, 100000)).orderBy("strategy", "budget").collect()
    for strategy in ("causal", "random"):
        r = [x for x in rows if x.strategy == strategy]
        costs = [x.expected_cost for x in r]
        assert costs == sorted(costs)
        assert all(x.expected_cost <= x.budget + 1e-6 for x in r)
        assert [x.customers_targeted for x in r] == sorted(x.customers_targeted for x in r)


def test_greedy_subset_of_lp_support(scored):
    g = {r.customer_id for r in al.allocate_greedy(scored, 1500.0).where("selected = 1").collect()}
    lp = al.allocate_lp(scored, 1500.0)
    sup = {r.customer_id for r in lp.where("selected = 1").collect()}
    assert g <= sup
    tot = lp.agg(F.sum("expected_cost"), F.sum(F.col("allocation_fraction") * (1 - F.col("allocation_fraction")))).collect()[0]
    assert tot[0] <= 1500.0 + 1e-6
    assert tot[1] <= 0.25 + 1e-9  # at most one fractional item


def test_qini_final_value(scored):
    curve = mt.qini_curve(scored)
    last = curve.orderBy(F.col("rank").desc()).first().qini
    a = scored.agg(F.sum(F.when(F.col("treatment_received") == 1, F.col("purchase")).otherwise(0)).alias("yt"),
                   F.sum(F.when(F.col("treatment_received") == 0, F.col("purchase")).otherwise(0)).alias("yc"),
                   F.sum(F.col("treatment_received")).alias("nt"), F.count("*").alias("n")).first()
    assert last == pytest.approx(a.yt - a.yc * a.nt / (a.n - a.nt))


def test_permutation_keeps_marginal(scored):
    base = scored.select("customer_id", "treatment_received")
    perm = pp.permute_treatment(base)
    assert perm.count() == base.count()
    assert perm.agg(F.sum("treatment_received")).first()[0] == base.agg(F.sum("treatment_received")).first()[0]
    moved = perm.join(base.withColumnRenamed("treatment_received", "w0"), "customer_id") \
                .where(F.col("w0") != F.col("treatment_received")).count()
    assert moved > 0


def test_split_and_subset_are_stable(scored):
    a = pp.train_test_split(scored).where("split = 'train'").select("customer_id").collect()
    b = pp.train_test_split(scored.repartition(3)).where("split = 'train'").select("customer_id").collect()
    assert sorted(a) == sorted(b)
    n, m = scored.count(), pp.subset_rows(scored).count()
    assert 0.6 * n < m < 0.95 * n


def test_noise_feature_is_standard_normal(spark):
    df = pp.add_noise_feature(spark.range(20000).withColumnRenamed("id", "customer_id"))
    s = df.agg(F.avg("random_noise"), F.stddev_pop("random_noise")).first()
    assert abs(s[0]) < 0.03 and abs(s[1] - 1) < 0.03


def test_allocation_independent_of_partitioning(scored):
    outs = []
    for parts in (1, 7):
        s = scored.repartition(parts)
        sel = sorted(r.customer_id for r in al.allocate_greedy(s, 1500.0).where("selected = 1").collect())
        scen = sorted(tuple(r) for r in al.budget_scenarios(s, (500, 1500, 4000)).collect())
        outs.append((sel, scen))
    assert outs[0] == outs[1]
