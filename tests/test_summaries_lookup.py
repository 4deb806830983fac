"""Summary and lookup semantics on small frames."""

import pytest

from cauldron.operators import lookup as lk
from cauldron.operators import summaries as sm

COLS = ("customer_id long, campaign_id int, customer_segment string, treatment_received int, purchase int, "
        "purchase_value double, discount_cost double, net_revenue double, true_ite double, discount_percentage double")


def _customers(spark):
    return spark.createDataFrame([
        (1, 1, "vip", 0, 1, 10.0, 0.0, 10.0, 0.0, 0.0),
        (2, 9, "budget", 0, 0, 0.0, 0.0, 0.0, 0.0, 0.0),     # campaign 9 does not exist
        (3, None, "budget", 0, 1, 5.0, 0.0, 5.0, 0.0, 0.0),   # no campaign
        (12, 1, "vip", 0, 0, 0.0, 0.0, 0.0, 0.0, 0.0),
        (21, 1, "standard", 0, 1, 7.5, 0.0, 7.5, 0.0, 0.0),
    ], COLS)


def test_campaign_summary_unassigned_group(spark):
    camps = spark.createDataFrame([(1, "spring")], "campaign_id int, campaign_name string")
    out = {r.campaign_name: r for r in sm.campaign_summary(_customers(spark), camps).collect()}
    assert set(out) == {"spring", "unassigned"}
    assert out["unassigned"].campaign_id == 0 and out["unassigned"].customers == 2
    assert out["spring"].customers == 3 and out["spring"].total_revenue == pytest.approx(17.5)


def test_dataset_summary_empty_arm_is_zero(spark):
    r = sm.dataset_summary(_customers(spark)).first()
    assert r.treated_customers == 0 and r.treated_purchase_rate == 0.0
    assert r.control_purchase_rate == pytest.approx(0.6)
    assert r.median_true_ite == 0.0


def test_paging_and_literal_search(spark):
    c = _customers(spark)
    page = lk.list_customers(c, offset=1, limit=2, segment="vip").collect()
    assert [r.customer_id for r in page] == [12] and page[0].total == 2
    assert [r.customer_id for r in lk.list_customers(c, search="1").collect()] == [1, 12, 21]
    assert lk.list_customers(c, search="%").count() == 0  # literal, not a LIKE wildcard
    with pytest.raises(ValueError):
        lk.list_customers(c, limit=0)
    with pytest.raises(ValueError):
        lk.list_customers(c, offset=-1)
    assert lk.get_customer(c, 404).count() == 0


def test_top_ite_ties_by_id(spark):
    df = spark.createDataFrame([(5, 0.3), (2, 0.3), (9, 0.1)], "customer_id long, ite double")
    assert [r.customer_id for r in lk.top_ite(df, 2).collect()] == [2, 5]


def test_dataset_summary_of_no_rows(spark):
    r = sm.dataset_summary(_customers(spark).limit(0)).first()
    assert r.customers == 0 and r.treatment_rate is None and r.median_true_ite is None


def test_customers_without_campaign_stay_in_the_join(spark):
    from cauldron.operators.joins import coverage_anti, join_campaign

    camps = spark.createDataFrame([(1, "spring")], "campaign_id int, campaign_name string")
    out = {r.customer_id: r.campaign_name for r in join_campaign(_customers(spark), camps).collect()}
    assert out == {1: "spring", 2: None, 3: None, 12: "spring", 21: "spring"}
    a = spark.createDataFrame([(1,), (2,), (2,), (None,)], "customer_id long")
    b = spark.createDataFrame([(2,), (3,)], "customer_id long")
    assert sorted(map(tuple, coverage_anti(a, b).collect())) == [(1, "missing"), (3, "extra")]


def test_pages_by_key_and_labels(spark):
    from pyspark.sql import functions as F

    from cauldron.functions.scalar import label

    page = lk.list_customers(_customers(spark), limit=2, after=2).collect()
    assert [r.customer_id for r in page] == [3, 12] and page[0].total == 5
    df = spark.createDataFrame([("sleeping dog",), ("",), (None,), ("été",)], "s string")
    assert [r.s for r in df.select(label(F.col("s")).alias("s")).collect()] == ["Sleeping dog", "", None, "Été"]
