"""Weighted selection against a plain running sum, with cells forced small."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cauldron.operators import allocate as al
from cauldron.operators import selection as se
from cauldron.operators.ordered import exact_median


def plain_cuts(rows, targets):
    out = []
    for t in targets:
        run = Decimal(0)
        for v, i, w in sorted(rows):
            run += w
            if run > t:
                out.append(se.Cut((v, i), run - w, w))
                break
        else:
            out.append(None)
    return out


@pytest.mark.parametrize("kind", ["spread", "ties", "one value", "heavy tail"])
def test_cuts_equal_a_plain_running_sum(spark, kind):
    rng = random.Random(kind)
    value = {"spread": lambda i: rng.random(), "ties": lambda i: float(rng.randint(0, 4)), "one value": lambda i: 2.5,
             "heavy tail": lambda i: float(10 ** rng.randint(-6, 9)) if i % 50 else float("inf")}[kind]
    rows = [(value(i), i, Decimal(rng.randint(1, 900)) / 100) for i in range(1200)]
    total = sum(w for _, _, w in rows)
    targets = [Decimal(-1), Decimal(0), rows[0][2], total / 3, total / 3, total - Decimal("0.01"), total, total + 1]
    df = spark.createDataFrame(rows, "v double, id long, w decimal(38,9)").repartition(5)
    got, _ = se.weighted_cuts(df, [se.ascending(F.col("v")), F.col("id")], F.col("w"), targets, cell_rows=7)
    want = plain_cuts(rows, targets)
    assert [c and c.key for c in got] == [c and c.key for c in want]
    assert [c and (c.before, c.weight) for c in got[1:]] == [c and (c.before, c.weight) for c in want[1:]]


def test_missing_values_come_last_and_nothing_gives_no_cut(spark):
    df = spark.createDataFrame([(1.0, 1), (float("nan"), 2), (None, 3), (0.5, 4)], "v double, id long")
    keys = [se.ascending(F.col("v")), F.col("id")]
    got, _ = se.weighted_cuts(df, keys, F.lit(1), [0, 1, 2, 3, 4], cell_rows=1)
    assert [c and c.key[1] for c in got] == [4, 1, 2, 3, None]
    assert se.weighted_cuts(df.limit(0), keys, F.lit(1), [0, 5])[0] == [None, None]


def test_allocation_and_median_with_small_cells(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, rng.choice([0.1, 0.2, rng.random()]), rng.choice([1.0, 2.5, 0.0]), rng.choice([3.0, rng.random() * 9])) for i in range(600)]
    df = spark.createDataFrame(rows, "customer_id long, ite double, discount_cost double, net_revenue double").repartition(4)
    whole = [sorted(map(tuple, f.collect())) for f in (al.allocate_greedy(df, 90.0), al.allocate_lp(df, 90.0),
                                                       al.budget_scenarios(df, [10.0, 90.0, 1e6]), exact_median(df, "ite", "customer_id"))]
    monkeypatch.setattr(se.weighted_cuts, "__defaults__", (5,))
    small = [sorted(map(tuple, f.collect())) for f in (al.allocate_greedy(df, 90.0), al.allocate_lp(df, 90.0),
                                                       al.budget_scenarios(df, [10.0, 90.0, 1e6]), exact_median(df, "ite", "customer_id"))]
    assert whole == small
    spent = sum(Decimal(str(r[2])) for r in whole[0] if r[-1] == 1)
    assert Decimal(80) < spent <= 90


def test_allocation_shuffles_no_candidates(spark):
    df = spark.range(1000).selectExpr("id AS customer_id", "rand(1) AS ite", "1.0D + rand(2) AS discount_cost", "rand(3) AS net_revenue")
    for plan in (al.allocate_greedy(df, 50.0), al.allocate_lp(df, 50.0)):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in text and "Window" not in text
