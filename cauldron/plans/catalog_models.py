"""Catalog: feature preparation, effect models, refutations, pipeline.

Learners, refutations and the pipeline are not SQL: they are registered
without oracle SQL (rows-only check) and emit small, rounded frames; their
accuracy is tested on generated frames with a known effect in tests/.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import learners as ln
from ..operators import prep as pp
from ..operators import refute as rf
from ..plans.pipeline import run_pipeline
from ..schema import ModelConfig
from ..session import scratch_dir
from ..sources import derived
from ..sources.tables import read_table
from .registry import W, register, rounded

_NUMS = ("age", "tenure_months", "historical_orders", "historical_revenue", "avg_order_value",
         "days_since_last_purchase", "website_visits", "email_opens", "email_clicks", "previous_campaign_response")


def _z_sql(c: str) -> str:
    return (f"ROUND(CASE WHEN STDDEV_POP({c}) OVER () > 0 THEN ({c} - AVG({c}) OVER ()) / STDDEV_POP({c}) OVER () "
            f"ELSE CAST(0 AS DOUBLE) END, 6) AS f_{c}")


@register("standardize", W("customers") + "SELECT customer_id, " + ", ".join(_z_sql(c) for c in _NUMS) + " FROM customers")
def q_standardize(spark, d):
    c = derived.customers(spark, d).select("customer_id", *_NUMS)
    out = pp.standardize(c, _NUMS).select("customer_id", *[f"f_{n}" for n in _NUMS])
    return rounded(out, 6)


@register("one_hot", W("customers") + """
SELECT customer_id, customer_segment,
  CASE WHEN customer_segment = 'budget' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS f_customer_segment_budget,
  CASE WHEN customer_segment = 'premium' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS f_customer_segment_premium,
  CASE WHEN customer_segment = 'standard' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS f_customer_segment_standard,
  CASE WHEN customer_segment = 'vip' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS f_customer_segment_vip
FROM customers""")
def q_one_hot(spark, d):
    return pp.one_hot(derived.customers(spark, d).select("customer_id", "customer_segment"), "customer_segment")


@register("one_hot_sparse", """
WITH levels AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS place FROM (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS k FROM orders WHERE o_custkey % 5 <> 0))
SELECT o_orderkey, CAST(place AS BIGINT) AS place, CAST((SELECT COUNT(*) FROM levels) AS BIGINT) AS size
FROM orders LEFT JOIN levels ON k = CAST(o_custkey AS VARCHAR)""")
def q_one_hot_sparse(spark, d):
    """A column of many levels, a fifth of them not seen when the levels were learned."""
    orders = read_table(spark, d, "orders").select("o_orderkey", "o_custkey")
    coder = pp.SparseOneHot.fit(orders.where("o_custkey % 5 <> 0"), "o_custkey")
    parts = F.from_json(F.to_json(F.struct("v")), "v struct<size:bigint,indices:array<bigint>>")["v"]
    return coder.transform(orders, "v").select("o_orderkey", F.get(parts["indices"], F.lit(0)).alias("place"), parts["size"].alias("size"))


def _u(seed: int, salt: str, key: str = "customer_id") -> str:
    """The SQL twin of functions.scalar.hash_uniform."""
    digest = f"md5('{salt}:{seed}:' || CAST({key} AS VARCHAR))"
    return f"((CAST(('0x' || substr({digest}, 1, 13)) AS BIGINT) + CAST(0.5 AS DOUBLE)) / CAST({2 ** 52} AS DOUBLE))"


@register("train_test_split", W("customers") + f"""
SELECT CASE WHEN {_u(42, 'split')} < CAST(0.8 AS DOUBLE) THEN 'train' ELSE 'test' END AS split, CAST(COUNT(*) AS BIGINT) AS count
FROM customers GROUP BY 1""")
def q_train_test_split(spark, d):
    return pp.train_test_split(derived.customers(spark, d)).groupBy("split").count()


@register("add_noise_feature", W("customers") + f"""
SELECT customer_id, ROUND(SQRT(CAST(-2 AS DOUBLE) * LN({_u(42, 'n1')})) * COS(CAST(2 AS DOUBLE) * PI() * {_u(42, 'n2')}), 6) AS random_noise
FROM customers""")
def q_add_noise_feature(spark, d):
    return rounded(pp.add_noise_feature(derived.customers(spark, d)).select("customer_id", "random_noise"), 6)


@register("permute_treatment", W("customers", extra=f""",
a AS (SELECT customer_id, purchase, ROW_NUMBER() OVER (ORDER BY {_u(42, 'perm1')}, customer_id) AS r FROM customers),
b AS (SELECT treatment_received, ROW_NUMBER() OVER (ORDER BY {_u(42, 'perm2')}, customer_id) AS r FROM customers)""") + """
SELECT a.customer_id, b.treatment_received, a.purchase FROM a JOIN b ON a.r = b.r""")
def q_permute_treatment(spark, d):
    c = derived.customers(spark, d).select("customer_id", "treatment_received", "purchase")
    return pp.permute_treatment(c, circle=False)


@register("subset_rows", W("customers") + f"SELECT customer_id FROM customers WHERE {_u(42, 'subset')} < CAST(0.8 AS DOUBLE)")
def q_subset_rows(spark, d):
    return pp.subset_rows(derived.customers(spark, d)).select("customer_id")


@register("final_stage", W("scored", extra=""",
r AS (SELECT CAST(purchase AS DOUBLE) - baseline_probability AS y,
  CAST(treatment_received AS DOUBLE) - true_treatment_probability AS t FROM scored)""") + """
SELECT ROUND(SUM(t * y) / SUM(t * t), 6) AS theta, CAST(COUNT(*) AS BIGINT) AS n FROM r""")
def q_final_stage(spark, d):
    """Residual on residual with fixed nuisances: the last step of double ML."""
    s = derived.scored(spark, d).select(
        (F.col("treatment_received") - F.col("true_treatment_probability")).alias("t"),
        (F.col("purchase") - F.col("baseline_probability")).alias("y"))
    theta = float(ln.gram_solve(s, ["t"], "y")[0])
    return s.agg(F.count(F.lit(1)).alias("n")).select(F.round(F.lit(theta), 6).alias("theta"), "n")


def _effects(model_type: str, base: str):
    def q(spark, d):
        c = derived.customers(spark, d)
        cfg = ModelConfig(model_type=model_type, base_learner=base)
        out = ln.CausalModel(cfg).fit(c).transform(c)
        return rounded(out.select("customer_id", "baseline_probability", "treatment_probability", "ite"), 6)

    return q


register("t_learner", None)(_effects("t_learner", "linear"))
register("x_learner", None)(_effects("x_learner", "linear"))
register("dml", None)(_effects("dml", "linear"))
register("dml_gradient_boosting", None)(_effects("dml", "gradient_boosting"))
register("dml_lightgbm", None)(_effects("dml", "lightgbm"))
register("t_learner_random_forest", None)(_effects("t_learner", "random_forest"))


@register("propensity", None)
def q_propensity(spark, d):
    c = derived.customers(spark, d)
    return rounded(ln.propensity(c).select("customer_id", "propensity"), 6)


@register("refutation_report", None)
def q_refutation_report(spark, d):
    return rounded(rf.refutation_report(derived.customers(spark, d), ModelConfig()), 6)


@register("compare_models", None)
def q_compare_models(spark, d):
    return rf.compare_models(derived.customers(spark, d))


@register("run_pipeline", None)
def q_run_pipeline(spark, d):
    """The whole run as configured, refutations included; what it stored is read back."""
    out = scratch_dir(spark, "pipeline-run")
    run_pipeline(derived.customers(spark, d), ModelConfig(), refute=True, out_dir=out)
    summary = spark.read.json(f"{out}/causal_summary/model_run_id=1")
    tests = spark.read.json(f"{out}/refutations/model_run_id=1").where("test = 'all_tests_passed'")
    manifest = spark.read.json(f"{out}/manifest/model_run_id=1").agg(F.count("*").alias("tables"))
    return rounded(summary, 6).select("*", tests.select("passed").scalar().alias("all_tests_passed"),
                                      manifest.select("tables").scalar().alias("tables"))
