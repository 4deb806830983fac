"""Catalog: reports, remaining sinks and model persistence (G8-LP, G10, G11, P4, S6, S10, S14, S15, E9, R1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import allocate as al
from ..operators import learners as ln
from ..operators import lookup as lk
from ..operators import metrics as mt
from ..operators import quality as qa
from ..operators import summaries as sm
from ..operators.refute import mean_effect
from ..schema import CUSTOMER_SCHEMA, SCENARIO_BUDGETS, ModelConfig
from ..session import scratch_dir
from ..sources import derived
from ..sources import io as sio
from ..sources import snapshots
from .catalog_allocation import _scenario_sql
from .catalog_views import _AREAS, _ERR, _SEG025
from .registry import stable_scored, FLAGSHIP_BUDGET, W, register, rounded

_COLS = [f.name for f in CUSTOMER_SCHEMA.fields]


@register("scenario_chart", "SELECT budget, strategy, customers_targeted, ROUND(expected_profit, 0) AS expected_profit, "
          "ROUND(expected_cost, 0) AS expected_cost FROM (" + _scenario_sql(SCENARIO_BUDGETS) + ")")
def q_scenario_chart(spark, d):
    return al.scenario_chart(al.budget_scenarios(stable_scored(spark, d)))


@register("uplift_report", _AREAS + f""",
e AS (SELECT {_ERR}, AVG(ite) AS average_ite FROM scored),
seg AS (SELECT {_SEG025} AS s FROM scored)
SELECT 'segment_count' AS kind, s AS name, CAST(COUNT(*) AS DOUBLE) AS value FROM seg GROUP BY s
UNION ALL SELECT 'segment_share', s, ROUND(COUNT(*) / CAST((SELECT COUNT(*) FROM scored) AS DOUBLE), 6) FROM seg GROUP BY s
UNION ALL SELECT 'metric', 'mae', ROUND(mae, 6) FROM e
UNION ALL SELECT 'metric', 'rmse', ROUND(rmse, 6) FROM e
UNION ALL SELECT 'metric', 'correlation', ROUND(correlation, 6) FROM e
UNION ALL SELECT 'metric', 'average_ite', ROUND(average_ite, 6) FROM e
UNION ALL SELECT 'metric', 'qini_coefficient', ROUND(qini_coefficient, 6) FROM coef""")
def q_uplift_report(spark, d):
    """Segment counts and shares plus effect metrics as one long document."""
    s = stable_scored(spark, d)
    shares = sm.uplift_segment_shares(s)
    counts = shares.select(F.lit("segment_count").alias("kind"), F.col("uplift_segment").alias("name"),
                           F.col("count").cast("double").alias("value"))
    share = shares.select(F.lit("segment_share").alias("kind"), F.col("uplift_segment").alias("name"),
                          F.round("share", 6).alias("value"))
    m = mt.effect_metrics(s)
    names = ("mae", "rmse", "correlation", "average_ite", "qini_coefficient")
    stack = ", ".join(f"'{n}', ROUND({n}, 6)" for n in names)
    metrics = m.selectExpr(f"stack({len(names)}, {stack}) AS (name, value)").select(
        F.lit("metric").alias("kind"), "name", "value")
    return counts.unionByName(share).unionByName(metrics)


_LP_SEL = W("scored", extra=f""",
base AS (SELECT s.*, ite*net_revenue AS gp, discount_cost AS gc, CAST(ROUND(discount_cost*100) AS BIGINT) AS cc,
  {_SEG025} AS uplift_segment FROM scored s),
cand AS (SELECT customer_id, cc, SUM(cc) OVER (ORDER BY ROUND(gp/gc, 9) DESC, customer_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_cents FROM base WHERE gp > 0 AND gc > 0),
x AS (SELECT b.*, CASE WHEN c.customer_id IS NOT NULL THEN GREATEST(CAST(0 AS DOUBLE), LEAST(CAST(1 AS DOUBLE),
    ({round(FLAGSHIP_BUDGET * 100)} - (c.cum_cents - c.cc)) / CAST(c.cc AS DOUBLE)))
  WHEN b.gp > 0 AND b.gc <= 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS f
  FROM base b LEFT JOIN cand c ON c.customer_id = b.customer_id)""")


@register("optimize_lp", _LP_SEL + """
SELECT customer_id, ite AS predicted_ite, discount_percentage AS recommended_discount, gp * f AS expected_profit,
  gc * f AS expected_cost, uplift_segment, 'lp' AS method
FROM x WHERE f > 0 ORDER BY gp * f DESC, customer_id LIMIT 100""")
def q_optimize_lp(spark, d):
    return al.recommendations(stable_scored(spark, d), FLAGSHIP_BUDGET, limit=100, method="lp").withColumn(
        "method", F.lit("lp"))


@register("drop_ground_truth", W("customers") + "SELECT " + ", ".join(c for c in _COLS if c != "true_ite") + " FROM customers")
def q_drop_ground_truth(spark, d):
    return lk.drop_ground_truth(derived.customers(spark, d))


@register("replace_customers", W("customers") + "SELECT * FROM customers")
def q_replace_customers(spark, d):
    """Truncate-and-load: a first load is fully replaced by the second."""
    path = scratch_dir(spark, "replace")
    c = derived.customers(spark, d)
    snapshots.replace_table(c.where(F.col("treatment_received") == 1), path)
    snapshots.replace_table(c, path)
    return snapshots.read(spark, path, "rows")


@register("export_query", W("customers") + """
SELECT customer_segment, CAST(COUNT(*) AS BIGINT) AS customers, ROUND(SUM(net_revenue), 6) AS net_revenue
FROM customers GROUP BY customer_segment""")
def q_export_query(spark, d):
    """Arbitrary SQL over DataFrame arguments, exported as CSV and read back."""
    path = scratch_dir(spark, "export-query")
    sio.export_query(spark, "SELECT customer_segment, COUNT(*) AS customers, ROUND(SUM(net_revenue), 6) AS net_revenue "
                            "FROM {c} GROUP BY customer_segment", path, "csv", c=derived.customers(spark, d))
    return spark.read.schema("customer_segment string, customers bigint, net_revenue double") \
                .option("header", True).csv(path)


@register("save_load_model", None)
def q_save_load_model(spark, d):
    """Persist a fitted T-learner, load it back and score."""
    c = derived.customers(spark, d)
    fitted = ln.CausalModel(ModelConfig(model_type="t_learner")).fit(c)
    path = scratch_dir(spark, "model")
    sio.save_model(fitted, path)
    loaded = sio.load_model(spark, path)
    return rounded(loaded.transform(c).select("customer_id", "baseline_probability", "treatment_probability", "ite"), 6)


@register("update_run_metrics", None)
def q_update_run_metrics(spark, d):
    """Merge evaluation metrics into the record of run 2."""
    s = stable_scored(spark, d)
    runs = derived.predictions(spark, d, s).groupBy("model_run_id").agg(F.max("created_at").alias("created_at")) \
        .select(F.col("model_run_id").alias("id"), F.lit("surrogate").alias("model_name"), "created_at",
                F.lit(None).cast("map<string,double>").alias("metrics"))
    m = mt.error_metrics(s).first().asDict()
    return sio.update_run_metrics(runs, 2, {k: round(v, 6) for k, v in m.items()})


@register("predict", None)
def q_predict(spark, d):
    """Transform with finite and coverage checks before anything is returned."""
    c = derived.customers(spark, d)
    fitted = ln.CausalModel(ModelConfig()).fit(c)
    preds = fitted.transform(c).select("customer_id", "baseline_probability", "treatment_probability", "ite")
    bad = qa.check_finite(preds).where(~F.col("passed")).count() + qa.check_coverage(c, preds).count()
    if bad:
        raise ValueError("predictions failed the finite / coverage checks")
    return rounded(preds, 6)


@register("mean_effect", None)
def q_mean_effect(spark, d):
    c = derived.customers(spark, d)
    value = mean_effect(c, ModelConfig())
    return c.agg(F.count(F.lit(1)).alias("n")).select("n", F.round(F.lit(value), 6).alias("mean_ite"))


@register("write_predictions", W("scored") + """
SELECT customer_id, baseline_probability, treatment_probability, ite FROM scored""")
def q_write_predictions(spark, d):
    """Finite and coverage checks, then the write; read back."""
    s = stable_scored(spark, d)
    path = scratch_dir(spark, "predictions-out")
    sio.write_predictions(s.select("customer_id", "baseline_probability", "treatment_probability", "ite"),
                          s.select("customer_id"), path)
    return spark.read.parquet(path)


@register("align_features", W("customers") + """
SELECT customer_id, customer_segment,
  CASE WHEN customer_segment = 'budget' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS f_customer_segment_budget,
  CASE WHEN customer_segment = 'premium' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS f_customer_segment_premium,
  CASE WHEN customer_segment = 'standard' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS f_customer_segment_standard
FROM customers""")
def q_align_features(spark, d):
    """Fit on customers without the 'vip' segment, transform everyone: the
    unseen category maps to all-zero dummies in the fitted order (F3)."""
    from ..operators.prep import Preprocessor
    from ..schema import FeatureConfig

    c = derived.customers(spark, d).select("customer_id", "customer_segment")
    fitted = Preprocessor(FeatureConfig(covariates=(), confounders=("customer_segment",))) \
        .fit(c.where(F.col("customer_segment") != "vip"))
    return fitted.transform(c)


@register("check_budget", W("scored", extra=f""",
base AS (SELECT customer_id, ite*net_revenue AS p, discount_cost AS c FROM scored),
cand AS (SELECT c, SUM(CAST(ROUND(c*100) AS BIGINT)) OVER (ORDER BY ROUND(p/c, 9) DESC, customer_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM base WHERE p > 0 AND c > 0)""") + f"""
SELECT CAST({FLAGSHIP_BUDGET} AS DOUBLE) AS budget, ROUND(COALESCE(SUM(c), 0), 6) AS selected_cost,
  COALESCE(SUM(c), 0) <= {FLAGSHIP_BUDGET} + CAST(0.000001 AS DOUBLE) AS passed
FROM cand WHERE cum <= {round(FLAGSHIP_BUDGET * 100)}""")
def q_check_budget(spark, d):
    """Refuse a selection above the budget (V18): cost of the greedy selection vs budget."""
    t = al.check_within_budget(al.recommendation_totals(stable_scored(spark, d), FLAGSHIP_BUDGET))
    return t.select("budget", F.round("total_expected_cost", 6).alias("selected_cost"),
                    F.col("within_budget").alias("passed"))
