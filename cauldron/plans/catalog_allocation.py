"""Catalog: derivation, segmentation and allocation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import allocate as al
from ..schema import SCENARIO_BUDGETS
from ..sources import derived
from .registry import stable_scored, FLAGSHIP_BUDGET, SMALL_BUDGET, W, register

# ---------------------------------------------------------------------------
# derivation
# ---------------------------------------------------------------------------
@register("customer_base", W("customer_base") + "SELECT * FROM customer_base")
def q_customer_base(spark: SparkSession, d: str) -> DataFrame:
    return derived.customer_base(spark, d)


@register("scored", W("scored") + "SELECT * FROM scored")
def q_scored(spark: SparkSession, d: str) -> DataFrame:
    return stable_scored(spark, d)


# ---------------------------------------------------------------------------
# G: segmentation and allocation
# ---------------------------------------------------------------------------
_SEG_SQL = """CASE WHEN ite >= CAST(0.05 AS DOUBLE) THEN 'persuadable'
  WHEN ite <= -CAST(0.05 AS DOUBLE) THEN 'sleeping dog'
  WHEN baseline_probability >= CAST({b} AS DOUBLE) THEN 'sure thing' ELSE 'lost cause' END"""


@register("uplift_segments", W("scored") + f"""
SELECT customer_id, ite, baseline_probability, {_SEG_SQL.format(b=0.5)} AS uplift_segment FROM scored""")
def q_uplift_segments(spark, d):
    return al.uplift_segments(stable_scored(spark, d)).select(
        "customer_id", "ite", "baseline_probability", "uplift_segment")


def _greedy_sql(budget: float) -> str:
    return W("scored", extra=f""",
base AS (SELECT customer_id, ite*net_revenue AS expected_profit, discount_cost AS expected_cost FROM scored),
cand AS (SELECT customer_id, SUM(CAST(ROUND(expected_cost*100) AS BIGINT)) OVER (
    ORDER BY ROUND(expected_profit/expected_cost, 9) DESC, customer_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_cents
  FROM base WHERE expected_profit > 0 AND expected_cost > 0)""") + f"""
SELECT b.customer_id, b.expected_profit, b.expected_cost,
  CASE WHEN c.cum_cents <= {round(budget * 100)} THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS allocation_fraction,
  CASE WHEN c.cum_cents <= {round(budget * 100)} THEN 1 ELSE 0 END AS selected
FROM base b LEFT JOIN cand c ON c.customer_id = b.customer_id"""


@register("allocate_greedy", _greedy_sql(FLAGSHIP_BUDGET))
def q_allocate_greedy(spark, d):
    return al.allocate_greedy(stable_scored(spark, d), FLAGSHIP_BUDGET).select(
        "customer_id", "expected_profit", "expected_cost", "allocation_fraction", "selected")


def _lp_sql(budget: float) -> str:
    bc = round(budget * 100)
    return W("scored", extra=""",
base AS (SELECT customer_id, ite*net_revenue AS gp, discount_cost AS gc, CAST(ROUND(discount_cost*100) AS BIGINT) AS cc FROM scored),
cand AS (SELECT customer_id, cc, SUM(cc) OVER (
    ORDER BY ROUND(gp/gc, 9) DESC, customer_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_cents
  FROM base WHERE gp > 0 AND gc > 0),
x AS (SELECT b.customer_id, b.gp, b.gc,
  CASE WHEN c.customer_id IS NOT NULL THEN GREATEST(CAST(0 AS DOUBLE), LEAST(CAST(1 AS DOUBLE), (""" + str(bc) + """ - (c.cum_cents - c.cc)) / CAST(c.cc AS DOUBLE)))
       WHEN b.gp > 0 AND b.gc <= 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS f
  FROM base b LEFT JOIN cand c ON c.customer_id = b.customer_id)""") + """
SELECT customer_id, gp AS gross_expected_profit, gc AS gross_expected_cost, f AS allocation_fraction,
  CASE WHEN f > 0 THEN 1 ELSE 0 END AS selected, gp*f AS expected_profit, gc*f AS expected_cost FROM x"""


@register("allocate_lp", _lp_sql(FLAGSHIP_BUDGET))
def q_allocate_lp(spark, d):
    return al.allocate_lp(stable_scored(spark, d), FLAGSHIP_BUDGET).select(
        "customer_id", "gross_expected_profit", "gross_expected_cost", "allocation_fraction",
        "selected", "expected_profit", "expected_cost")


def _scenario_sql(budgets, seed: int = 42, strategies=("causal", "random")) -> str:
    parts = []
    bud = " UNION ALL ".join(f"SELECT CAST({float(b)} AS DOUBLE) AS budget, {round(b * 100)} AS bc" for b in budgets)
    if "causal" in strategies:
        parts.append("""SELECT b.budget, 'causal' AS strategy, c.p, c.cc, c.cum FROM budgets b JOIN (
  SELECT ite*net_revenue AS p, CAST(ROUND(discount_cost*100) AS BIGINT) AS cc,
    SUM(CAST(ROUND(discount_cost*100) AS BIGINT)) OVER (ORDER BY ROUND(ite*net_revenue/discount_cost, 9) DESC, customer_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
  FROM scored WHERE ite*net_revenue > 0 AND discount_cost > 0) c ON c.cum <= b.bc""")
    if "random" in strategies:
        parts.append(f"""SELECT b.budget, 'random' AS strategy, c.p, c.cc, c.cum FROM budgets b JOIN (
  SELECT ite*net_revenue AS p, CAST(ROUND(discount_cost*100) AS BIGINT) AS cc,
    SUM(CAST(ROUND(discount_cost*100) AS BIGINT)) OVER (ORDER BY md5('{seed}' || ':' || CAST(customer_id AS VARCHAR)), customer_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
  FROM scored WHERE discount_cost > 0) c ON c.cum <= b.bc""")
    strat = " UNION ALL ".join(f"SELECT '{s}' AS strategy" for s in strategies)
    return W("scored", extra=f""",
budgets AS ({bud}),
strategies AS ({strat}),
sel AS ({' UNION ALL '.join(parts)})""") + """
SELECT b.budget, s.strategy, CAST(COUNT(sel.p) AS BIGINT) AS customers_targeted,
  ROUND(COALESCE(SUM(sel.p), 0), 6) AS expected_profit,
  CAST(COALESCE(SUM(sel.cc), 0) AS BIGINT) / CAST(100 AS DOUBLE) AS expected_cost,
  CASE WHEN COALESCE(SUM(sel.cc), 0) > 0 THEN ROUND(SUM(sel.p) / (SUM(sel.cc) / CAST(100 AS DOUBLE)), 9) ELSE CAST(0 AS DOUBLE) END AS roi
FROM budgets b CROSS JOIN strategies s LEFT JOIN sel ON sel.budget = b.budget AND sel.strategy = s.strategy
GROUP BY b.budget, s.strategy"""


def _round_scenarios(df: DataFrame) -> DataFrame:
    return df.select("budget", "strategy", "customers_targeted",
                     F.round("expected_profit", 6).alias("expected_profit"), "expected_cost",
                     F.round("roi", 9).alias("roi"))


@register("budget_scenarios", _scenario_sql(SCENARIO_BUDGETS))
def q_budget_scenarios(spark, d):
    return _round_scenarios(al.budget_scenarios(stable_scored(spark, d)))


@register("random_targeting", _scenario_sql((SMALL_BUDGET,), strategies=("random",)))
def q_random_targeting(spark, d):
    return _round_scenarios(al.random_targeting(stable_scored(spark, d), SMALL_BUDGET))


def _selected_sql(budget: float, threshold: float = 0.25) -> str:
    """Greedy selection with segments, as a CTE named ``sel``."""
    return W("scored", extra=f""",
base AS (SELECT s.*, ite*net_revenue AS expected_profit, discount_cost AS expected_cost,
  {_SEG_SQL.format(b=threshold)} AS uplift_segment FROM scored s),
cand AS (SELECT customer_id, SUM(CAST(ROUND(expected_cost*100) AS BIGINT)) OVER (
    ORDER BY ROUND(expected_profit/expected_cost, 9) DESC, customer_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_cents
  FROM base WHERE expected_profit > 0 AND expected_cost > 0),
sel AS (SELECT b.* FROM base b JOIN cand c ON c.customer_id = b.customer_id WHERE c.cum_cents <= {round(budget * 100)})""")


@register("recommendations", _selected_sql(FLAGSHIP_BUDGET) + """
SELECT customer_id, ite AS predicted_ite, discount_percentage AS recommended_discount,
  expected_profit, expected_cost, uplift_segment
FROM sel ORDER BY expected_profit DESC, customer_id LIMIT 25""")
def q_recommendations(spark, d):
    return al.recommendations(stable_scored(spark, d), FLAGSHIP_BUDGET, limit=25)


@register("recommendations_segment", _selected_sql(FLAGSHIP_BUDGET) + """
SELECT customer_id, ite AS predicted_ite, discount_percentage AS recommended_discount,
  expected_profit, expected_cost, uplift_segment
FROM sel WHERE uplift_segment = 'persuadable' ORDER BY expected_profit DESC, customer_id LIMIT 25""")
def q_recommendations_segment(spark, d):
    return al.recommendations(stable_scored(spark, d), FLAGSHIP_BUDGET, limit=25, segment="persuadable")


@register("optimize", _selected_sql(FLAGSHIP_BUDGET) + """
SELECT customer_id, ite AS predicted_ite, discount_percentage AS recommended_discount,
  expected_profit, expected_cost, uplift_segment, 'greedy' AS method
FROM sel ORDER BY expected_profit DESC, customer_id LIMIT 100""")
def q_optimize(spark, d):
    return al.recommendations(stable_scored(spark, d), FLAGSHIP_BUDGET, limit=100).withColumn(
        "method", F.lit("greedy"))


@register("recommendation_totals", _selected_sql(FLAGSHIP_BUDGET) + f"""
SELECT CAST({FLAGSHIP_BUDGET} AS DOUBLE) AS budget, CAST(COUNT(*) AS BIGINT) AS total_recommended_customers,
  ROUND(COALESCE(SUM(expected_profit), 0), 6) AS total_expected_profit,
  ROUND(COALESCE(SUM(expected_cost), 0), 6) AS total_expected_cost,
  CASE WHEN SUM(expected_cost) > 0 THEN ROUND(SUM(expected_profit)/SUM(expected_cost), 9) ELSE CAST(0 AS DOUBLE) END AS roi,
  COALESCE(SUM(expected_cost), 0) <= {FLAGSHIP_BUDGET} + CAST(0.000001 AS DOUBLE) AS within_budget
FROM sel""")
def q_recommendation_totals(spark, d):
    t = al.recommendation_totals(stable_scored(spark, d), FLAGSHIP_BUDGET)
    return t.select("budget", "total_recommended_customers",
                    F.round("total_expected_profit", 6).alias("total_expected_profit"),
                    F.round("total_expected_cost", 6).alias("total_expected_cost"),
                    F.round("roi", 9).alias("roi"), "within_budget")


@register("recommendation_report", _selected_sql(1000000.0) + """
SELECT customer_id, ite, uplift_segment, treatment_probability AS expected_conversion,
  discount_percentage AS recommended_discount, expected_profit, expected_cost,
  CASE WHEN expected_cost > 0 THEN expected_profit / expected_cost ELSE CAST(0 AS DOUBLE) END AS roi
FROM sel""")
def q_recommendation_report(spark, d):
    return al.recommendation_report(stable_scored(spark, d))


