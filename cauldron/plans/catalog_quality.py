"""Catalog: validation queries.

A check that only ever sees valid rows would stay green if it never fired. So
these queries run on dirty views: the derived tables with faults put in by
conditions on their own data, as one SQL text that both engines run. Every
rule has violations to count.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as jn
from ..operators import metrics as mt
from ..operators import quality as qa
from ..operators import summaries as sm
from ..schema import CUSTOMER_SCHEMA, REQUIRED_COLUMNS
from ..sources import derived
from .catalog_views import _RUNS, _SEG025, _recs_sql
from .registry import W, register, rounded, stable_customers, stable_scored

_TYPES = {f.name: f.dataType.simpleString() for f in CUSTOMER_SCHEMA.fields}
_SQL_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR"}
_MARK = "(historical_orders * 5 + website_visits * 3 + age)"
_BAD = {"treatment_received": "2", "purchase": "3", "discount_percentage": "1.5", "customer_segment": "''",
        "customer_id": "-customer_id", "campaign_id": "0", "true_ite": "true_ite + 1"}


def _dirty_cell(i: int, c: str, typed) -> str:
    """The cell with a NULL, and elsewhere a value out of range, where the row's mark says so."""
    probability = c.startswith("true_") and c != "true_ite"
    bad = _BAD.get(c, "1.25" if probability else f"-{c} - 1")
    kind = typed(_TYPES[c])
    null = f"WHEN {_MARK} % 29 = {i} THEN NULL "
    return f"CAST(CASE {null}WHEN {_MARK} % 31 = {i} THEN {bad} ELSE {c} END AS {kind}) AS {c}"


def _dirty_select(typed) -> str:
    cells = ", ".join(_dirty_cell(i, c, typed) for i, c in enumerate(_TYPES))
    # and some rows twice
    return f"SELECT {cells} FROM customers UNION ALL SELECT {cells} FROM customers WHERE {_MARK} % 17 = 3"


_DIRTY = ", dirty AS (" + _dirty_select(_SQL_TYPES.get) + ")"


def dirty_customers(spark, customers):
    return spark.sql(_dirty_select(str).replace("FROM customers", "FROM {customers}"), customers=customers)


_DIRTY_PREDICTIONS = """SELECT id, CASE WHEN id % 19 = 1 THEN NULL WHEN id % 23 = 2 THEN customer_id + 100000000 ELSE customer_id END AS customer_id,
  CASE WHEN id % 29 = 3 THEN 7 ELSE model_run_id END AS model_run_id,
  CASE WHEN id % 11 = 1 THEN CAST('NaN' AS DOUBLE) WHEN id % 11 = 2 THEN CAST(-0.5 AS DOUBLE) ELSE baseline_probability END AS baseline_probability,
  CASE WHEN id % 13 = 1 THEN NULL WHEN id % 13 = 2 THEN CAST(1.5 AS DOUBLE) ELSE treatment_probability END AS treatment_probability,
  CASE WHEN id % 17 = 1 THEN CAST('Infinity' AS DOUBLE) ELSE ite END AS ite, created_at FROM {predictions}"""
_DIRTY_PREDICTIONS += " UNION ALL SELECT * FROM {predictions} WHERE id % 31 = 5"


def dirty_predictions(spark, predictions):
    return spark.sql(_DIRTY_PREDICTIONS, predictions=predictions)


_DIRTY_P = ", dirty_p AS (" + _DIRTY_PREDICTIONS.replace("{predictions}", "predictions") + ")"


def _rules_sql(rules, table: str) -> str:
    """One row a rule. NaN compares above every number in both engines."""
    return " UNION ALL ".join(
        f"SELECT '{name}' AS \"check\", CAST(COUNT(*) FILTER (WHERE {cond}) AS BIGINT) AS violations FROM {table}"
        for name, cond in rules)


def _checked(sql: str) -> str:
    return f'SELECT "check", violations, violations = 0 AS passed FROM ({sql})'


@register("validate_customers", W("customers", extra=_DIRTY) + _checked(
    _rules_sql(qa.customer_rule_sql(list(_TYPES)), "dirty")
    + " UNION ALL SELECT 'duplicate_ids', CAST(COUNT(*) - COUNT(DISTINCT customer_id) AS BIGINT) FROM dirty"))
def q_validate_customers(spark, d):
    return qa.validate_customers(dirty_customers(spark, derived.customers(spark, d)))


@register("check_duplicate_ids", W("customers", "predictions") + """
SELECT CAST(COUNT(*) - COUNT(DISTINCT customer_id) AS BIGINT) AS duplicates FROM predictions""")
def q_check_duplicate_ids(spark, d):
    return qa.duplicate_ids(derived.predictions(spark, d))


_MISSING = ", ".join(
    f"CASE WHEN {c} IS NULL{' OR ' + c + chr(61) + chr(39) * 2 if _TYPES[c] == 'string' else ''} THEN '{c}' END"
    for c in REQUIRED_COLUMNS)


@register("check_rows_missing", W("customers", extra=_DIRTY) + f"""
SELECT * FROM (SELECT customer_id, list_filter([{_MISSING}], lambda v: v IS NOT NULL) AS missing FROM dirty) WHERE len(missing) > 0""")
def q_check_rows_missing(spark, d):
    return qa.rows_missing(dirty_customers(spark, derived.customers(spark, d)))


@register("check_ite_consistency", W("customers", extra=_DIRTY) + """
SELECT ROUND(m, 9) AS max_difference, m <= CAST(0.00001 AS DOUBLE) AS passed FROM (
  SELECT MAX(ABS(true_treatment_purchase_probability - true_baseline_purchase_probability - true_ite)) AS m FROM dirty)""")
def q_check_ite_consistency(spark, d):
    return rounded(qa.ite_max_difference(dirty_customers(spark, derived.customers(spark, d))), 9)


_FINITE = tuple((f"finite_{c}", f"{c} IS NULL OR isnan({c}) OR isinf({c})")
                for c in ("baseline_probability", "treatment_probability", "ite"))


@register("check_finite", W("predictions", extra=_DIRTY_P) + _checked(
    _rules_sql((("known_customer_id", "customer_id IS NULL"),) + _FINITE, "dirty_p")))
def q_check_finite(spark, d):
    return qa.check_finite(dirty_predictions(spark, derived.predictions(spark, d)))


@register("check_coverage", W("customers", "predictions", extra=_DIRTY_P + """,
p2 AS (SELECT DISTINCT customer_id FROM dirty_p WHERE model_run_id = 1 AND customer_id IS NOT NULL),
diff AS (SELECT customer_id, 'missing' AS side FROM customers WHERE customer_id NOT IN (SELECT customer_id FROM p2)
  UNION ALL SELECT customer_id, 'extra' AS side FROM p2 WHERE customer_id NOT IN (SELECT customer_id FROM customers))""") + """
SELECT customer_id, side FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY side ORDER BY customer_id) AS rn FROM diff) WHERE rn <= 10""")
def q_check_coverage(spark, d):
    s = stable_scored(spark, d)
    p = dirty_predictions(spark, derived.predictions(spark, d, s)).where(F.col("model_run_id") == 1)
    return qa.check_coverage(stable_customers(spark, d, s), p)


_DIRTY_RECS = """SELECT id, CASE WHEN id % 7 = 1 THEN customer_id + 100000000 ELSE customer_id END AS customer_id,
  CASE WHEN id % 11 = 2 THEN 9 ELSE campaign_id END AS campaign_id, CASE WHEN id % 13 = 3 THEN 8 ELSE model_run_id END AS model_run_id,
  CASE WHEN id % 5 = 4 THEN CAST(1.1 AS DOUBLE) ELSE recommended_discount END AS recommended_discount,
  CASE WHEN id % 3 = 2 THEN -expected_cost ELSE expected_cost END AS expected_cost FROM {recommendations}"""
_DIRTY_R = ", dirty_r AS (" + _DIRTY_RECS.replace("{recommendations}", "recommendations") + ")"
_RUN_IDS = ", runs AS (SELECT DISTINCT model_run_id FROM predictions)"


def _unresolved_sql(name: str, child: str, parent: str, col: str) -> str:
    return (f"SELECT '{name}' AS \"check\", CAST(COUNT(*) AS BIGINT) AS violations FROM {child} "
            f"WHERE {col} IS NOT NULL AND {col} NOT IN (SELECT {col} FROM {parent} WHERE {col} IS NOT NULL)")


@register("check_references", W("customers", "campaigns", "predictions", extra=_recs_sql() + _DIRTY + _DIRTY_P + _DIRTY_R + _RUN_IDS) + _checked(" UNION ALL ".join([
    _unresolved_sql("customer_campaign_resolves", "dirty", "campaigns", "campaign_id"),
    _unresolved_sql("prediction_customer_resolves", "dirty_p", "dirty", "customer_id"),
    "SELECT 'prediction_run_unique', CAST(COUNT(*) AS BIGINT) FROM (SELECT customer_id, model_run_id FROM dirty_p GROUP BY 1, 2 HAVING COUNT(*) > 1)",
    _unresolved_sql("prediction_run_resolves", "dirty_p", "runs", "model_run_id"),
    _unresolved_sql("recommendation_customer_resolves", "dirty_r", "dirty", "customer_id"),
    _unresolved_sql("recommendation_campaign_resolves", "dirty_r", "campaigns", "campaign_id"),
    _unresolved_sql("recommendation_run_resolves", "dirty_r", "runs", "model_run_id")])))
def q_check_references(spark, d):
    s = stable_scored(spark, d)
    p = derived.predictions(spark, d, s)
    recs = spark.sql(_DIRTY_RECS, recommendations=jn.recommendations_table(s, _RUNS))
    return qa.check_references(dirty_customers(spark, stable_customers(spark, d, s)), derived.campaigns(spark, d),
                               dirty_predictions(spark, p), recs, p.select("model_run_id").distinct())


_DIRTY_SHARES = """SELECT uplift_segment, CASE WHEN uplift_segment = 'persuadable' THEN -count ELSE count END AS count,
  CASE WHEN uplift_segment <> 'persuadable' THEN share + 1 ELSE share END AS share FROM {shares}"""


@register("check_contract_outputs", W("predictions", extra=_recs_sql() + _DIRTY_P + _DIRTY_R + f""",
seg_shares AS (SELECT uplift_segment, COUNT(*) AS count, COUNT(*) / CAST((SELECT COUNT(*) FROM scored) AS DOUBLE) AS share
  FROM (SELECT {_SEG025} AS uplift_segment FROM scored) GROUP BY 1),
dirty_s AS (""" + _DIRTY_SHARES.replace("{shares}", "seg_shares") + ")") + _checked(" UNION ALL ".join([
    _rules_sql(qa.PREDICTION_RULES, "dirty_p"), _rules_sql(qa.RECOMMENDATION_RULES, "dirty_r"),
    _rules_sql(qa.SHARE_RULES, "dirty_s")])))
def q_check_contract_outputs(spark, d):
    s = stable_scored(spark, d)
    recs = spark.sql(_DIRTY_RECS, recommendations=jn.recommendations_table(s, _RUNS))
    shares = spark.sql(_DIRTY_SHARES, shares=sm.uplift_segment_shares(s))
    return qa.check_contract_outputs(dirty_predictions(spark, derived.predictions(spark, d, s)), recs, shares)


_DIRTY_SUMMARY = """SELECT positive_ite_share + 1 AS positive_ite_share, correlation + 2 AS correlation, -mae - 1 AS mae, -rmse - 1 AS rmse FROM {summary}
UNION ALL SELECT positive_ite_share, correlation, mae, rmse FROM {summary}"""


@register("check_summary_ranges", W("scored", extra=""",
summary AS (SELECT AVG(CASE WHEN ite > 0 THEN 1.0 ELSE 0.0 END) AS positive_ite_share, CORR(ite, true_ite) AS correlation,
  AVG(ABS(ite - true_ite)) AS mae, SQRT(AVG((ite - true_ite) * (ite - true_ite))) AS rmse FROM scored),
dirty_m AS (""" + _DIRTY_SUMMARY.replace("{summary}", "summary") + ")") + _checked(_rules_sql(qa.SUMMARY_RULES, "dirty_m")))
def q_check_summary_ranges(spark, d):
    """Summary contract ranges over computed metrics, once as they are and once pushed out of range."""
    s = stable_scored(spark, d)
    share = s.agg(F.avg(F.when(F.col("ite") > 0, 1.0).otherwise(0.0))).scalar()
    return qa.check_summary_ranges(spark.sql(
        _DIRTY_SUMMARY, summary=mt.error_metrics(s).withColumn("positive_ite_share", share)))


@register("check_imbalance", W("customers") + """
SELECT kind, ROUND(rate, 6) AS rate, rate < CAST(0.05 AS DOUBLE) OR rate > CAST(0.95 AS DOUBLE) AS warning FROM (
  SELECT 'treatment' AS kind, AVG(CAST(treatment_received AS DOUBLE)) AS rate FROM customers
  UNION ALL SELECT 'outcome', AVG(CAST(purchase AS DOUBLE)) FROM customers)""")
def q_check_imbalance(spark, d):
    out = qa.check_imbalance(derived.customers(spark, d))
    return out.select("kind", F.round("rate", 6).alias("rate"), "warning")
