"""Data-quality checks.

The reference runs one query (or pandas pass) per check.  Here each check is
a named boolean "violation" column and a whole rule list is one aggregate
pass producing ``(check, violations, passed)`` rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import is_finite
from ..schema import GROUND_TRUTH_COLUMNS, OPTIONAL_COLUMNS, PREDICTION_COLUMNS, REQUIRED_COLUMNS

ITE_TOLERANCE = 1e-5


def run_rules(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Count violations of every rule in one aggregate; long result."""
    if not rules:
        raise ValueError("no rules")
    wide = df.agg(*[F.count(F.when(cond, 1)).alias(f"r{i}") for i, (_, cond) in enumerate(rules)])
    stack = ", ".join(f"'{name}', r{i}" for i, (name, _) in enumerate(rules))
    long = wide.selectExpr(f"stack({len(rules)}, {stack}) AS (check, violations)")
    return long.select("check", F.col("violations").cast("bigint"), (F.col("violations") == 0).alias("passed"))


def missing_columns(df: DataFrame, required=REQUIRED_COLUMNS) -> list[str]:
    """V1 (metadata only)."""
    return [c for c in required if c not in df.columns]


def unknown_columns(df: DataFrame, allowed=OPTIONAL_COLUMNS + REQUIRED_COLUMNS) -> list[str]:
    """V2 (metadata only)."""
    return sorted(set(df.columns) - set(allowed))


def schema_checks(df: DataFrame) -> DataFrame:
    """V1 + V2 as rows ``(check, detail, passed)`` built from the schema alone."""
    spark = df.sparkSession
    miss, unk = missing_columns(df), unknown_columns(df)
    return spark.createDataFrame(
        [("check_required_columns", ",".join(miss), not miss),
         ("check_unknown_columns", ",".join(unk), not unk)],
        "check string, detail string, passed boolean")


def rows_missing(df: DataFrame, key: str = "customer_id", required=REQUIRED_COLUMNS) -> DataFrame:
    """Rows with a required cell NULL or empty (V3): ``(key, missing array<string>)``."""
    flags = []
    for c in required:
        if c not in df.columns:
            flags.append(F.lit(c))
            continue
        cond = F.col(c).isNull()
        if dict(df.dtypes)[c] == "string":
            cond = cond | (F.col(c) == "")
        flags.append(F.when(cond, F.lit(c)))
    missing = F.array_compact(F.array(*flags))
    return df.select(F.col(key), missing.alias("missing")).where(F.size("missing") > 0)


def duplicate_ids(df: DataFrame, key: str = "customer_id") -> DataFrame:
    """COUNT(*) - COUNT(DISTINCT key) as a one-row frame (V4): one shuffle
    by key, partially aggregated map-side."""
    per = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    # rows without an id are no ids of their own: each counts
    return per.agg((F.coalesce(F.sum("n"), F.lit(0)) - F.count(key)).cast("bigint").alias("duplicates"))


def customer_rule_sql(columns, ite_tolerance: float = ITE_TOLERANCE) -> list[tuple[str, str]]:
    """V5-V11 and V14 as (name, SQL predicate of a violation), for the columns present."""
    has = set(columns)
    rules: list[tuple[str, str]] = [(f"null_{c}", f"{c} IS NULL") for c in REQUIRED_COLUMNS if c in has]
    if "treatment_received" in has:
        rules.append(("binary_treatment_received", "treatment_received NOT IN (0, 1)"))
    if "purchase" in has:
        rules.append(("binary_purchase", "purchase NOT IN (0, 1)"))
    if "discount_percentage" in has:
        rules.append(("discount_range", "discount_percentage < 0 OR discount_percentage > 1"))
        if "treatment_received" in has:
            rules.append(("control_discount", "treatment_received = 0 AND discount_percentage <> 0"))
            rules.append(("treated_discount",
                          "treatment_received = 1 AND (discount_percentage <= 0 OR discount_percentage IS NULL)"))
    if {"purchase", "purchase_value"} <= has:
        rules.append(("purchase_value_without_purchase", "purchase = 0 AND purchase_value <> 0"))
    if {"true_treatment_purchase_probability", "true_baseline_purchase_probability", "true_ite"} <= has:
        rules.append(("ite_consistency",
                      "ABS(true_treatment_purchase_probability - true_baseline_purchase_probability - true_ite)"
                      f" > CAST({float(ite_tolerance)!r} AS DOUBLE)"))
    if "customer_id" in has:
        rules.append(("customer_id_positive", "customer_id < 1"))
    if "campaign_id" in has:
        rules.append(("campaign_id_positive", "campaign_id < 1"))
    if "customer_segment" in has:
        rules.append(("customer_segment_nonempty", "customer_segment = ''"))
    for c in ("age", "tenure_months", "historical_orders", "historical_revenue", "avg_order_value",
              "days_since_last_purchase", "website_visits", "email_opens", "email_clicks",
              "previous_campaign_response", "purchase_value", "discount_cost"):
        if c in has:
            rules.append((f"nonnegative_{c}", f"{c} < 0"))
    for c in GROUND_TRUTH_COLUMNS:
        if c in has and c != "true_ite":
            rules.append((f"probability_{c}", f"{c} < 0 OR {c} > 1"))
    return rules


def customer_rules(df: DataFrame, ite_tolerance: float = ITE_TOLERANCE) -> list[tuple[str, Column]]:
    """The rule list as Spark columns."""
    return [(name, F.expr(sql)) for name, sql in customer_rule_sql(df.columns, ite_tolerance)]


def validate_customers(df: DataFrame, key: str = "customer_id", ite_tolerance: float = ITE_TOLERANCE) -> DataFrame:
    """All row-level customer checks in one pass, plus duplicate ids."""
    checks = run_rules(df, customer_rules(df, ite_tolerance))
    dup = duplicate_ids(df, key).select(F.lit("duplicate_ids").alias("check"), F.col("duplicates").alias("violations"))
    dup = dup.select("check", "violations", (F.col("violations") == 0).alias("passed"))
    return checks.unionByName(dup)


def ite_max_difference(df: DataFrame) -> DataFrame:
    """V11 in the reference's form: the largest |(p1 - p0) - ite|."""
    diff = F.abs(F.col("true_treatment_purchase_probability") - F.col("true_baseline_purchase_probability")
                 - F.col("true_ite"))
    return df.agg(F.coalesce(F.max(diff), F.lit(0.0)).alias("max_difference")).select(
        "max_difference", (F.col("max_difference") <= ITE_TOLERANCE).alias("passed"))


def check_finite(predictions: DataFrame, cols=PREDICTION_COLUMNS) -> DataFrame:
    """Prediction id set, prediction columns numeric, not null, finite."""
    known = [("known_customer_id", F.col("customer_id").isNull())] if "customer_id" in predictions.columns else []
    return run_rules(predictions, known + [(f"finite_{c}", ~is_finite(c)) for c in cols])


def check_coverage(customers: DataFrame, predictions: DataFrame, key: str = "customer_id",
                   show: int = 10) -> DataFrame:
    """Prediction ids vs customer ids (V13): first ``show`` sorted ids per side.

    The per-side top-k is a window limited to k, which Spark runs as a
    group limit before the shuffle.
    """
    from pyspark.sql import Window

    from .joins import coverage_anti

    diff = coverage_anti(customers, predictions, key)
    w = Window.partitionBy("side").orderBy(key)
    return diff.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= show).drop("_rn")


def _unresolved(child: DataFrame, parent: DataFrame, col: str) -> DataFrame:
    """Rows of ``child`` whose ``col`` is set but not in ``parent``: one aggregation over both, no join."""
    both = child.where(F.col(col).isNotNull()).select(F.col(col).alias("k"), F.lit(1).alias("c"), F.lit(0).alias("p")) \
        .union(parent.select(F.col(col).alias("k"), F.lit(0).alias("c"), F.lit(1).alias("p")))
    per = both.groupBy("k").agg(F.sum("c").alias("c"), F.max("p").alias("p"))
    return per.agg(F.coalesce(F.sum(F.when(F.col("p") == 0, F.col("c"))), F.lit(0)).cast("bigint").alias("violations"))


def check_references(customers: DataFrame, campaigns: DataFrame, predictions: DataFrame,
                     recommendations: DataFrame | None = None, runs: DataFrame | None = None,
                     key: str = "customer_id") -> DataFrame:
    """Foreign keys resolve, (customer, run) of predictions and run ids are unique."""
    dup = predictions.groupBy(key, "model_run_id").count().agg(
        F.coalesce(F.sum(F.when(F.col("count") > 1, 1)), F.lit(0)).cast("bigint").alias("violations"))
    found = {
        "customer_campaign_resolves": _unresolved(customers, campaigns, "campaign_id"),
        "prediction_customer_resolves": _unresolved(predictions, customers, key),
        "prediction_run_unique": dup,
    }
    if runs is not None:
        found["prediction_run_resolves"] = _unresolved(predictions, runs, "model_run_id")
    if recommendations is not None:
        found["recommendation_customer_resolves"] = _unresolved(recommendations, customers, key)
        found["recommendation_campaign_resolves"] = _unresolved(recommendations, campaigns, "campaign_id")
        if runs is not None:
            found["recommendation_run_resolves"] = _unresolved(recommendations, runs, "model_run_id")
    rows = [df.select(F.lit(name).alias("check"), "violations", (F.col("violations") == 0).alias("passed"))
            for name, df in found.items()]
    return reduce(DataFrame.unionByName, rows)


#: Output contract (V16) as (name, SQL predicate of a violation).
PREDICTION_RULES = (
    ("prediction_baseline_probability_range", "baseline_probability < 0 OR baseline_probability > 1"),
    ("prediction_treatment_probability_range", "treatment_probability < 0 OR treatment_probability > 1"),
)
RECOMMENDATION_RULES = (
    ("recommendation_cost_nonnegative", "expected_cost < 0"),
    ("recommendation_discount_range", "recommended_discount < 0 OR recommended_discount > 1"),
)
SUMMARY_RULES = (
    ("summary_positive_ite_share_range", "positive_ite_share < 0 OR positive_ite_share > 1"),
    ("summary_correlation_range", "correlation < -1 OR correlation > 1"),
    ("summary_mae_nonnegative", "mae < 0"),
    ("summary_rmse_nonnegative", "rmse < 0"),
)
SHARE_RULES = (("segment_count_nonnegative", "count < 0"), ("segment_share_range", "share < 0 OR share > 1"))


def run_sql_rules(df: DataFrame, rules) -> DataFrame:
    return run_rules(df, [(name, F.expr(cond)) for name, cond in rules])


def check_contract_outputs(predictions: DataFrame, recommendations: DataFrame, shares: DataFrame) -> DataFrame:
    """Output ranges of the prediction, recommendation and segment contracts."""
    return run_sql_rules(predictions, PREDICTION_RULES).unionByName(
        run_sql_rules(recommendations, RECOMMENDATION_RULES)).unionByName(run_sql_rules(shares, SHARE_RULES))


def check_summary_ranges(metrics: DataFrame) -> DataFrame:
    """Summary contract: shares in [0, 1], correlation in [-1, 1], mae and rmse >= 0."""
    return run_sql_rules(metrics, SUMMARY_RULES)


def check_imbalance(df: DataFrame, treatment_col: str = "treatment_received", outcome_col: str = "purchase",
                    low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Treatment and outcome rates with a warning flag outside [low, high]."""
    rates = df.agg(F.avg(F.col(treatment_col).cast("double")).alias("treatment"),
                   F.avg(F.col(outcome_col).cast("double")).alias("outcome"))
    long = rates.selectExpr("stack(2, 'treatment', treatment, 'outcome', outcome) AS (kind, rate)")
    return long.select("kind", "rate", ((F.col("rate") < low) | (F.col("rate") > high)).alias("warning"))


def check_campaign_dates(campaigns: DataFrame) -> DataFrame:
    """ends_at >= starts_at when both set; default discount in [0, 1]."""
    cols = set(campaigns.columns)
    s = F.col("starts_at") if "starts_at" in cols else F.lit(None).cast("timestamp")
    e = F.col("ends_at") if "ends_at" in cols else F.lit(None).cast("timestamp")
    dd = F.col("default_discount_percentage") if "default_discount_percentage" in cols else F.lit(None).cast("double")
    return run_rules(campaigns, [
        ("campaign_dates_ordered", s.isNotNull() & e.isNotNull() & (e < s)),
        ("campaign_default_discount_range", (dd < 0) | (dd > 1)),
    ])
