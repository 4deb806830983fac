"""Joins of customers, predictions, campaigns and recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .allocate import greedy_prefixes
from .ordered import latest_per_key


def join_scored(customers: DataFrame, predictions: DataFrame, key: str = "customer_id") -> DataFrame:
    """Inner equi-join on the id (J1); sort-merge at scale, both sides by id."""
    return customers.join(predictions, key, "inner")


def join_campaign(customers: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Left outer join to the campaign dimension (J2); the planner and AQE choose how.

    Customers without a campaign can be many: they need no partner, so they
    stay out of the join (and out of one hot partition).
    """
    having = customers.where(F.col("campaign_id").isNotNull()).join(campaigns, "campaign_id", "left")
    without = customers.where(F.col("campaign_id").isNull())
    return having.unionByName(without, allowMissingColumns=True)


PRED_VALUES = ("baseline_probability", "treatment_probability", "ite")
REC_VALUES = ("recommended_discount", "expected_profit", "expected_cost")


def latest_prediction(predictions: DataFrame, key: str = "customer_id") -> DataFrame:
    """Newest prediction per customer by (created_at, id)."""
    return latest_per_key(predictions, key, ["created_at", "id"], list(PRED_VALUES))


def latest_recommendation(recommendations: DataFrame, key: str = "customer_id") -> DataFrame:
    """Newest recommendation per customer by (created_at, id)."""
    return latest_per_key(recommendations, key, ["created_at", "id"], list(REC_VALUES))


def recommendations_table(scored: DataFrame, runs: dict) -> DataFrame:
    """Recommendation rows of several greedy runs: ``runs`` maps run id -> (budget, created_at).

    The order is the same for all runs, so one search finds where each budget
    ends; a row then appears once for each run that buys it.
    """
    order = sorted(runs.items())
    cand, bought = greedy_prefixes(scored, [budget for _, (budget, _) in order])
    every = F.array(*[F.when(inside, F.struct(F.lit(run).alias("model_run_id"), F.expr(f"TIMESTAMP_NTZ '{created}'").alias("created_at")))
                      for (run, (_, created)), inside in zip(order, bought)])
    rows = cand.select("*", F.explode(F.array_compact(every)).alias("run"))
    return rows.select(
        (F.col("customer_id") * 2 + (F.col("run.model_run_id") - 1)).alias("id"),
        "customer_id", "campaign_id", F.col("run.model_run_id").alias("model_run_id"),
        F.col("ite").alias("predicted_ite"),
        F.col("discount_percentage").alias("recommended_discount"),
        "expected_profit", "expected_cost", F.col("run.created_at").alias("created_at"))


def export_dashboard(customers: DataFrame, predictions: DataFrame, recommendations: DataFrame,
                     key: str = "customer_id") -> DataFrame:
    """Customer + latest prediction + latest recommendation, 16 columns.

    Each "latest" is one grouped aggregation (map-side partial), so both
    joins are key-to-key with at most one row per customer on the right.
    """
    p = latest_prediction(predictions, key).withColumnRenamed("ite", "predicted_ite")
    r = latest_recommendation(recommendations, key)
    return customers.select(
        key, "campaign_id", "customer_segment", "treatment_received", "discount_percentage",
        "purchase", "purchase_value", "discount_cost", "net_revenue", "true_ite",
    ).join(p, key, "left").join(r, key, "left")


def mark_selected(df: DataFrame, ids: DataFrame, key: str = "customer_id", out: str = "selected") -> DataFrame:
    """0/1 membership of each id in a set coming from elsewhere."""
    members = ids.select(key).distinct().withColumn("_member", F.lit(1))
    return df.join(members, key, "left").withColumn(out, F.coalesce(F.col("_member"), F.lit(0))).drop("_member")


def coverage_anti(left: DataFrame, right: DataFrame, key: str = "customer_id") -> DataFrame:
    """Ids on one side only, both ways (J6): ``(key, side)`` with side missing/extra; one aggregation."""
    both = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).union(
        right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r")))
    seen = both.where(F.col(key).isNotNull()).groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return seen.where("l <> r").select(key, F.when(F.col("l") == 1, "missing").otherwise("extra").alias("side"))
