"""Summary views over the customer table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .allocate import uplift_segments
from .ordered import exact_median


def customer_summary(c: DataFrame) -> DataFrame:
    """Counts, arm rates, mean true ITE, revenue, discount cost (A1)."""
    t, y = F.col("treatment_received"), F.col("purchase")
    return c.agg(
        F.count(F.lit(1)).alias("customers"),
        F.sum(F.when(t == 1, 1).otherwise(0)).alias("treated_customers"),
        F.sum(F.when(t == 0, 1).otherwise(0)).alias("control_customers"),
        F.avg(t.cast("double")).alias("treatment_rate"),
        F.avg(y.cast("double")).alias("purchase_rate"),
        F.avg(F.when(t == 1, y.cast("double"))).alias("treated_purchase_rate"),
        F.avg(F.when(t == 0, y.cast("double"))).alias("control_purchase_rate"),
        F.avg("true_ite").alias("average_true_ite"),
        F.sum("purchase_value").alias("total_revenue"),
        F.sum("discount_cost").alias("total_discount_cost"),
    )


def revenue_summary(c: DataFrame) -> DataFrame:
    """Per customer segment: count, revenue, mean purchase value, cost (A2)."""
    return c.groupBy("customer_segment").agg(
        F.count(F.lit(1)).alias("customers"),
        F.sum("purchase_value").alias("total_revenue"),
        F.avg("purchase_value").alias("avg_purchase_value"),
        F.sum("discount_cost").alias("total_discount_cost"),
    )


def campaign_summary(c: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Per campaign, unmatched customers under 0 / 'unassigned' (A3).

    The campaign dimension is joined after aggregating the fact table by
    campaign_id, so only one row per campaign id crosses the join.
    """
    per = c.groupBy("campaign_id").agg(
        F.count("customer_id").alias("customers"),
        F.count(F.when(F.col("treatment_received") == 1, F.col("customer_id"))).alias("treated_customers"),
        F.sum("purchase_value").alias("rev"),
        F.sum("discount_cost").alias("cost"),
        F.sum("net_revenue").alias("net"),
    )
    joined = per.join(campaigns.select("campaign_id", "campaign_name"), "campaign_id", "left")
    # customers whose campaign does not resolve fold into one 'unassigned' group
    return joined.groupBy(
        F.when(F.col("campaign_name").isNotNull(), F.col("campaign_id")).otherwise(F.lit(0)).alias("campaign_id"),
        F.coalesce(F.col("campaign_name"), F.lit("unassigned")).alias("campaign_name"),
    ).agg(
        F.sum("customers").alias("customers"),
        F.sum("treated_customers").alias("treated_customers"),
        F.coalesce(F.sum("rev"), F.lit(0.0)).alias("total_revenue"),
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("total_discount_cost"),
        F.coalesce(F.sum("net"), F.lit(0.0)).alias("total_net_revenue"),
    )


def treatment_summary(c: DataFrame) -> DataFrame:
    """Per arm (A4)."""
    return c.groupBy("treatment_received").agg(
        F.count(F.lit(1)).alias("customers"),
        F.avg(F.col("purchase").cast("double")).alias("purchase_rate"),
        F.avg("discount_percentage").alias("avg_discount_percentage"),
        F.avg("true_ite").alias("avg_true_ite"),
        F.coalesce(F.sum("purchase_value"), F.lit(0.0)).alias("total_revenue"),
        F.coalesce(F.sum("discount_cost"), F.lit(0.0)).alias("total_discount_cost"),
        F.coalesce(F.sum("net_revenue"), F.lit(0.0)).alias("total_net_revenue"),
    )


def dataset_summary(c: DataFrame, key: str = "customer_id") -> DataFrame:
    """A1 plus exact median true ITE and mean purchase value; 0.0 for an empty arm (A5)."""
    t, y = F.col("treatment_received"), F.col("purchase")
    median = exact_median(c, "true_ite", key, alias="m").select("m").scalar()
    n = F.count(F.lit(1))
    return c.agg(
        n.alias("customers"),
        F.count(F.when(t == 1, 1)).alias("treated_customers"),
        F.count(F.when(t == 0, 1)).alias("control_customers"),
        F.try_divide(F.count(F.when(t == 1, 1)), n).alias("treatment_rate"),
        F.avg(y.cast("double")).alias("purchase_rate"),
        F.coalesce(F.avg(F.when(t == 1, y.cast("double"))), F.lit(0.0)).alias("treated_purchase_rate"),
        F.coalesce(F.avg(F.when(t == 0, y.cast("double"))), F.lit(0.0)).alias("control_purchase_rate"),
        F.avg("true_ite").alias("average_true_ite"),
        F.avg("purchase_value").alias("average_purchase_value"),
        F.sum("purchase_value").alias("total_revenue"),
        F.sum("discount_cost").alias("total_discount_cost"),
    ).select("*", median.alias("median_true_ite"))


def segment_counts_raw(c: DataFrame) -> DataFrame:
    """Value counts of the customer segment, largest first."""
    return c.groupBy("customer_segment").agg(F.count(F.lit(1)).alias("count")) \
            .orderBy(F.col("count").desc(), F.col("customer_segment"))


def discount_distribution(c: DataFrame) -> DataFrame:
    """Value counts of the discount, by value."""
    return c.groupBy("discount_percentage").agg(F.count(F.lit(1)).alias("count")).orderBy("discount_percentage")


def uplift_segment_shares(scored: DataFrame, ite_threshold: float = 0.05,
                          baseline_threshold: float = 0.25) -> DataFrame:
    """Count and share per uplift segment."""
    seg = uplift_segments(scored, ite_threshold=ite_threshold, baseline_threshold=baseline_threshold)
    total = seg.select(F.count(F.lit(1))).scalar()
    return seg.groupBy("uplift_segment").agg(F.count(F.lit(1)).alias("count")) \
              .select("uplift_segment", "count", (F.col("count") / total).alias("share"))
