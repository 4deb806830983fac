"""Contracts, column roles and configuration shared by every operator."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values that must match the reference contract exactly.
# Required customer columns in contract order, the one optional column, the
# segment labels, the default budgets of the scenario report and the
# heterogeneity columns of the DML final stage.
# ---------------------------------------------------------------------------
REQUIRED_COLUMNS = (
    "customer_id", "age", "tenure_months", "customer_segment", "historical_orders",
    "historical_revenue", "avg_order_value", "days_since_last_purchase", "website_visits",
    "email_opens", "email_clicks", "previous_campaign_response", "treatment_received",
    "discount_percentage", "purchase", "purchase_value", "discount_cost", "net_revenue",
    "true_baseline_purchase_probability", "true_treatment_purchase_probability", "true_ite",
    "true_treatment_probability",
)
OPTIONAL_COLUMNS = ("campaign_id",)
SCENARIO_BUDGETS = (25000, 50000, 100000, 250000, 500000, 1000000, 2500000)
HETEROGENEITY_NUMERIC = (
    "age", "tenure_months", "previous_campaign_response", "website_visits",
    "days_since_last_purchase", "historical_revenue",
)
MODEL_INPUT_COLUMNS = (
    "customer_id", "age", "tenure_months", "customer_segment", "historical_orders",
    "historical_revenue", "avg_order_value", "days_since_last_purchase",
    "website_visits", "email_opens", "email_clicks", "previous_campaign_response",
    "treatment_received", "discount_percentage", "purchase",
)
GROUND_TRUTH_COLUMNS = (
    "true_baseline_purchase_probability", "true_treatment_purchase_probability",
    "true_ite", "true_treatment_probability",
)
PREDICTION_COLUMNS = ("baseline_probability", "treatment_probability", "ite")

_INT_COLUMNS = {
    "age", "tenure_months", "historical_orders", "days_since_last_purchase",
    "website_visits", "email_opens", "email_clicks", "previous_campaign_response",
    "treatment_received", "purchase",
}


def _customer_field(name: str) -> T.StructField:
    if name == "customer_id":
        return T.StructField(name, T.LongType(), False)
    if name == "customer_segment":
        return T.StructField(name, T.StringType(), False)
    if name in _INT_COLUMNS:
        return T.StructField(name, T.IntegerType(), False)
    return T.StructField(name, T.DoubleType(), False)


CUSTOMER_SCHEMA = T.StructType(
    [_customer_field(REQUIRED_COLUMNS[0]), T.StructField("campaign_id", T.IntegerType(), True)]
    + [_customer_field(c) for c in REQUIRED_COLUMNS[1:]]
)
"""Explicit schema for file sources (never inferred)."""


@dataclass(frozen=True)
class FeatureConfig:
    """Column roles of the effect models (the reference's ``features`` block)."""

    covariates: tuple = ("age", "tenure_months")
    confounders: tuple = (
        "historical_orders", "historical_revenue", "avg_order_value",
        "days_since_last_purchase", "website_visits", "email_opens", "email_clicks",
        "previous_campaign_response", "customer_segment",
    )
    treatment: str = "treatment_received"
    outcome: str = "purchase"
    key: str = "customer_id"

    @property
    def all_features(self) -> tuple:
        return tuple(self.covariates) + tuple(self.confounders)

    @property
    def categorical(self) -> tuple:
        return tuple(c for c in self.all_features if c == "customer_segment")

    @property
    def numeric(self) -> tuple:
        return tuple(c for c in self.all_features if c != "customer_segment")


@dataclass(frozen=True)
class ModelConfig:
    """Effect-model choice (the reference's ``model`` block)."""

    model_type: str = "dml"  # t_learner | x_learner | dml
    base_learner: str = "lightgbm"  # lightgbm | gradient_boosting | random_forest | linear
    seed: int = 42
    n_estimators: int = 100
    max_depth: int = 4
    min_samples_split: int = 10
    learning_rate: float = 0.1
    folds: int = 2
    stratified_folds: bool = False  # exact per-arm balance (one ranked pass) vs hash folds (no shuffle)


#: The model that the configured one is compared with.
BASELINE_MODEL = ModelConfig(model_type="t_learner", base_learner="gradient_boosting")
