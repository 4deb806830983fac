"""Refutation of the effect estimate and model comparison.

Each test refits the effect model on a changed input (permuted treatment,
an added noise confounder, a hash subset) and compares mean effects; boosted
refits grow together with the original.  The results are small one-row
frames; only the scalar means reach the driver.
"""

from __future__ import annotations

from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import BASELINE_MODEL, FeatureConfig, ModelConfig
from ..session import reliable_checkpoint, run_concurrently, write_stage_table
from .learners import BOOSTED, CausalModel, Variant, fit_jointly
from .metrics import error_metrics
from .prep import add_noise_feature, imbalance_warnings, permute_treatment, subset_condition, subset_rows, train_test_split

REPORT_SCHEMA = ("test string, original_mean_ite double, refuted_mean_ite double, "
                 "percent_change double, passed boolean")


def mean_effect(df: DataFrame, cfg: ModelConfig = ModelConfig(), features: FeatureConfig = FeatureConfig(),
                extra_confounders=()) -> float:
    """Fit and average the ITE over the same rows."""
    fitted = CausalModel(cfg, features, extra_confounders).fit(df)
    return float(fitted.transform(df).agg(F.avg("ite")).collect()[0][0])


def _relative(new: float, original: float) -> float:
    return abs(new - original) / abs(original) if original != 0 else abs(new)


def _needed(features: FeatureConfig) -> list:
    return list(dict.fromkeys([features.key, features.treatment, features.outcome, *features.all_features]))


def _joint_refits(df: DataFrame, cfg: ModelConfig, features: FeatureConfig, fraction: float, with_original: bool):
    """(the original model or None, refitted means): all boosted fits in the same jobs."""
    placebo, noise = "_placebo_treatment", "random_noise"
    noisy = add_noise_feature(df.select(*_needed(features)), features.key, cfg.seed, noise)
    wide = permute_treatment(noisy, features.treatment, features.key, cfg.seed, placebo, circle=False)
    keep = subset_condition(features.key, cfg.seed, fraction)
    wide = write_stage_table(wide, "refits")
    variants = [Variant("placebo", treatment=placebo), Variant("noisy", extra=(noise,)), Variant("subset", rows=keep)]
    fitted = fit_jointly(wide, cfg, features, ([Variant("original")] if with_original else []) + variants)

    def mean(v):
        rows = wide if v.rows is None else wide.where(v.rows)
        return float(fitted[v.name].transform(rows).agg(F.avg("ite")).first()[0])

    means = run_concurrently([lambda v=v: mean(v) for v in variants], max_workers=3)
    return fitted.get("original"), dict(zip([v.name for v in variants], means))


def fit_with_refits(df: DataFrame, cfg: ModelConfig = ModelConfig(), features: FeatureConfig = FeatureConfig(),
                    fraction: float = 0.8):
    """(fitted model, refitted means) of ``df``."""
    if cfg.base_learner in BOOSTED:
        fitted, means = _joint_refits(df, cfg, features, fraction, with_original=True)
        fitted.prep.warnings = imbalance_warnings(df, features)
        fitted.trained_at = datetime.now(timezone.utc).isoformat(timespec="seconds")
        return fitted, means
    return tuple(run_concurrently([lambda: CausalModel(cfg, features).fit(df), lambda: refit_means(df, cfg, features, fraction)], 2))


def refit_means(df: DataFrame, cfg: ModelConfig = ModelConfig(), features: FeatureConfig = FeatureConfig(),
                fraction: float = 0.8) -> dict:
    """The three refitted mean effects (placebo, noise confounder, subset).

    They need only the input table, not the original fit.
    """
    if cfg.base_learner in BOOSTED:
        return _joint_refits(df, cfg, features, fraction, with_original=False)[1]
    permuted = lambda: mean_effect(
        reliable_checkpoint(permute_treatment(df, features.treatment, features.key, cfg.seed, circle=False)), cfg, features)
    noisy = lambda: mean_effect(
        add_noise_feature(df, features.key, cfg.seed), cfg, features, extra_confounders=("random_noise",))
    subset = lambda: mean_effect(subset_rows(df, features.key, cfg.seed, fraction), cfg, features)
    values = run_concurrently([permuted, noisy, subset], max_workers=3)
    return dict(zip(("placebo", "noisy", "subset"), values))


def report_rows(spark, original: float, means: dict) -> DataFrame:
    """Pass/fail rules applied to the refitted means."""
    rows = []
    placebo = means["placebo"]
    rows.append(("placebo_treatment", original, placebo, _relative(placebo, original),
                 abs(placebo) < 0.5 * abs(original)))
    for test, key in (("random_common_cause", "noisy"), ("data_subset", "subset")):
        change = _relative(means[key], original)
        rows.append((test, original, means[key], change, change < 0.20))
    rows.append(("all_tests_passed", original, None, None, all(r[4] for r in rows)))
    return spark.createDataFrame(rows, REPORT_SCHEMA)


def refutation_report(df: DataFrame, cfg: ModelConfig = ModelConfig(),
                      features: FeatureConfig = FeatureConfig(), original: float | None = None) -> DataFrame:
    """The three refutations as rows plus an all-passed row.

    ``original`` is the mean effect of an already fitted model on ``df``;
    without it the model is fitted too, concurrently with the refits.  The
    columns that the fits need are computed once, into a written table.
    """
    df = write_stage_table(df.select(*_needed(features)), "customers")
    if original is None:
        fitted, means = fit_with_refits(df, cfg, features)
        original = float(fitted.transform(df).agg(F.avg("ite")).first()[0])
    else:
        means = refit_means(df, cfg, features)
    return report_rows(df.sparkSession, original, means)


def compare_models(df: DataFrame, configs: dict | None = None, features: FeatureConfig = FeatureConfig(),
                   true_col: str = "true_ite", seed: int = 42) -> DataFrame:
    """Hold-out MAE (6 dp) and correlation (4 dp) of each model (M8): the baseline and the configured one by default.

    As in the reference, preprocessing is fitted on all rows before the split.
    """
    from .prep import Preprocessor

    configs = configs or {"t_learner": BASELINE_MODEL, "dml": ModelConfig()}
    split = reliable_checkpoint(train_test_split(df, features.key, seed))
    prep = Preprocessor(features).fit(split)
    train, test = split.where("split = 'train'"), split.where("split = 'test'")

    def measured(name, cfg):
        fitted = CausalModel(cfg, features).fit(train, prep)
        return error_metrics(fitted.transform(test), "ite", true_col).select(
            F.lit(name).alias("model_type"), F.lit(cfg.base_learner).alias("base_learner"), F.round("mae", 6).alias("mae"),
            F.round("correlation", 4).alias("correlation_with_ground_truth"))

    rows = run_concurrently([lambda n=n, c=c: measured(n, c) for n, c in configs.items()])
    return reduce(DataFrame.unionByName, rows)
