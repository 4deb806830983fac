"""Learners on generated frames with a known effect."""

import pytest
from pyspark.sql import functions as F

from cauldron.functions.scalar import hash_normal, hash_uniform
from cauldron.operators.learners import CausalModel
from cauldron.operators.refute import refit_means, report_rows
from cauldron.schema import FeatureConfig, ModelConfig

FEATS = FeatureConfig(covariates=("x1",), confounders=("x2",), treatment="w", outcome="y", key="id")


def _frame(spark, tau: float, n: int = 6000):
    df = spark.range(n).select(F.col("id"), hash_normal("id", 1).alias("x1"), hash_normal("id", 2).alias("x2"))
    # treatment depends on x1 (confounding); outcome probability on x1 and w
    w = (hash_uniform("id", 3, "w") < 1 / (1 + F.exp(-1.5 * F.col("x1")))).cast("int")
    p0 = F.greatest(F.lit(0.02), F.least(F.lit(0.9), 0.3 + 0.12 * F.col("x1") + 0.03 * F.col("x2")))
    df = df.withColumn("w", w).withColumn("p", p0 + F.lit(tau) * F.col("w"))
    return df.withColumn("y", (hash_uniform("id", 4, "y") < F.col("p")).cast("int")).checkpoint(eager=True)


@pytest.fixture(scope="module")
def effect_frame(spark):
    return _frame(spark, 0.1)


def _mean_ite(df, mtype):
    fit = CausalModel(ModelConfig(model_type=mtype, base_learner="linear"), FEATS).fit(df)
    return fit.transform(df).agg(F.avg("ite")).first()[0]


def test_dml_recovers_constant_effect_better_than_naive(effect_frame):
    naive = effect_frame.groupBy().agg(
        (F.avg(F.when(F.col("w") == 1, F.col("y"))) - F.avg(F.when(F.col("w") == 0, F.col("y"))))).first()[0]
    dml = _mean_ite(effect_frame, "dml")
    assert abs(dml - 0.1) < 0.04
    assert abs(dml - 0.1) < abs(naive - 0.1)


@pytest.mark.parametrize("mtype", ["t_learner", "x_learner"])
def test_meta_learners_recover_effect(effect_frame, mtype):
    assert abs(_mean_ite(effect_frame, mtype) - 0.1) < 0.05


def test_zero_effect_and_placebo(spark, effect_frame):
    zero = _frame(spark, 0.0)
    assert abs(_mean_ite(zero, "dml")) < 0.04
    means = refit_means(effect_frame, ModelConfig(model_type="dml", base_learner="linear"), FEATS)
    rows = {r.test: r for r in report_rows(spark, 0.1, means).collect()}
    assert abs(rows["placebo_treatment"].refuted_mean_ite) < 0.05 and rows["all_tests_passed"].passed


@pytest.mark.parametrize("base, mtype, most", [
    ("gradient_boosting", "dml", 0.05), ("lightgbm", "t_learner", 0.08), ("random_forest", "x_learner", 0.05)])
def test_tree_bases_recover_effect(effect_frame, base, mtype, most):
    fit = CausalModel(ModelConfig(model_type=mtype, base_learner=base, n_estimators=20), FEATS).fit(effect_frame)
    assert abs(fit.transform(effect_frame).agg(F.avg("ite")).first()[0] - 0.1) < most


def test_logistic_penalty_is_the_library_default(effect_frame):
    """C = 1: the gradient of the summed log loss plus half the squared weights is zero at the fit."""
    import numpy as np

    fit = CausalModel(ModelConfig(model_type="t_learner", base_learner="linear"), FEATS).fit(effect_frame.limit(150))
    model = fit.mu1.model
    rows = fit._features(effect_frame.limit(150)).where("w = 1").select("x_all", "y").collect()
    x, y = np.array([r.x_all.toArray() for r in rows]), np.array([r.y for r in rows])
    w = model.coefficients.toArray()
    p = 1 / (1 + np.exp(-(x @ w + model.intercept)))
    assert np.allclose(x.T @ (p - y) + w, 0, atol=1e-2)


def test_unknown_model_type():
    with pytest.raises(ValueError):
        CausalModel(ModelConfig(model_type="s_learner"))


def test_stratified_folds_are_exact(effect_frame):
    from cauldron.operators.learners import stratified_folds

    f = stratified_folds(effect_frame, "id", "w", 42, 2)
    counts = {(r.w, r._fold): r["count"] for r in f.groupBy("w", "_fold").count().collect()}
    for arm in (0, 1):
        assert abs(counts[(arm, 0)] - counts[(arm, 1)]) <= 1


def test_dml_with_stratified_folds(effect_frame):
    fit = CausalModel(ModelConfig(model_type="dml", base_learner="linear", stratified_folds=True), FEATS).fit(effect_frame)
    assert abs(fit.transform(effect_frame).agg(F.avg("ite")).first()[0] - 0.1) < 0.04


def test_joint_fits_equal_single_fits(effect_frame):
    """Fits that grow together with others' give the model that they give alone."""
    from cauldron.operators.learners import Variant, fit_jointly

    cfg = ModelConfig(n_estimators=8)
    half = F.col("id") % 2 == 0
    both = fit_jointly(effect_frame, cfg, FEATS, [Variant("all"), Variant("half", rows=half)])
    for name, rows in (("all", effect_frame), ("half", effect_frame.where(half))):
        alone = CausalModel(cfg, FEATS).fit(rows)
        a, b = (m.transform(rows).agg(F.avg("ite"), F.avg("treatment_probability")).first() for m in (both[name], alone))
        # bins are quantiles of all rows, so the half's own fit differs a little
        assert list(a) == pytest.approx(list(b), abs=1e-9 if name == "all" else 0.02)


def test_boosted_refits_share_their_jobs(effect_frame, monkeypatch):
    """One call of fit_all trains the original and its three refits."""
    from cauldron.operators import learners
    from cauldron.operators.refute import fit_with_refits

    calls, fit_all = [], learners.fit_all
    monkeypatch.setattr(learners, "fit_all", lambda df, inputs, specs, growth: calls.append(len(specs)) or fit_all(df, inputs, specs, growth))
    fitted, means = fit_with_refits(effect_frame, ModelConfig(n_estimators=20), FEATS)
    assert calls == [20]  # four models of an outcome fit and two nuisances a fold
    assert abs(fitted.transform(effect_frame).agg(F.avg("ite")).first()[0] - 0.1) < 0.06
    assert abs(means["placebo"]) < 0.06 and abs(means["noisy"] - 0.1) < 0.06 and abs(means["subset"] - 0.1) < 0.06
