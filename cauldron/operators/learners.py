"""Treatment-effect estimation.

Boosted bases (``lightgbm``, ``gradient_boosting``) train in shared jobs
(``boosting``): all fits of a model, and of all variants of it that a
refutation asks for, read one table and grow together.  Forests and linear
bases are Spark ML fits on filtered DataFrames.  DML cross-fits its nuisances
by folds and solves the linear final stage from one Gram-matrix aggregate (a
(p+1)^2 matrix reaches the driver, never rows).  Every fitted model scores
with ``transform``, a map-only pass.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

import numpy as np
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import hash_uniform
from ..schema import FeatureConfig, ModelConfig
from ..session import run_concurrently, write_stage_table
from .boosting import BoostedTrees, FitSpec, Growth, fit_all, score_columns
from .prep import Preprocessor, PreprocessorModel, assemble, heterogeneity_columns, imbalance_warnings

MODEL_TYPES = ("t_learner", "x_learner", "dml")
BOOSTED = ("gradient_boosting", "lightgbm")
LIGHTGBM_LEAVES, LIGHTGBM_LEAF_ROWS = 31, 20  # that library's defaults
LOGISTIC_ITERATIONS, LOGISTIC_TOLERANCE = 1000, 1e-6
TREATMENT = "__treatment__"


def growth_of(cfg: ModelConfig) -> Growth:
    """Boosting parameters (E1): lightgbm grows leaf-wise on second-order gains with that library's defaults;
    gradient_boosting grows to the depth on least-squares gains and splits nodes of min_samples_split rows or more."""
    if cfg.base_learner == "lightgbm":
        return Growth(cfg.n_estimators, cfg.max_depth, LIGHTGBM_LEAVES, cfg.learning_rate, LIGHTGBM_LEAF_ROWS)
    return Growth(cfg.n_estimators, cfg.max_depth, 2 ** cfg.max_depth, cfg.learning_rate, 1, cfg.min_samples_split, 0.0, False)


def base_learner(name: str, kind: str, cfg: ModelConfig, n_rows: int, features: str, label: str, tag: str):
    """Spark ML classifier / regressor (E1): random_forest, or else logistic / ridge.

    The linear bases have the usual defaults C = 1 and alpha = 1, as
    regParam = 1/n for the n rows of this fit, on unstandardised features.
    Forest splits need >= min_samples_split rows per node; Spark's limit is
    per child, hence half; forest regressors try all features at a split.
    """
    common = dict(featuresCol=features, labelCol=label, predictionCol=f"{tag}_pred")
    if name == "random_forest":
        min_child = max(1, cfg.min_samples_split // 2)
        if kind == "classifier":
            est = RandomForestClassifier(numTrees=cfg.n_estimators, maxDepth=cfg.max_depth,
                                         minInstancesPerNode=min_child, seed=cfg.seed, **common)
            return est.setProbabilityCol(f"{tag}_prob").setRawPredictionCol(f"{tag}_raw")
        return RandomForestRegressor(numTrees=cfg.n_estimators, maxDepth=cfg.max_depth,
                                     minInstancesPerNode=min_child, featureSubsetStrategy="all", seed=cfg.seed, **common)
    reg = 1.0 / max(1, n_rows)
    if kind == "classifier":
        est = LogisticRegression(regParam=reg, elasticNetParam=0.0, standardization=False, maxIter=LOGISTIC_ITERATIONS,
                                 tol=LOGISTIC_TOLERANCE, **common)
        return est.setProbabilityCol(f"{tag}_prob").setRawPredictionCol(f"{tag}_raw")
    return LinearRegression(regParam=reg, elasticNetParam=0.0, standardization=False, solver="normal", **common)


def _score(model, df: DataFrame, tag: str, kind: str, out: str) -> DataFrame:
    """Apply a fitted Spark ML model; keep one numeric output column."""
    scored = model.transform(df)
    if kind == "classifier" and f"{tag}_prob" in scored.columns:
        value = vector_to_array(F.col(f"{tag}_prob")).getItem(1)
    else:
        value = F.col(f"{tag}_pred")
    drop = [c for c in scored.columns if c.startswith(f"{tag}_")]
    return scored.withColumn(out, value).drop(*drop)


@dataclass
class _Fit:
    model: object
    tag: str
    kind: str

    def score(self, df: DataFrame, out: str) -> DataFrame:
        return _score(self.model, df, self.tag, self.kind, out)


@dataclass
class _Boosted:
    """A boosted fit; it reads the columns themselves, as standardising changes no split."""

    model: BoostedTrees
    kind: str


def raw_inputs(prep: PreprocessorModel, names, treatment: Column | None = None) -> dict:
    """Feature name -> Column over unprepared columns."""
    out = {c: F.col(c) for c in prep.numeric}
    for c in prep.categorical:
        out |= {f"{c}_{v}": F.coalesce((F.col(c) == F.lit(v)).cast("double"), F.lit(0.0)) for v in prep.categories[c]}
    if treatment is not None:
        out[TREATMENT] = treatment
    return {n: out[n] for n in names}


def _apply(df: DataFrame, fits: list, prep: PreprocessorModel) -> DataFrame:
    """``df`` with a prediction column for each (output name, fit, treatment Column or None); boosted fits share a pass."""
    boosted = [(out, f.model, raw_inputs(prep, f.model.features, w)) for out, f, w in fits if isinstance(f, _Boosted)]
    for out, f, _ in fits:
        if isinstance(f, _Fit):
            df = f.score(df, out)
    return score_columns(df, boosted) if boosted else df


def _fit(name: str, kind: str, cfg: ModelConfig, df: DataFrame, features: str, label: str, tag: str,
         n_rows: int) -> _Fit:
    est = base_learner(name, kind, cfg, n_rows, features, label, tag)
    return _Fit(est.fit(df), tag, kind)


class CausalModel:
    """Dispatcher over T-learner, X-learner and DML."""

    def __init__(self, config: ModelConfig = ModelConfig(), features: FeatureConfig = FeatureConfig(),
                 extra_confounders=(), fallback: str | None = None):
        if config.model_type not in MODEL_TYPES:
            raise ValueError(f"{config.model_type!r} is none of {MODEL_TYPES}")
        self.config = config
        self.features = features
        self.extra_confounders = tuple(extra_confounders)
        self.fallback = fallback

    def fit(self, df: DataFrame, prep: PreprocessorModel | None = None) -> "FittedCausalModel":
        prep = prep or Preprocessor(self.features, extra_numeric=self.extra_confounders).fit(df)
        prep.warnings = imbalance_warnings(df, self.features)
        try:
            if self.config.base_learner in BOOSTED:
                fitted = fit_jointly(df, self.config, self.features, [Variant("model", prep=prep)])["model"]
            else:
                fitted = _FITTERS[self.config.model_type](self, df, prep)
            fitted.trained_at = datetime.now(timezone.utc).isoformat(timespec="seconds")
            return fitted
        except Exception:
            # No silent fallback; only when asked for explicitly
            if self.fallback == "t_learner" and self.config.model_type != "t_learner":
                cfg = ModelConfig(**{**self.config.__dict__, "model_type": "t_learner"})
                return CausalModel(cfg, self.features, self.extra_confounders).fit(df, prep)
            raise


class FittedCausalModel:
    """Adds baseline_probability, treatment_probability and ite."""

    model_type = ""
    trained_at = None

    def __init__(self, prep: PreprocessorModel, cfg: ModelConfig, features: FeatureConfig):
        self.prep = prep
        self.cfg = cfg
        self.features = features

    def _features(self, df: DataFrame) -> DataFrame:
        if self.cfg.base_learner in BOOSTED:
            return df
        x = self.prep.transform(df)
        return assemble(x, self.prep.feature_names, "x_all")

    def transform(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def metadata(self) -> dict:
        return {"model_type": self.model_type, "base_learner": self.cfg.base_learner, "seed": self.cfg.seed,
                "n_estimators": self.cfg.n_estimators, "max_depth": self.cfg.max_depth,
                "learning_rate": self.cfg.learning_rate, "trained_at": self.trained_at,
                "features": self.prep.feature_names,
                "warnings": self.prep.warnings}


def _keep(df: DataFrame, original: list, extra: list) -> DataFrame:
    return df.select(*[F.col(c) for c in original], *[F.col(c) for c in extra])


# ---------------------------------------------------------------------------
# T-learner
# ---------------------------------------------------------------------------
class FittedTLearner(FittedCausalModel):
    model_type = "t_learner"

    def __init__(self, prep, cfg, features, mu0: _Fit, mu1: _Fit):
        super().__init__(prep, cfg, features)
        self.mu0, self.mu1 = mu0, mu1

    def potential_outcomes(self, x: DataFrame) -> DataFrame:
        return _apply(x, [("baseline_probability", self.mu0, None), ("treatment_probability", self.mu1, None)], self.prep)

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.potential_outcomes(self._features(df))
        out = out.withColumn("ite", F.col("treatment_probability") - F.col("baseline_probability"))
        return _keep(out, df.columns, ["baseline_probability", "treatment_probability", "ite"])


def _prepare(model: CausalModel, df: DataFrame, prep: PreprocessorModel):
    f = model.features
    x = assemble(prep.transform(df), prep.feature_names, "x_all") \
        .withColumn("_w", F.col(f.treatment).cast("int")).withColumn("_y", F.col(f.outcome).cast("double"))
    # every step of every fit reads this narrow table, not the sources
    return write_stage_table(x.select(f.key, "x_all", "_w", "_y"), "features")


def _fit_t(model: CausalModel, df: DataFrame, prep: PreprocessorModel, prepared: DataFrame | None = None) -> FittedTLearner:
    cfg = model.config
    x = prepared if prepared is not None else _prepare(model, df, prep)
    counts = x.groupBy("_w").count().collect()
    n = {r["_w"]: r["count"] for r in counts}
    mu0, mu1 = run_concurrently([
        lambda: _fit(cfg.base_learner, "classifier", cfg, x.where("_w = 0"), "x_all", "_y", "mu0", n.get(0, 1)),
        lambda: _fit(cfg.base_learner, "classifier", cfg, x.where("_w = 1"), "x_all", "_y", "mu1", n.get(1, 1)),
    ])
    return FittedTLearner(prep, cfg, model.features, mu0, mu1)


# ---------------------------------------------------------------------------
# X-learner
# ---------------------------------------------------------------------------
class FittedXLearner(FittedTLearner):
    model_type = "x_learner"

    def __init__(self, prep, cfg, features, mu0, mu1, tau0: _Fit, tau1: _Fit, prop: _Fit):
        super().__init__(prep, cfg, features, mu0, mu1)
        self.tau0, self.tau1, self.prop = tau0, tau1, prop

    def transform(self, df: DataFrame) -> DataFrame:
        x = _apply(self._features(df), [
            ("baseline_probability", self.mu0, None), ("treatment_probability", self.mu1, None),
            ("_tau0", self.tau0, None), ("_tau1", self.tau1, None), ("_e", self.prop, None)], self.prep)
        x = x.withColumn("ite", F.col("_e") * F.col("_tau0") + (F.lit(1.0) - F.col("_e")) * F.col("_tau1"))
        return _keep(x, df.columns, ["baseline_probability", "treatment_probability", "ite"])


def _fit_x(model: CausalModel, df: DataFrame, prep: PreprocessorModel) -> FittedXLearner:
    cfg = model.config
    prepared = _prepare(model, df, prep)
    t = _fit_t(model, df, prep, prepared)
    x = t.potential_outcomes(prepared)
    # imputed effects: D1 = y - mu0 (treated), D0 = mu1 - y (control)
    x = x.withColumn("_d", F.when(F.col("_w") == 1, F.col("_y") - F.col("baseline_probability"))
                     .otherwise(F.col("treatment_probability") - F.col("_y")))
    x = write_stage_table(x, "imputed")  # three more fits read it
    n = {r["_w"]: r["count"] for r in x.groupBy("_w").count().collect()}
    n_all = sum(n.values())
    tau0, tau1, prop = run_concurrently([
        lambda: _fit(cfg.base_learner, "regressor", cfg, x.where("_w = 0"), "x_all", "_d", "tau0", n.get(0, 1)),
        lambda: _fit(cfg.base_learner, "regressor", cfg, x.where("_w = 1"), "x_all", "_d", "tau1", n.get(1, 1)),
        lambda: _fit(cfg.base_learner, "classifier", cfg, x.withColumn("_wd", F.col("_w").cast("double")),
                     "x_all", "_wd", "prop", n_all),
    ])
    return FittedXLearner(prep, cfg, model.features, t.mu0, t.mu1, tau0, tau1, prop)


# ---------------------------------------------------------------------------
# Double machine learning
# ---------------------------------------------------------------------------
class FittedDML(FittedCausalModel):
    model_type = "dml"

    def __init__(self, prep, cfg, features, het_names, theta: np.ndarray, outcome: _Fit, nuisance_names):
        super().__init__(prep, cfg, features)
        self.het_names = het_names
        self.theta = theta
        self.outcome = outcome
        self.nuisance_names = nuisance_names

    def effect(self) -> Column:
        """theta . [1, x_het] as a column expression."""
        expr = F.lit(float(self.theta[0]))
        for coef, name in zip(self.theta[1:], self.het_names):
            expr = expr + F.lit(float(coef)) * F.col(f"f_{name}")
        return expr

    def transform(self, df: DataFrame) -> DataFrame:
        x = self.prep.transform(df)
        x = x.withColumn("ite", self.effect())
        # potential outcomes from the auxiliary classifier with W forced to 0 / 1 (E5)
        if isinstance(self.outcome, _Boosted):
            x = _apply(x, [("baseline_probability", self.outcome, F.lit(0.0)),
                           ("treatment_probability", self.outcome, F.lit(1.0))], self.prep)
            return _keep(x, df.columns, ["baseline_probability", "treatment_probability", "ite"])
        names = self.prep.feature_names
        x0 = x.withColumn("f___treatment__", F.lit(0.0))
        x0 = assemble(x0, names + ["__treatment__"], "x_wt")
        x0 = self.outcome.score(x0, "baseline_probability").drop("x_wt")
        x1 = x0.withColumn("f___treatment__", F.lit(1.0))
        x1 = assemble(x1, names + ["__treatment__"], "x_wt")
        x1 = self.outcome.score(x1, "treatment_probability")
        return _keep(x1, df.columns, ["baseline_probability", "treatment_probability", "ite"])


def _fold(key: str, seed: int, k: int) -> Column:
    return F.floor(hash_uniform(key, seed, "fold") * k).cast("int")


def stratified_folds(df: DataFrame, key: str, treatment: str, seed: int, k: int, out: str = "_fold") -> DataFrame:
    """Exactly stratified folds: rank rows within each arm by a key hash, fold = rank mod k.

    One distributed ranked pass over the composite order (arm, hash); each
    fold then holds floor or ceil of n_arm / k rows of every arm.
    """
    from .ordered import global_rank

    w = F.col(treatment).cast("int")
    keyed = df.withColumn("_sk", w.cast("double") + hash_uniform(key, seed, "fold"))
    ranked = global_rank(keyed, "_sk", key, desc=False, rank="_r")
    n0 = df.agg(F.count(F.when(F.col(treatment) == 0, 1)).alias("n0")).select("n0").scalar()
    within = F.col("_r") - F.when(w == 1, n0).otherwise(F.lit(0)) - 1
    return ranked.withColumn(out, F.pmod(within, F.lit(k)).cast("int")).drop("_sk", "_r")


def gram_solve(df: DataFrame, z_cols: list, y_col: str) -> np.ndarray:
    """Least squares of y on z (no intercept) from one aggregate of Z'Z and Z'y.

    ``lstsq`` returns the minimum-norm solution when Z'Z is singular (full
    one-hot plus an intercept), where fitted values are still unique.
    """
    p = len(z_cols)
    aggs = []
    for i in range(p):
        for j in range(i, p):
            aggs.append(F.sum(F.col(z_cols[i]) * F.col(z_cols[j])).alias(f"g_{i}_{j}"))
        aggs.append(F.sum(F.col(z_cols[i]) * F.col(y_col)).alias(f"b_{i}"))
    row = df.agg(*aggs).collect()[0]
    g = np.zeros((p, p))
    b = np.zeros(p)
    for i in range(p):
        for j in range(i, p):
            g[i, j] = g[j, i] = float(row[f"g_{i}_{j}"] or 0.0)
        b[i] = float(row[f"b_{i}"] or 0.0)
    theta, *_ = np.linalg.lstsq(g, b, rcond=None)
    return theta


def _nuisance_names(prep: PreprocessorModel) -> list:
    """Heterogeneity features and every confounder: all features except the two pure covariates (extras such as noise included)."""
    conf = [n for n in prep.feature_names if n not in ("age", "tenure_months")]
    return list(dict.fromkeys(heterogeneity_columns(prep) + conf))


def _fit_dml(model: CausalModel, df: DataFrame, prep: PreprocessorModel) -> FittedDML:
    cfg, f = model.config, model.features
    het = heterogeneity_columns(prep)
    nuisance = _nuisance_names(prep)
    x = prep.transform(df).withColumn("_w", F.col(f.treatment).cast("int")) \
        .withColumn("_wd", F.col(f.treatment).cast("double")).withColumn("_y", F.col(f.outcome).cast("double"))
    if cfg.stratified_folds:
        x = stratified_folds(x, f.key, f.treatment, cfg.seed, cfg.folds)
    else:
        x = x.withColumn("_fold", _fold(f.key, cfg.seed, cfg.folds))
    # the auxiliary outcome classifier for the two probabilities sees (X, W)
    x = assemble(x.withColumn("f___treatment__", F.col("_wd")), prep.feature_names + ["__treatment__"], "x_wt")
    x = write_stage_table(assemble(x, nuisance, "x_nuis").select(
        f.key, "_fold", "_w", "_wd", "_y", "x_wt", "x_nuis", *[f"f_{n}" for n in het]), "nuisance")
    in_fold = {r["_fold"]: r["count"] for r in x.groupBy("_fold").count().collect()}
    n_rows = sum(in_fold.values())
    tasks = [lambda: _fit(cfg.base_learner, "classifier", cfg, x, "x_wt", "_y", "po", n_rows)]
    for k in range(cfg.folds):
        train, n = x.where(F.col("_fold") != k), n_rows - in_fold.get(k, 0)
        tasks.append(lambda t=train, n=n: _fit(cfg.base_learner, "regressor", cfg, t, "x_nuis", "_y", "my", n))
        tasks.append(lambda t=train, n=n: _fit(cfg.base_learner, "classifier", cfg, t, "x_nuis", "_wd", "mt", n))
    # 2K cross-fitted nuisance fits and the outcome model are independent
    fits = run_concurrently(tasks, max_workers=len(tasks))
    outcome, nuis = fits[0], fits[1:]
    held_out = []
    for k in range(cfg.folds):
        my, mt = nuis[2 * k], nuis[2 * k + 1]
        test = x.where(F.col("_fold") == k)
        held_out.append(mt.score(my.score(test, "_yhat"), "_that"))
    res = held_out[0]
    for h in held_out[1:]:
        res = res.unionByName(h)
    res = res.withColumn("_yres", F.col("_y") - F.col("_yhat")).withColumn("_tres", F.col("_wd") - F.col("_that"))
    z = [F.col("_tres").alias("_z0")] + [(F.col("_tres") * F.col(f"f_{n}")).alias(f"_z{i + 1}")
                                         for i, n in enumerate(het)]
    theta = gram_solve(res.select(*z, "_yres"), [f"_z{i}" for i in range(len(het) + 1)], "_yres")
    return FittedDML(prep, cfg, f, het, theta, outcome, nuisance)


_FITTERS = {"t_learner": _fit_t, "x_learner": _fit_x, "dml": _fit_dml}


# ---------------------------------------------------------------------------
# boosted bases: all fits of all variants together
# ---------------------------------------------------------------------------
@dataclass
class Variant:
    """A model on the same rows with something changed: another treatment column, more confounders, or fewer rows."""

    name: str
    treatment: str | None = None
    extra: tuple = ()
    rows: Column | None = None
    prep: PreprocessorModel | None = None


def _prepared(v: Variant, df: DataFrame, features: FeatureConfig) -> PreprocessorModel:
    return v.prep or Preprocessor(features, extra_numeric=v.extra).fit(df if v.rows is None else df.where(v.rows))


def _residual_coefficients(x: DataFrame, scored: DataFrame, key: str, v: str, het: list, prep: PreprocessorModel, folds: int) -> np.ndarray:
    """The final stage (E4): residual on residual times the heterogeneity features, from held-out nuisances."""
    fold, rows = F.col(f"_fold_{v}"), scored.where(F.col(f"_in_{v}"))
    held_out = lambda what: F.coalesce(*[F.when(fold == k, F.col(f"_{what}_{v}_{k}")) for k in range(folds)])
    rows = prep.transform(rows.withColumn("_yres", F.col("_y") - held_out("my")).withColumn("_tres", F.col(f"_w_{v}") - held_out("mt")))
    z = [F.col("_tres").alias("_z0")] + [(F.col("_tres") * F.col(f"f_{n}")).alias(f"_z{i + 1}") for i, n in enumerate(het)]
    return gram_solve(rows.select(*z, "_yres"), [f"_z{i}" for i in range(len(het) + 1)], "_yres")


def fit_jointly(df: DataFrame, cfg: ModelConfig, features: FeatureConfig, variants: list[Variant]) -> dict:
    """Variant name -> fitted model; the boosted fits of all variants grow in the same jobs.

    ``df`` is read once for each variant's preparation and once to write the
    narrow table that everything else reads.
    """
    preps = dict(zip([v.name for v in variants], run_concurrently([lambda v=v: _prepared(v, df, features) for v in variants])))
    columns = dict.fromkeys(c for p in preps.values() for c in [*p.numeric, *p.categorical])
    x = df.withColumns({"_y": F.col(features.outcome).cast("double")} | {
        f"_w_{v.name}": F.col(v.treatment or features.treatment).cast("double") for v in variants} | {
        f"_in_{v.name}": F.lit(True) if v.rows is None else F.coalesce(v.rows, F.lit(False)) for v in variants})
    for v in variants if cfg.model_type == "dml" else ():
        if cfg.stratified_folds:
            x = stratified_folds(x, features.key, f"_w_{v.name}", cfg.seed, cfg.folds, f"_fold_{v.name}")
        else:
            x = x.withColumn(f"_fold_{v.name}", _fold(features.key, cfg.seed, cfg.folds))
    made = [c for c in x.columns if c == "_y" or c.startswith(("_w_", "_in_", "_fold_")) and c not in df.columns]
    x = write_stage_table(x.select(features.key, *columns, *made), "features")
    inputs, specs = {}, []
    for v in variants:
        prep, w, seen = preps[v.name], F.col(f"_w_{v.name}"), F.col(f"_in_{v.name}")
        own = f"{TREATMENT}{v.name}"
        inputs |= raw_inputs(prep, prep.feature_names) | {own: w}
        names = tuple(prep.feature_names)
        spec = lambda what, kind, label, rows, names=names, v=v: specs.append(FitSpec(f"{what}_{v.name}", kind, names, label, rows))
        if cfg.model_type == "dml":
            spec("outcome", "classifier", F.col("_y"), seen, names + (own,))
            for k in range(cfg.folds):
                rows = seen & (F.col(f"_fold_{v.name}") != k)
                spec(f"my{k}", "regressor", F.col("_y"), rows, tuple(_nuisance_names(prep)))
                spec(f"mt{k}", "classifier", w, rows, tuple(_nuisance_names(prep)))
        else:
            for arm in (0, 1):
                spec(f"mu{arm}", "classifier", F.col("_y"), seen & (w == arm))
            if cfg.model_type == "x_learner":
                spec("prop", "classifier", w, seen)
    growth = growth_of(cfg)
    models = {n: _Boosted(m, m.kind) for n, m in fit_all(x, inputs, specs, growth).items()}
    for m in models.values():
        m.model.features = [TREATMENT if f.startswith(TREATMENT) else f for f in m.model.features]
    if cfg.model_type == "t_learner":
        return {v.name: FittedTLearner(preps[v.name], cfg, features, models[f"mu0_{v.name}"], models[f"mu1_{v.name}"]) for v in variants}
    if cfg.model_type == "x_learner":
        return _finish_x(x, cfg, features, variants, preps, models, inputs, growth)
    # a row needs the nuisances of its own fold, and of variants that see it
    scored = score_columns(x, [(f"_{what}_{v.name}_{k}", models[f"{what}{k}_{v.name}"].model, raw_inputs(preps[v.name], _nuisance_names(preps[v.name])),
                                F.col(f"_in_{v.name}") & (F.col(f"_fold_{v.name}") == k))
                               for v in variants for k in range(cfg.folds) for what in ("my", "mt")])
    scored = write_stage_table(scored, "nuisances")
    het = {v.name: heterogeneity_columns(preps[v.name]) for v in variants}
    thetas = run_concurrently([lambda v=v: _residual_coefficients(x, scored, features.key, v.name, het[v.name], preps[v.name], cfg.folds)
                               for v in variants])
    return {v.name: FittedDML(preps[v.name], cfg, features, het[v.name], theta, models[f"outcome_{v.name}"], _nuisance_names(preps[v.name]))
            for v, theta in zip(variants, thetas)}


def _finish_x(x: DataFrame, cfg, features, variants, preps, models, inputs, growth) -> dict:
    """The X-learner's second step: effects imputed by the other arm's outcome model, fitted in each arm."""
    for v in variants:
        cols = raw_inputs(preps[v.name], preps[v.name].feature_names)
        x = score_columns(x, [(f"_mu{arm}_{v.name}", models[f"mu{arm}_{v.name}"].model, cols) for arm in (0, 1)])
    x = write_stage_table(x, "imputed")
    specs = []
    for v in variants:
        w, y = F.col(f"_w_{v.name}"), F.col("_y")
        for arm, effect in ((0, F.col(f"_mu1_{v.name}") - y), (1, y - F.col(f"_mu0_{v.name}"))):
            specs.append(FitSpec(f"tau{arm}_{v.name}", "regressor", tuple(preps[v.name].feature_names), effect,
                                 F.col(f"_in_{v.name}") & (w == arm)))
    models |= {n: _Boosted(m, m.kind) for n, m in fit_all(x, inputs, specs, growth).items()}
    part = lambda v, *names: [models[f"{n}_{v.name}"] for n in names]
    return {v.name: FittedXLearner(preps[v.name], cfg, features, *part(v, "mu0", "mu1", "tau0", "tau1", "prop")) for v in variants}


def propensity(df: DataFrame, cfg: ModelConfig = ModelConfig(), features: FeatureConfig = FeatureConfig()) -> DataFrame:
    """P(W = 1 | x) as column ``propensity``."""
    prep = Preprocessor(features).fit(df)
    names = prep.feature_names
    if cfg.base_learner in BOOSTED:
        w = F.col(features.treatment).cast("double")
        x = write_stage_table(df.select(*dict.fromkeys([*prep.numeric, *prep.categorical, features.treatment])), "propensity")
        model = fit_all(x, raw_inputs(prep, names), [FitSpec("ps", "classifier", tuple(names), w)], growth_of(cfg))["ps"]
        return score_columns(df, [("propensity", model, raw_inputs(prep, names))])
    x = assemble(prep.transform(df), names, "x_all").withColumn("_wd", F.col(features.treatment).cast("double"))
    narrow = write_stage_table(x.select("x_all", "_wd"), "propensity")
    m = _fit(cfg.base_learner, "classifier", cfg, narrow, "x_all", "_wd", "ps", narrow.count())
    return _keep(m.score(x, "propensity"), df.columns, ["propensity"])
