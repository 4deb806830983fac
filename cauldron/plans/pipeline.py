"""End-to-end run: train -> predict -> diagnostics -> refutation -> uplift outputs.

One driver function over DataFrames.  The customer table and the scored
table are each written once into the shared folder of
``spark.checkpoint.dir``.  The reports do not depend on each other: they are
computed concurrently, each once, and what builds on a report or describes it
reads the stored one.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import allocate as al
from ..operators import metrics as mt
from ..operators import quality as qa
from ..operators import summaries as sm
from ..operators.learners import CausalModel
from ..operators.refute import fit_with_refits, report_rows
from ..schema import SCENARIO_BUDGETS, FeatureConfig, ModelConfig
from ..session import run_concurrently, write_stage_table
from ..sources import io as sio


@dataclass
class PipelineResult:
    predictions: DataFrame
    scored: DataFrame
    reports: dict = field(default_factory=dict)
    metadata: dict = field(default_factory=dict)

    def __getattr__(self, name):
        reports = self.__dict__.get("reports", {})
        if name in reports:
            return reports[name]
        raise AttributeError(name)


def run_pipeline(customers: DataFrame, cfg: ModelConfig = ModelConfig(), features: FeatureConfig = FeatureConfig(),
                 run_id: int = 1, budget: float = 1000000.0, budgets=SCENARIO_BUDGETS,
                 refute: bool = True, baseline_threshold: float = 0.25, out_dir: str | None = None,
                 materialise: bool = False) -> PipelineResult:
    """Fit, predict and build every report.

    With ``out_dir`` the run's reports, predictions, model, record and manifest
    are written there, each in a folder of the run; with ``materialise`` each
    report is a written table.  Repeated customer ids and a stored run are
    refused.
    """
    key = features.key
    spark = customers.sparkSession
    base = write_stage_table(customers, "customers")
    repeated = qa.duplicate_ids(base, key).first()[0]
    if repeated:
        raise ValueError(f"{repeated} customer rows repeat an id")
    root = out_dir.rstrip("/") if out_dir else None
    if root and sio.exists(spark, f"{root}/manifest/model_run_id={run_id}"):
        raise ValueError(f"run {run_id} is stored already")

    def put(name, df):
        """A report written once and read back; what reads it does not compute it again."""
        if root:  # every run has folders of its own; earlier runs stay
            path = f"{root}/{name}/model_run_id={run_id}"
            sio.write_report(df, path)
            return spark.read.schema(df.schema).json(path)
        return write_stage_table(df, name) if materialise else df

    fitted, means = fit_with_refits(base, cfg, features) if refute else (CausalModel(cfg, features).fit(base), None)
    scored = write_stage_table(fitted.transform(base), "scored")
    predictions = scored.select(key, "baseline_probability", "treatment_probability", "ite")
    bad = [r["check"] for r in qa.check_finite(predictions).where(~F.col("passed")).collect()]
    bad += [f"coverage: {r['side']} {r[key]}" for r in qa.check_coverage(base, predictions, key).collect()]
    if bad:
        raise ValueError(f"predictions refused: {bad}")
    builders = {
        "causal_summary": lambda: mt.causal_summary(scored),
        "segment_shares": lambda: sm.uplift_segment_shares(scored, baseline_threshold=baseline_threshold),
        "scenarios": lambda: al.budget_scenarios(scored, budgets),
        "recommendations": lambda: al.recommendation_report(scored, budget, baseline_threshold),
        "recommendation_totals": lambda: al.check_within_budget(
            al.recommendation_totals(scored, budget, baseline_threshold=baseline_threshold)),
    }
    tasks = [lambda n=n, f=f: put(n, f()) for n, f in builders.items()]
    if root:
        tasks.append(lambda: predictions.write.mode("overwrite").parquet(f"{root}/predictions/model_run_id={run_id}"))
        tasks.append(lambda: sio.save_model(fitted, f"{root}/models/model_run_id={run_id}", spark))
    built = run_concurrently(tasks, max_workers=len(tasks))
    reports = dict(zip(builders, built))
    summary = reports["causal_summary"]
    reports["effect_metrics"] = put("effect_metrics", summary.select("mae", "rmse", "correlation", "qini_coefficient", "average_ite"))
    if refute:
        original = summary.select("average_ite").first()[0]
        reports["refutations"] = put("refutations", report_rows(spark, original, means))
    metadata = fitted.metadata()
    if root:
        record = spark.createDataFrame([(json.dumps(metadata), float(budget))], "metadata string, budget double")
        put("run_records", record)
        # last, and from the files as stored: a run that broke off has no manifest and can be run again
        stored = [*reports, "predictions", "models", "run_records"]
        put("manifest", sio.stored_manifest(spark, {n: f"{root}/{n}/model_run_id={run_id}" for n in stored}))
    return PipelineResult(predictions=predictions.withColumn("model_run_id", F.lit(run_id)), scored=scored, reports=reports, metadata=metadata)
