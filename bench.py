"""Benchmark at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Headline ("pipeline"): the reference's whole run with the configured effect
model (cross-fitted DML on leaf-wise boosted trees, 100 of depth 4): derive and load the
customer table, fit, predict, diagnostics (causal summary with Qini
coefficient), three refutations (each a refit), uplift outputs, every output
written. Before it the same run on the linear base, twice: the session's first
run ("pipeline_linear_cold") and a warm one ("pipeline_linear"). Then each
serving/summary operator is timed on the scored table.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from cauldron.operators import allocate as al  # noqa: E402
from cauldron.operators import joins as jn  # noqa: E402
from cauldron.operators import metrics as mt  # noqa: E402
from cauldron.operators import quality as qa  # noqa: E402
from cauldron.operators import summaries as sm  # noqa: E402
from cauldron.plans.pipeline import run_pipeline  # noqa: E402
from cauldron.schema import ModelConfig  # noqa: E402
from cauldron.session import build_session, scratch_dir, write_stage_table  # noqa: E402
from cauldron.sources import derived  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=max(2, cpus), app_name="cauldron-bench",
                          extra={"spark.scheduler.mode": os.environ.get("BENCH_SCHEDULER", "FAIR")})
    times: dict[str, float] = {}

    def timed(name, fn):
        t0 = time.perf_counter()
        out = fn()
        times[name] = round(time.perf_counter() - t0, 3)
        return out

    # ---- headline: the whole pipeline --------------------------------------
    def pipeline(base: str):
        return run_pipeline(derived.customers(spark, sf_dir), ModelConfig(base_learner=base), refute=True,
                            out_dir=scratch_dir(spark, "bench-outputs"))

    timed("pipeline_linear_cold", lambda: pipeline("linear"))
    timed("pipeline_linear", lambda: pipeline("linear"))
    res = timed("pipeline", lambda: pipeline("lightgbm"))
    pipeline_sec = times["pipeline"]
    n_customers = res.scored.count()
    customers = res.scored.select(*[c for c in res.scored.columns
                                    if c not in ("baseline_probability", "treatment_probability", "ite")])

    # ---- operators on the checkpointed scored table -------------------------
    scored = write_stage_table(derived.scored(spark, sf_dir), "bench-scored")
    campaigns = derived.campaigns(spark, sf_dir)
    predictions = derived.predictions(spark, sf_dir, scored)
    timed("validate_customers", lambda: qa.validate_customers(customers).collect())
    timed("summaries", lambda: [sm.customer_summary(customers).collect(), sm.revenue_summary(customers).collect(),
                                sm.campaign_summary(customers, campaigns).collect(),
                                sm.treatment_summary(customers).collect()])
    timed("dataset_summary", lambda: sm.dataset_summary(customers).collect())
    timed("allocate_greedy", lambda: al.allocate_greedy(scored, 100000.0).where("selected = 1").count())
    timed("allocate_lp", lambda: al.allocate_lp(scored, 100000.0).where("selected = 1").count())
    timed("budget_scenarios", lambda: al.budget_scenarios(scored).collect())
    timed("recommendations", lambda: al.recommendations(scored, 100000.0, limit=100).collect())
    timed("qini_curve", lambda: mt.qini_curve(scored).agg(F.sum("qini")).collect())
    timed("causal_summary", lambda: mt.causal_summary(scored).collect())
    timed("export_dashboard", lambda: jn.export_dashboard(
        customers, predictions, jn.recommendations_table(scored, {1: (50000.0, "2000-04-01 00:00:00"),
                                                                  2: (100000.0, "2000-04-02 00:00:00")})).count())
    print(json.dumps({
        "metric": "pipeline_wall_time", "value": pipeline_sec, "unit": "sec", "queries": times,
        "customers": n_customers, "customers_per_sec": round(n_customers / pipeline_sec, 1),
        "operators_total_sec": round(sum(v for k, v in times.items() if not k.startswith("pipeline")), 3),
        "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""), "cpus": cpus,
        "warmup": "two runs on the linear base, timed: pipeline_linear_cold and pipeline_linear",
    }))
    spark.stop()


if __name__ == "__main__":
    main()
