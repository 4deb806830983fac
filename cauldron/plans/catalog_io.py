"""Catalog: sources, sinks and streaming (round trips through written tables).

Each query writes data derived from the given tables into a fresh folder
under the shared checkpoint root and reads it back through the operator, so
the oracle compares the final state.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.learners import CausalModel
from ..operators.allocate import uplift_segments
from ..schema import CUSTOMER_SCHEMA, MODEL_INPUT_COLUMNS
from ..session import scratch_dir
from ..sources import derived
from ..sources import io as sio
from ..sources import snapshots
from ..streaming import stream as st
from .catalog_views import _SEG025
from .registry import FLAGSHIP_BUDGET, SMALL_BUDGET, W, register, rounded, stable_customers, stable_scored

_COLS = [f.name for f in CUSTOMER_SCHEMA.fields]


@register("scan_customers_csv", W("customers") + "SELECT * FROM customers")
def q_scan_customers_csv(spark, d):
    path = scratch_dir(spark, "customers-csv")
    sio.export_customers(derived.customers(spark, d), path, "csv")
    return sio.scan_customers_csv(spark, path)


@register("faulty_rows", W("customers") + """
SELECT customer_id, CASE WHEN customer_id % 97 = 0 THEN 'age' ELSE 'customer_segment' END AS "column" FROM customers
WHERE customer_id % 97 = 0 OR customer_id % 89 = 0""")
def q_faulty_rows(spark, d):
    """Every row of a load that has a cell missing, found by file and line (V3)."""
    path = scratch_dir(spark, "faulty-csv")
    gaps = {"age": F.col("customer_id") % 97 == 0, "customer_segment": (F.col("customer_id") % 89 == 0) & (F.col("customer_id") % 97 != 0)}
    c = derived.customers(spark, d)
    sio.export_customers(c.select(*[F.when(~gaps[n], F.col(n)).alias(n) if n in gaps else F.col(n) for n in c.columns]), path, "csv")
    return sio.faulty_rows(spark, path).where("line > 1 AND size(columns) = 1").select(
        F.col("customer_id").cast("bigint").alias("customer_id"), F.col("columns")[0].alias("column"))


@register("scan_customers_json", W("customers") + "SELECT * FROM customers")
def q_scan_customers_json(spark, d):
    path = scratch_dir(spark, "customers-json")
    sio.export_customers(derived.customers(spark, d), path, "json")
    return sio.scan_customers_json(spark, path, multiline=False)


@register("export_customers", W("customers") + "SELECT * FROM customers")
def q_export_customers(spark, d):
    path = scratch_dir(spark, "customers-parquet")
    sio.write_table(derived.customers(spark, d).orderBy("customer_id"), path)
    return sio.scan_customers_table(spark, path)


@register("export_model_input", W("customers") + f"SELECT {', '.join(MODEL_INPUT_COLUMNS)} FROM customers")
def q_export_model_input(spark, d):
    return sio.export_model_input(derived.customers(spark, d))


@register("scan_predictions", W("predictions") + """
SELECT customer_id, baseline_probability, treatment_probability, ite FROM predictions""")
def q_scan_predictions(spark, d):
    path = scratch_dir(spark, "predictions")
    # the columns in another order: they are found by name
    p = derived.predictions(spark, d).select("ite", "customer_id", "treatment_probability", "baseline_probability")
    p.write.option("header", True).csv(path)
    return sio.scan_predictions(spark, path, "csv")


@register("scan_customers_document", W("customers") + "SELECT * FROM customers")
def q_scan_customers_document(spark, d):
    """The wrapped JSON form: documents with a ``customers`` array, each of a few thousand customers."""
    path = scratch_dir(spark, "customers-document")
    sio.write_customer_documents(stable_customers(spark, d), path)
    return sio.scan_customers_json(spark, path)


_UPSERT_SQL = W("customers") + "SELECT " + ", ".join(
    "CASE WHEN campaign_id = 1 THEN NULL ELSE campaign_id END AS campaign_id" if c == "campaign_id" else
    "CASE WHEN campaign_id = 1 THEN purchase_value + CAST(1 AS DOUBLE) ELSE purchase_value END AS purchase_value"
    if c == "purchase_value" else c for c in _COLS) + " FROM customers"


def _incoming(c):
    """Campaign-1 customers arrive again without campaign and with a new purchase value."""
    return c.where(F.col("campaign_id") == 1).withColumn("campaign_id", F.lit(None).cast("int")) \
            .withColumn("purchase_value", F.col("purchase_value") + F.lit(1.0))


@register("upsert_customers", _UPSERT_SQL)
def q_upsert_customers(spark, d):
    c = derived.customers(spark, d)
    return sio.upsert(c, _incoming(c)).select(*_COLS)


@register("upsert_stored", _UPSERT_SQL)
def q_upsert_stored(spark, d):
    """The upsert on a stored table in hash buckets: the batch's buckets only are written anew."""
    root = scratch_dir(spark, "bucketed")
    c = stable_customers(spark, d)
    for batch in (c, _incoming(c)):
        snapshots.upsert_table(batch, root, buckets=32)
    return snapshots.read_upserted(spark, root).select(*_COLS)


@register("stream_upsert_customers", _UPSERT_SQL)
def q_stream_upsert_customers(spark, d):
    c = derived.customers(spark, d)
    table, quarantine, ckpt, inbox, compacted = (
        scratch_dir(spark, f"stream-{n}") for n in ("table", "quarantine", "ckpt", "inbox", "compacted"))
    # the full load arrives first, with a row that lacks cells beside each good one; then the changed rows
    broken = c.select(*[F.lit(None).cast(t).alias(n) if n == "age" else F.col(n) for n, t in c.dtypes])
    for arriving in (c.unionByName(broken), _incoming(c)):
        arriving.write.mode("append").parquet(inbox)
        st.stream_upsert_customers(spark, inbox, table, quarantine, ckpt).awaitTermination()
    st.compact(spark, table, compacted)
    return st.read_current(spark, compacted).select(*_COLS)


@register("stream_score", W("scored") + """
SELECT customer_id, baseline_probability, ite, CASE WHEN ite >= CAST(0.05 AS DOUBLE) THEN 'persuadable'
  WHEN ite <= -CAST(0.05 AS DOUBLE) THEN 'sleeping dog'
  WHEN baseline_probability >= CAST(0.25 AS DOUBLE) THEN 'sure thing' ELSE 'lost cause' END AS uplift_segment FROM scored""")
def q_stream_score(spark, d):
    base = derived.customer_base(spark, d)
    src, out, ckpt = (scratch_dir(spark, n) for n in ("score-src", "score-out", "score-ckpt"))
    base.repartition(3).write.mode("overwrite").parquet(src)
    st.run_score_stream(spark, src, out, ckpt, derived.score_surrogate, schema=base.schema)
    return spark.read.parquet(out).select("customer_id", "baseline_probability", "ite", "uplift_segment")


@register("stream_score_model", None)
def q_stream_score_model(spark, d):
    """A fitted model (the configured one) scores the files of a stream."""
    c = stable_customers(spark, d)
    fitted = CausalModel().fit(c)
    src, out, ckpt = (scratch_dir(spark, f"model-{n}") for n in ("src", "out", "ckpt"))
    c.repartition(3).write.mode("overwrite").parquet(src)
    st.run_score_stream(spark, src, out, ckpt, fitted.transform, schema=c.schema, max_files_per_trigger=1)
    return spark.read.parquet(out).select("customer_id", F.round("ite", 6).alias("ite"), "uplift_segment")


@register("import_run", W("predictions", extra=f""",
base AS (SELECT p.model_run_id, p.customer_id, p.ite*s.net_revenue AS expected_profit, s.discount_cost AS expected_cost
  FROM predictions p JOIN scored s ON s.customer_id = p.customer_id),
cand AS (SELECT *, SUM(CAST(ROUND(expected_cost*100) AS BIGINT)) OVER (PARTITION BY model_run_id
    ORDER BY ROUND(expected_profit/expected_cost, 9) DESC, customer_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
  FROM base WHERE expected_profit > 0 AND expected_cost > 0)""") + f"""
SELECT p.model_run_id, p.customer_id, p.baseline_probability, p.treatment_probability, p.ite, c.expected_profit, c.expected_cost,
  CASE WHEN p.model_run_id = 1 THEN 'first' ELSE 'second' END AS name
FROM predictions p LEFT JOIN cand c ON c.customer_id = p.customer_id AND c.model_run_id = p.model_run_id
  AND ((c.model_run_id = 1 AND c.cum <= {round(SMALL_BUDGET * 100)}) OR (c.model_run_id = 2 AND c.cum <= {round(FLAGSHIP_BUDGET * 100)}))""")
def q_import_run(spark, d):
    """Two runs imported, the second twice more: refused, then replaced by name; everything stored is read back."""
    root = scratch_dir(spark, "runs")
    s = stable_scored(spark, d)
    p = derived.predictions(spark, d, s)
    money = s.select("customer_id", "discount_cost", "net_revenue")

    def run(i, name, budget, replace=False):
        rows = p.where(F.col("model_run_id") == i).select(
            "customer_id", "baseline_probability", "treatment_probability", "ite")
        sio.import_run(rows, money, root, i, name, budget, replace)

    run(1, "first", SMALL_BUDGET)
    run(2, "second", SMALL_BUDGET)
    try:
        run(2, "second", FLAGSHIP_BUDGET)
    except ValueError:
        run(2, "second", FLAGSHIP_BUDGET, replace=True)
    else:
        raise AssertionError("a stored run was imported again")
    chosen = sio.read_run_table(spark, root, "recommendations").drop("ite")
    names = sio.read_runs(spark, root).select("model_run_id", "name")
    return sio.read_run_table(spark, root, "predictions").join(chosen, ["model_run_id", "customer_id"], "left") \
        .join(names, "model_run_id")


@register("dataset_manifest_counts", W("customers", "predictions", "campaigns") + """
SELECT 'customers' AS "table", CAST(COUNT(*) AS BIGINT) AS rows FROM customers
UNION ALL SELECT 'predictions', CAST(COUNT(*) AS BIGINT) FROM predictions
UNION ALL SELECT 'campaigns', CAST(COUNT(*) AS BIGINT) FROM campaigns""")
def q_dataset_manifest_counts(spark, d):
    s = derived.scored(spark, d)
    m = sio.dataset_manifest({"customers": derived.customers(spark, d), "predictions": derived.predictions(spark, d, s),
                              "campaigns": derived.campaigns(spark, d)})
    return m.select("table", "rows")


@register("dataset_manifest", None)
def q_dataset_manifest(spark, d):
    s = derived.scored(spark, d)
    return sio.dataset_manifest({"customers": derived.customers(spark, d), "predictions": derived.predictions(spark, d, s)})


@register("write_report", W("scored", extra=f""",
n AS (SELECT {_SEG025} AS uplift_segment, ite FROM scored)""") + """
SELECT uplift_segment, CAST(COUNT(*) AS BIGINT) AS customers, ROUND(AVG(ite), 6) AS average, ROUND(MAX(ite), 6) AS largest
FROM n GROUP BY uplift_segment""")
def q_write_report(spark, d):
    """A nested report, checked at any depth, written and read back."""
    path = scratch_dir(spark, "report")
    seg = uplift_segments(derived.scored(spark, d), baseline_threshold=0.25)
    report = seg.groupBy("uplift_segment").agg(F.struct(
        F.count(F.lit(1)).alias("customers"),
        F.array(F.struct(F.round(F.avg("ite"), 6).alias("average"), F.round(F.max("ite"), 6).alias("largest"))).alias("effect")
    ).alias("body"))
    sio.write_report(report, path, "uplift_segment")
    back = spark.read.schema(report.schema).json(path)
    return back.select("uplift_segment", "body.customers", F.col("body.effect")[0]["average"].alias("average"),
                       F.col("body.effect")[0]["largest"].alias("largest"))
