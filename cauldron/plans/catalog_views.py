"""Catalog: metrics, summary views, lookups and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import label
from ..operators import joins as jn
from ..operators import lookup as lk
from ..operators import metrics as mt
from ..operators import ordered as od
from ..operators import summaries as sm
from ..operators.allocate import recommendation_rows
from ..schema import CUSTOMER_SCHEMA
from ..session import scratch_dir
from ..sources import derived, snapshots
from .registry import stable_customers, stable_scored, FLAGSHIP_BUDGET, SMALL_BUDGET, W, register, rounded

# ---------------------------------------------------------------------------
# W / M: ordered kernel and effect metrics
# ---------------------------------------------------------------------------
_ARMS = """,
arms AS (SELECT CAST(SUM(CASE WHEN treatment_received=1 THEN 1 ELSE 0 END) AS BIGINT) AS nt,
                CAST(SUM(CASE WHEN treatment_received=0 THEN 1 ELSE 0 END) AS BIGINT) AS nc, COUNT(*) AS n FROM scored)"""


def _curve_cte(name: str, score: str) -> str:
    w = f"ORDER BY {score} DESC, customer_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    return f""",
{name} AS (SELECT customer_id, {score} AS score, ROW_NUMBER() OVER (ORDER BY {score} DESC, customer_id) AS rank,
  SUM(CASE WHEN treatment_received=1 THEN purchase ELSE 0 END) OVER ({w}) AS cyt,
  SUM(CASE WHEN treatment_received=0 THEN purchase ELSE 0 END) OVER ({w}) AS cyc FROM scored)"""


_QINI = "CASE WHEN a.nt > 0 AND a.nc > 0 THEN c.cyt - c.cyc * (CAST(a.nt AS DOUBLE) / a.nc) ELSE CAST(0 AS DOUBLE) END"


@register("cumulative_sum", W("scored", extra=""",
x AS (SELECT customer_id, ite, CAST(SUM(CAST(ROUND(discount_cost*100) AS BIGINT)) OVER (
  ORDER BY ite DESC, customer_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum_cost_cents,
  ROW_NUMBER() OVER (ORDER BY ite DESC, customer_id) AS rank FROM scored)""") + """
SELECT customer_id, ite, cum_cost_cents, rank FROM x""")
def q_cumulative_sum(spark, d):
    s = stable_scored(spark, d).select("customer_id", "ite", "discount_cost")
    from ..functions.scalar import cents

    r = od.running_totals(s, "ite", "customer_id", {"cum_cost_cents": cents("discount_cost")}, desc=True)
    return r.select("customer_id", "ite", "cum_cost_cents", "rank")


@register("qini_curve", W("scored", extra=_ARMS + _curve_cte("c", "ite")) + f"""
SELECT c.rank, c.customer_id, c.score, ROUND({_QINI}, 6) AS qini FROM c CROSS JOIN arms a""")
def q_qini_curve(spark, d):
    return rounded(mt.qini_curve(stable_scored(spark, d)), 6, cols=["qini"])


@register("random_targeting_curve", W("scored", extra=_ARMS + _curve_cte("c", "ite") + f""",
q AS (SELECT c.rank, {_QINI} AS qini FROM c CROSS JOIN arms a)""") + """
SELECT rank, ROUND(CASE WHEN (SELECT COUNT(*) FROM q) > 1 THEN
   (SELECT qini FROM q ORDER BY rank DESC LIMIT 1) * (rank - 1) / ((SELECT COUNT(*) FROM q) - 1) ELSE CAST(0 AS DOUBLE) END, 6) AS qini_random
FROM q""")
def q_random_targeting_curve(spark, d):
    return rounded(mt.random_curve(mt.qini_curve(stable_scored(spark, d))), 6)


_AREAS = W("scored", extra=_ARMS + _curve_cte("c", "ite") + _curve_cte("p", "true_ite") + f""",
qm AS (SELECT c.rank, {_QINI} AS qini FROM c CROSS JOIN arms a),
qp AS (SELECT c.rank, {_QINI} AS qini FROM p c CROSS JOIN arms a),
areas AS (SELECT (SELECT AVG(qini) FROM qm) AS am, (SELECT AVG(qini) FROM qp) AS ap,
  CASE WHEN (SELECT COUNT(*) FROM qm) >= 2 THEN (SELECT qini FROM qm ORDER BY rank DESC LIMIT 1) / 2 ELSE CAST(0 AS DOUBLE) END AS ar,
  (SELECT COUNT(*) FROM qm) AS n),
coef AS (SELECT CASE WHEN n = 0 THEN CAST(0 AS DOUBLE) WHEN ap - ar <> 0 THEN (am - ar) / (ap - ar) ELSE CAST(0 AS DOUBLE) END AS qini_coefficient FROM areas)""")


@register("auuc", _AREAS + "SELECT ROUND(COALESCE(am, 0), 6) AS auuc FROM areas")
def q_auuc(spark, d):
    return rounded(mt.auuc(mt.qini_curve(stable_scored(spark, d))), 6)


@register("qini_coefficient", _AREAS + "SELECT ROUND(qini_coefficient, 6) AS qini_coefficient FROM coef")
def q_qini_coefficient(spark, d):
    s = stable_scored(spark, d)
    return rounded(s.agg(F.count(F.lit(1)).alias("_n")).select(mt.qini_coefficient(s).alias("qini_coefficient")), 6)


_ERR = """AVG(ABS(ite - true_ite)) AS mae, SQRT(AVG(POW(ite - true_ite, 2))) AS rmse,
  CASE WHEN COUNT(*) >= 2 AND ABS(STDDEV_POP(ite)) > CAST(0.00000001 AS DOUBLE) AND ABS(STDDEV_POP(true_ite)) > CAST(0.00000001 AS DOUBLE)
    THEN COVAR_POP(ite, true_ite) / (STDDEV_POP(ite) * STDDEV_POP(true_ite)) ELSE CAST(0 AS DOUBLE) END AS correlation"""


@register("error_metrics", W("scored", extra=f""",
e AS (SELECT {_ERR} FROM scored)""") + """
SELECT ROUND(mae, 6) AS mae, ROUND(rmse, 6) AS rmse, ROUND(correlation, 6) AS correlation FROM e""")
def q_error_metrics(spark, d):
    return rounded(mt.error_metrics(derived.scored(spark, d)), 6)


@register("effect_metrics", _AREAS + f""",
e AS (SELECT {_ERR}, AVG(ite) AS average_ite FROM scored)
SELECT ROUND(mae, 6) AS mae, ROUND(rmse, 6) AS rmse, ROUND(correlation, 6) AS correlation,
  ROUND(average_ite, 6) AS average_ite, ROUND(qini_coefficient, 6) AS qini_coefficient FROM e CROSS JOIN coef""")
def q_effect_metrics(spark, d):
    return rounded(mt.effect_metrics(stable_scored(spark, d)), 6)


@register("causal_summary", _AREAS + f""",
e AS (SELECT {_ERR}, AVG(ite) AS average_ite, MEDIAN(ite) AS median_ite,
  AVG(CASE WHEN ite > 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS positive_ite_share,
  MAX(ite) AS top_positive_ite, MIN(ite) AS top_negative_ite, COUNT(*) AS n_customers FROM scored)
SELECT ROUND(average_ite, 6) AS average_ite, ROUND(median_ite, 7) AS median_ite, ROUND(positive_ite_share, 6) AS positive_ite_share,
  top_positive_ite, top_negative_ite, ROUND(mae, 6) AS mae, ROUND(rmse, 6) AS rmse, ROUND(correlation, 6) AS correlation,
  ROUND(qini_coefficient, 6) AS qini_coefficient, n_customers FROM e CROSS JOIN coef""")
def q_causal_summary(spark, d):
    out = mt.causal_summary(stable_scored(spark, d))
    out = rounded(out, 6, cols=["average_ite", "positive_ite_share", "mae", "rmse", "correlation", "qini_coefficient"])
    return out.withColumn("median_ite", F.round("median_ite", 7))


@register("median_true_ite", W("scored") + "SELECT ROUND(MEDIAN(true_ite), 7) AS median_true_ite FROM scored")
def q_median_true_ite(spark, d):
    m = od.exact_median(stable_scored(spark, d), "true_ite", "customer_id", alias="median_true_ite")
    return m.select(F.round("median_true_ite", 7).alias("median_true_ite"))


# ---------------------------------------------------------------------------
# A: summary views
# ---------------------------------------------------------------------------
#: Totals of each treatment arm, from which whole-table rates follow (continues the WITH of ``W``).
_ARMS = """,
arms AS (SELECT treatment_received AS arm, COUNT(*) AS n, SUM(purchase) AS bought, SUM(true_ite) AS effect, SUM(purchase_value) AS revenue,
  SUM(discount_cost) AS cost, SUM(net_revenue) AS net, SUM(discount_percentage) AS discounts FROM customers GROUP BY arm)"""


@register("customer_summary", W("customers", extra=_ARMS + """,
whole AS (SELECT MAX(n) FILTER (WHERE arm = 1) AS n1, MAX(n) FILTER (WHERE arm = 0) AS n0, MAX(bought) FILTER (WHERE arm = 1) AS b1,
  MAX(bought) FILTER (WHERE arm = 0) AS b0, SUM(n) AS n, SUM(bought) AS b, SUM(effect) AS effect, SUM(revenue) AS revenue, SUM(cost) AS cost FROM arms)""") + """
SELECT CAST(n AS BIGINT) AS customers, CAST(n1 AS BIGINT) AS treated_customers, CAST(n0 AS BIGINT) AS control_customers,
  ROUND(n1 / n, 6) AS treatment_rate, ROUND(b / n, 6) AS purchase_rate, ROUND(b1 / n1, 6) AS treated_purchase_rate,
  ROUND(b0 / n0, 6) AS control_purchase_rate, ROUND(effect / n, 6) AS average_true_ite,
  ROUND(revenue, 6) AS total_revenue, ROUND(cost, 6) AS total_discount_cost
FROM whole""")
def q_customer_summary(spark, d):
    out = sm.customer_summary(derived.customers(spark, d))
    return rounded(out.withColumn("treated_customers", F.col("treated_customers").cast("bigint"))
                      .withColumn("control_customers", F.col("control_customers").cast("bigint")), 6)


@register("revenue_summary", W("customers", extra=""",
spent AS (SELECT customer_segment, COUNT(*) AS n, SUM(purchase_value) AS revenue, SUM(discount_cost) AS cost FROM customers GROUP BY ALL)""") + """
SELECT customer_segment, n AS customers, ROUND(revenue, 6) AS total_revenue, ROUND(revenue / n, 6) AS avg_purchase_value,
  ROUND(cost, 6) AS total_discount_cost FROM spent""")
def q_revenue_summary(spark, d):
    return rounded(sm.revenue_summary(derived.customers(spark, d)), 6)


@register("campaign_summary", W("customers", "campaigns", extra=""",
per AS (SELECT campaign_id AS id, COUNT(*) AS n, SUM(treatment_received) AS treated, SUM(purchase_value) AS revenue,
  SUM(discount_cost) AS cost, SUM(net_revenue) AS net FROM customers GROUP BY id),
named AS (SELECT per.*, (SELECT campaign_name FROM campaigns WHERE campaign_id = per.id) AS title FROM per)""") + """
SELECT CAST(CASE WHEN title IS NULL THEN 0 ELSE id END AS INTEGER) AS campaign_id, IFNULL(title, 'unassigned') AS campaign_name,
  CAST(SUM(n) AS BIGINT) AS customers, CAST(SUM(treated) AS BIGINT) AS treated_customers, ROUND(SUM(revenue), 6) AS total_revenue,
  ROUND(SUM(cost), 6) AS total_discount_cost, ROUND(SUM(net), 6) AS total_net_revenue
FROM named GROUP BY 1, 2""")
def q_campaign_summary(spark, d):
    out = sm.campaign_summary(derived.customers(spark, d), derived.campaigns(spark, d))
    return rounded(out.withColumn("campaign_id", F.col("campaign_id").cast("int"))
                      .withColumn("customers", F.col("customers").cast("bigint"))
                      .withColumn("treated_customers", F.col("treated_customers").cast("bigint")), 6)


@register("treatment_summary", W("customers", extra=_ARMS) + """
SELECT arm AS treatment_received, n AS customers, ROUND(bought / n, 6) AS purchase_rate, ROUND(discounts / n, 6) AS avg_discount_percentage,
  ROUND(effect / n, 6) AS avg_true_ite, ROUND(revenue, 6) AS total_revenue, ROUND(cost, 6) AS total_discount_cost,
  ROUND(net, 6) AS total_net_revenue FROM arms""")
def q_treatment_summary(spark, d):
    return rounded(sm.treatment_summary(derived.customers(spark, d)), 6)


@register("dataset_summary", W("customers") + """
SELECT CAST(COUNT(*) AS BIGINT) AS customers,
  CAST(COUNT(CASE WHEN treatment_received = 1 THEN 1 END) AS BIGINT) AS treated_customers,
  CAST(COUNT(CASE WHEN treatment_received = 0 THEN 1 END) AS BIGINT) AS control_customers,
  ROUND(COUNT(CASE WHEN treatment_received = 1 THEN 1 END) / CAST(COUNT(*) AS DOUBLE), 6) AS treatment_rate,
  ROUND(AVG(CAST(purchase AS DOUBLE)), 6) AS purchase_rate,
  ROUND(COALESCE(AVG(CASE WHEN treatment_received = 1 THEN CAST(purchase AS DOUBLE) END), 0), 6) AS treated_purchase_rate,
  ROUND(COALESCE(AVG(CASE WHEN treatment_received = 0 THEN CAST(purchase AS DOUBLE) END), 0), 6) AS control_purchase_rate,
  ROUND(AVG(true_ite), 6) AS average_true_ite, ROUND(AVG(purchase_value), 6) AS average_purchase_value,
  ROUND(SUM(purchase_value), 6) AS total_revenue, ROUND(SUM(discount_cost), 6) AS total_discount_cost,
  ROUND(MEDIAN(true_ite), 7) AS median_true_ite
FROM customers""")
def q_dataset_summary(spark, d):
    out = sm.dataset_summary(stable_customers(spark, d))
    out = rounded(out, 6, skip=("median_true_ite",))
    return out.withColumn("median_true_ite", F.round("median_true_ite", 7))


@register("segment_counts_raw", W("customers") + """
SELECT customer_segment, CAST(COUNT(*) AS BIGINT) AS count FROM customers GROUP BY customer_segment""")
def q_segment_counts_raw(spark, d):
    return sm.segment_counts_raw(derived.customers(spark, d))


@register("discount_distribution", W("customers") + """
SELECT discount_percentage, CAST(COUNT(*) AS BIGINT) AS count FROM customers GROUP BY discount_percentage""")
def q_discount_distribution(spark, d):
    return sm.discount_distribution(derived.customers(spark, d))


_SEG025 = """CASE WHEN ite >= CAST(0.05 AS DOUBLE) THEN 'persuadable'
  WHEN ite <= -CAST(0.05 AS DOUBLE) THEN 'sleeping dog'
  WHEN baseline_probability >= CAST(0.25 AS DOUBLE) THEN 'sure thing' ELSE 'lost cause' END"""


@register("uplift_segment_shares", W("scored") + f"""
SELECT uplift_segment, CAST(COUNT(*) AS BIGINT) AS count, ROUND(COUNT(*) / CAST((SELECT COUNT(*) FROM scored) AS DOUBLE), 6) AS share
FROM (SELECT {_SEG025} AS uplift_segment FROM scored) GROUP BY uplift_segment""")
def q_uplift_segment_shares(spark, d):
    return rounded(sm.uplift_segment_shares(stable_scored(spark, d)), 6)


@register("segment_labels", W("scored") + f"""
SELECT upper(substr(s, 1, 1)) || substr(s, 2) AS segment_label, CAST(COUNT(*) AS BIGINT) AS customers
FROM (SELECT {_SEG025} AS s FROM scored) GROUP BY 1""")
def q_segment_labels(spark, d):
    shares = sm.uplift_segment_shares(derived.scored(spark, d))
    return shares.select(label("uplift_segment").alias("segment_label"), F.col("count").alias("customers"))


# ---------------------------------------------------------------------------
# P: lookups
# ---------------------------------------------------------------------------
_CUST_COLS = ", ".join(f.name for f in CUSTOMER_SCHEMA.fields)


@register("scan_customers_table", W("customers") + "SELECT * FROM customers")
def q_scan_customers_table(spark, d):
    return derived.customers(spark, d)


@register("list_customers", W("customers") + f"""
SELECT {_CUST_COLS}, (SELECT COUNT(*) FROM customers WHERE customer_segment = 'vip' AND instr(CAST(customer_id AS VARCHAR), '7') > 0) AS total
FROM customers WHERE customer_segment = 'vip' AND instr(CAST(customer_id AS VARCHAR), '7') > 0
ORDER BY customer_id LIMIT 20 OFFSET 5""")
def q_list_customers(spark, d):
    return lk.list_customers(derived.customers(spark, d), offset=5, limit=20, segment="vip", search="7")


@register("list_customers_after", W("customers") + f"""
SELECT {_CUST_COLS}, (SELECT COUNT(*) FROM customers WHERE customer_segment = 'vip') AS total
FROM customers WHERE customer_segment = 'vip' AND customer_id > 60 ORDER BY customer_id LIMIT 20""")
def q_list_customers_after(spark, d):
    return lk.list_customers(derived.customers(spark, d), limit=20, segment="vip", after=60)


@register("get_customer", W("customers") + "SELECT * FROM customers WHERE customer_id = 42")
def q_get_customer(spark, d):
    # the id predicate reaches the customer scan; nothing else is computed for the other rows
    return lk.get_customer(derived.customers(spark, d), 42)


@register("top_ite", W("scored") + """
SELECT customer_id, ite, baseline_probability, treatment_probability FROM scored ORDER BY ite DESC, customer_id LIMIT 10""")
def q_top_ite(spark, d):
    s = derived.scored(spark, d).select("customer_id", "ite", "baseline_probability", "treatment_probability")
    return lk.top_ite(s, 10)


@register("search_recommendations", W("scored", extra=f""",
base AS (SELECT s.*, ite*net_revenue AS expected_profit, discount_cost AS expected_cost, {_SEG025} AS uplift_segment FROM scored s),
cand AS (SELECT customer_id, SUM(CAST(ROUND(expected_cost*100) AS BIGINT)) OVER (
    ORDER BY ROUND(expected_profit/expected_cost, 9) DESC, customer_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_cents
  FROM base WHERE expected_profit > 0 AND expected_cost > 0)""") + f"""
SELECT b.customer_id, b.ite, b.expected_profit, b.expected_cost, b.uplift_segment
FROM base b JOIN cand c ON c.customer_id = b.customer_id
WHERE c.cum_cents <= {round(FLAGSHIP_BUDGET * 100)} AND b.uplift_segment = 'persuadable' AND instr(CAST(b.customer_id AS VARCHAR), '1') > 0
ORDER BY b.expected_profit DESC, b.customer_id LIMIT 25""")
def q_search_recommendations(spark, d):
    sel = recommendation_rows(stable_scored(spark, d), FLAGSHIP_BUDGET)
    return lk.search_recommendations(sel, search="1", segment="persuadable", limit=25).select(
        "customer_id", "ite", "expected_profit", "expected_cost", "uplift_segment")


# ---------------------------------------------------------------------------
# J: joins
# ---------------------------------------------------------------------------
@register("join_scored", W("customers", "predictions") + """
SELECT c.customer_id, p.model_run_id, p.ite, c.true_ite, c.treatment_received, c.purchase
FROM customers c JOIN predictions p ON p.customer_id = c.customer_id""")
def q_join_scored(spark, d):
    s = stable_scored(spark, d)
    c = stable_customers(spark, d, s).select("customer_id", "true_ite", "treatment_received", "purchase")
    p = derived.predictions(spark, d, s).select("customer_id", "model_run_id", "ite")
    return jn.join_scored(c, p)


@register("join_stored", W("customers", "predictions") + """
SELECT c.customer_id, p.model_run_id, p.ite, c.true_ite, c.treatment_received, c.purchase
FROM customers c JOIN predictions p ON p.customer_id = c.customer_id""")
def q_join_stored(spark, d):
    """J1 on tables stored in hash buckets of the id: neither side is shuffled by the join."""
    s = stable_scored(spark, d)
    c = stable_customers(spark, d, s).select("customer_id", "true_ite", "treatment_received", "purchase")
    p = derived.predictions(spark, d, s).select("customer_id", "model_run_id", "ite")
    stored = []
    for name, df in (("customers", c), ("predictions", p)):
        path = scratch_dir(spark, f"bucketed-{name}")
        stored.append(snapshots.store_bucketed(df, f"{name}_{path[-12:]}", path, buckets=16))
    return jn.join_scored(*stored)


@register("join_campaign", W("customers", "campaigns") + """
SELECT c.customer_id, c.campaign_id, ca.campaign_name FROM customers c LEFT JOIN campaigns ca ON ca.campaign_id = c.campaign_id""")
def q_join_campaign(spark, d):
    c = derived.customers(spark, d).select("customer_id", "campaign_id")
    return jn.join_campaign(c, derived.campaigns(spark, d))


@register("latest_prediction", W("predictions") + """
SELECT customer_id, baseline_probability, treatment_probability, ite FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY created_at DESC, id DESC) AS rn FROM predictions) WHERE rn = 1""")
def q_latest_prediction(spark, d):
    return jn.latest_prediction(derived.predictions(spark, d))


def _recs_sql() -> str:
    def run(rid: int, budget: float, ts: str) -> str:
        return f"""SELECT b.customer_id*2 + {rid - 1} AS id, b.customer_id, b.campaign_id, {rid} AS model_run_id,
    b.ite AS predicted_ite, b.discount_percentage AS recommended_discount, b.expected_profit, b.expected_cost,
    TIMESTAMP '{ts}' AS created_at
  FROM rbase b JOIN rcand c ON c.customer_id = b.customer_id WHERE c.cum_cents <= {round(budget * 100)}"""

    return f""",
rbase AS (SELECT s.*, ite*net_revenue AS expected_profit, discount_cost AS expected_cost FROM scored s),
rcand AS (SELECT customer_id, SUM(CAST(ROUND(expected_cost*100) AS BIGINT)) OVER (
    ORDER BY ROUND(expected_profit/expected_cost, 9) DESC, customer_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_cents
  FROM rbase WHERE expected_profit > 0 AND expected_cost > 0),
recommendations AS ({run(1, SMALL_BUDGET, '2000-04-01 00:00:00')} UNION ALL {run(2, FLAGSHIP_BUDGET, '2000-04-02 00:00:00')})"""


_RUNS = {1: (SMALL_BUDGET, "2000-04-01 00:00:00"), 2: (FLAGSHIP_BUDGET, "2000-04-02 00:00:00")}


@register("latest_recommendation", W("scored", extra=_recs_sql()) + """
SELECT customer_id, recommended_discount, expected_profit, expected_cost FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY created_at DESC, id DESC) AS rn FROM recommendations) WHERE rn = 1""")
def q_latest_recommendation(spark, d):
    return jn.latest_recommendation(jn.recommendations_table(stable_scored(spark, d), _RUNS))


@register("export_dashboard", W("customers", "predictions", extra=_recs_sql() + """,
newest AS (SELECT customer_id, arg_max(struct_pack(b := baseline_probability, t := treatment_probability, e := ite),
    struct_pack(at := created_at, id := id)) AS told FROM predictions GROUP BY customer_id),
advised AS (SELECT customer_id, arg_max(struct_pack(d := recommended_discount, p := expected_profit, c := expected_cost),
    struct_pack(at := created_at, id := id)) AS told FROM recommendations GROUP BY customer_id)""") + """
SELECT customer_id, customer_segment, campaign_id, treatment_received, purchase, purchase_value, discount_percentage, discount_cost,
  net_revenue, true_ite, newest.told.b AS baseline_probability, newest.told.t AS treatment_probability, newest.told.e AS predicted_ite,
  advised.told.d AS recommended_discount, advised.told.p AS expected_profit, advised.told.c AS expected_cost
FROM customers LEFT JOIN newest USING (customer_id) LEFT JOIN advised USING (customer_id)""")
def q_export_dashboard(spark, d):
    s = stable_scored(spark, d)
    return jn.export_dashboard(stable_customers(spark, d, s), derived.predictions(spark, d, s),
                               jn.recommendations_table(s, _RUNS))


@register("mark_selected", W("customers", "predictions") + """
SELECT c.customer_id, CASE WHEN EXISTS (SELECT 1 FROM predictions p WHERE p.customer_id = c.customer_id AND p.model_run_id = 1)
  THEN 1 ELSE 0 END AS selected FROM customers c""")
def q_mark_selected(spark, d):
    s = stable_scored(spark, d)
    ids = derived.predictions(spark, d, s).where(F.col("model_run_id") == 1)
    return jn.mark_selected(stable_customers(spark, d, s).select("customer_id"), ids)


@register("coverage_anti", W("customers", "predictions") + """
SELECT customer_id, 'missing' AS side FROM customers WHERE customer_id NOT IN (SELECT customer_id FROM predictions WHERE model_run_id = 2)
UNION ALL
SELECT DISTINCT customer_id, 'extra' AS side FROM predictions WHERE model_run_id = 2 AND customer_id NOT IN (SELECT customer_id FROM customers)""")
def q_coverage_anti(spark, d):
    s = stable_scored(spark, d)
    p = derived.predictions(spark, d, s).where(F.col("model_run_id") == 2)
    return jn.coverage_anti(stable_customers(spark, d, s), p)
