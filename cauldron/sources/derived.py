"""The customer/campaign tables derived from the TPC-H-like test data.

The reference works on one wide customer table.  The test data has orders,
customers, nations, regions and events instead; this module derives the
customer contract from them (engagement counts from events, history and the
outcome window from orders, treatment by a deterministic rule).  The same
derivation exists twice: as DataFrame code that Spark runs and as SQL text
the DuckDB oracle runs.  They must stay equivalent.

Portability rules: money in integer cents, no bare decimal literals in double
arithmetic, calendar arithmetic on integers, every EXP rounded to 6 dp.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import Tables


def _ts(text: str) -> Column:
    return F.expr(f"TIMESTAMP_NTZ '{text}'")


def _d(x: float) -> Column:
    return F.lit(float(x))


def customer_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """22 contract columns + ``campaign_id`` + helper ``seg_score``; one row per customer."""
    t = Tables(spark, sf_dir)
    events = t.events
    ev = events.groupBy("user_id").agg(
        F.sum(F.when(F.col("event_type") == "view", 1).otherwise(0)).alias("views"),
        F.sum(F.when(F.col("event_type") == "click", 1).otherwise(0)).alias("clicks"),
        F.sum(F.when(F.col("event_type") == "signup", 1).otherwise(0)).alias("signups"),
    )
    # number of event users as a scalar subquery: one plan, no cross join
    n_users = events.select((F.max("user_id") + 1).alias("n")).scalar()

    d = F.col("o_orderdate")
    t2000, t1997, t2000q2 = _ts("2000-01-01 00:00:00"), _ts("1997-01-01 00:00:00"), _ts("2000-04-01 00:00:00")
    cents = F.round("o_totalprice").cast("bigint")
    hist = d < t2000
    o = t.orders.groupBy("o_custkey").agg(
        F.sum(F.when(hist, 1).otherwise(0)).alias("h_orders"),
        F.sum(F.when(hist, cents).otherwise(0)).alias("h_cents"),
        F.min(d).alias("first_dt"),
        F.max(F.when(hist, F.year(d) * 372 + F.month(d) * 31 + F.dayofmonth(d))).alias("last_dn"),
        F.max(F.when((F.col("o_orderpriority") == "1-URGENT") & (d < t1997), 1).otherwise(0)).alias("resp"),
        F.sum(F.when((d >= t2000) & (d < t2000q2), cents).otherwise(0)).alias("w_cents"),
    )

    c = t.customer.select("c_custkey", "c_nationkey", "c_mktsegment")
    n = t.nation.select("n_nationkey", "n_regionkey")
    joined = (
        c.join(n, c.c_nationkey == n.n_nationkey, "inner")
        .withColumn("ev_user", F.col("c_custkey") % n_users)
        .join(ev, F.col("ev_user") == ev.user_id, "left")
        .join(o, F.col("c_custkey") == o.o_custkey, "left")
    )
    key = F.col("c_custkey")
    seg = F.col("c_mktsegment")
    h_orders = F.coalesce(F.col("h_orders"), F.lit(0))
    clicks = F.coalesce(F.col("clicks"), F.lit(0))
    signups = F.coalesce(F.col("signups"), F.lit(0))
    treated = (key * 7919 + 13) % 1000 < 150 + 25 * h_orders
    f = joined.select(
        (key + 1).alias("customer_id"),
        F.when(F.col("n_regionkey") < 4, F.col("n_regionkey") + 1).alias("campaign_id"),
        (18 + (key * 37) % 58).alias("age"),
        ((2000 - F.year("first_dt")) * 12 + 1 - F.month("first_dt")).alias("tenure_raw"),
        F.when(seg == "BUILDING", "budget").when(seg == "HOUSEHOLD", "premium")
        .when(seg == "MACHINERY", "vip").otherwise("standard").alias("customer_segment"),
        F.when(seg == "BUILDING", 0).when(seg == "HOUSEHOLD", 2)
        .when(seg == "MACHINERY", 3).otherwise(1).alias("seg_score"),
        h_orders.alias("historical_orders"),
        F.coalesce(F.col("h_cents"), F.lit(0)).alias("h_cents"),
        (F.lit(2000 * 372 + 31 + 1) - F.coalesce(F.col("last_dn"), F.lit(1994 * 372 + 31))).alias("days_since_last_purchase"),
        F.coalesce(F.col("views"), F.lit(0)).alias("website_visits"),
        clicks.alias("email_opens"),
        F.least(signups, clicks).alias("email_clicks"),
        F.coalesce(F.col("resp"), F.lit(0)).alias("previous_campaign_response"),
        F.when(treated, 1).otherwise(0).alias("treatment_received"),
        F.when(treated, 5 * (1 + key % 4)).otherwise(0).alias("pct"),
        F.coalesce(F.col("w_cents"), F.lit(0)).alias("w_cents"),
    )
    tenure = F.coalesce(F.col("tenure_raw"), F.lit(0))
    orders_n = F.col("historical_orders")
    w = F.col("w_cents")
    disc_cents = F.floor((w * F.col("pct") + 50) / _d(100))
    return f.select(
        F.col("customer_id").cast("bigint"),
        F.col("campaign_id").cast("int"),
        F.col("age").cast("int"),
        F.when(tenure < 0, 0).otherwise(tenure).cast("int").alias("tenure_months"),
        "customer_segment",
        F.col("seg_score").cast("int"),
        orders_n.cast("int").alias("historical_orders"),
        (F.col("h_cents") / _d(100)).alias("historical_revenue"),
        F.when(orders_n > 0, F.col("h_cents") / (_d(100) * orders_n)).otherwise(_d(0)).alias("avg_order_value"),
        F.col("days_since_last_purchase").cast("int"),
        F.col("website_visits").cast("int"),
        F.col("email_opens").cast("int"),
        F.col("email_clicks").cast("int"),
        F.col("previous_campaign_response").cast("int"),
        F.col("treatment_received").cast("int"),
        (F.col("pct") / _d(100)).alias("discount_percentage"),
        F.when(w > 0, 1).otherwise(0).cast("int").alias("purchase"),
        (w / _d(100)).alias("purchase_value"),
        (disc_cents / _d(100)).alias("discount_cost"),
        ((w - disc_cents) / _d(100)).alias("net_revenue"),
    )


def _six(x: Column) -> Column:
    """Six fractional digits by plain double arithmetic, the same in every engine (ROUND differs at halves)."""
    return F.floor(x * _d(1000000) + _d(0.5)) / _d(1000000)


def score_surrogate(base: DataFrame) -> DataFrame:
    """Ground truth and predictions by a fixed rule on engagement and loyalty.

    Stands in for a fitted model so that everything downstream of prediction
    has an exact oracle. Both shares saturate (x / (x + c)); effects grow with
    engagement and shrink with loyalty, so every uplift segment occurs.
    """
    touches = F.col("website_visits") + F.col("email_opens") + F.col("email_clicks")
    orders = F.col("historical_orders")
    z = base.withColumns({
        "_engaged": _six(touches / (touches + _d(12))),
        "_loyal": _six(orders / (orders + _d(6))),
        "true_treatment_probability": F.when(150 + 25 * orders > 1000, _d(1)).otherwise((150 + 25 * orders) / _d(1000)),
    })
    z = z.select(
        "*",
        _six(_d(0.08) + _d(0.5) * F.col("_loyal") * F.col("_engaged")).alias("baseline_probability"),
        _six(_d(0.6) * F.col("_engaged") * (_d(1) - F.col("_loyal"))
                + _d(0.05) * F.col("previous_campaign_response") - _d(0.2)).alias("ite"),
        _six(F.col("discount_percentage") * (_d(0.9) - _d(0.6) * F.col("_loyal"))).alias("true_ite"),
    ).withColumn("true_baseline_purchase_probability", _six(_d(0.02) + _d(0.5) * F.col("baseline_probability")))
    raw = F.col("baseline_probability") + F.col("ite")
    return z.select(
        "*",
        F.when(raw < 0, _d(0)).when(raw > 1, _d(1)).otherwise(_six(raw)).alias("treatment_probability"),
        _six(F.col("true_baseline_purchase_probability") + F.col("true_ite"))
        .alias("true_treatment_purchase_probability"),
    ).drop("_engaged", "_loyal")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer table with ground truth and surrogate predictions."""
    return score_surrogate(customer_base(spark, sf_dir))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 23-column customer contract (no helper, no predictions)."""
    from ..schema import CUSTOMER_SCHEMA

    return scored(spark, sf_dir).select(*[f.name for f in CUSTOMER_SCHEMA.fields])


def campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Tables(spark, sf_dir).region
    return r.where(F.col("r_regionkey") < 4).select(
        (F.col("r_regionkey") + 1).cast("int").alias("campaign_id"),
        F.col("r_name").alias("campaign_name"),
    )


def predictions(spark: SparkSession, sf_dir: str, scored_df: DataFrame | None = None) -> DataFrame:
    """Two prediction runs, so that "latest" has something to choose from.

    Run 1 scored the non-vip customers, run 2 the customers with a campaign:
    the runs overlap, and each misses customers the other has.
    """
    s = scored_df if scored_df is not None else scored(spark, sf_dir)
    cid = F.col("customer_id")
    run1 = s.where(F.col("customer_segment") != "vip").select(
        (cid * 2).alias("id"), cid, F.lit(1).alias("model_run_id"),
        "baseline_probability", "treatment_probability",
        _six(F.col("ite") - _d(0.01)).alias("ite"),
        _ts("2000-04-01 00:00:00").alias("created_at"),
    )
    run2 = s.where(F.col("campaign_id").isNotNull()).select(
        (cid * 2 + 1).alias("id"), cid, F.lit(2).alias("model_run_id"),
        "baseline_probability", "treatment_probability", "ite",
        _ts("2000-04-02 00:00:00").alias("created_at"),
    )
    return run1.unionByName(run2)


# ---------------------------------------------------------------------------
# The same derivation as SQL text for the DuckDB oracle (flattened CTEs).
# ---------------------------------------------------------------------------
_CTE_CUSTOMER_BASE = """
ev AS (
  SELECT user_id,
    SUM(CASE WHEN event_type='view' THEN 1 ELSE 0 END) AS views,
    SUM(CASE WHEN event_type='click' THEN 1 ELSE 0 END) AS clicks,
    SUM(CASE WHEN event_type='signup' THEN 1 ELSE 0 END) AS signups
  FROM events GROUP BY user_id),
nu AS (SELECT MAX(user_id)+1 AS n_users FROM events),
o AS (
  SELECT o_custkey,
    SUM(CASE WHEN o_orderdate <  TIMESTAMP '2000-01-01 00:00:00' THEN 1 ELSE 0 END) AS h_orders,
    SUM(CASE WHEN o_orderdate <  TIMESTAMP '2000-01-01 00:00:00' THEN CAST(ROUND(o_totalprice) AS BIGINT) ELSE 0 END) AS h_cents,
    MIN(o_orderdate) AS first_dt,
    MAX(CASE WHEN o_orderdate <  TIMESTAMP '2000-01-01 00:00:00' THEN YEAR(o_orderdate)*372+MONTH(o_orderdate)*31+DAY(o_orderdate) END) AS last_dn,
    MAX(CASE WHEN o_orderpriority='1-URGENT' AND o_orderdate < TIMESTAMP '1997-01-01 00:00:00' THEN 1 ELSE 0 END) AS resp,
    SUM(CASE WHEN o_orderdate >= TIMESTAMP '2000-01-01 00:00:00' AND o_orderdate < TIMESTAMP '2000-04-01 00:00:00' THEN CAST(ROUND(o_totalprice) AS BIGINT) ELSE 0 END) AS w_cents
  FROM orders GROUP BY o_custkey),
f AS (
  SELECT c.c_custkey + 1 AS customer_id,
    CASE WHEN n.n_regionkey < 4 THEN n.n_regionkey + 1 END AS campaign_id,
    18 + (c.c_custkey*37) % 58 AS age,
    (2000 - YEAR(o.first_dt))*12 + 1 - MONTH(o.first_dt) AS tenure_raw,
    CASE c.c_mktsegment WHEN 'BUILDING' THEN 'budget' WHEN 'HOUSEHOLD' THEN 'premium' WHEN 'MACHINERY' THEN 'vip' ELSE 'standard' END AS customer_segment,
    CASE c.c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'HOUSEHOLD' THEN 2 WHEN 'MACHINERY' THEN 3 ELSE 1 END AS seg_score,
    COALESCE(o.h_orders,0) AS historical_orders,
    COALESCE(o.h_cents,0) AS h_cents,
    2000*372+31+1 - COALESCE(o.last_dn, 1994*372+31) AS days_since_last_purchase,
    COALESCE(ev.views,0) AS website_visits,
    COALESCE(ev.clicks,0) AS email_opens,
    CASE WHEN COALESCE(ev.signups,0) < COALESCE(ev.clicks,0) THEN COALESCE(ev.signups,0) ELSE COALESCE(ev.clicks,0) END AS email_clicks,
    COALESCE(o.resp,0) AS previous_campaign_response,
    CASE WHEN (c.c_custkey*7919+13) % 1000 < 150 + 25*COALESCE(o.h_orders,0) THEN 1 ELSE 0 END AS treatment_received,
    CASE WHEN (c.c_custkey*7919+13) % 1000 < 150 + 25*COALESCE(o.h_orders,0) THEN 5*(1 + c.c_custkey % 4) ELSE 0 END AS pct,
    COALESCE(o.w_cents,0) AS w_cents
  FROM customer c
  JOIN nation n ON n.n_nationkey = c.c_nationkey
  CROSS JOIN nu
  LEFT JOIN ev ON ev.user_id = c.c_custkey % nu.n_users
  LEFT JOIN o ON o.o_custkey = c.c_custkey),
customer_base AS (
SELECT CAST(customer_id AS BIGINT) AS customer_id, CAST(campaign_id AS INTEGER) AS campaign_id,
  CAST(age AS INTEGER) AS age,
  CAST(CASE WHEN COALESCE(tenure_raw,0) < 0 THEN 0 ELSE COALESCE(tenure_raw,0) END AS INTEGER) AS tenure_months,
  customer_segment, CAST(seg_score AS INTEGER) AS seg_score, CAST(historical_orders AS INTEGER) AS historical_orders,
  h_cents/CAST(100 AS DOUBLE) AS historical_revenue,
  CASE WHEN historical_orders > 0 THEN h_cents/(CAST(100 AS DOUBLE)*historical_orders) ELSE CAST(0 AS DOUBLE) END AS avg_order_value,
  CAST(days_since_last_purchase AS INTEGER) AS days_since_last_purchase,
  CAST(website_visits AS INTEGER) AS website_visits, CAST(email_opens AS INTEGER) AS email_opens,
  CAST(email_clicks AS INTEGER) AS email_clicks,
  CAST(previous_campaign_response AS INTEGER) AS previous_campaign_response,
  CAST(treatment_received AS INTEGER) AS treatment_received,
  pct/CAST(100 AS DOUBLE) AS discount_percentage,
  CAST(CASE WHEN w_cents > 0 THEN 1 ELSE 0 END AS INTEGER) AS purchase,
  w_cents/CAST(100 AS DOUBLE) AS purchase_value,
  FLOOR((w_cents*pct+50)/CAST(100 AS DOUBLE))/CAST(100 AS DOUBLE) AS discount_cost,
  (w_cents - FLOOR((w_cents*pct+50)/CAST(100 AS DOUBLE)))/CAST(100 AS DOUBLE) AS net_revenue
FROM f)"""

_CTE_SCORED = """
shares AS (
SELECT *,
  FLOOR(((website_visits + email_opens + email_clicks)/(website_visits + email_opens + email_clicks + CAST(12 AS DOUBLE)))*CAST(1000000 AS DOUBLE) + CAST(0.5 AS DOUBLE))/CAST(1000000 AS DOUBLE) AS engaged,
  FLOOR((historical_orders/(historical_orders + CAST(6 AS DOUBLE)))*CAST(1000000 AS DOUBLE) + CAST(0.5 AS DOUBLE))/CAST(1000000 AS DOUBLE) AS loyal,
  CASE WHEN 150+25*historical_orders > 1000 THEN CAST(1 AS DOUBLE) ELSE (150+25*historical_orders)/CAST(1000 AS DOUBLE) END AS true_treatment_probability
FROM customer_base),
effects AS (
SELECT *,
  FLOOR((CAST(0.08 AS DOUBLE) + CAST(0.5 AS DOUBLE)*loyal*engaged)*CAST(1000000 AS DOUBLE) + CAST(0.5 AS DOUBLE))/CAST(1000000 AS DOUBLE) AS baseline_probability,
  FLOOR((CAST(0.6 AS DOUBLE)*engaged*(CAST(1 AS DOUBLE) - loyal) + CAST(0.05 AS DOUBLE)*previous_campaign_response - CAST(0.2 AS DOUBLE))*CAST(1000000 AS DOUBLE) + CAST(0.5 AS DOUBLE))/CAST(1000000 AS DOUBLE) AS ite,
  FLOOR((discount_percentage*(CAST(0.9 AS DOUBLE) - CAST(0.6 AS DOUBLE)*loyal))*CAST(1000000 AS DOUBLE) + CAST(0.5 AS DOUBLE))/CAST(1000000 AS DOUBLE) AS true_ite
FROM shares),
truths AS (
SELECT * EXCLUDE (engaged, loyal), FLOOR((CAST(0.02 AS DOUBLE) + CAST(0.5 AS DOUBLE)*baseline_probability)*CAST(1000000 AS DOUBLE) + CAST(0.5 AS DOUBLE))/CAST(1000000 AS DOUBLE) AS true_baseline_purchase_probability
FROM effects),
scored AS (
SELECT *,
  CASE WHEN baseline_probability + ite < 0 THEN CAST(0 AS DOUBLE)
       WHEN baseline_probability + ite > 1 THEN CAST(1 AS DOUBLE)
       ELSE FLOOR((baseline_probability + ite)*CAST(1000000 AS DOUBLE) + CAST(0.5 AS DOUBLE))/CAST(1000000 AS DOUBLE) END AS treatment_probability,
  FLOOR((true_baseline_purchase_probability + true_ite)*CAST(1000000 AS DOUBLE) + CAST(0.5 AS DOUBLE))/CAST(1000000 AS DOUBLE) AS true_treatment_purchase_probability
FROM truths)"""

_CTE_CAMPAIGNS = """
campaigns AS (SELECT CAST(r_regionkey + 1 AS INTEGER) AS campaign_id, r_name AS campaign_name FROM region WHERE r_regionkey < 4)"""

_CTE_PREDICTIONS = """
predictions AS (
SELECT customer_id*2 AS id, customer_id, 1 AS model_run_id, baseline_probability, treatment_probability,
       FLOOR((ite - CAST(0.01 AS DOUBLE))*CAST(1000000 AS DOUBLE) + CAST(0.5 AS DOUBLE))/CAST(1000000 AS DOUBLE) AS ite, TIMESTAMP '2000-04-01 00:00:00' AS created_at
FROM scored WHERE customer_segment <> 'vip'
UNION ALL
SELECT customer_id*2+1, customer_id, 2, baseline_probability, treatment_probability, ite, TIMESTAMP '2000-04-02 00:00:00'
FROM scored WHERE campaign_id IS NOT NULL)"""

_CTE_CUSTOMERS = """
customers AS (
SELECT customer_id, campaign_id, age, tenure_months, customer_segment, historical_orders,
  historical_revenue, avg_order_value, days_since_last_purchase, website_visits, email_opens,
  email_clicks, previous_campaign_response, treatment_received, discount_percentage, purchase,
  purchase_value, discount_cost, net_revenue, true_baseline_purchase_probability,
  true_treatment_purchase_probability, true_ite, true_treatment_probability
FROM scored)"""

_CTES = {
    "customer_base": _CTE_CUSTOMER_BASE,
    "scored": _CTE_SCORED,
    "campaigns": _CTE_CAMPAIGNS,
    "predictions": _CTE_PREDICTIONS,
    "customers": _CTE_CUSTOMERS,
}
_NEEDS = {
    "customer_base": (),
    "scored": ("customer_base",),
    "customers": ("scored",),
    "predictions": ("scored",),
    "campaigns": (),
}


def with_derived(*names: str, extra: str = "") -> str:
    """``WITH`` prefix defining the named derived relations (and what they need).

    ``extra`` holds more comma-led CTEs written by the caller.
    """
    order: list[str] = []

    def visit(n: str) -> None:
        for dep in _NEEDS[n]:
            visit(dep)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    body = ",".join(_CTES[n] for n in order)
    return "WITH " + body + extra + "\n"
