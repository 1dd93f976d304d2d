"""Queries of scores and projections."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F

from patronage.operators import axes
from patronage.operators import scoring as sc
from patronage.plans import segmentation
from patronage.queries.axes import wide_of
from patronage.queries.registry import query, r, rounded
from patronage.queries.sales import PROF, orders_of, profiles_of, ref_of
from patronage.queries.segments import ALL_AXES, quantiled_of

CUST = PROF + ", fr AS (SELECT p.customer_id, total_orders AS orders, CAST(round(i.irp * total_orders * 2) AS BIGINT) AS returns, lifetime_value AS value, recent.v AS recent_value, avg_order_value / 2 AS historic_avg FROM prof p JOIN it i USING (customer_id) JOIN (SELECT customer_id, max(total_price) AS v FROM ord GROUP BY 1) recent USING (customer_id)), pp AS (SELECT avg(orders) AS m, stddev_pop(orders) AS s, quantile_cont(value, 0.99) AS p99, quantile_cont(value, 0.995) AS p995, count(*) AS n FROM fr), an AS (SELECT customer_id, 'return' AS kind, least(1, returns / CAST(orders AS DOUBLE) / 0.8) AS severity FROM fr WHERE orders >= 3 AND returns / CAST(orders AS DOUBLE) >= 0.5 UNION ALL SELECT customer_id, 'velocity', least(1, (orders - m) / s / 5) FROM fr, pp WHERE (orders - m) / s >= 2 UNION ALL SELECT customer_id, 'vip', greatest(0, least(1, (value - p99) / (p995 - p99))) FROM fr, pp WHERE n >= 100 AND value >= p995 UNION ALL SELECT customer_id, 'escalation', least(1, (recent_value / historic_avg - 3) / 7) FROM fr WHERE orders >= 5 AND recent_value / historic_avg >= 3)"


def customers_of(t):
    w = wide_of(t)
    recent = orders_of(t).groupBy("customer_id").agg(F.max("total_price").alias("recent_value"))
    base = w.select("customer_id", F.col("total_orders").alias("orders"), F.round(F.col("items_returned_pct") * F.col("total_orders") * 2).cast("long").alias("returns"), F.col("lifetime_value").alias("value"), (F.col("avg_order_value") / 2).alias("historic_avg"))
    return base.join(recent, "customer_id")


def found_of(t):
    return sc.anomalies(customers_of(t), 2.0)


def _frd(no: int, kind: str) -> None:
    @query(f"FRD-{no}", f"WITH {CUST} SELECT customer_id, round(severity, 6) AS severity FROM an WHERE kind = '{kind}'")
    def one(t):
        return found_of(t).where(F.col("kind") == kind).select("customer_id", r("severity").alias("severity"))


for _no, _kind in enumerate(("return", "velocity", "vip", "escalation"), 1):
    _frd(_no, _kind)


@query("FRD-5", f"WITH {CUST}, z AS (SELECT customer_id, least(1, sum(CASE kind WHEN 'return' THEN 0.4 WHEN 'velocity' THEN 0.3 ELSE 0.5 END * severity)) AS s, least(count(*), 3) / 3.0 AS c FROM an WHERE kind <> 'vip' GROUP BY 1) SELECT customer_id, round(s, 6) AS fraud_score, round(c, 6) AS confidence, s >= 0.6 AND c >= 0.5 AS flagged FROM z")
def frd_5(t):
    return rounded(sc.fraud_scores(found_of(t)))


@query("FRD-6", f"WITH {CUST} SELECT kind, count(*) AS n, count(*) FILTER (severity >= 0.7) AS severe, round(avg(severity), 6) AS mean_severity FROM an GROUP BY 1")
def frd_6(t):
    return found_of(t).groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("severity") >= 0.7).alias("severe"), r(F.avg("severity")).alias("mean_severity"))


@query("UDF-6", f"WITH {CUST} SELECT customer_id, kind, round(severity, 6) AS severity FROM an")
def udf_6(t):
    return rounded(found_of(t))


@query("CLD-1", f"WITH {PROF} SELECT customer_id, CASE WHEN total_orders <= 1 THEN 'cold_start' WHEN total_orders <= 4 THEN 'warming_up' WHEN total_orders <= 9 THEN 'established' ELSE 'mature' END AS lifecycle_stage, CASE WHEN total_orders < 3 OR tenure_days < 14 THEN 'insufficient' WHEN total_orders < 5 THEN 'minimal' WHEN total_orders >= 10 THEN 'rich' ELSE 'adequate' END AS sufficiency, round(0.4 * least(1, total_orders / 10.0) + 0.3 * least(1, tenure_days / 90.0) + 0.3, 6) AS confidence, CASE WHEN total_orders = 1 THEN 'One-Time Buyer' WHEN total_orders <= 3 THEN 'Occasional Shopper' WHEN total_orders <= 6 THEN 'Regular Buyer' ELSE 'Frequent Shopper' END AS fallback_frequency, 'Premium Buyer' AS fallback_value, CASE WHEN days_since_last_purchase <= 7 THEN 'Highly Engaged' WHEN days_since_last_purchase <= 30 THEN 'Active' WHEN days_since_last_purchase <= 90 THEN 'Casual' ELSE 'Dormant' END AS fallback_engagement, CAST(CASE WHEN total_orders >= 10 THEN 0 ELSE ceil((10 - total_orders) * greatest(tenure_days, 1) / CAST(total_orders AS DOUBLE)) END AS BIGINT) AS days_to_mature, NOT (total_orders < 3 OR tenure_days < 14) AS use_clustering, CAST(tenure_days AS BIGINT) AS days_since_first_order, total_orders < 3 OR tenure_days < 14 AS using_fallback, CASE WHEN total_orders < 3 OR tenure_days < 14 THEN 'INSUFFICIENT DATA: rule-based segments' WHEN total_orders >= 10 THEN 'clusters' ELSE 'clusters, with care' END AS recommendation, CASE WHEN total_orders < 3 OR tenure_days < 14 THEN 'Premium Buyer' END AS instead_value FROM prof")
def cld_1(t):
    d = sc.enriched(profiles_of(t))
    return rounded(d.withColumn("instead_value", F.col("fallback_segments")["value"]).withColumn("days_since_first_order", F.col("days_since_first_order").cast("long")).drop("fallback_segments"))


CHURN8 = "CASE WHEN churn_risk_score > 0.5 THEN 0.3 ELSE 0 END + CASE WHEN days_since_last_purchase > 90 THEN 0.3 ELSE 0 END + CASE WHEN seg_purchase_frequency = 'rare' THEN 0.2 ELSE 0 END + CASE WHEN seg_customer_maturity = 'young' THEN 0.2 ELSE 0 END"


@query("CHN-8", f"WITH {PROF}, s AS (SELECT customer_id, CAST({CHURN8} AS DOUBLE) AS s FROM prof) SELECT customer_id, round(s, 4) AS score, CASE WHEN round(s, 4) > 0.7 THEN 'critical' WHEN round(s, 4) > 0.5 THEN 'high' WHEN round(s, 4) > 0.3 THEN 'medium' ELSE 'low' END AS level FROM s")
def chn_8(t):
    d = sc.rule_churn(profiles_of(t)).withColumn("score", r("score", 4))
    return d.withColumn("level", F.when(F.col("score") > 0.7, "critical").when(F.col("score") > 0.5, "high").when(F.col("score") > 0.3, "medium").otherwise("low"))


@query("CHN-9", f"WITH {PROF}, s AS (SELECT customer_id, CASE WHEN churn_risk_score > 0.6 THEN 40 ELSE 0 END + CASE WHEN seg_purchase_frequency = 'rare' THEN 30 ELSE 0 END + CASE WHEN days_since_last_purchase > 180 THEN 30 ELSE 0 END AS points FROM prof) SELECT customer_id, points, CASE WHEN points >= 70 THEN 'HIGH' WHEN points >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM s")
def chn_9(t):
    s = F.col("dominant_segments")
    points = F.when(F.col("churn_risk_score") > 0.6, 40).otherwise(0) + F.when(s["purchase_frequency"] == "rare", 30).otherwise(0) + F.when(F.col("days_since_last_purchase") > 180, 30).otherwise(0)
    return profiles_of(t).select("customer_id", points.alias("points")).withColumn("level", sc.ladder(F.col("points"), [(70, "HIGH"), (40, "MEDIUM")], "LOW"))


OBS = [date(2000, m, 1) for m in range(1, 13, 2)]
TRAIN_SQL = PROF + ", ob AS (SELECT unnest([" + ", ".join(f"DATE '{d}'" for d in OBS) + "]) AS obs), tr AS (SELECT customer_id, obs, count(*) FILTER (dy < obs) AS orders, coalesce(sum(total_price) FILTER (dy < obs), 0) AS value, max(dy) FILTER (dy < obs) AS ld, count(*) FILTER (dy >= obs AND dy < obs + 90) AS later FROM (SELECT *, CAST(order_date AS DATE) AS dy FROM ord) o JOIN ob ON dy >= obs - 180 AND dy < obs + 90 GROUP BY 1, 2), ts AS (SELECT customer_id, obs, orders, value, date_diff('day', ld, obs) AS recency, CASE WHEN later = 0 THEN 1 ELSE 0 END AS churned FROM tr WHERE orders >= 2)"


@query("CHN-1", f"WITH {TRAIN_SQL} SELECT customer_id, CAST(obs AS VARCHAR) AS obs_date, orders, round(value, 4) AS value, round(value / orders, 4) AS avg_value, CAST(recency AS INT) AS recency, churned FROM ts")
def chn_1(t):
    return rounded(sc.training_set(orders_of(t), OBS), 4).withColumn("obs_date", F.col("obs_date").cast("string"))


@query("SC-10", "SELECT CAST(unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 30 DAY)) AS VARCHAR) AS obs_date FROM orders")
def sc_10(t):
    days = F.sequence(F.min("order_date"), F.max("order_date"), F.expr("INTERVAL 30 DAYS"))
    return t.headers.agg(days.alias("d")).select(F.explode("d").alias("obs_date")).select(F.col("obs_date").cast("string").alias("obs_date"))


@query("SET-5", f"WITH {TRAIN_SQL} SELECT CAST(obs AS VARCHAR) AS obs_date, count(*) AS n, round(avg(churned), 6) AS churn_rate FROM ts GROUP BY 1")
def set_5(t):
    return sc.training_set(orders_of(t), OBS).groupBy(F.col("obs_date").cast("string").alias("obs_date")).agg(F.count("*").alias("n"), r(F.avg("churned")).alias("churn_rate"))


FUZZY = [(a, n) for a in axes.AXES for n in ("low", "middle", "high")]
_FUZZY_SQL = ", ".join(f"round(max(score) FILTER (axis = '{a}' AND segment = '{n}'), 6) AS fuzzy_{a}_{n}" for a, n in FUZZY)


@query("CHN-2", f"WITH {ALL_AXES}, fz AS (SELECT customer_id, {_FUZZY_SQL} FROM m13 GROUP BY 1) SELECT fz.*, round(lifetime_value / total_orders, 6) AS aov, round(orders_per_month, 6) AS orders_per_month, round(days_since_last_purchase / CAST(tenure_days AS DOUBLE), 6) AS recency_ratio FROM fz JOIN wide USING (customer_id) WHERE tenure_days > 0")
def chn_2(t):
    """The memberships of all thirteen axes as columns, beside figures of the customer, all from features that are written once."""
    features, segments = quantiled_of(t, keep=("lifetime_value", "total_orders", "orders_per_month", "days_since_last_purchase", "tenure_days"))
    figures = {"aov": F.col("lifetime_value") / F.col("total_orders"), "orders_per_month": F.col("orders_per_month"), "recency_ratio": F.col("days_since_last_purchase") / F.col("tenure_days")}
    known = features.where("tenure_days > 0").withColumns(figures)
    shares = segmentation.by_axis(known, segments, keep=tuple(figures))
    return shares.select("customer_id", *[r(F.col(f"m_{a}")[n]).alias(f"fuzzy_{a}_{n}") for a, n in FUZZY], *[r(c).alias(c) for c in figures])


RULE_SCORE = "least(1.0, recency / 180.0)"


@query("CHN-5", f"WITH {TRAIN_SQL}, p AS (SELECT churned = 1 AS y, {RULE_SCORE} >= 0.3 AS p FROM ts), c AS (SELECT count(*) FILTER (y AND p) AS tp, count(*) FILTER (NOT y AND p) AS fp, count(*) FILTER (y AND NOT p) AS fn, count(*) FILTER (NOT y AND NOT p) AS tn FROM p) SELECT tp, fp, fn, tn, round(CAST(tp + tn AS DOUBLE) / (tp + fp + fn + tn), 6) AS accuracy, round(CAST(tp AS DOUBLE) / (tp + fp), 6) AS precision, round(CAST(tp AS DOUBLE) / (tp + fn), 6) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c")
def chn_5(t):
    d = sc.training_set(orders_of(t), OBS).withColumn("score", F.least(F.lit(1.0), F.col("recency") / 180))
    return rounded(sc.classifier_report(d, "score", "churned", 0.3))


@query("CHN-6", f"WITH {TRAIN_SQL}, bn AS (SELECT CAST(floor({RULE_SCORE} * 100) AS BIGINT) AS bin, sum(churned) AS pos, count(*) AS n FROM ts GROUP BY 1), cv AS (SELECT bin / 100.0 AS threshold, CAST(sum(pos) OVER w AS DOUBLE) / sum(n) OVER w AS precision, CAST(sum(pos) OVER w AS DOUBLE) / sum(pos) OVER () AS recall FROM bn WINDOW w AS (ORDER BY bin DESC)) SELECT round(threshold, 4) AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(2 * precision * recall / (precision + recall), 6) AS f1 FROM cv WHERE precision >= 0.3 ORDER BY round(2 * precision * recall / (precision + recall), 9) DESC, threshold DESC LIMIT 1")
def chn_6(t):
    d = sc.training_set(orders_of(t), OBS).withColumn("score", F.least(F.lit(1.0), F.col("recency") / 180))
    return rounded(sc.threshold_search(d, "score", "churned", 100, 0.3))


@query("LTV-2", f"WITH {TRAIN_SQL}, e AS (SELECT value AS y, orders * 150000.0 - value AS e FROM ts) SELECT round(avg(abs(e)), 4) AS mae, round(sqrt(avg(e * e)), 4) AS rmse, round(1 - avg(e * e) / var_pop(y), 4) AS r2, round(avg(abs(e / y) * 100), 4) AS mape, round(median(abs(e)), 4) AS median_error, round(stddev_pop(e), 4) AS error_std FROM e")
def ltv_2(t):
    d = sc.training_set(orders_of(t), OBS).withColumn("guess", F.col("orders") * 150000.0)
    return rounded(sc.regression_report(d, "value", "guess"), 4)


@query("LTV-3", f"WITH {PROF}, v AS (SELECT customer_id, lifetime_value + avg_order_value * orders_per_month * 12 * 0.8 AS v FROM prof) SELECT customer_id, round(v, 4) AS predicted, round(v * 0.8, 4) AS low, round(v * 1.2, 4) AS high FROM v")
def ltv_3(t):
    v = F.col("lifetime_value") + F.col("avg_order_value") * F.col("orders_per_month") * 12 * 0.8
    return profiles_of(t).select("customer_id", r(v, 4).alias("predicted"), r(v * 0.8, 4).alias("low"), r(v * 1.2, 4).alias("high"))


@query("LTV-4", f"WITH {PROF} SELECT customer_id, round(least(12, 365.0 / greatest(days_since_last_purchase, 30)) * avg_order_value, 4) AS next_year FROM prof")
def ltv_4(t):
    return profiles_of(t).select("customer_id", r(F.least(F.lit(12.0), 365.0 / F.greatest("days_since_last_purchase", F.lit(30))) * F.col("avg_order_value"), 4).alias("next_year"))


@query("LTV-5", f"WITH {PROF}, bs AS (SELECT customer_id, lifetime_value AS v, lifetime_value / total_orders AS aov, CASE seg_purchase_frequency WHEN 'frequent' THEN 2.0 WHEN 'regular' THEN 1.0 ELSE 0.33 END AS rate, 1 - churn_risk_score / 12 AS q FROM prof), m AS (SELECT *, unnest(range(1, 7)) AS month FROM bs) SELECT customer_id, CAST(month AS INT) AS month, round(rate * q ** month, 6) AS expected_orders, round(rate * q ** month * aov, 3) AS expected_revenue, round(v + sum(rate * q ** month * aov) OVER (PARTITION BY customer_id ORDER BY month), 3) AS cumulative_ltv FROM m")
def ltv_5(t):
    p = profiles_of(t).select("customer_id", F.col("dominant_segments")["purchase_frequency"].alias("frequency"), F.col("lifetime_value").alias("value"), F.col("total_orders").alias("orders"), F.col("churn_risk_score").alias("risk"))
    return sc.ltv_months(p, 6).select("customer_id", "month", r("expected_orders").alias("expected_orders"), r("expected_revenue", 3).alias("expected_revenue"), r("cumulative_ltv", 3).alias("cumulative_ltv"))


GAP6 = "CASE seg_purchase_frequency WHEN 'frequent' THEN 60 WHEN 'regular' THEN 120 ELSE 300 END"


@query("LTV-6", f"WITH {PROF} SELECT customer_id, CAST({GAP6} - days_since_last_purchase AS BIGINT) AS days_to_next, CASE WHEN days_since_last_purchase > 2 * {GAP6} THEN 'at_risk' WHEN days_since_last_purchase >= {GAP6} THEN 'due' ELSE 'waiting' END AS status FROM prof")
def ltv_6(t):
    gap = F.create_map(*[F.lit(x) for x in ("frequent", 60, "regular", 120, "rare", 300)])[F.col("dominant_segments")["purchase_frequency"]]
    last = F.col("days_since_last_purchase")
    return profiles_of(t).select("customer_id", (gap - last).cast("long").alias("days_to_next"), F.when(last > 2 * gap, "at_risk").when(last >= gap, "due").otherwise("waiting").alias("status"))


def _grow(start: str, keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    return f"RECURSIVE g AS ({start} UNION ALL SELECT {k}month + 1, n + CAST(floor(n * 0.03) AS BIGINT) - CAST(floor(n * churn) AS BIGINT), CAST(floor(n * churn) AS BIGINT), CAST(floor(n * 0.03) AS BIGINT), churn FROM g WHERE month < 12)"


@query("GRW-1", "WITH RECURSIVE " + PROF + ", " + _grow("SELECT 0 AS month, count(*) AS n, CAST(0 AS BIGINT) AS churned, CAST(0 AS BIGINT) AS acquired, avg(churn_risk_score) / 12 AS churn FROM prof")[10:] + " SELECT CAST(month AS INT) AS month, n AS customers, churned, acquired FROM g WHERE month > 0")
def grw_1(t):
    return sc.growth(profiles_of(t).agg(F.count("*").alias("customers"), (F.avg("churn_risk_score") / 12).alias("churn")))


@query("GRW-2", "WITH RECURSIVE " + PROF + ", " + _grow("SELECT seg_purchase_value AS segment, 0 AS month, count(*) AS n, CAST(0 AS BIGINT) AS churned, CAST(0 AS BIGINT) AS acquired, avg(churn_risk_score) / 12 AS churn FROM prof GROUP BY 1", "segment")[10:] + " SELECT segment, CAST(month AS INT) AS month, n AS customers, churned, acquired FROM g WHERE month > 0")
def grw_2(t):
    return sc.growth(profiles_of(t).groupBy(F.col("dominant_segments")["purchase_value"].alias("segment")).agg(F.count("*").alias("customers"), (F.avg("churn_risk_score") / 12).alias("churn")))


@query("GRW-3", "WITH RECURSIVE " + PROF + ", " + _grow("SELECT 0 AS month, count(*) AS n, CAST(0 AS BIGINT) AS churned, CAST(0 AS BIGINT) AS acquired, avg(churn_risk_score) / 12 AS churn FROM prof")[10:] + ", av AS (SELECT avg(lifetime_value) AS v, avg(total_orders) AS o FROM prof) SELECT CAST(month AS INT) AS month, n AS customers, round(n * (o / 24) * (v / o), 2) AS monthly_revenue, round(sum(n * (o / 24) * (v / o)) OVER (ORDER BY month), 2) AS cumulative_revenue FROM g, av WHERE month > 0")
def grw_3(t):
    from pyspark.sql.window import Window as W

    p = profiles_of(t)
    g = sc.growth(p.agg(F.count("*").alias("customers"), (F.avg("churn_risk_score") / 12).alias("churn"), F.avg("lifetime_value").alias("v"), F.avg("total_orders").alias("o")))
    revenue = F.col("customers") * (F.col("o") / 24) * (F.col("v") / F.col("o"))
    return g.select("month", "customers", r(revenue, 2).alias("monthly_revenue"), r(F.sum(revenue).over(W.orderBy("month")), 2).alias("cumulative_revenue"))


@query("TOP-6", f"WITH {PROF}, c AS (SELECT customer_id, CASE WHEN churn_risk_score < 0.3 THEN 'growth' WHEN churn_risk_score < 0.7 THEN 'retention' ELSE 'winback' END AS campaign, CASE WHEN churn_risk_score < 0.3 THEN lifetime_value * (1 - churn_risk_score) ELSE lifetime_value * churn_risk_score END AS score FROM prof), k AS (SELECT *, row_number() OVER (PARTITION BY campaign ORDER BY round(score, 6) DESC, customer_id) AS place FROM c) SELECT customer_id, campaign, round(score, 3) AS score, CAST(place AS INT) AS place FROM k WHERE place <= 10")
def top_6(t):
    return rounded(sc.campaigns(profiles_of(t)), 3)


@query("TOP-7", f"WITH {PROF}, c AS (SELECT axis || ':' || segment AS name, count(*) AS n FROM seg GROUP BY 1) SELECT name, n FROM c WHERE contains(name, 'frequent') OR contains(name, 'veteran') ORDER BY n DESC, name LIMIT 5")
def top_7(t):
    goal = F.array(F.lit("frequent"), F.lit("veteran"))
    c = profiles_of(t).select(F.explode("dominant_segments").alias("axis", "segment")).groupBy(F.concat_ws(":", "axis", "segment").alias("name")).agg(F.count("*").alias("n"))
    return c.where(F.exists(goal, lambda g: F.contains(F.col("name"), g))).orderBy(F.col("n").desc(), "name").limit(5)


ISSUES = ("billing_error", "product_defect", "lost_package", "shipping_delay", "wrong_item", "question")
ACTIONS = "iv AS (SELECT *, CASE WHEN issue IN ('billing_error', 'product_defect', 'lost_package') THEN 1.5 WHEN issue IN ('shipping_delay', 'wrong_item') THEN 1.2 ELSE 1.0 END AS w FROM (SELECT *, [" + ", ".join(f"'{i}'" for i in ISSUES) + "][1 + customer_id % 6] AS issue FROM prof)), ac AS (SELECT customer_id, 'offer_discount' AS action, CASE WHEN churn_risk_score > 0.7 THEN 'high' ELSE 'medium' END AS priority, avg_order_value * CASE WHEN lifetime_value < 1500000 THEN 0.1 ELSE 0.15 END AS cost, lifetime_value * 0.15 * w AS benefit, 0.75 AS p, lifetime_value AS v, churn_risk_score AS c FROM iv WHERE lifetime_value > 800000 OR churn_risk_score > 0.6 UNION ALL SELECT customer_id, 'expedite_shipping', 'medium', 15.0, lifetime_value * 0.1 * w, 0.85, lifetime_value, churn_risk_score FROM iv WHERE issue IN ('shipping_delay', 'wrong_item', 'lost_package') UNION ALL SELECT customer_id, 'offer_refund_or_replacement', 'high', avg_order_value, lifetime_value * 0.2 * w, 0.9, lifetime_value, churn_risk_score FROM iv WHERE issue IN ('product_defect', 'wrong_item') UNION ALL SELECT customer_id, 'schedule_followup', 'low', 0.0, lifetime_value * 0.05, 0.6, lifetime_value, churn_risk_score FROM iv)"


@query("CMP-1", f"WITH {PROF}, {ACTIONS} SELECT customer_id, CAST(row_number() OVER (PARTITION BY customer_id ORDER BY cost - benefit, action) AS INT) AS place, action, priority, CAST(floor(cost) AS BIGINT) AS cost, CAST(floor(benefit) AS BIGINT) AS benefit, CAST(p AS DOUBLE) AS success_probability, CASE WHEN c > 0.7 THEN 'urgent' WHEN c > 0.5 OR v > 1500000 THEN 'high' ELSE 'medium' END AS overall, CASE WHEN c > 0.7 THEN 9.0 WHEN c > 0.5 OR v > 1500000 THEN 7.5 ELSE 5.0 END::DOUBLE AS urgency FROM ac")
def cmp_1(t):
    issue = F.element_at(F.array(*[F.lit(i) for i in ISSUES]), (F.col("customer_id") % 6 + 1).cast("int"))
    d = sc.next_actions(profiles_of(t).withColumn("issue_type", issue), 800_000, 1_500_000)
    return d.withColumn("cost", F.floor("cost")).withColumn("benefit", F.floor("benefit"))


#: Segments at the quantiles of an axis stand for the fitted ones.
DESK = (("problem_complexity_profile", "high", "senior_agent_queue"), ("loyalty_trajectory", "low", "retention_specialist"), ("product_knowledge", "high", "product_specialist"))
DESK_SQL = ALL_AXES + ", dm AS (SELECT customer_id, " + ", ".join(f"max(segment) FILTER (axis = '{a}') AS {n}" for (a, *_), n in zip(DESK, ("complexity", "loyalty", "knowledge"), strict=True)) + " FROM m13 WHERE rn = 1 GROUP BY 1), rt AS (SELECT customer_id, CAST(count(*) FILTER (line_item_refunds > 0) AS DOUBLE) / count(*) AS rate FROM lines WHERE product_id IS NOT NULL AND order_date >= (SELECT max(order_date) FROM ord) - INTERVAL 90 DAY GROUP BY 1)"


def desk_of(t):
    """What tickets are routed by: the dominant segments of the axes of ``DESK`` and habits, all from features that are written once."""
    only, habits = tuple(a for a, *_ in DESK), ("lifetime_value", "weekend_vs_weekday_ratio", "business_hours_ratio", "preferred_time_numeric")
    d = segmentation.dominants(*quantiled_of(t, only, habits), only, habits)
    times = F.element_at(F.array(*[F.lit(x) for x in ("morning", "afternoon", "evening")]), F.col("preferred_time_numeric") + 1)
    return d.withColumn("preferred_contact_time", times)


@query("CMP-2", f"WITH {DESK_SQL} SELECT customer_id, CASE WHEN complexity = 'high' THEN 'senior_agent_queue' WHEN loyalty = 'low' THEN 'retention_specialist' WHEN knowledge = 'high' THEN 'product_specialist' ELSE 'general_support' END AS queue, CASE WHEN weekend_vs_weekday_ratio > 2 THEN 'saturday_9am' WHEN business_hours_ratio > 0.8 THEN 'weekday_2pm' WHEN preferred_time_numeric = 2 THEN 'weekday_6pm' END AS slot FROM dm JOIN wide USING (customer_id)")
def cmp_2(t):
    return sc.route_tickets(desk_of(t), DESK)


@query("CMP-2-outreach", f"WITH {DESK_SQL} SELECT customer_id, 'declining' AS reason, 'high' AS priority FROM dm JOIN wide USING (customer_id) WHERE loyalty = 'low' AND lifetime_value > 800000 UNION ALL SELECT customer_id, 'returns', 'medium' FROM dm JOIN rt USING (customer_id) WHERE complexity = 'high' AND rate > 0.3")
def cmp_2_outreach(t):
    since = axes.reference_date_of(t.headers.join(t.raw_lines.select("order_id"), "order_id", "left_semi")) - timedelta(days=90)
    d = desk_of(t).join(sc.recent_return_rate(t.sales_lines, F.lit(since)), "customer_id", "left")
    return sc.outreach(d, 800_000, 0.3, DESK).select("customer_id", "reason", "priority")


@query("SC-7", "SELECT c_custkey AS customer_id, 'C-' || upper(substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 8)) AS anonymous_id FROM customer")
def sc_7(t):
    return t.stores.select("customer_id", F.concat(F.lit("C-"), F.upper(F.substring(F.sha2(F.col("customer_id").cast("string"), 256), 1, 8))).alias("anonymous_id"))


@query("SC-8", "SELECT o_orderkey AS order_id, CAST(year(o_orderdate) AS INT) AS year, CAST(quarter(o_orderdate) AS INT) AS quarter, CAST(month(o_orderdate) AS INT) AS month, monthname(o_orderdate) AS month_name, CAST(weekofyear(o_orderdate) AS INT) AS week, CAST(day(o_orderdate) AS INT) AS day, dayname(o_orderdate) AS week_day FROM orders")
def sc_8(t):
    d = F.col("order_date")
    return t.headers.select("order_id", F.year(d).alias("year"), F.quarter(d).alias("quarter"), F.month(d).alias("month"), F.date_format(d, "MMMM").alias("month_name"), F.weekofyear(d).alias("week"), F.dayofmonth(d).alias("day"), F.date_format(d, "EEEE").alias("week_day"))


@query("SC-2", "SELECT p_partkey AS product_id, left(regexp_replace(regexp_replace(lower(trim(p_name)), '[ -]+', '_', 'g'), '[^a-z0-9_]', '', 'g'), 50) AS slug FROM part")
def sc_2(t):
    clean = F.regexp_replace(F.regexp_replace(F.lower(F.trim("product_name")), "[ -]+", "_"), "[^a-z0-9_]", "")
    return t.products.select("product_id", F.when(F.length(clean) > 0, F.substring(clean, 1, 50)).otherwise("segment").alias("slug"))


@query("SC-6", "SELECT o_orderkey AS order_id, o_totalprice AS value FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 0 FROM orders WHERE o_orderkey % 2 = 1")
def sc_6(t):
    text = F.when(F.col("order_id") % 2 == 0, F.format_number("order_total", 2)).otherwise("n/a")
    return t.headers.select("order_id", F.coalesce(F.replace(text, F.lit(","), F.lit("")).try_cast("double"), F.lit(0.0)).alias("value"))


@query("SC-14", f"WITH {PROF} SELECT p.customer_id, CASE WHEN p.lifetime_value >= 2500000 THEN 'VIP - Top Tier' WHEN p.lifetime_value >= 1500000 THEN 'High Value' WHEN p.lifetime_value >= 800000 THEN 'Mid Value' WHEN p.lifetime_value > 0 THEN 'Standard' ELSE 'New Customer' END AS ltv_tier, CASE WHEN p.churn_risk_score >= 0.7 THEN 'CRITICAL - High Risk' WHEN p.churn_risk_score >= 0.5 THEN 'ELEVATED - Monitor Closely' WHEN p.churn_risk_score >= 0.3 THEN 'MODERATE - Standard Care' ELSE 'LOW - Healthy' END AS churn_tier, CASE WHEN p.total_orders = 0 THEN 'No purchases yet' WHEN p.days_since_last_purchase <= 30 THEN 'Active' WHEN p.days_since_last_purchase <= 60 THEN 'Recently Active' WHEN p.days_since_last_purchase <= 90 THEN 'Cooling Down' ELSE 'At Risk of Lapse' END AS engagement, CASE WHEN p.total_orders >= 10 AND avg_days_between_orders < 30 THEN 'frequent' WHEN p.total_orders >= 10 AND avg_days_between_orders < 90 THEN 'seasonal' WHEN p.total_orders >= 10 THEN 'occasional' WHEN p.total_orders >= 3 THEN 'building' WHEN p.total_orders > 0 THEN 'recent' END AS relationship, CASE WHEN p.lifetime_value >= 1500000 AND p.churn_risk_score >= 0.7 THEN 'priority' WHEN p.lifetime_value >= 1500000 AND p.churn_risk_score >= 0.5 THEN 'strategy' WHEN p.churn_risk_score >= 0.7 THEN 'alert' WHEN p.lifetime_value >= 1500000 THEN 'maintain' END AS retention_advice FROM prof p JOIN wide w ON w.customer_id = p.customer_id")
def sc_14(t):
    w = wide_of(t).withColumn("churn_risk_score", F.coalesce("churn_risk_score", F.lit(0.5)))
    return sc.tiers(w, (2_500_000, 1_500_000, 800_000))


@query("SC-16", f"WITH {PROF} SELECT customer_id, concat_ws('; ', CASE WHEN seg_purchase_value = 'high' THEN 'lead with service' END, CASE WHEN seg_purchase_frequency = 'frequent' THEN 'offer subscription' END, CASE WHEN seg_return_behavior = 'returner' THEN 'check fit first' END) AS hints FROM prof")
def sc_16(t):
    s = F.col("dominant_segments")
    hints = F.array_compact(F.array(F.when(s["purchase_value"] == "high", "lead with service"), F.when(s["purchase_frequency"] == "frequent", "offer subscription"), F.when(s["return_behavior"] == "returner", "check fit first")))
    return profiles_of(t).select("customer_id", F.array_join(hints, "; ").alias("hints"))
