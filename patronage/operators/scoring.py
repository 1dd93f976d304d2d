"""Rule scores of customers: fraud, cold start, churn, lifetime value, growth and campaigns."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the rules.
ORDERS_A_MONTH = {"frequent": 2.0, "regular": 1.0, "rare": 0.33}
ACQUISITION = 0.03
FRAUD_WEIGHTS = {"return": 0.4, "velocity": 0.3, "escalation": 0.5}


def clamp(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def ladder(c: Column, steps: list[tuple[float, str]], rest: str) -> Column:
    """The name of the first bound that the value reaches."""
    out = F.lit(rest)
    for low, name in reversed(steps):
        out = F.when(c >= low, name).otherwise(out)
    return out


def anomalies(customers: DataFrame, velocity_z: float = 3.0) -> DataFrame:
    """One row for each anomaly of a customer (FRD-1 to FRD-4, UDF-6).

    ``customers`` has customer_id, orders, returns, value, recent_value, historic_avg. Population figures are one row,
    broadcast to all customers.
    """
    population = customers.agg(F.avg("orders").alias("m"), F.stddev_pop("orders").alias("s"), F.percentile("value", F.array(F.lit(0.99), F.lit(0.995))).alias("p"), F.count("*").alias("all_n"))
    c = customers.crossJoin(F.broadcast(population))
    rate, z = F.col("returns") / F.nullif("orders", F.lit(0)), (F.col("orders") - F.col("m")) / F.nullif("s", F.lit(0.0))
    up = F.col("recent_value") / F.nullif("historic_avg", F.lit(0.0))
    over = (F.col("value") - F.col("p")[0]) / F.nullif(F.col("p")[1] - F.col("p")[0], F.lit(0.0))
    found = F.array_compact(F.array(
        F.when((F.col("orders") >= 3) & (rate >= 0.5), F.struct(F.lit("return").alias("kind"), clamp(rate / 0.8).alias("severity"))),
        F.when(z >= velocity_z, F.struct(F.lit("velocity").alias("kind"), clamp(z / 5).alias("severity"))),
        F.when((F.col("all_n") >= 100) & (F.col("value") >= F.col("p")[1]), F.struct(F.lit("vip").alias("kind"), clamp(over).alias("severity"))),
        F.when((F.col("orders") >= 5) & (up >= 3), F.struct(F.lit("escalation").alias("kind"), clamp((up - 3) / 7).alias("severity"))),
    ))
    return c.select("customer_id", F.explode(found).alias("a")).select("customer_id", "a.kind", "a.severity")


def fraud_scores(found: DataFrame) -> DataFrame:
    """Weighted score, confidence by signals and the flag for review (FRD-5)."""
    weight = F.create_map(*[F.lit(x) for kv in FRAUD_WEIGHTS.items() for x in kv])[F.col("kind")]
    g = found.where(F.col("kind").isin(*FRAUD_WEIGHTS)).groupBy("customer_id").agg(clamp(F.sum(weight * F.col("severity"))).alias("fraud_score"), (F.least(F.count("*"), F.lit(3)) / 3).alias("confidence"))
    return g.withColumn("flagged", (F.col("fraud_score") >= 0.6) & (F.col("confidence") >= 0.5))


def cold_start(c: DataFrame) -> DataFrame:
    """Lifecycle, sufficiency of data, confidence, fallback segments, days to maturity (CLD-1).

    Needs customer_id, total_orders, tenure_days, lifetime_value, days_since_last_purchase.
    """
    n, tenure, last = F.col("total_orders"), F.col("tenure_days"), F.col("days_since_last_purchase")
    average = F.col("lifetime_value") / F.greatest(n, F.lit(1))
    stage = F.when(n <= 1, "cold_start").when(n <= 4, "warming_up").when(n <= 9, "established").otherwise("mature")
    enough = F.when((n < 3) | (tenure < 14), "insufficient").when(n < 5, "minimal").when(n >= 10, "rich").otherwise("adequate")
    return c.select(
        "customer_id", stage.alias("lifecycle_stage"), enough.alias("sufficiency"), (0.4 * clamp(n / 10) + 0.3 * clamp(tenure / 90) + 0.3).alias("confidence"),
        F.when(n == 1, "One-Time Buyer").when(n <= 3, "Occasional Shopper").when(n <= 6, "Regular Buyer").otherwise("Frequent Shopper").alias("fallback_frequency"),
        F.when(average < 30, "Budget Conscious").when(average < 75, "Mid-Range").otherwise("Premium Buyer").alias("fallback_value"),
        F.when(last <= 7, "Highly Engaged").when(last <= 30, "Active").when(last <= 90, "Casual").otherwise("Dormant").alias("fallback_engagement"),
        F.when(n >= 10, 0).otherwise(F.ceil((10 - n) * F.greatest(tenure, F.lit(1)) / n)).cast("long").alias("days_to_mature"), (enough != "insufficient").alias("use_clustering"), tenure.alias("days_since_first_order"),
    )


def enriched(c: DataFrame) -> DataFrame:
    """The cold start of a customer as its profile carries it: using_fallback, and the fallback segments and their confidence where clusters are not to be used (CLD-1)."""
    d = cold_start(c)
    instead = ~F.col("use_clustering") | (F.col("confidence") < 0.3)
    segments = F.create_map(*[x for k in ("frequency", "value", "engagement") for x in (F.lit(k), F.col(f"fallback_{k}"))])
    advice = F.when(instead, "INSUFFICIENT DATA: rule-based segments").when(F.col("lifecycle_stage") == "mature", "clusters").otherwise("clusters, with care")
    return d.withColumn("using_fallback", instead).withColumn("fallback_segments", F.when(instead, segments)).withColumn("recommendation", advice)


def rule_churn(c: DataFrame) -> DataFrame:
    """Churn score of recency and segments with its level (CHN-8)."""
    s = F.col("dominant_segments")
    score = F.when(F.col("churn_risk_score") > 0.5, 0.3).otherwise(0.0) + F.when(F.col("days_since_last_purchase") > 90, 0.3).otherwise(0.0) + F.when(s["purchase_frequency"] == "rare", 0.2).otherwise(0.0) + F.when(s["customer_maturity"] == "young", 0.2).otherwise(0.0)
    return c.select("customer_id", score.alias("score")).withColumn("level", F.when(F.col("score") > 0.7, "critical").when(F.col("score") > 0.5, "high").when(F.col("score") > 0.3, "medium").otherwise("low"))


def training_set(orders: DataFrame, dates: list[date], feature_days: int = 180, label_days: int = 90, least: int = 2) -> DataFrame:
    """Point-in-time features and label of each (customer, observation date) (CHN-1).

    Orders combine to (customer, day) first; each day is dealt to the observation dates whose windows hold it.
    """
    daily = orders.groupBy("customer_id", F.to_date("order_date").alias("day")).agg(F.count("*").alias("n"), F.sum("total_price").alias("v"))
    near = F.filter(F.array(*[F.lit(d) for d in dates]), lambda d: (d > F.date_sub("day", label_days + 1)) & (d <= F.date_add("day", feature_days)))
    dealt = daily.select("customer_id", "day", "n", "v", F.explode(near).alias("obs_date"))
    before = F.col("day") < F.col("obs_date")
    when = lambda c: F.when(before, c)
    g = dealt.groupBy("customer_id", "obs_date").agg(F.coalesce(F.sum(when(F.col("n"))), F.lit(0)).alias("orders"), F.coalesce(F.sum(when(F.col("v"))), F.lit(0.0)).alias("value"), F.max(when(F.col("day"))).alias("last_day"), F.coalesce(F.sum(F.when(~before & (F.datediff("day", "obs_date") < label_days), F.col("n"))), F.lit(0)).alias("later"))
    return g.where(F.col("orders") >= least).select("customer_id", "obs_date", "orders", "value", (F.col("value") / F.col("orders")).alias("avg_value"), F.datediff("obs_date", "last_day").alias("recency"), (F.col("later") == 0).cast("int").alias("churned"))


def preprocess(df: DataFrame, columns: tuple[str, ...] | list[str]) -> tuple[DataFrame, list[str]]:
    """Null and NaN as 0, columns that never vary dropped, the rest at mean 0 and population deviation 1; other columns as they are (CHN-3).

    Gives the frame and the names that are left. All figures are one row of one aggregate; an empty table leaves no column.
    """
    x = {c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in columns}
    row = df.agg(*[F.struct(F.avg(v).alias("m"), F.stddev_pop(v).alias("s")).alias(c) for c, v in x.items()]).first()
    kept = [c for c in columns if row[c]["s"]]
    return df.select(*[c for c in df.columns if c not in x], *[((x[c] - row[c]["m"]) / row[c]["s"]).alias(c) for c in kept]), kept


def threshold_search(scored: DataFrame, score: str, label: str, bins: int = 100, least_precision: float = 0.7) -> DataFrame:
    """The threshold with the best F1 among those of enough precision (CHN-6), over binned scores: the window is over bins, not rows."""
    from pyspark.sql.window import Window as W

    b = scored.groupBy(F.floor(F.col(score) * bins).alias("bin")).agg(F.sum(F.col(label)).alias("pos"), F.count("*").alias("n"))
    down = W.orderBy(F.col("bin").desc()).rowsBetween(W.unboundedPreceding, 0)
    c = b.select("bin", F.sum("pos").over(down).alias("tp"), F.sum("n").over(down).alias("pp"), F.sum("pos").over(W.partitionBy()).alias("all_pos"))
    c = c.select((F.col("bin") / bins).alias("threshold"), (F.col("tp") / F.col("pp")).alias("precision"), (F.col("tp") / F.nullif("all_pos", F.lit(0))).alias("recall"))
    c = c.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))
    return c.where(F.col("precision") >= least_precision).orderBy(F.round("f1", 9).desc(), F.col("threshold").desc()).limit(1)


def classifier_report(scored: DataFrame, score: str, label: str, threshold: float = 0.5) -> DataFrame:
    """Confusion counts, accuracy, precision, recall and F1 at a threshold, in one pass (CHN-5)."""
    y, p = F.col(label) == 1, F.col(score) >= threshold
    g = scored.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    part = lambda a, b: F.col(a) / F.nullif(F.col(a) + F.col(b), F.lit(0))
    g = g.withColumn("accuracy", (F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))).withColumn("precision", part("tp", "fp")).withColumn("recall", part("tp", "fn"))
    return g.withColumn("f1", 2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)))


def regression_report(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """MAE, RMSE, R2, MAPE, median and spread of the error, in one pass (LTV-2, TKT-7)."""
    e, y = F.col(predicted) - F.col(actual), F.col(actual)
    return df.agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.avg(e * e) / F.nullif(F.var_pop(y), F.lit(0.0))).alias("r2"), F.avg(F.when(y != 0, F.abs(e / y) * 100)).alias("mape"), F.median(F.abs(e)).alias("median_error"), F.stddev_pop(e).alias("error_std"))


def ltv_months(c: DataFrame, months: int = 12) -> DataFrame:
    """Expected orders, revenue and running value of each month, with retention decay (LTV-5). Needs frequency, value, orders, risk."""
    rate = F.coalesce(F.create_map(*[F.lit(x) for kv in ORDERS_A_MONTH.items() for x in kv])[F.col("frequency")], F.lit(0.5))
    q, average = 1 - F.col("risk") / 12, F.col("value") / F.col("orders")
    m = c.select("customer_id", "value", rate.alias("rate"), q.alias("q"), average.alias("aov"), F.explode(F.sequence(F.lit(1), F.lit(months))).alias("month"))
    series = F.when(F.col("q") == 1, F.col("month").cast("double")).otherwise(F.col("q") * (1 - F.pow("q", F.col("month"))) / (1 - F.col("q")))
    return m.select("customer_id", "month", (F.col("rate") * F.pow("q", F.col("month"))).alias("expected_orders"), (F.col("rate") * F.pow("q", F.col("month")) * F.col("aov")).alias("expected_revenue"), (F.col("value") + F.col("rate") * F.col("aov") * series).alias("cumulative_ltv"))


def growth(start: DataFrame, months: int = 12, acquisition: float = ACQUISITION) -> DataFrame:
    """Customers month by month with whole churned and acquired customers (GRW-1, GRW-2). Needs customers and churn (monthly)."""
    zero = F.struct(F.col("customers").cast("long").alias("n"), F.array().cast("array<struct<month:int,customers:bigint,churned:bigint,acquired:bigint>>").alias("rows"))

    def step(a: Column, month: Column) -> Column:
        lost, won = (a["n"] * F.col("churn")).cast("long"), (a["n"] * acquisition).cast("long")
        now = a["n"] + won - lost
        return F.struct(now.alias("n"), F.concat(a["rows"], F.array(F.struct(month.alias("month"), now.alias("customers"), lost.alias("churned"), won.alias("acquired")))).alias("rows"))

    keep = [c for c in start.columns if c not in ("customers", "churn")]
    return start.select(*keep, F.explode(F.aggregate(F.sequence(F.lit(1), F.lit(months)), zero, step, lambda a: a["rows"])).alias("r")).select(*keep, "r.*")


def campaigns(c: DataFrame, limit: int = 10) -> DataFrame:
    """Top customers of the retention, growth and winback lists by score (TOP-6)."""
    risk, value = F.col("churn_risk_score"), F.col("lifetime_value")
    kind = F.when(risk < 0.3, "growth").when(risk < 0.7, "retention").otherwise("winback")
    score = F.when(risk < 0.3, value * (1 - risk)).otherwise(value * risk)
    from pyspark.sql.window import Window as W

    ranked = c.select("customer_id", kind.alias("campaign"), score.alias("score"))
    tops = [ranked.where(F.col("campaign") == k).orderBy(F.round("score", 6).desc(), "customer_id").limit(limit) for k in ("growth", "retention", "winback")]
    out = tops[0].unionByName(tops[1]).unionByName(tops[2])
    return out.withColumn("place", F.row_number().over(W.partitionBy("campaign").orderBy(F.round("score", 6).desc(), "customer_id")))


# How much worse an issue makes it, and which issues an action is for.
SEVERITY = {"billing_error": 1.5, "product_defect": 1.5, "lost_package": 1.5, "shipping_delay": 1.2, "wrong_item": 1.2}
SHIPPING, DEFECTS = ("shipping_delay", "wrong_item", "lost_package"), ("product_defect", "wrong_item")


def next_actions(c: DataFrame, much: float = 200.0, more: float = 500.0) -> DataFrame:
    """Actions on a customer's issue, best first by benefit less cost, with priority and urgency (CMP-1).

    Needs customer_id, issue_type, lifetime_value, avg_order_value, churn_risk_score. ``much`` and ``more`` are the values
    from which on a customer is worth a discount, and a larger one. Of equal actions the first by name.
    """
    risk, value, order, issue = F.col("churn_risk_score"), F.col("lifetime_value"), F.col("avg_order_value"), F.col("issue_type")
    worse = F.coalesce(F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])[issue], F.lit(1.0))
    part = F.when(value < more, 0.10).otherwise(0.15)

    def act(name: str, priority: Column | str, cost: Column, gain: Column, chance: float) -> Column:
        of = priority if isinstance(priority, Column) else F.lit(priority)
        return F.struct((cost - gain).alias("n"), F.lit(name).alias("action"), of.alias("priority"), cost.alias("cost"), gain.alias("benefit"), F.lit(chance).alias("success_probability"))

    rows = F.array_sort(F.array_compact(F.array(
        F.when((value > much) | (risk > 0.6), act("offer_discount", F.when(risk > 0.7, "high").otherwise("medium"), order * part, value * 0.15 * worse, 0.75)),
        F.when(issue.isin(*SHIPPING), act("expedite_shipping", "medium", F.lit(15.0), value * 0.10 * worse, 0.85)),
        F.when(issue.isin(*DEFECTS), act("offer_refund_or_replacement", "high", order.cast("double"), value * 0.20 * worse, 0.90)),
        act("schedule_followup", "low", F.lit(0.0), value * 0.05, 0.60),
    )))
    urgency = F.when(risk > 0.7, 9.0).when((risk > 0.5) | (value > more), 7.5).otherwise(5.0)
    level = F.when(urgency == 9.0, "urgent").when(urgency == 7.5, "high").otherwise("medium")
    out = c.select("customer_id", level.alias("overall"), urgency.alias("urgency"), F.posexplode(rows).alias("place", "a"))
    return out.select("customer_id", (F.col("place") + 1).alias("place"), "a.action", "a.priority", "a.cost", "a.benefit", "a.success_probability", "overall", "urgency")


#: The segments that a ticket is routed by, the queue of each in order of precedence, and the callback slots.
QUEUES = (("problem_complexity_profile", "high_touch_shopper", "senior_agent_queue"), ("loyalty_trajectory", "declining_risk", "retention_specialist"), ("product_knowledge", "category_expert", "product_specialist"))


def route_tickets(c: DataFrame, queues=QUEUES) -> DataFrame:
    """The queue of each customer's tickets and the slot for a call (CMP-2).

    Needs customer_id, dominant (axis -> segment), weekend_vs_weekday_ratio, business_hours_ratio, preferred_contact_time.
    ``queues`` are (axis, segment, queue), the first that fits counts, else general_support; no slot where no habit shows.
    """
    queue = F.coalesce(*[F.when(F.col("dominant")[axis] == segment, name) for axis, segment, name in queues], F.lit("general_support"))
    slot = F.when(F.col("weekend_vs_weekday_ratio") > 2, "saturday_9am").when(F.col("business_hours_ratio") > 0.8, "weekday_2pm").when(F.col("preferred_contact_time") == "evening", "weekday_6pm")
    return c.select("customer_id", queue.alias("queue"), slot.alias("slot"))


def recent_return_rate(lines: DataFrame, since) -> DataFrame:
    """(customer_id, recent_return_rate): the share of a customer's items since a date that have a refund."""
    late = lines.where(F.col("customer_id").isNotNull() & F.col("product_id").isNotNull() & (F.col("order_date") >= since))
    return late.groupBy("customer_id").agg((F.count_if(F.col("line_item_refunds") > 0) / F.count("*")).alias("recent_return_rate"))


def outreach(c: DataFrame, value: float = 500.0, returns: float = 0.5, queues=QUEUES) -> DataFrame:
    """Customers to write to before they ask, a row for each reason (CMP-2): of value but declining; needing much and returning much lately.

    Needs customer_id, dominant (axis -> segment), lifetime_value, recent_return_rate (null: none). ``queues`` as in ``route_tickets``: its
    first entry is the segment that needs much, its second the declining one.
    """
    (much, touchy, _), (path, falling, _) = queues[:2]
    own = F.col("dominant")
    found = F.array_compact(F.array(
        F.when((own[path] == falling) & (F.col("lifetime_value") > value), F.struct(F.lit("declining").alias("reason"), F.lit("high").alias("priority"), F.lit("It has been a while since your last order: can we help?").alias("message"))),
        F.when((own[much] == touchy) & (F.col("recent_return_rate") > returns), F.struct(F.lit("returns").alias("reason"), F.lit("medium").alias("priority"), F.lit("You returned some items lately: let us find what fits.").alias("message"))),
    ))
    return c.select("customer_id", F.explode(found).alias("a")).select("customer_id", "a.*")


def tiers(c: DataFrame, values: tuple[float, float, float] = (5000, 2000, 500)) -> DataFrame:
    """Five ladders about a customer: value, churn risk, engagement, relationship, retention advice (SC-14); ``values`` are the cuts of value.

    Needs customer_id, lifetime_value, churn_risk_score, days_since_last_purchase, total_orders, avg_days_between_orders.
    """
    vip, high, mid = values
    value, risk, last, n, gap = (F.col(x) for x in ("lifetime_value", "churn_risk_score", "days_since_last_purchase", "total_orders", "avg_days_between_orders"))
    relation = F.when((n >= 10) & (gap < 30), "frequent").when((n >= 10) & (gap < 90), "seasonal").when(n >= 10, "occasional").when(n >= 3, "building").when(n > 0, "recent")
    advice = F.when((value >= high) & (risk >= 0.7), "priority").when((value >= high) & (risk >= 0.5), "strategy").when(risk >= 0.7, "alert").when(value >= high, "maintain")
    return c.select(
        "customer_id", F.when(value >= vip, "VIP - Top Tier").when(value >= high, "High Value").when(value >= mid, "Mid Value").when(value > 0, "Standard").otherwise("New Customer").alias("ltv_tier"),
        F.when(risk >= 0.7, "CRITICAL - High Risk").when(risk >= 0.5, "ELEVATED - Monitor Closely").when(risk >= 0.3, "MODERATE - Standard Care").otherwise("LOW - Healthy").alias("churn_tier"),
        F.when(n == 0, "No purchases yet").when(last <= 30, "Active").when(last <= 60, "Recently Active").when(last <= 90, "Cooling Down").otherwise("At Risk of Lapse").alias("engagement"), relation.alias("relationship"), advice.alias("retention_advice"),
    )
