"""Queries over sales lines and profiles: cleaning, joins, reports, sets, top lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from patronage.operators import axes, cleaning, joins, profiles, reports
from patronage.queries.axes import wide_of
from patronage.queries.registry import BOTH, LINES, ORDERS, WIDE, query, r, rounded
from patronage.sources.tables import Tables

ENTRIES = "(VALUES {})"
RULES_SQL = {
    axis: "CASE " + " ".join(f"WHEN {figure} >= {low} THEN '{name}'" for low, name in bounds[:-1]) + f" ELSE '{bounds[-1][1]}' END" for axis, (figure, bounds) in profiles.RULES.items()
}
SIG_SQL = " || ';' || ".join(f"'{a}=' || {RULES_SQL[a]}" for a in sorted(RULES_SQL))
PROF = WIDE + f""",
prof AS (SELECT customer_id, lifetime_value, total_orders, avg_order_value, days_since_last_purchase, tenure_days, tenure_months, orders_per_month, refund_rate, discount_rate, unique_categories, coalesce(churn_risk_score, 0.5) AS churn_risk_score,
 primary_channel, recent_orders_90d, first_order, last_order, {SIG_SQL} AS signature, 'arch_' || substr(sha256({SIG_SQL}), 1, 12) AS archetype_id, c_mktsegment AS store_id,
 {', '.join(f"{e} AS seg_{a}" for a, e in RULES_SQL.items())} FROM wide LEFT JOIN customer ON customer_id = c_custkey),
seg AS ({' UNION ALL '.join(f"SELECT customer_id, lifetime_value, '{a}' AS axis, seg_{a} AS segment FROM prof" for a in RULES_SQL)}),
cnt AS (SELECT axis, segment, count(*) AS n FROM seg GROUP BY 1, 2)"""


def profiles_of(t: Tables):
    return profiles.profiles(wide_of(t), t.stores)


def orders_of(t: Tables):
    return cleaning.to_orders(t.sales_lines)


def ref_of(t: Tables):
    return axes.reference_date_of(t.headers)


@query("CLEAN-1", f"WITH {ORDERS} SELECT customer_id, order_id, order_date, round(total_price, 6) AS total_price, round(discount_amount, 6) AS discount_amount, source FROM ord")
def clean_1(t):
    return rounded(orders_of(t))


@query("CLEAN-2", f"WITH {LINES} SELECT customer_id, order_id, min(order_date) AS order_date, round(sum(line_item_sales), 4) AS sales, CAST(sum(quantity) AS BIGINT) AS quantity FROM lines GROUP BY 1, 2")
def clean_2(t):
    return rounded(cleaning.order_totals(t.sales_lines), 4)


@query("CLEAN-3", f"WITH {BOTH} SELECT customer_id, order_id, product_id, category, product_type, quantity, round(price, 6) AS price, round(refund_amount, 6) AS refund_amount FROM items")
def clean_3(t):
    return rounded(cleaning.to_items(t.sales_lines))


@query("CLEAN-4", "SELECT o_custkey AS customer_id, count(*) AS n FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1")
def clean_4(t):
    return t.headers.where(F.col("customer_id").isNotNull()).groupBy("customer_id").agg(F.count("*").alias("n"))


ODD = "CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 7 = 1 THEN 'NaN'::DOUBLE WHEN c_custkey % 7 = 2 THEN 'Infinity'::DOUBLE WHEN c_custkey % 7 = 3 THEN '-Infinity'::DOUBLE ELSE c_acctbal END"


def _odd_balance(t):
    m = F.col("customer_id") % 7
    return t.stores.select("customer_id", F.when(m == 0, F.lit(None)).when(m == 1, float("nan")).when(m == 2, float("inf")).when(m == 3, float("-inf")).otherwise(F.col("balance")).alias("x"))


@query("CLEAN-5", f"SELECT c_custkey AS customer_id, CASE WHEN x IS NULL OR isnan(x) THEN 0 WHEN x = 'Infinity'::DOUBLE THEN 1e10 WHEN x = '-Infinity'::DOUBLE THEN -1e10 ELSE x END AS x FROM (SELECT c_custkey, {ODD} AS x FROM customer)")
def clean_5(t):
    return _odd_balance(t).select("customer_id", cleaning.nan_to_zero(F.col("x")).alias("x"))


@query("CLEAN-6", "WITH q AS (SELECT c_custkey, CASE WHEN c_custkey % 7 > 1 THEN c_acctbal END AS x FROM customer) SELECT c_custkey AS customer_id, round(coalesce(x, (SELECT avg(x) FROM q)), 6) AS x FROM q")
def clean_6(t):
    m = F.col("customer_id") % 7
    df = t.stores.select("customer_id", F.when(m == 0, F.lit(None)).when(m == 1, float("nan")).otherwise(F.col("balance")).alias("x"))
    return rounded(cleaning.nan_to_mean(df, ["x"]))


@query("JOIN-1", f"WITH {LINES} SELECT order_id, line_number, product_id, supplier_id, round(line_item_sales, 6) AS line_item_sales, customer_id, order_date, order_total, sales_channel FROM lines")
def join_1(t):
    return rounded(joins.combine_sales(t.raw_lines, t.headers).select("order_id", "line_number", "product_id", "supplier_id", "line_item_sales", "customer_id", "order_date", "order_total", "sales_channel"))


DAYS = "o AS (SELECT o_custkey AS customer_id, o_orderkey AS order_id, CAST(o_orderdate AS DATE) AS day FROM orders)"


@query("JOIN-2", f"WITH {DAYS} SELECT a.customer_id, a.order_id, CAST(a.day AS VARCHAR) AS day, b.order_id AS other_order_id, CAST(b.day AS VARCHAR) AS other_day FROM o a JOIN o b ON a.customer_id = b.customer_id AND abs(date_diff('day', a.day, b.day)) <= 1 WHERE a.order_id < b.order_id")
def join_2(t):
    o = t.headers.select("customer_id", "order_id", F.to_date("order_date").alias("day"))
    return joins.join_date_tolerant(o, o).where("order_id < other_order_id").select("customer_id", "order_id", F.col("day").cast("string").alias("day"), "other_order_id", F.col("other_day").cast("string").alias("other_day"))


@query("JOIN-2-nearest", f"WITH {DAYS}, s AS (SELECT o_custkey AS customer_id, l_orderkey AS order_id, min(CAST(l_shipdate AS DATE)) AS day FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2), p AS (SELECT s.order_id, o.order_id AS other, o.day AS other_day, abs(date_diff('day', s.day, o.day)) AS apart, row_number() OVER (PARTITION BY s.order_id ORDER BY abs(date_diff('day', s.day, o.day)), o.day, o.order_id) AS rn FROM s JOIN o ON s.customer_id = o.customer_id AND abs(date_diff('day', s.day, o.day)) <= 3) SELECT s.customer_id, s.order_id, CAST(s.day AS VARCHAR) AS day, p.other AS other_order_id, CAST(p.other_day AS VARCHAR) AS other_day, CAST(p.apart AS INT) AS days_apart FROM s LEFT JOIN p ON p.order_id = s.order_id AND rn = 1")
def join_2_nearest(t):
    """The first shipment of each order with the nearest order date of its customer, three days away at most."""
    shipped = t.raw_lines.groupBy("order_id").agg(F.min(F.to_date("ship_date")).alias("day")).join(t.headers.select("order_id", "customer_id"), "order_id")
    o = t.headers.select("customer_id", "order_id", F.to_date("order_date").alias("day"))
    d = joins.nearest_by_date(shipped, o, days=3)
    return d.select("customer_id", "order_id", F.col("day").cast("string").alias("day"), "other_order_id", F.col("other_day").cast("string").alias("other_day"), "days_apart")


@query("JOIN-3", f"WITH {DAYS} SELECT a.customer_id, CAST(a.day AS VARCHAR) AS day, a.order_id, b.order_id AS other_order_id FROM o a JOIN o b USING (customer_id, day) WHERE a.order_id < b.order_id")
def join_3(t):
    o = t.headers.select("customer_id", "order_id", F.to_date("order_date").alias("day"))
    return o.join(o.withColumnRenamed("order_id", "other_order_id"), ["customer_id", "day"]).where("order_id < other_order_id").select("customer_id", F.col("day").cast("string").alias("day"), "order_id", "other_order_id")


@query("JOIN-4", "SELECT DISTINCT l_orderkey AS order_id FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority <> '5-LOW')")
def join_4(t):
    return joins.orphans(t.raw_lines, t.headers.where("sales_channel <> '5-LOW'"))


@query("JOIN-5", "SELECT l_orderkey AS order_id, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) GROUP BY 1")
def join_5(t):
    return t.sales_lines.join(t.stores.where("nation_id = 3").select("customer_id"), "customer_id", "left_semi").groupBy("order_id").agg(F.count("*").alias("n"))


@query("JOIN-6", f"WITH {PROF}, arch AS (SELECT archetype_id, count(*) AS members, min(signature) AS signature FROM prof GROUP BY 1) SELECT customer_id, archetype_id, members, arch.signature AS definition FROM prof LEFT JOIN arch USING (archetype_id)")
def join_6(t):
    p = profiles_of(t)
    defs = p.groupBy("archetype_id").agg(F.count("*").alias("members"), F.min("signature").alias("definition"))
    return p.select("customer_id", "archetype_id").join(defs, "archetype_id", "left")


@query("JOIN-9", f"WITH {PROF}, top AS (SELECT archetype_id FROM prof GROUP BY 1 ORDER BY count(*) DESC, archetype_id LIMIT 1) SELECT product_name, CAST(sum(quantity) AS BIGINT) AS units, count(*) AS n FROM lines JOIN prof USING (customer_id) WHERE archetype_id = (SELECT archetype_id FROM top) AND order_date >= (SELECT max(order_date) FROM ord) - INTERVAL 90 DAY GROUP BY 1 ORDER BY units DESC, product_name LIMIT 10")
def join_9(t):
    p = profiles_of(t)
    top = p.groupBy("archetype_id").count().orderBy(F.col("count").desc(), "archetype_id").limit(1).select("archetype_id")
    members = p.join(F.broadcast(top), "archetype_id", "left_semi").select("customer_id")
    recent = t.sales_lines.where(F.col("order_date") >= F.lit(ref_of(t)) - F.expr("INTERVAL 90 DAYS"))
    sold = recent.join(members, "customer_id", "left_semi").groupBy("product_name").agg(F.sum("quantity").alias("units"), F.count("*").alias("n"))
    return reports.top_by(sold, F.col("units").desc(), 10, "product_name")


@query("JOIN-12", f"WITH {LINES}, h AS (SELECT order_id, max(CASE WHEN line_number = 1 THEN fulfillment_status END) AS s FROM lines GROUP BY 1) SELECT 'order_day' AS column_name, count(*) FILTER (CAST(ship_date AS DATE) <> CAST(order_date AS DATE)) AS mismatches FROM lines UNION ALL SELECT 'customer_id', count(*) FILTER (product_id <> customer_id) FROM lines")
def join_12(t):
    lines = t.raw_lines.select("order_id", F.to_date("ship_date").alias("order_day"), F.col("product_id").alias("customer_id"))
    return joins.mismatches(lines, t.headers.select("order_id", F.to_date("order_date").alias("order_day"), "customer_id"), ["order_day", "customer_id"])


@query("JOIN-13", f"WITH {PROF} SELECT customer_id, archetype_id, count(*) OVER (PARTITION BY signature) AS members FROM prof")
def join_13(t):
    p = profiles_of(t)
    return p.join(p.groupBy("signature").agg(F.count("*").alias("members")), "signature").select("customer_id", "archetype_id", "members")


AGG1 = "SELECT category, round(sum(line_item_sales), 4) AS revenue, count(DISTINCT order_id) AS orders, count(DISTINCT customer_id) AS customers, round(sum(line_item_sales) / count(*), 4) AS avg_line_value, CAST(sum(quantity) AS BIGINT) AS units, round(sum(line_item_sales) / count(DISTINCT customer_id), 4) AS revenue_per_customer FROM lines WHERE order_date >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 12 MONTH GROUP BY 1"


@query("AGG-1", f"WITH {LINES} {AGG1} ORDER BY revenue DESC, category LIMIT 5")
def agg_1(t):
    return rounded(reports.revenue_by_category(t.sales_lines, ref_of(t), 12, 5), 4)


@query("AGG-2", f"WITH {LINES}, c AS (SELECT category, customer_id, count(DISTINCT order_id) AS n FROM lines GROUP BY 1, 2) SELECT category, count(*) AS customers, count(*) FILTER (n > 1) AS repeat_customers, round(100.0 * count(*) FILTER (n > 1) / count(*), 6) AS repurchase_pct, round(avg(n), 6) AS avg_orders FROM c GROUP BY 1")
def agg_2(t):
    return rounded(reports.category_repurchase(t.sales_lines))


@query("AGG-3", f"WITH {ORDERS} SELECT customer_id, count(*) AS orders, round(sum(total_price), 4) AS spend, min(order_date) AS first_order, max(order_date) AS last_order, count(DISTINCT date_trunc('month', order_date)) AS active_months FROM ord GROUP BY 1 HAVING count(*) >= 3")
def agg_3(t):
    return rounded(reports.repeat_customers(orders_of(t)), 4)


@query("AGG-4", f"WITH {ORDERS}, o AS (SELECT customer_id, sum(total_price) AS spend, date_diff('day', max(order_date), (SELECT max(order_date) FROM ord)) AS d FROM ord GROUP BY 1 HAVING count(*) = 1) SELECT customer_id, round(spend, 4) AS spend, CAST(d AS INT) AS days, CASE WHEN d <= 30 THEN 0 WHEN d <= 90 THEN 1 WHEN d <= 180 THEN 2 WHEN d <= 365 THEN 3 ELSE 4 END AS band FROM o")
def agg_4(t):
    return rounded(reports.one_time_customers(orders_of(t), ref_of(t)), 4)


@query("AGG-5", f"WITH {PROF} SELECT axis, segment, n FROM cnt")
def agg_5(t):
    return reports.distribution(profiles_of(t), "dominant_segments")


@query("AGG-6", f"WITH {PROF} SELECT count(*) AS total, count(*) AS with_segments, 1.0 AS rate FROM prof")
def agg_6(t):
    return reports.coverage(profiles_of(t), "dominant_segments")


@query("AGG-7", f"WITH {PROF}, k AS (SELECT *, row_number() OVER (PARTITION BY axis ORDER BY n, segment) AS i, count(*) OVER (PARTITION BY axis) AS k FROM cnt), z AS (SELECT axis, stddev_pop(n) / avg(n) AS cv, CAST(sum((2 * i - k - 1) * n) AS DOUBLE) / (max(k) * sum(n)) AS gini, max(n) AS largest, min(n) AS smallest, CAST(max(n) AS DOUBLE) / min(n) AS ratio FROM k GROUP BY 1) SELECT axis, round(cv, 6) AS cv, round(gini, 6) AS gini, largest, smallest, round(ratio, 6) AS ratio, CASE WHEN cv < 0.3 THEN 'excellent' WHEN cv < 0.5 THEN 'good' WHEN cv < 0.7 THEN 'fair' ELSE 'poor' END AS quality FROM z")
def agg_7(t):
    return rounded(reports.balance(reports.distribution(profiles_of(t), "dominant_segments")))


@query("AGG-8", f"WITH {PROF}, z AS (SELECT axis, segment, n, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY axis) AS share FROM cnt) SELECT axis, segment, n, round(share, 6) AS share, CASE WHEN share < 0.2 THEN 'tiny' ELSE 'dominant' END AS kind FROM z WHERE share < 0.2 OR share > 0.6")
def agg_8(t):
    return rounded(reports.odd_segments(reports.distribution(profiles_of(t), "dominant_segments"), 0.2, 0.6))


SEGV = "SELECT axis || ':' || segment AS name, count(*) AS member_count, round(avg(lifetime_value), 4) AS avg_ltv, round(sum(lifetime_value), 4) AS total_ltv FROM seg GROUP BY 1"


@query("AGG-9", f"WITH {PROF} {SEGV} ORDER BY member_count DESC, name LIMIT 5")
def agg_9(t):
    return rounded(reports.top_by(reports.segment_values(profiles_of(t), "dominant_segments"), F.col("member_count").desc(), 5, "name"), 4)


@query("AGG-10", f"WITH {PROF} SELECT seg_purchase_value AS segment, count(*) AS n, round(avg(lifetime_value), 4) AS avg_ltv, round(avg(total_orders), 6) AS avg_orders, round(avg(avg_order_value), 4) AS avg_aov, round(sum(lifetime_value), 4) AS total_ltv FROM prof GROUP BY 1")
def agg_10(t):
    return profiles_of(t).groupBy(F.col("dominant_segments")["purchase_value"].alias("segment")).agg(F.count("*").alias("n"), r(F.avg("lifetime_value"), 4).alias("avg_ltv"), r(F.avg("total_orders")).alias("avg_orders"), r(F.avg("avg_order_value"), 4).alias("avg_aov"), r(F.sum("lifetime_value"), 4).alias("total_ltv"))


@query("AGG-11", f"WITH {PROF} SELECT seg_purchase_value AS down, count(*) FILTER (seg_purchase_frequency = 'frequent') AS frequent, count(*) FILTER (seg_purchase_frequency = 'regular') AS regular, count(*) FILTER (seg_purchase_frequency = 'rare') AS rare FROM prof GROUP BY 1")
def agg_11(t):
    return reports.heat_map(profiles_of(t), "dominant_segments", "purchase_value", "purchase_frequency", ["frequent", "regular", "rare"])


@query("AGG-12", f"WITH {PROF} SELECT round(sum(lifetime_value), 4) AS total_ltv, round(avg(avg_order_value), 4) AS avg_aov, round(100.0 * count(*) FILTER (total_orders > 1) / count(*), 6) AS repeat_pct, round(100.0 * count(*) FILTER (churn_risk_score > 0.7) / count(*), 6) AS high_churn_pct, CAST(min(days_since_last_purchase) AS BIGINT) AS freshness_days, (SELECT round(stddev_pop(n) / avg(n), 6) FROM cnt) AS size_cv FROM prof")
def agg_12(t):
    p = profiles_of(t)
    sizes = reports.distribution(p, "dominant_segments").agg(r(F.stddev_pop("n") / F.avg("n")).alias("size_cv"))
    return p.agg(
        r(F.sum("lifetime_value"), 4).alias("total_ltv"), r(F.avg("avg_order_value"), 4).alias("avg_aov"), r(100 * F.count_if(F.col("total_orders") > 1) / F.count("*")).alias("repeat_pct"),
        r(100 * F.count_if(F.col("churn_risk_score") > 0.7) / F.count("*")).alias("high_churn_pct"), F.min("days_since_last_purchase").cast("long").alias("freshness_days"),
    ).crossJoin(F.broadcast(sizes))


@query("AGG-13", f"WITH {PROF} SELECT seg_purchase_frequency AS frequency, seg_purchase_value AS value, seg_customer_maturity AS maturity, count(*) AS n, round(avg(lifetime_value), 4) AS avg_ltv, round(100.0 * count(*) FILTER (churn_risk_score >= 0.7) / count(*), 6) AS high_risk_pct FROM prof GROUP BY CUBE (1, 2, 3)")
def agg_13(t):
    s = F.col("dominant_segments")
    p = profiles_of(t).select(s["purchase_frequency"].alias("frequency"), s["purchase_value"].alias("value"), s["customer_maturity"].alias("maturity"), "lifetime_value", "churn_risk_score")
    return p.cube("frequency", "value", "maturity").agg(F.count("*").alias("n"), r(F.avg("lifetime_value"), 4).alias("avg_ltv"), r(100 * F.count_if(F.col("churn_risk_score") >= 0.7) / F.count("*")).alias("high_risk_pct"))


@query("AGG-14", f"WITH {PROF}, s AS (SELECT churn_risk_score AS c FROM prof) SELECT round(avg(c), 6) AS mean_risk, round(median(c), 6) AS median_risk, round(100.0 * count(*) FILTER (c < 0.2) / count(*), 6) AS low_pct, round(100.0 * count(*) FILTER (c >= 0.2 AND c < 0.5) / count(*), 6) AS medium_pct, round(100.0 * count(*) FILTER (c >= 0.5 AND c < 0.75) / count(*), 6) AS high_pct, round(100.0 * count(*) FILTER (c >= 0.75) / count(*), 6) AS critical_pct, round(100.0 * count(*) FILTER (c >= 0.5) / count(*), 6) AS at_risk_pct FROM s")
def agg_14(t):
    return rounded(reports.churn_bands(profiles_of(t)))


@query("AGG-15", f"WITH {PROF} {SEGV} ORDER BY total_ltv DESC, name LIMIT 4")
def agg_15(t):
    return rounded(reports.top_by(reports.segment_values(profiles_of(t), "dominant_segments"), F.col("total_ltv").desc(), 4, "name"), 4)


@query("AGG-16", f"WITH {PROF} SELECT archetype_id, count(*) AS member_count, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (), 6) AS population_pct, round(avg(lifetime_value), 4) AS avg_ltv, round(avg(total_orders), 4) AS avg_orders, round(avg(churn_risk_score), 4) AS avg_churn FROM prof GROUP BY 1")
def agg_16(t):
    d = reports.archetype_stats(profiles_of(t))
    return d.select("archetype_id", "member_count", r("population_pct").alias("population_pct"), *[r(c, 4).alias(c) for c in ("avg_ltv", "avg_orders", "avg_churn")])


#: Sort keys of the archetype ranking: column, and whether the smallest come first.
RANKINGS = {"n": False, "avg_ltv": False, "total_ltv": False, "avg_order": False, "frequency": False, "recency": True, "churn": False}
RANKED_SQL = "g AS (SELECT archetype_id, count(*) AS n, round(avg(lifetime_value), 4) AS avg_ltv, round(sum(lifetime_value), 2) AS total_ltv, round(avg(avg_order_value), 4) AS avg_order, round(avg(orders_per_month), 6) AS frequency, round(avg(days_since_last_purchase), 4) AS recency, round(avg(churn_risk_score), 6) AS churn FROM prof GROUP BY 1)"


@query("AGG-17", f"WITH {PROF}, {RANKED_SQL} " + " UNION ALL ".join(f"(SELECT '{k}' AS sort_key, * FROM g ORDER BY {k} {'ASC' if up else 'DESC'}, archetype_id LIMIT 7)" for k, up in RANKINGS.items()))
def agg_17(t):
    mean = lambda c, digits: r(F.avg(c), digits)
    g = profiles_of(t).groupBy("archetype_id").agg(
        F.count("*").alias("n"), mean("lifetime_value", 4).alias("avg_ltv"), r(F.sum("lifetime_value"), 2).alias("total_ltv"), mean("avg_order_value", 4).alias("avg_order"),
        mean("orders_per_month", 6).alias("frequency"), mean("days_since_last_purchase", 4).alias("recency"), mean("churn_risk_score", 6).alias("churn"),
    )
    return reports.rankings(g, RANKINGS, 7, "archetype_id")


@query("AGG-18", f"WITH {PROF} SELECT round(avg(lifetime_value) FILTER (lifetime_value > 0), 4) AS avg_ltv, count(*) FILTER (lifetime_value > 0) AS n FROM prof")
def agg_18(t):
    paid = F.col("lifetime_value") > 0
    return profiles_of(t).agg(r(F.avg(F.when(paid, F.col("lifetime_value"))), 4).alias("avg_ltv"), F.count_if(paid).alias("n"))


@query("AGG-20", "SELECT count(*) AS total, count(o_orderkey) AS matched, count(*) - count(o_orderkey) AS unmatched, round(100.0 * count(o_orderkey) / count(*), 6) AS match_pct FROM lineitem LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderpriority <> '5-LOW') ON l_orderkey = o_orderkey")
def agg_20(t):
    return rounded(joins.match_profile(t.raw_lines, t.headers.where("sales_channel <> '5-LOW'")))


@query("AGG-21", f"WITH {LINES}, d AS (SELECT date_diff('day', CAST(order_date AS DATE), CAST(ship_date AS DATE)) AS diff FROM lines), b AS (SELECT CAST(floor(diff / 100.0) * 100 AS BIGINT) AS bucket, count(*) AS n FROM d GROUP BY 1) SELECT bucket, n, round(100.0 * n / sum(n) OVER (), 6) AS pct FROM b")
def agg_21(t):
    from pyspark.sql.window import Window as W

    diff = F.datediff("ship_date", "order_date")
    b = t.sales_lines.groupBy((F.floor(diff / 100) * 100).alias("bucket")).agg(F.count("*").alias("n"))
    return b.select("bucket", "n", r(100 * F.col("n") / F.sum("n").over(W.partitionBy())).alias("pct"))


@query("AGG-22", "SELECT l_orderkey AS order_id, CAST(l_linenumber AS BIGINT) AS line_number, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def agg_22(t):
    return reports.duplicate_keys(t.raw_lines.withColumn("line_number", F.col("line_number").cast("long")), ["order_id", "line_number"])


@query("AGG-22-nulls", f"WITH {WIDE} SELECT 'value_consistency' AS column_name, count(*) FILTER (value_consistency IS NULL) AS nulls, round(100.0 * count(*) FILTER (value_consistency IS NULL) / count(*), 6) AS null_pct FROM wide UNION ALL SELECT 'purchase_consistency', count(*) FILTER (purchase_consistency IS NULL), round(100.0 * count(*) FILTER (purchase_consistency IS NULL) / count(*), 6) FROM wide")
def agg_22_nulls(t):
    return rounded(reports.null_counts(wide_of(t), ["value_consistency", "purchase_consistency"]))


NUMERIC = ("total_orders", "lifetime_value", "avg_order_value", "tenure_months", "refund_rate", "discount_rate", "unique_categories", "orders_per_month")


@query("AGG-23", f"WITH {WIDE}, c AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM wide" for i, a in enumerate(NUMERIC) for b in NUMERIC[i + 1 :]) + ") SELECT a, b, round(r, 6) AS r, CASE WHEN abs(r) > 0.7 THEN 'strong' ELSE 'moderate' END AS strength FROM c WHERE abs(r) >= 0.4")
def agg_23(t):
    return rounded(reports.correlations(wide_of(t), list(NUMERIC)))


@query("AGG-25", f"WITH {PROF} SELECT seg_customer_maturity AS class, count(*) AS n, round(sum(lifetime_value) / sum(sum(lifetime_value)) OVER (), 6) AS revenue_share, round(avg(CASE WHEN total_orders > 1 THEN 1.0 ELSE 0 END), 6) AS repeat_rate FROM prof GROUP BY 1")
def agg_25(t):
    from pyspark.sql.window import Window as W

    g = profiles_of(t).groupBy(F.col("dominant_segments")["customer_maturity"].alias("class")).agg(F.count("*").alias("n"), F.sum("lifetime_value").alias("s"), r(F.avg((F.col("total_orders") > 1).cast("double"))).alias("repeat_rate"))
    return g.select("class", "n", r(F.col("s") / F.sum("s").over(W.partitionBy())).alias("revenue_share"), "repeat_rate")


@query("AGG-26", f"WITH {WIDE} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(CAST(min({c}) AS DOUBLE), 6) AS min, round(CAST(max({c}) AS DOUBLE), 6) AS max, round(avg({c}), 6) AS mean, round(median({c}), 6) AS median, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.75), 6) AS p75 FROM wide" for c in NUMERIC))
def agg_26(t):
    return rounded(reports.column_stats(wide_of(t), list(NUMERIC)))


@query("AGG-27", f"WITH {PROF}, s AS (SELECT * FROM prof WHERE days_since_last_purchase <= 365) SELECT count(DISTINCT store_id) AS companies, round(avg(lifetime_value), 4) AS avg_ltv, round(quantile_cont(lifetime_value, 0.25), 4) AS p25, round(quantile_cont(lifetime_value, 0.5), 4) AS p50, round(quantile_cont(lifetime_value, 0.75), 4) AS p75 FROM s")
def agg_27(t):
    s = profiles_of(t).where("days_since_last_purchase <= 365")
    p = F.percentile("lifetime_value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return s.agg(F.countDistinct("store_id").alias("companies"), r(F.avg("lifetime_value"), 4).alias("avg_ltv"), p.alias("p")).select("companies", "avg_ltv", *[r(F.col("p")[k], 4).alias(n) for k, n in enumerate(("p25", "p50", "p75"))])


@query("AGG-27-segments", f"WITH {PROF} SELECT axis, segment, count(DISTINCT c_mktsegment) AS companies, count(*) AS n FROM seg JOIN customer ON customer_id = c_custkey GROUP BY 1, 2 HAVING count(DISTINCT c_mktsegment) >= 3")
def agg_27_segments(t):
    return profiles_of(t).select("store_id", F.explode("dominant_segments").alias("axis", "segment")).groupBy("axis", "segment").agg(F.countDistinct("store_id").alias("companies"), F.count("*").alias("n")).where("companies >= 3")


@query("FLT-1", f"WITH {PROF} SELECT customer_id, archetype_id FROM prof WHERE seg_purchase_value = 'high' AND seg_customer_maturity = 'veteran' ORDER BY customer_id LIMIT 50")
def flt_1(t):
    s = F.col("dominant_segments")
    return profiles_of(t).where((s["purchase_value"] == "high") & (s["customer_maturity"] == "veteran")).select("customer_id", "archetype_id").orderBy("customer_id").limit(50)


@query("FLT-2", f"WITH {PROF} (SELECT 'value' AS list, customer_id, round(lifetime_value, 4) AS figure FROM prof WHERE lifetime_value >= 1000000 ORDER BY lifetime_value DESC, customer_id LIMIT 20) UNION ALL (SELECT 'churn', customer_id, round(churn_risk_score, 4) FROM prof WHERE churn_risk_score >= 0.7 ORDER BY churn_risk_score DESC, customer_id LIMIT 20)")
def flt_2(t):
    p = profiles_of(t)
    value = reports.top_by(p.where("lifetime_value >= 1000000"), F.col("lifetime_value").desc(), 20, "customer_id").select(F.lit("value").alias("list"), "customer_id", r("lifetime_value", 4).alias("figure"))
    churn = reports.top_by(p.where("churn_risk_score >= 0.7"), F.col("churn_risk_score").desc(), 20, "customer_id").select(F.lit("churn").alias("list"), "customer_id", r("churn_risk_score", 4).alias("figure"))
    return value.unionByName(churn)


@query("FLT-3", "SELECT c_custkey AS customer_id FROM customer WHERE lower(c_name) LIKE lower('CUSTOMER%7')")
def flt_3(t):
    return t.stores.where(F.lower("customer_name").like("customer%7")).select("customer_id")


@query("FLT-4", f"WITH {LINES}, h AS (SELECT * FROM lines WHERE order_date >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 360 DAY) SELECT customer_id, order_id, count(*) AS hits, string_agg(product_name, '|' ORDER BY product_name, line_number, product_id, supplier_id) AS titles FROM h WHERE contains(lower(product_name), 'a') OR contains(lower(product_name), '13') GROUP BY 1, 2")
def flt_4(t):
    terms = F.transform(F.split(F.lit("A, 13"), ","), lambda x: F.lower(F.trim(x)))
    recent = t.sales_lines.where(F.col("order_date") >= F.lit(ref_of(t)) - F.expr("INTERVAL 360 DAYS"))
    hit = recent.where(F.exists(terms, lambda x: F.lower("product_name").contains(x)))
    return hit.groupBy("customer_id", "order_id").agg(F.count("*").alias("hits"), F.array_join(F.sort_array(F.collect_list("product_name")), "|").alias("titles"))


@query("FLT-12", f"WITH {PROF} SELECT customer_id, round(lifetime_value, 4) AS lifetime_value FROM prof WHERE store_id = 'BUILDING'")
def flt_12(t):
    return profiles_of(t).where("store_id = 'BUILDING'").select("customer_id", r("lifetime_value", 4).alias("lifetime_value"))


@query("FLT-13", f"WITH {PROF} SELECT customer_id, total_orders FROM prof WHERE total_orders >= 2")
def flt_13(t):
    return profiles_of(t).where("total_orders >= 2").select("customer_id", "total_orders")


@query("SET-1", "SELECT 'orders' AS source, min(o_orderkey) AS low, max(o_orderkey) AS high, count(*) AS n FROM orders UNION ALL SELECT 'lines', min(l_orderkey), max(l_orderkey), count(*) FROM lineitem")
def set_1(t):
    span = lambda df, name: df.agg(F.min("order_id").alias("low"), F.max("order_id").alias("high"), F.count("*").alias("n")).select(F.lit(name).alias("source"), "low", "high", "n")
    return span(t.headers, "orders").unionByName(span(t.raw_lines, "lines"))


@query("SET-3", "SELECT o_orderkey AS order_id FROM orders EXCEPT SELECT l_orderkey FROM lineitem WHERE l_linenumber <= 2")
def set_3(t):
    return t.headers.select("order_id").subtract(t.raw_lines.where("line_number <= 2").select("order_id"))


@query("SET-6", "SELECT DISTINCT user_id AS entity, event_type FROM events")
def set_6(t):
    return t.events.select("entity", "event_type").distinct()


@query("WIN-1", f"WITH {ORDERS} SELECT customer_id, order_id, CAST(date_diff('day', lag(order_date) OVER (PARTITION BY customer_id ORDER BY order_date, order_id), order_date) AS INT) AS gap FROM ord")
def win_1(t):
    from pyspark.sql.window import Window as W

    w = W.partitionBy("customer_id").orderBy("order_date", "order_id")
    return orders_of(t).select("customer_id", "order_id", axes.days_between(F.col("order_date"), F.lag("order_date").over(w)).alias("gap"))


@query("WIN-2", f"WITH {ORDERS} SELECT customer_id, order_id, coalesce(source <> lag(source) OVER (PARTITION BY customer_id ORDER BY order_date, order_id), true) AS switched FROM ord")
def win_2(t):
    from pyspark.sql.window import Window as W

    w = W.partitionBy("customer_id").orderBy("order_date", "order_id")
    return orders_of(t).select("customer_id", "order_id", (~F.col("source").eqNullSafe(F.lag("source").over(w))).alias("switched"))


@query("WIN-3", f"WITH {ORDERS} SELECT customer_id, order_id, row_number() OVER (PARTITION BY customer_id ORDER BY order_date, order_id) - 1 AS order_index FROM ord")
def win_3(t):
    from pyspark.sql.window import Window as W

    return orders_of(t).select("customer_id", "order_id", (F.row_number().over(W.partitionBy("customer_id").orderBy("order_date", "order_id")) - 1).cast("long").alias("order_index"))


@query("WIN-4", f"WITH {WIDE} SELECT customer_id, product_id, CAST(q AS BIGINT) AS quantity, r AS place FROM pk WHERE r <= greatest(1, CAST(floor(m * 0.2) AS BIGINT))")
def win_4(t):
    from pyspark.sql.window import Window as W

    mine = W.partitionBy("customer_id")
    p = cleaning.to_items(t.sales_lines).groupBy("customer_id", "product_id").agg(F.sum("quantity").alias("quantity"))
    p = p.withColumn("place", F.row_number().over(mine.orderBy(F.col("quantity").desc(), "product_id")).cast("long")).withColumn("m", F.count("*").over(mine))
    return p.where(F.col("place") <= F.greatest(F.lit(1), F.floor(F.col("m") * 0.2))).drop("m")


@query("WIN-8", f"WITH {PROF} SELECT customer_id, round((rank() OVER (ORDER BY lifetime_value) - 1) / CAST(count(*) OVER () AS DOUBLE), 6) AS percentile FROM prof")
def win_8(t):
    from patronage.operators.ranks import global_percentile

    return rounded(global_percentile(profiles_of(t).select("customer_id", "lifetime_value"), "lifetime_value", "percentile").drop("lifetime_value"))


@query("TOP-1", f"WITH {PROF} SELECT archetype_id, count(*) AS n FROM prof GROUP BY 1 ORDER BY n DESC, archetype_id LIMIT 10")
def top_1(t):
    return reports.top_by(profiles_of(t).groupBy("archetype_id").agg(F.count("*").alias("n")), F.col("n").desc(), 10, "archetype_id")


@query("TOP-3", f"WITH {PROF} SELECT customer_id, round(lifetime_value, 4) AS lifetime_value FROM prof ORDER BY lifetime_value DESC, customer_id LIMIT 10")
def top_3(t):
    return reports.top_by(profiles_of(t), F.col("lifetime_value").desc(), 10, "customer_id").select("customer_id", r("lifetime_value", 4).alias("lifetime_value"))
