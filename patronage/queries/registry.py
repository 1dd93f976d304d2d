"""How queries are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patronage.sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of ``Tables`` under an operator's id, with SQL that gives the same rows."""

    def put(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn

    return put


def rounded(df: DataFrame, digits: int = 6, keep: tuple[str, ...] = ()) -> DataFrame:
    """Doubles rounded, other columns as they are."""
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") and c not in keep else F.col(c) for c, t in df.dtypes])


def r(c: Column | str, digits: int = 6) -> Column:
    return F.round(c, digits)


#: Common table expressions of the oracles.
LINES = """lines AS (SELECT l_orderkey AS order_id, l_linenumber AS line_number, l_partkey AS product_id, l_suppkey AS supplier_id, CAST(l_quantity AS BIGINT) AS quantity,
 l_extendedprice * (1 - l_discount) AS line_item_sales, l_extendedprice * l_discount AS line_item_discount, CASE WHEN l_returnflag = 'R' THEN l_extendedprice * (1 - l_discount) ELSE 0 END AS line_item_refunds,
 l_shipdate AS ship_date, l_extendedprice AS list_price, o_custkey AS customer_id, o_orderdate AS order_date, o_totalprice AS order_total,
 CASE o_orderpriority WHEN '1-URGENT' THEN 'pos' WHEN '2-HIGH' THEN 'web' WHEN '3-MEDIUM' THEN 'shopify_draft_order' ELSE o_orderpriority END AS sales_channel, o_orderstatus AS fulfillment_status,
 p_name AS product_name, p_type AS category, p_brand AS product_type
 FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey)"""
ORDERS = (
    LINES
    + """,
ord AS (SELECT customer_id, order_id, order_date, order_total AS total_price, line_item_discount AS discount_amount, sales_channel AS source FROM
 (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY line_number, product_id, supplier_id, ship_date, list_price) AS rn FROM lines WHERE customer_id IS NOT NULL) WHERE rn = 1)"""
)
ITEMS = """items AS (SELECT customer_id, order_id, product_id, category, product_type, quantity, line_item_sales AS price, line_item_refunds AS refund_amount FROM lines WHERE product_id IS NOT NULL)"""
BOTH = ORDERS + ",\n" + ITEMS
REF = "(SELECT max(order_date) FROM ord)"
WIDE = (
    BOTH
    + """,
seq AS (SELECT *, row_number() OVER w - 1 AS s, date_diff('day', lag(order_date) OVER w, order_date) AS gap, lag(source) OVER w AS before, first_value(order_date) OVER w AS first_date,
 avg(total_price) OVER (PARTITION BY customer_id) AS mean_price, (SELECT max(order_date) FROM ord) AS ref FROM ord WINDOW w AS (PARTITION BY customer_id ORDER BY order_date, order_id)),
ch AS (SELECT customer_id, source, row_number() OVER (PARTITION BY customer_id ORDER BY count(*) DESC, source) AS rn FROM ord GROUP BY 1, 2),
a AS (SELECT customer_id, count(*) AS n, min(order_date) AS first_order, max(order_date) AS last_order, any_value(ref) AS ref, avg(gap) AS mg, CASE WHEN count(gap) > 1 THEN stddev_samp(gap) END AS gs,
 count(*) FILTER (order_date >= ref - INTERVAL 90 DAY) AS r90, count(*) FILTER (order_date >= ref - INTERVAL 180 DAY AND order_date < ref - INTERVAL 90 DAY) AS p90,
 sum(total_price) AS ltv, avg(total_price) AS aov, median(total_price) AS med, max(total_price) AS mx, CASE WHEN count(*) > 1 THEN stddev_samp(total_price) END AS vs,
 CASE WHEN count(*) >= 3 THEN regr_slope(total_price, s) END AS vslope, CASE WHEN count(*) >= 3 THEN regr_slope(gap, s) END AS gslope,
 count(*) FILTER (discount_amount > 0) AS nc, avg(discount_amount) FILTER (discount_amount > 0) AS mc, avg(discount_amount / total_price) FILTER (discount_amount > 0) AS mcp,
 count(*) FILTER (isodow(order_date) >= 6) AS nw, avg(CASE WHEN hour(order_date) BETWEEN 9 AND 17 THEN 1.0 ELSE 0 END) AS bh, count(*) FILTER (hour(order_date) < 12) AS nm, count(*) FILTER (hour(order_date) BETWEEN 12 AND 17) AS na, count(*) FILTER (hour(order_date) >= 17) AS ne,
 count(DISTINCT source) AS cd, count(*) FILTER (s > 0 AND source <> before) AS sw, max(date_diff('day', first_date, order_date) / 30.44) AS mm, sum(floor(date_diff('day', first_date, order_date) / 30.44)) AS sm, count(*) FILTER (total_price > 2 * mean_price) AS ns
 FROM seq GROUP BY customer_id),
b AS (SELECT *, date_diff('day', first_order, ref) AS td, date_diff('day', first_order, ref) / 30.44 AS tm, date_diff('day', last_order, ref) AS dsl, CAST(ceil(mm + 1) AS DOUBLE) AS k FROM a),
pr AS (SELECT customer_id, product_id, count(*) AS n, sum(quantity) AS q FROM items GROUP BY 1, 2),
pk AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY q DESC, product_id) AS r, count(*) OVER (PARTITION BY customer_id) AS m, CAST(q AS DOUBLE) / sum(q) OVER (PARTITION BY customer_id) AS sh FROM pr),
pa AS (SELECT customer_id, count(*) AS up, sum(sh * sh) AS pc, CAST(count(*) FILTER (n > 1) AS DOUBLE) / count(*) AS rp, coalesce(avg(n) FILTER (n > 1), 0) AS ar, sum(sh) FILTER (r <= greatest(1, CAST(floor(m * 0.2) AS BIGINT))) AS li FROM pk GROUP BY 1),
cr AS (SELECT customer_id, category, count(*) AS n, sum(quantity) AS q FROM items WHERE category IS NOT NULL GROUP BY 1, 2),
cp AS (SELECT *, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY customer_id) AS p FROM cr),
ca AS (SELECT customer_id, count(*) AS uc, sum(-p * ln(p)) / CASE WHEN count(*) > 1 THEN ln(count(*)) ELSE 1 END AS dv, CAST(max(q) AS DOUBLE) / sum(q) AS dom, count(*) FILTER (n >= 3) AS cm FROM cp GROUP BY 1),
it AS (SELECT customer_id, count(*) AS ti, sum(refund_amount) AS tr, CAST(count(*) FILTER (refund_amount > 0) AS DOUBLE) / count(*) AS irp, avg(price) AS aip, CASE WHEN count(*) > 1 THEN stddev_samp(price) END AS ps FROM items GROUP BY 1),
wide AS (SELECT customer_id, n, first_order, last_order, td AS tenure_days, tm > 0 AS some, p90,
 CASE WHEN tm > 0 THEN n / tm ELSE 0 END AS orders_per_month, CASE WHEN n > 1 THEN mg ELSE td END AS avg_days_between_orders, CASE WHEN n = 1 THEN 1.0 ELSE 1 / (1 + gs / CASE WHEN mg = 0 THEN 1 ELSE mg END) END AS purchase_consistency, r90 AS recent_orders_90d, dsl AS days_since_last_purchase, n AS total_orders,
 ltv AS lifetime_value, aov AS avg_order_value, med AS median_order_value, mx AS max_order_value, coalesce(vslope, 0) AS value_trend, 1 / (1 + vs / aov) AS value_consistency,
 uc AS unique_categories, up AS unique_products, dv AS category_diversity, 1 - pc AS product_diversity, dom AS primary_category_dominance, CAST(up AS DOUBLE) / ti AS exploration_breadth,
 CAST(nc AS DOUBLE) / n AS discount_rate, coalesce(mc, 0) AS avg_discount_amount, coalesce(mcp, 0) AS avg_discount_pct, 1 - CAST(nc AS DOUBLE) / n AS full_price_ratio, CAST(nc AS DOUBLE) / n AS discount_dependency,
 CAST(nw AS DOUBLE) / CASE WHEN n = nw THEN 1 ELSE n - nw END AS weekend_vs_weekday_ratio, bh AS business_hours_ratio, CAST(nw AS DOUBLE) / n AS weekend_rate, CASE WHEN na > nm AND na > ne THEN 1 WHEN ne > nm AND ne > na THEN 2 ELSE 0 END AS preferred_time_numeric,
 tm AS tenure_months, CASE WHEN tm >= 24 THEN 2 WHEN tm >= 12 THEN 1 ELSE 0 END + CASE WHEN n >= 20 THEN 3 WHEN n >= 10 THEN 2 WHEN n >= 5 THEN 1 ELSE 0 END AS customer_maturity_score, CASE WHEN tm < 3 THEN 0 WHEN tm < 12 THEN 1 WHEN tm < 24 THEN 2 ELSE 3 END AS lifecycle_stage,
 n / CASE WHEN tm = 0 THEN 1 ELSE tm END AS orders_per_tenure_month, CASE WHEN tm >= 6 THEN (r90 / 3.0 - n / tm) / (n / tm) ELSE 0 END AS acceleration,
 rp AS repeat_product_rate, ar AS avg_repurchase_count, li AS loyalty_index, 1 - li AS purchase_variety,
 CASE WHEN ltv > 0 THEN tr / ltv ELSE 0 END AS refund_rate, irp AS items_returned_pct, tr AS total_refunds, CASE WHEN tr > 0 THEN 1.0 ELSE 0.0 END AS has_returns,
 CASE ch.source WHEN 'web' THEN 0 WHEN 'pos' THEN 1 WHEN 'shopify_draft_order' THEN 2 ELSE -1 END AS primary_channel_numeric, ch.source AS primary_channel, cd AS channel_diversity, CASE WHEN n > 1 THEN CAST(sw AS DOUBLE) / n ELSE 0 END AS channel_switching_rate,
 CAST(up AS DOUBLE) / n AS unique_products_vs_orders, uc AS category_switching,
 CASE WHEN n < 2 THEN NULL WHEN n >= 3 AND mm > 0 AND k >= 2 THEN (k * sm - k * (k - 1) / 2 * n) / (k * ((k - 1) * k * (2 * k - 1) / 6) - (k * (k - 1) / 2) * (k * (k - 1) / 2)) ELSE 0 END AS order_frequency_trend,
 CASE WHEN n < 2 THEN NULL ELSE coalesce(vslope, 0) END AS trajectory_value_trend, CASE WHEN n < 2 THEN NULL ELSE coalesce(-gslope, 0) END AS recency_momentum, CASE WHEN n >= 2 THEN CASE WHEN r90 > 1.5 * p90 THEN 1.0 ELSE 0.0 END END AS acceleration_phase, CASE WHEN n >= 2 THEN CASE WHEN r90 < 0.5 * p90 THEN 1.0 ELSE 0.0 END END AS deceleration_phase,
 CASE WHEN n >= 2 THEN CASE WHEN mg = 0 THEN 1.0 ELSE least(1.0, dsl / (2 * mg)) END END AS churn_risk_score,
 pc AS product_concentration, cm AS categories_mastered, 1 - pc AS exploration_vs_loyalty, aip AS avg_item_price, ps / aip AS price_variance, CAST(nc AS DOUBLE) / n AS discount_hunt_score, 1 - CAST(nc AS DOUBLE) / n AS full_price_comfort, 1 / (1 + vs / aov) AS spend_consistency, CAST(ns AS DOUBLE) / n AS big_splurge_rate
 FROM b JOIN it USING (customer_id) JOIN pa USING (customer_id) LEFT JOIN ca USING (customer_id) JOIN ch USING (customer_id) WHERE ch.rn = 1)"""
)
