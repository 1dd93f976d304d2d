"""Queries of sources, sampling, clustering and trained models."""

from __future__ import annotations

import os
import uuid
from datetime import date

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import functions as F

from patronage.operators import axes, customers, sampling
from patronage.operators import membership as mem
from patronage.operators.scoring import preprocess, training_set
from patronage.plans import churn
from patronage.plans import clustering as cl
from patronage.plans import diagnostics as dg
from patronage.plans import segmentation
from patronage.queries.axes import wide_of
from patronage.queries.registry import BOTH, LINES, ORDERS, WIDE, query, r, rounded
from patronage.queries.sales import PROF, orders_of, profiles_of
from patronage.queries.segments import ALL_AXES, scored_of
from patronage.sources import database, landing
from patronage.sources.landing import work_path

KEY_AXES = {"purchase_value": ("lifetime_value", "avg_order_value", "max_order_value"), "purchase_frequency": ("orders_per_month", "avg_days_between_orders", "total_orders")}


@query("SRC-1", f"WITH {LINES} SELECT customer_id, CAST(order_date AS VARCHAR) AS order_date, product_name, category, quantity, round(line_item_sales, 4) AS line_item_sales FROM lines")
def src_1(t):
    path = landing.work_path(t.spark, "csv")
    names = {v: k for k, v in landing.EXPORT.items()}
    t.sales_lines.select(*[F.col(v).alias(k) for v, k in names.items()]).write.option("header", True).csv(path)
    d = landing.read_lines_csv(t.spark, path)
    return d.select("customer_id", F.col("order_date").cast("string").alias("order_date"), "product_name", "category", "quantity", r("line_item_sales", 4).alias("line_item_sales"))


@query("SRC-2", f"WITH {LINES} SELECT o_orderkey AS order_id, CAST(o_orderdate AS VARCHAR) AS order_date, o_custkey AS customer_id, l.line_number, l.quantity, round(l.line_item_sales, 4) AS line_item_sales FROM orders JOIN lines l ON o_orderkey = l.order_id WHERE o_orderdate >= TIMESTAMP '1999-01-01' AND o_orderdate < TIMESTAMP '2000-03-01'")
def src_2(t):
    """Orders and lines are written to a database and read back by date range; Spark's embedded one in memory unless the session names another."""
    url = t.spark.conf.get("spark.patronage.jdbc.url", "") or f"jdbc:derby:memory:sales{uuid.uuid4().hex};create=true"
    if url.startswith("jdbc:derby:memory") and not t.spark.sparkContext.master.startswith("local"):
        raise ValueError("a database in the driver's memory cannot be read by executors: set spark.patronage.jdbc.url")
    t.spark._jvm.java.lang.System.setProperty("derby.stream.error.file", os.devnull)
    database.write_table(t.headers.select("order_id", "order_date", "customer_id"), url, "sales_orders")
    lines = t.raw_lines.join(t.headers.select("order_id", "order_date"), "order_id")
    database.write_table(lines.select("order_id", "order_date", "line_number", "quantity", "line_item_sales"), url, "sales_lines")
    d = database.read_sales(t.spark, url, "sales_orders", "sales_lines", date(1999, 1, 1), date(2000, 3, 1))
    return d.select("order_id", F.col("order_date").cast("string").alias("order_date"), "customer_id", "line_number", "quantity", r("line_item_sales", 4).alias("line_item_sales"))


@query("SRC-3", f"WITH {LINES}, n AS (SELECT order_id, CAST(sum(quantity) AS BIGINT) AS items FROM lines GROUP BY 1) SELECT order_id, order_id AS order_number, customer_id, product_id, CASE WHEN product_id % 7 = 0 THEN 'Unknown Product' ELSE product_name END AS product_name, product_type, CASE WHEN product_id % 3 = 0 THEN 'v' || product_id ELSE '' END AS variant_name, 'sku-' || product_id AS sku, CAST(quantity AS INT) AS quantity, CAST(floor(line_item_sales) AS BIGINT) AS whole_sales, CASE WHEN order_id % 2 = 0 THEN 'EUR' ELSE 'USD' END AS currency, round(order_total, 2) AS order_total, items AS order_total_items, CASE WHEN order_id % 4 = 0 THEN order_id % 90 + 0.5 END AS latitude, CASE WHEN order_id % 4 = 0 THEN -(order_id % 90) - 0.5 END AS longitude, CASE WHEN order_id % 3 = 0 THEN 'UNFULFILLED' ELSE fulfillment_status END AS fulfillment_status, CASE WHEN order_id % 5 = 0 THEN 'PENDING' ELSE 'PAID' END AS financial_status, CAST(order_date AS VARCHAR) AS order_date, CAST(CASE WHEN order_id % 2 = 0 THEN order_date + INTERVAL 1 HOUR ELSE order_date END AS VARCHAR) AS created_at, CAST(year(order_date) AS INT) AS year, CAST(quarter(order_date) AS INT) AS quarter, CAST(month(order_date) AS INT) AS month, strftime(order_date, '%B') AS month_name, CAST(weekofyear(order_date) AS INT) AS week, CAST(day(order_date) AS INT) AS day, strftime(order_date, '%A') AS week_day FROM lines JOIN n USING (order_id) WHERE order_id % 10 <> 0")
def src_3(t):
    """Orders with lines are written as nested JSON, with fields that some orders lack, landed as text and flattened."""
    o, p = F.col("order_id"), F.col("product_id")
    currency = F.when(o % 2 == 0, "EUR").otherwise("USD")
    # An amount is the shortest text of its double: rounded to digits it can cross a whole number.
    money = lambda c: F.struct(F.struct(c.cast("string").alias("amount"), currency.alias("currencyCode")).alias("shopMoney"))
    product = F.struct(p.cast("string").alias("legacyResourceId"), F.when(p % 7 != 0, F.col("product_name")).alias("title"), F.col("product_type").alias("productType"))
    variant = F.when(p % 3 == 0, F.struct(F.concat(F.lit("v"), p).alias("title")))
    node = F.struct(F.col("quantity").cast("int").alias("quantity"), F.concat(F.lit("sku-"), p).alias("sku"), product.alias("product"), variant.alias("variant"), money(F.col("list_price")).alias("originalTotalSet"), money(F.col("line_item_sales")).alias("discountedTotalSet"))
    head = ("order_id", "customer_id", "order_date", "order_total", "fulfillment_status")
    nested = t.sales_lines.groupBy(*head).agg(F.collect_list(F.struct(node.alias("node"))).alias("edges"))
    customer = F.when(o % 10 != 0, F.struct(F.col("customer_id").cast("string").alias("legacyResourceId")))
    address = F.when(o % 4 == 0, F.struct((o % 90 + 0.5).alias("latitude"), (-(o % 90) - 0.5).alias("longitude")))
    doc = F.to_json(F.struct(
        o.cast("string").alias("legacyResourceId"), F.concat(F.lit("#"), o).alias("name"), F.col("order_date").cast("string").alias("createdAt"), F.when(o % 2 == 0, (F.col("order_date") + F.expr("INTERVAL '1' HOUR")).cast("string")).alias("processedAt"),
        customer.alias("customer"), money(F.col("order_total")).alias("totalPriceSet"), F.when(o % 3 != 0, F.col("fulfillment_status")).alias("displayFulfillmentStatus"), F.when(o % 5 != 0, "PAID").alias("displayFinancialStatus"), address.alias("shippingAddress"), F.struct("edges").alias("lineItems"),
    ))
    path = landing.work_path(t.spark, "orders-json")
    nested.select(doc.alias("value")).write.text(path)
    d = landing.flatten_orders(t.spark.read.text(path))
    texts = [F.col(c).cast("string").alias(c) for c in ("order_date", "created_at")]
    return d.withColumn("whole_sales", F.floor("line_item_sales")).withColumn("order_total", r("order_total", 2)).select("order_id", "order_number", "customer_id", "product_id", "product_name", "product_type", "variant_name", "sku", "quantity", "whole_sales", "currency", "order_total", "order_total_items", "latitude", "longitude", "fulfillment_status", "financial_status", *texts, "year", "quarter", "month", "month_name", "week", "day", "week_day")


@query("SRC-4", "SELECT DISTINCT CAST(conv_id AS VARCHAR) AS id, substr(sha256('ticket:' || conv_id), 1, 16) AS ticket_key, CASE conv_id % 3 WHEN 0 THEN 'c' || conv_id WHEN 1 THEN 'm' || conv_id ELSE 'unknown' END AS customer, CASE conv_id % 2 WHEN 0 THEN 'chat' ELSE 'email' END AS channel, CASE conv_id % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'closed' ELSE 'pending' END AS status, CASE WHEN conv_id % 5 = 0 THEN 'high' ELSE 'normal' END AS priority, CASE WHEN conv_id % 2 = 0 THEN 'a,b' ELSE '' END AS tags FROM conversations")
def src_4(t):
    c = F.col("ticket_id")
    ids = t.messages.select("ticket_id").distinct()
    doc = F.to_json(F.struct(
        c.cast("string").alias("id"), F.when(c % 4 == 0, "open").when(c % 4 == 1, "closed").when(c % 4 == 2, "waiting").alias("status"), F.when(c % 2 == 0, "api").otherwise("email").alias("channel"), (c % 5 == 0).alias("is_unread"),
        F.struct(F.when(c % 3 == 0, F.concat(F.lit("c"), c)).alias("id"), F.when(c % 3 == 1, F.concat(F.lit("m"), c)).alias("email")).alias("customer"), F.when(c % 2 == 0, F.array(F.struct(F.lit("a").alias("name")), F.struct(F.lit("b").alias("name")))).alias("tags"),
    ))
    return landing.normalise_tickets(ids.select(doc.alias("value"))).withColumn("tags", F.array_join("tags", ","))


@query("SRC-5", "SELECT CAST(conv_id * 1000 + turn AS VARCHAR) AS id, CASE WHEN role <> 'user' THEN 'agent' ELSE 'customer' END AS sender, CASE WHEN turn % 2 = 0 THEN text ELSE '<p>' || text || '</p>' END AS content FROM conversations")
def src_5(t):
    even = F.col("message_no") % 2 == 0
    doc = F.to_json(F.struct((F.col("ticket_id") * 1000 + F.col("message_no")).cast("string").alias("id"), F.when(even, F.col("content")).otherwise("").alias("body_text"), F.concat(F.lit("<p>"), "content", F.lit("</p>")).alias("body_html"), F.struct(F.when(F.col("from_agent"), "helpdesk").otherwise("email").alias("type")).alias("source")))
    return landing.normalise_messages(t.messages.select(doc.alias("value")))


@query("SRC-6", f"WITH {LINES} SELECT CAST(year(order_date) AS INT) AS year, CAST(month(order_date) AS INT) AS month, count(*) AS n FROM lines GROUP BY 1, 2")
def src_6(t):
    path = landing.work_path(t.spark, "months")
    lines = t.sales_lines
    landing.write_months(lines.where("order_id % 2 = 0"), path)
    landing.write_months(lines.where("order_id % 2 = 1"), path, "append")
    return t.spark.read.parquet(path).groupBy("year", "month").agg(F.count("*").alias("n"))


@query("SRC-7", "SELECT o_orderkey AS order_id FROM orders WHERE CAST(o_orderdate AS DATE) >= (SELECT CAST(max(o_orderdate) AS DATE) + 1 FROM orders WHERE o_orderdate < TIMESTAMP '2001-01-01')")
def src_7(t):
    return landing.incremental_slice(t.headers, t.headers.where("order_date < timestamp_ntz'2001-01-01'")).select("order_id")


@query("SRC-8", "SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 3 = 0 THEN 'changed' ELSE o_orderstatus END AS fulfillment_status, o_orderpriority IS NOT NULL AS created, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS INT) AS version FROM orders")
def src_8(t):
    base = t.headers.select("order_id", "fulfillment_status", F.lit(True).alias("created"), F.lit(1).alias("version"))
    new = base.where("order_id % 3 = 0").select("order_id", F.lit("changed").alias("fulfillment_status"), F.lit(False).alias("created"), F.lit(2).alias("version"))
    return landing.upsert(base, new, ["order_id"], "version", ("created",))


@query("SRC-9", "SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE o_totalprice END AS total, o_orderstatus AS status FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 0, 'new' FROM orders WHERE o_orderkey % 4 = 1")
def src_9(t):
    h = t.headers.select("order_id", F.col("order_total").alias("total"), F.col("fulfillment_status").alias("status"))
    new = h.where("order_id % 4 IN (0, 1)").select("order_id", F.lit(0.0).alias("total"), F.lit("new").alias("status"))
    return landing.update_columns(h.where("order_id % 2 = 0"), new, ["order_id"], ["total"])


@query("SRC-10", "SELECT c_mktsegment AS store_id, CAST(CASE WHEN c_mktsegment = 'BUILDING' THEN 2 ELSE 1 END AS INT) AS run, count(*) AS n FROM customer GROUP BY 1, 2")
def src_10(t):
    path = landing.work_path(t.spark, "stores")
    first = t.stores.select("customer_id", "store_id", F.lit(1).alias("run"))
    landing.replace_store(first, path)
    landing.replace_store(first.where("store_id = 'BUILDING'").withColumn("run", F.lit(2)), path)
    return t.spark.read.parquet(path).groupBy("store_id", "run").agg(F.count("*").alias("n"))


@query("SRC-11", f"WITH {PROF} SELECT customer_id, seg_purchase_value AS value_segment, seg_return_behavior AS return_segment FROM prof")
def src_11(t):
    text = profiles_of(t).select("customer_id", F.to_json("dominant_segments").alias("j"))
    m = F.from_json("j", "map<string,string>")
    return text.select("customer_id", m["purchase_value"].alias("value_segment"), m["return_behavior"].alias("return_segment"))


TIERS = "tr AS (SELECT 'tier1' AS tier, axis AS k, segment AS name, count(*) AS n, 100.0 * count(*) / (SELECT count(*) FROM prof) AS pct FROM seg GROUP BY 2, 3), ta AS (SELECT 'tier2' AS tier, archetype_id AS k, signature AS name, count(*) AS n, 100.0 * count(*) / (SELECT count(*) FROM prof) AS pct FROM prof GROUP BY 2, 3 ORDER BY n DESC, k LIMIT 50), tv AS (SELECT 'tier3' AS tier, CAST(customer_id AS VARCHAR) AS k, signature AS name, 1 AS n, NULL AS pct FROM prof ORDER BY md5('1:' || customer_id), customer_id LIMIT 10)"


@query("SRC-12", f"WITH {PROF}, {TIERS} SELECT tier, k AS key, name, n, round(pct, 6) AS pct FROM (SELECT * FROM tr UNION ALL SELECT * FROM ta UNION ALL SELECT * FROM tv)")
def src_12(t):
    """The three parts of a run's results written as JSON and read again: all segments, the fifty largest archetypes, vectors of a sample."""
    p, path = profiles_of(t), work_path(t.spark, "results")
    landing.write_results(p, path)
    schema = "key string, name string, n long, pct double"
    one = lambda tier: t.spark.read.schema(schema).json(f"{path}/{tier}").select(F.lit(tier).alias("tier"), "key", "name", "n", r("pct").alias("pct"))
    return one("tier1").unionByName(one("tier2")).unionByName(one("tier3"))


@query("SRC-13", f"WITH {WIDE} SELECT customer_id, round(lifetime_value, 2) AS lifetime_value FROM wide")
def src_13(t):
    path = landing.work_path(t.spark, "wide")
    wide_of(t).select("customer_id", r("lifetime_value", 2).alias("lifetime_value")).orderBy(F.col("lifetime_value").desc(), "customer_id").write.option("header", True).csv(path)
    return t.spark.read.schema("customer_id long, lifetime_value double").option("header", True).csv(path)


@query("SMP-1", f"WITH {PROF}, q AS (SELECT quantile_cont(lifetime_value, 0.5) AS a, quantile_cont(lifetime_value, 0.8) AS b, quantile_cont(lifetime_value, 0.95) AS c FROM prof), k AS (SELECT customer_id, CASE WHEN lifetime_value > c THEN 3 WHEN lifetime_value > b THEN 2 WHEN lifetime_value > a THEN 1 ELSE 0 END AS tier FROM prof, q), d AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY md5('1:' || customer_id), customer_id) AS nth FROM k) SELECT customer_id, tier FROM d WHERE nth <= CASE tier WHEN 0 THEN 40 WHEN 1 THEN 60 WHEN 2 THEN 60 ELSE 40 END")
def smp_1(t):
    return sampling.tiered(profiles_of(t), "customer_id", "lifetime_value", 200, by=sampling.digest).select("customer_id", "tier")


@query("SMP-2", "WITH k AS (SELECT c_custkey AS customer_id, c_mktsegment AS store_id, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('1:' || c_custkey), c_custkey) AS nth FROM customer), s AS (SELECT count(DISTINCT store_id) AS n FROM k), b AS (SELECT customer_id, store_id FROM k, s WHERE nth <= (20 * s.n + 7) // s.n), m AS (SELECT customer_id, store_id FROM k WHERE customer_id NOT IN (SELECT customer_id FROM b) ORDER BY md5('2:' || customer_id), customer_id LIMIT greatest(0, (SELECT 20 * n + 7 FROM s) - (SELECT count(*) FROM b))) SELECT * FROM b UNION ALL SELECT * FROM m")
def smp_2(t):
    """Equal quotas and a remainder of seven, topped up from all that were not drawn."""
    strata = t.stores.select("store_id").distinct().count()
    return sampling.stratified(t.stores, "customer_id", "store_id", 20 * strata + 7, strata, by=sampling.digest).select("customer_id", "store_id")


@query("SMP-3")
def smp_3(t):
    return sampling.weighted(profiles_of(t), "customer_id", F.col("lifetime_value"), 100).select("customer_id", r("lifetime_value", 4).alias("lifetime_value"))


@query("SMP-5", f"WITH n AS (SELECT count(*) AS n FROM customer), x AS (SELECT unnest([{', '.join(repr(a) for a in axes.AXES)}]) AS axis) SELECT axis, CASE WHEN axis IN ('purchase_value', 'value_sophistication') THEN 'weighted' WHEN axis IN ('customer_maturity', 'loyalty_trajectory') THEN 'recent' WHEN axis IN ('category_exploration', 'communication_preference', 'problem_complexity_profile', 'product_knowledge') THEN 'diverse' ELSE 'tiered' END AS strategy, CAST(greatest(500, least(5000, CAST(floor(n * CASE WHEN n < 10000 THEN 0.25 WHEN n < 100000 THEN 0.05 ELSE 0.03 END) AS INT))) AS INT) AS sample_size, n FROM n, x")
def smp_5(t):
    n = t.stores.count()
    return t.spark.createDataFrame([(a, sampling.strategy(a), sampling.sample_size(n), n) for a in axes.AXES], "axis string, strategy string, sample_size int, n long")


@query("SMP-6", "SELECT c_custkey AS customer_id FROM customer ORDER BY md5('1:' || c_custkey), c_custkey LIMIT 100")
def smp_6(t):
    return sampling.at_random(t.stores, "customer_id", 100).select("customer_id")


def points_of(t, features):
    """Scaled points of some features, which are written once: quantiles and scaling read them five times."""
    path = work_path(t.spark, "own-features")
    wide_of(t).select("customer_id", *features).write.parquet(path)
    w = t.spark.read.parquet(path)
    return cl.vectors(w, mem.fit_scaler(w, features, "robust", winsorise=True))


def choice_points(t, kind="robust", winsorise=True):
    """Scaled points of all thirteen axes, one row for each customer and axis."""
    path = work_path(t.spark, "features")
    axes.flatten(wide_of(t)).write.parquet(path)
    features = t.spark.read.parquet(path)
    columns = {a: segmentation.columns_of(a) for a in axes.AXES}
    return cl.axis_points(features, columns, mem.fit_scaler(features, tuple(c for own in columns.values() for c in own), kind, winsorise))


@query("CLU-4")
def clu_4(t):
    """Best k of every axis by silhouette, with the sizes of its clusters: k 2 to 6, ten restarts, all axes in the same passes."""
    rows = []
    for axis, found in sorted(cl.scores_by_group(choice_points(t), "axis").items()):
        s = max(found, key=lambda s: s["silhouette"])
        rows.append((axis, s["k"], round(s["silhouette"], 4), s["largest"], s["smallest"]))
    return t.spark.createDataFrame(rows, "axis string, k int, silhouette double, largest long, smallest long")


@query("CLU-6")
def clu_6(t):
    """Figures of each k up to what the population is worth."""
    p = points_of(t, KEY_AXES["purchase_value"])
    s = cl.k_scores(p, range(2, cl.most_k(p.count(), cl.MOST_CLUSTERS) + 1))
    return t.spark.createDataFrame([(x["k"], x["silhouette"], x["inertia"], x["calinski_harabasz"], x["smallest"], x["balance"]) for x in s], "k int, silhouette double, inertia double, calinski_harabasz double, smallest long, balance double")


@query("CLU-7")
def clu_7(t):
    """k of two axes by three votes: features of both written once, all their k and restarts in the same passes."""
    path = work_path(t.spark, "two-axes")
    wide_of(t).select("customer_id", *[f for own in KEY_AXES.values() for f in own]).write.parquet(path)
    features = t.spark.read.parquet(path)
    points = cl.axis_points(features, KEY_AXES, mem.fit_scaler(features, tuple(f for own in KEY_AXES.values() for f in own), "robust", winsorise=True))
    found = cl.scores_by_group(points, "axis", range(2, 7), 5, 1, False)
    votes = [(axis, *cl.vote(found[axis])) for axis in KEY_AXES]
    return t.spark.createDataFrame([(axis, k, confidence, confidence < 0.5) for axis, k, confidence in votes], "axis string, k int, confidence double, low_confidence boolean")


@query("CLU-9")
def clu_9(t):
    p = points_of(t, KEY_AXES["purchase_frequency"])
    s = cl.balanced_choice(cl.k_scores(p, range(3, 9), 5), p.count())
    return t.spark.createDataFrame([(s["k"], s["silhouette"], s["largest"], s["smallest"])], "k int, silhouette double, largest long, smallest long")


@query("CLU-10")
def clu_10(t):
    """The balance-aware k of 3 to 7, and of its clusters the rows and the mean membership of all rows."""
    p = points_of(t, KEY_AXES["purchase_value"])
    k, models, balanced = cl.fuzzy_choice(p)
    u = p.select(F.posexplode(cl.fuzzy_membership(F.col("x"), models[k].centers)).alias("cluster", "u"))
    sizes = F.array(*[F.lit(int(n)) for n in models[k].sizes])
    return u.groupBy("cluster").agg(F.avg("u").alias("mean_membership"), F.count("*").alias("n")).select("cluster", "mean_membership", "n", F.get(sizes, F.col("cluster")).alias("size"), F.lit(k).alias("k"), F.lit(balanced).alias("balanced"))


#: Starting centres of CLU-11, in units of the robust scaling.
FUZZY_STARTS = ((-1.0, -1.0, -1.0), (0.0, 0.0, 0.0), (1.0, 1.0, 1.0))


def _fuzzy_sql() -> str:
    """Fuzzy c-means round by round over customers with orders, as the centres g, and all customers, scaled, as ev."""
    dims, ks = (1, 2, 3), range(3)
    each = lambda form, sep=", ": sep.join(form.format(i=i) for i in dims)
    scaled = each("(least(greatest(f{i}, l{i}[1]), l{i}[2]) - q{i}[2]) / CASE WHEN q{i}[3] = q{i}[1] THEN 1 ELSE q{i}[3] - q{i}[1] END AS x{i}")
    near = lambda c, name: ", ".join("1 / greatest(" + " + ".join(f"pow(x{i} - {c}[{3 * k + i}], 2)" for i in dims) + f", 1e-20) AS {name}{k}" for k in ks)
    shares = lambda name, to: ", ".join(f"{name}{k} / ({' + '.join(f'{name}{j}' for j in ks)}) AS {to}{k}" for k in ks)
    centers = ", ".join(f"sum(u{k} * u{k} * x{i}) / greatest(sum(u{k} * u{k}), 1e-300)" for k in ks for i in dims)
    change = " + ".join(f"pow(u{k} - o{k}, 2)" for k in ks)
    return (
        "kn AS MATERIALIZED (SELECT customer_id, coalesce(sum(total_price), 0) AS f1, coalesce(avg(total_price), 0) AS f2, coalesce(max(total_price), 0) AS f3 FROM (SELECT customer_id, CASE WHEN isfinite(total_price) THEN total_price END AS total_price FROM ord) GROUP BY 1), "
        f"lm AS (SELECT {each('quantile_cont(f{i}, [0.01, 0.99]) AS l{i}')} FROM kn), "
        f"st AS MATERIALIZED (SELECT {each('any_value(l{i}) AS l{i}, quantile_cont(least(greatest(f{i}, l{i}[1]), l{i}[2]), [0.25, 0.5, 0.75]) AS q{i}')} FROM kn, lm), "
        f"px AS MATERIALIZED (SELECT {scaled} FROM kn, st), "
        f"fit AS (SELECT 0 AS no, CAST({[v for c in FUZZY_STARTS for v in c]} AS DOUBLE[]) AS c, CAST(NULL AS DOUBLE[]) AS b UNION ALL "
        f"SELECT no + 1, [{centers}], c FROM (SELECT no, c, {each('x{i}')}, {shares('a', 'u')}, {shares('d', 'o')} FROM (SELECT no, c, {each('x{i}')}, {near('c', 'a')}, {near('b', 'd')} FROM fit, px WHERE no < 150)) GROUP BY no, c HAVING no = 0 OR sqrt(sum({change})) >= 1e-5), "
        "g AS (SELECT list_sort([c[1:3], c[4:6], c[7:9]]) AS g FROM fit WHERE no > 0 ORDER BY no DESC LIMIT 1), "
        f"ev AS (SELECT id AS customer_id, {scaled} FROM (SELECT coalesce(c_custkey, customer_id) AS id, {each('coalesce(f{i}, 0) AS f{i}')} FROM customer FULL JOIN kn ON c_custkey = customer_id), st)"
    )


_FUZZY_NEAR = ", ".join("1 / greatest(" + " + ".join(f"pow(x{i} - g[{k}][{i}], 2)" for i in (1, 2, 3)) + f", 1e-20) AS a{k}" for k in (1, 2, 3))


@query("CLU-11", f"WITH RECURSIVE {ORDERS}, {_fuzzy_sql()} SELECT customer_id, {', '.join(f'CASE WHEN g IS NOT NULL THEN round(a{k} / (a1 + a2 + a3), 6) END AS u{k - 1}' for k in (1, 2, 3))} FROM (SELECT customer_id, g, {_FUZZY_NEAR} FROM ev LEFT JOIN g ON true)")
def clu_11(t):
    """Memberships of all customers in three segments of purchase value, fitted on those with orders; the others are new rows, whose figures are 0."""
    names, path = KEY_AXES["purchase_value"], work_path(t.spark, "features")
    # Orders that have lines, each once; of the lines only the order's number moves.
    dated = t.headers.where("customer_id IS NOT NULL").join(t.raw_lines.select("order_id"), "order_id", "left_semi")
    orders = dated.groupBy("customer_id", "order_id").agg(F.min(F.col("order_total").cast("double")).alias("total_price"))
    # NaN and infinite prices count as missing.
    price = F.when(F.abs("total_price") < float("inf"), F.col("total_price"))
    orders.groupBy("customer_id").agg(*[f(price).alias(n) for f, n in zip((F.sum, F.avg, F.max), names, strict=True)]).write.parquet(path)
    known = t.spark.read.parquet(path)
    scaler = mem.fit_scaler(known, names, "robust", winsorise=True)
    centers = cl.fuzzy_centers(cl.vectors(known, scaler), np.array(FUZZY_STARTS))
    u = cl.fuzzy_membership(F.array(*scaler.columns()), centers) if centers is not None else F.lit(None).cast("array<double>")
    every = t.stores.select("customer_id").join(known, "customer_id", "full")
    return every.select("customer_id", u.alias("u")).select("customer_id", *[r(F.col("u")[k]).alias(f"u{k}") for k in range(3)])


@query("CLU-11-given", "WITH c AS (SELECT max(c_acctbal) AS a, min(c_acctbal) AS b FROM customer), d AS (SELECT c_custkey, greatest((c_acctbal - a) ** 2 / 1000000, 1e-20) AS x, greatest((c_acctbal - b) ** 2 / 1000000, 1e-20) AS y FROM customer, c) SELECT c_custkey AS customer_id, round(1 / x / (1 / x + 1 / y), 6) AS u0, round(1 / y / (1 / x + 1 / y), 6) AS u1 FROM d")
def clu_11_given(t):
    """Memberships of all customers from given centres: the two ends of the balance."""
    ends = t.stores.agg(F.max("balance").alias("a"), F.min("balance").alias("b")).first()
    u = cl.fuzzy_membership(F.array(F.col("balance") / 1000), np.array([[ends["a"] / 1000], [ends["b"] / 1000]]))
    return t.stores.select("customer_id", u.alias("u")).select("customer_id", r(F.col("u")[0]).alias("u0"), r(F.col("u")[1]).alias("u1"))


_CENTERS = ", ".join(f"{{'axis': '{a}', 'segment': '{n}', 'feature': '{f}', 'c': m_{a}__{f} + s_{a}__{f} * round((q_{a}__{f}[{k}] - m_{a}__{f}) / s_{a}__{f}, 4), 'v': m_{a}__{fs[0]} + s_{a}__{fs[0]} * round((q_{a}__{fs[0]}[{k}] - m_{a}__{fs[0]}) / s_{a}__{fs[0]}, 4), 'v_name': '{fs[0]}'}}" for a, fs in axes.AXES.items() for k, n in enumerate(("low", "middle", "high"), 1) for f in fs)
_LEVEL = "CASE WHEN u.v > 0.5 THEN 'high' WHEN u.v > -0.5 THEN 'medium' ELSE 'low' END"


@query("CLU-12", f"WITH {ALL_AXES}, ce AS (SELECT unnest([{_CENTERS}]) AS u FROM st), sz AS (SELECT axis, segment, count(*) AS n FROM m13 WHERE rn = 1 GROUP BY 1, 2) SELECT u.axis AS axis, u.segment AS segment, u.feature AS feature, round(u.c, 4) AS center_original, coalesce(n, 0) AS customer_count, round(100.0 * coalesce(n, 0) / (SELECT count(*) FROM fl), 6) AS population_pct, {_LEVEL} || '_' || u.axis AS name, 'Customers with ' || {_LEVEL} || ' ' || u.v_name AS interpretation FROM ce LEFT JOIN sz ON sz.axis = u.axis AND sz.segment = u.segment")
def clu_12(t):
    """All segments of the thirteen axes, one row for each feature of the centre."""
    assigned, segments = scored_of(t)
    d = segmentation.described(segmentation.population(assigned, segments))
    per = d.select("axis", "segment", "customer_count", "population_pct", "name", "interpretation", F.explode(F.arrays_zip("feature_names", "center_original")).alias("c"))
    return per.select("axis", "segment", F.get(F.split("c.feature_names", "__"), F.lit(1)).alias("feature"), r("c.center_original", 4).alias("center_original"), "customer_count", r("population_pct").alias("population_pct"), "name", "interpretation")


@query("CLU-13")
def clu_13(t):
    """Two clusters of the value axis, split again where they are too wide: the rows of each leaf, and why its parents were split."""
    p = points_of(t, KEY_AXES["purchase_value"])
    centers = np.array(cl.k_scores(p, range(2, 3), 3)[0]["centers"])
    far = [dg.l2(F.col("x"), F.array(*[F.lit(float(v)) for v in c])) for c in centers]
    split, nodes = cl.subdivide(p.withColumn("label", (far[1] < far[0]).cast("int")), "label")
    known = t.spark.createDataFrame([(n["path"], n["depth"], n["variance"], n["p95"], n["farthest"], n["reasons"], n["split"]) for n in nodes], "path string, depth int, variance double, p95 double, farthest double, reasons string, split boolean")
    # A few segments, whatever the population.
    return split.groupBy("path").agg(F.count("*").alias("n")).join(F.broadcast(known), "path")


@query("CLU-15")
def clu_15(t):
    """Segments from a tiered sample, and the nearest of them for every customer on every axis; a fit has no SQL."""
    path = work_path(t.spark, "features")
    axes.flatten(wide_of(t)).write.parquet(path)
    features = t.spark.read.parquet(path)
    found = segmentation.assign(features, segmentation.discover(features), "nearest")
    return found.select("customer_id", F.explode("dominant").alias("axis", "segment"))


OBS = [date(2000, m, 1) for m in range(1, 13, 2)]
COLUMNS = ["orders", "value", "avg_value", "recency"]


PREPARED = ("has_returns", "business_hours_ratio", "total_orders", "lifetime_value", "purchase_consistency", "days_since_last_purchase")
_RAW = " UNION ALL ".join(f"SELECT customer_id, '{c}' AS feature, coalesce(CAST({c} AS DOUBLE), 0) AS x FROM wide" for c in PREPARED)


@query("CHN-3", f"WITH {WIDE}, rw AS ({_RAW}), sp AS (SELECT feature, avg(x) AS m, stddev_pop(x) AS s FROM rw GROUP BY 1) SELECT customer_id, feature, round((x - m) / s, 6) AS value FROM rw JOIN sp USING (feature) WHERE s > 0")
def chn_3(t):
    """The features that are left, scaled, one row for each customer and feature."""
    d, kept = preprocess(wide_of(t).select("customer_id", *PREPARED), PREPARED)
    return d.select("customer_id", F.explode(F.create_map(*[x for c in kept for x in (F.lit(c), r(c))])).alias("feature", "value"))


@query("CHN-4")
def chn_4(t):
    """Five folds by observation date with the mean and spread of their figures, and the final model's on the dates after four fifths."""
    return churn.cross_validate(churn.stashed(training_set(orders_of(t), OBS)), COLUMNS)


@query("CHN-7")
def chn_7(t):
    d = training_set(orders_of(t), OBS)
    model = churn.fit(d.where(F.col("obs_date") < OBS[-1]), COLUMNS)
    return churn.risk_report(churn.scored(model, d.where(F.col("obs_date") == OBS[-1]), COLUMNS)).select("customer_id", "probability", "at_risk", "confidence", "level")


@query("CHN-10")
def chn_10(t):
    return churn.importances(churn.fit(training_set(orders_of(t), OBS), COLUMNS), COLUMNS, t.spark)


@query("LTV-1")
def ltv_1(t):
    w = wide_of(t).select("customer_id", F.greatest(F.col("lifetime_value"), F.lit(0.01)).alias("y"), (F.col("total_orders") / 10).alias("a"), (F.col("tenure_months") / 50).alias("b"), F.col("discount_rate").alias("c"))
    f = VectorAssembler(inputCols=["a", "b", "c"], outputCol="f").transform(w)
    model = GeneralizedLinearRegression(family="gamma", link="log", regParam=1.0, maxIter=100, featuresCol="f", labelCol="y").fit(f)
    return model.transform(f).select("customer_id", r("y", 4).alias("actual"), r("prediction", 4).alias("predicted"))


@query("FEAT-4", f"WITH {BOTH} SELECT customer_id, round(avg(CASE WHEN source = 'pos' THEN 1.0 ELSE 0 END), 6) AS pos, round(avg(CASE WHEN source = 'web' THEN 1.0 ELSE 0 END), 6) AS web, round(avg(CASE WHEN source = 'shopify_draft_order' THEN 1.0 ELSE 0 END), 6) AS draft, count(DISTINCT source) AS channels FROM ord GROUP BY 1")
def feat_4(t):
    share = lambda s, a: r(F.avg((F.col("source") == s).cast("double"))).alias(a)
    return orders_of(t).groupBy("customer_id").agg(share("pos", "pos"), share("web", "web"), share("shopify_draft_order", "draft"), F.countDistinct("source").alias("channels"))


@query("FEAT-5", f"WITH {ORDERS}, q AS (SELECT customer_id, quarter(order_date) AS v, row_number() OVER (PARTITION BY customer_id ORDER BY count(*) DESC, quarter(order_date)) AS k FROM ord GROUP BY 1, 2), m AS (SELECT customer_id, month(order_date) AS v, row_number() OVER (PARTITION BY customer_id ORDER BY count(*) DESC, month(order_date)) AS k FROM ord GROUP BY 1, 2) SELECT q.customer_id, CAST(q.v AS INT) AS peak_quarter, CAST(m.v AS INT) AS peak_month FROM q JOIN m ON q.customer_id = m.customer_id AND q.k = 1 AND m.k = 1")
def feat_5(t):
    return orders_of(t).groupBy("customer_id").agg(F.mode(F.quarter("order_date"), True).alias("peak_quarter"), F.mode(F.month("order_date"), True).alias("peak_month"))


@query("FEAT-6", f"WITH {BOTH}, c AS (SELECT customer_id, category, sum(quantity) AS q FROM items GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY q DESC, category) AS k, CAST(q AS DOUBLE) / sum(q) OVER (PARTITION BY customer_id) AS s FROM c) SELECT customer_id, category AS primary_category, round(s, 6) AS share FROM k WHERE k = 1")
def feat_6(t):
    from patronage.operators.cleaning import to_items

    c = to_items(t.sales_lines).groupBy("customer_id", "category").agg(F.sum("quantity").alias("q"))
    g = c.groupBy("customer_id").agg(F.min(F.struct((-F.col("q")).alias("n"), "category")).alias("b"), F.sum("q").alias("all"))
    return g.select("customer_id", F.col("b.category").alias("primary_category"), r(-F.col("b.n") / F.col("all")).alias("share"))


@query("FEAT-7", f"WITH {BOTH} SELECT customer_id, product_type, CAST(sum(quantity) AS BIGINT) AS quantity, round(sum(price), 4) AS spend FROM items GROUP BY 1, 2")
def feat_7(t):
    from patronage.operators.cleaning import to_items

    m = to_items(t.sales_lines).groupBy("customer_id", "product_type").agg(F.sum("quantity").alias("q"), F.sum("price").alias("s")).groupBy("customer_id").agg(F.map_from_entries(F.collect_list(F.struct("product_type", F.struct("q", "s")))).alias("matrix"))
    return m.select("customer_id", F.explode("matrix").alias("product_type", "v")).select("customer_id", "product_type", F.col("v.q").alias("quantity"), r("v.s", 4).alias("spend"))


TABLE = BOTH + ", og AS (SELECT *, date_diff('day', lag(order_date) OVER w, order_date) AS gap FROM ord WINDOW w AS (PARTITION BY customer_id ORDER BY order_date, order_id)), md AS (SELECT customer_id, mode_q, mode_m, mode_s FROM (SELECT customer_id, v AS mode_q FROM (SELECT customer_id, quarter(order_date) AS v, row_number() OVER (PARTITION BY customer_id ORDER BY count(*) DESC, quarter(order_date)) AS k FROM ord GROUP BY 1, 2) WHERE k = 1) JOIN (SELECT customer_id, v AS mode_m FROM (SELECT customer_id, month(order_date) AS v, row_number() OVER (PARTITION BY customer_id ORDER BY count(*) DESC, month(order_date)) AS k FROM ord GROUP BY 1, 2) WHERE k = 1) USING (customer_id) JOIN (SELECT customer_id, v AS mode_s FROM (SELECT customer_id, source AS v, row_number() OVER (PARTITION BY customer_id ORDER BY count(*) DESC, source) AS k FROM ord GROUP BY 1, 2) WHERE k = 1) USING (customer_id)), oc AS (SELECT customer_id, count(*) AS n, min(order_date) AS a, max(order_date) AS z, sum(total_price) AS v, avg(total_price) AS aov, avg(CASE WHEN isodow(order_date) >= 6 THEN 1.0 ELSE 0 END) AS we, avg(CASE WHEN discount_amount > 0 THEN 1.0 ELSE 0 END) AS dr, coalesce(avg(discount_amount) FILTER (discount_amount > 0), 0) AS du, count(*) FILTER (order_date >= (SELECT max(order_date) FROM ord) - INTERVAL 90 DAY) AS recent, count(DISTINCT source) AS ch, avg(CASE WHEN source = 'pos' THEN 1.0 ELSE 0 END) AS pp, avg(CASE WHEN source = 'web' THEN 1.0 ELSE 0 END) AS pw, avg(CASE WHEN source = 'shopify_draft_order' THEN 1.0 ELSE 0 END) AS ps, avg(gap) AS mg, CASE WHEN count(gap) > 1 THEN stddev_samp(gap) END AS sg FROM og GROUP BY 1), ic AS (SELECT customer_id, count(DISTINCT product_id) AS up, count(DISTINCT category) AS uc, count(DISTINCT product_type) AS ut, CAST(sum(quantity) AS BIGINT) AS q, sum(refund_amount) AS f FROM items GROUP BY 1), cq AS (SELECT customer_id, category, CAST(sum(quantity) AS BIGINT) AS q FROM items GROUP BY 1, 2), mc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY q DESC, category) AS k FROM cq WHERE category IS NOT NULL) WHERE k = 1), ct AS (SELECT customer_id, n AS total_orders, a AS first_purchase_date, z AS last_purchase_date, v AS lifetime_value, aov AS avg_order_value, we AS pct_weekend_orders, dr AS discount_rate, du AS avg_discount_when_used, recent AS recent_orders_3mo, mode_s AS primary_channel, ch AS channels_used, pp AS pct_pos, pw AS pct_web, ps AS pct_shopify, mode_q AS peak_quarter, mode_m AS peak_month, mg AS avg_days_between_purchases, sg AS std_days_between_purchases, up AS unique_products, uc AS unique_categories, ut AS unique_product_types, ic.q AS total_items_purchased, f AS total_refunds, date_diff('day', a, (SELECT max(order_date) FROM ord)) AS customer_tenure_days, date_diff('day', z, (SELECT max(order_date) FROM ord)) AS days_since_last_purchase, ic.q / CAST(n AS DOUBLE) AS avg_items_per_order, mc.category AS primary_category, mc.q / CAST(ic.q AS DOUBLE) AS primary_category_pct, CASE WHEN v = 0 THEN 0 ELSE f / v END AS refund_rate FROM oc JOIN md USING (customer_id) JOIN ic USING (customer_id) JOIN mc USING (customer_id))"


def table_of(t):
    from patronage.operators.cleaning import to_items

    return customers.customer_table(orders_of(t), to_items(t.sales_lines), axes.reference_date_of(orders_of(t)))


_RATIOS = ("pct_weekend_orders", "discount_rate", "pct_pos", "pct_web", "pct_shopify", "avg_days_between_purchases", "std_days_between_purchases", "avg_items_per_order", "primary_category_pct", "refund_rate")
_PLAIN = ("customer_id", "total_orders", "recent_orders_3mo", "primary_channel", "channels_used", "unique_products", "unique_categories", "unique_product_types", "total_items_purchased", "primary_category")


@query("FEAT-3", f"WITH {TABLE} SELECT {', '.join(_PLAIN)}, {', '.join(f'round({c}, 6) AS {c}' for c in _RATIOS)}, round(lifetime_value, 2) AS lifetime_value, round(avg_order_value, 6) AS avg_order_value, round(avg_discount_when_used, 8) AS avg_discount_when_used, round(total_refunds, 4) AS total_refunds, CAST(first_purchase_date AS VARCHAR) AS first_purchase_date, CAST(last_purchase_date AS VARCHAR) AS last_purchase_date, CAST(peak_quarter AS INT) AS peak_quarter, CAST(peak_month AS INT) AS peak_month, CAST(customer_tenure_days AS INT) AS customer_tenure_days, CAST(days_since_last_purchase AS INT) AS days_since_last_purchase, round(total_orders / CAST(CASE WHEN customer_tenure_days = 0 THEN 1 ELSE customer_tenure_days END AS DOUBLE) * 30.44, 6) AS orders_per_month, CAST(days_since_last_purchase AS INT) AS rfm_recency, total_orders AS rfm_frequency, round(lifetime_value, 2) AS rfm_monetary, CASE WHEN days_since_last_purchase <= 90 THEN 'Active' WHEN days_since_last_purchase <= 180 THEN 'At Risk' ELSE 'Churned' END AS customer_status, total_orders > 1 AS is_repeat_customer FROM ct")
def feat_3(t):
    d = table_of(t)
    digits = {"lifetime_value": 2, "rfm_monetary": 2, "avg_discount_when_used": 8, "total_refunds": 4}
    column = lambda c, kind: r(c, digits.get(c, 6)).alias(c) if kind == "double" else F.col(c).cast("string").alias(c) if c.endswith("_date") else F.col(c).cast("int").alias(c) if "days" in c or c == "rfm_recency" else F.col(c)
    return d.select(*[column(c, k) for c, k in d.dtypes if c != "category_quantities"])


CONTRASTS = "qv AS (SELECT quantile_cont(lifetime_value, 0.25) AS lo, quantile_cont(lifetime_value, 0.75) AS hi FROM ct), cx AS (SELECT ct.*, unnest([{'contrast': 'status', 'bucket': CASE WHEN days_since_last_purchase <= 90 THEN 'Active' WHEN days_since_last_purchase <= 180 THEN 'At Risk' ELSE 'Churned' END}, {'contrast': 'repeat', 'bucket': CASE WHEN total_orders > 1 THEN 'repeat' ELSE 'one-time' END}, {'contrast': 'value', 'bucket': CASE WHEN lifetime_value >= hi THEN 'top' WHEN lifetime_value <= lo THEN 'bottom' END}, {'contrast': 'discount', 'bucket': CASE WHEN discount_rate > 0.5 THEN 'high' WHEN discount_rate = 0 THEN 'never' END}, {'contrast': 'weekend', 'bucket': CASE WHEN pct_weekend_orders > 0.5 THEN 'weekend' WHEN pct_weekend_orders < 0.3 THEN 'weekday' END}]) AS x FROM ct, qv)"


@query("AGG-24", f"WITH {TABLE}, {CONTRASTS} SELECT x.contrast AS contrast, x.bucket AS bucket, count(*) AS n, round(avg(lifetime_value), 4) AS avg_ltv, round(avg(total_orders), 6) AS avg_orders, round(avg(avg_order_value), 4) AS avg_order_value, round(avg(customer_tenure_days), 6) AS avg_tenure_days, round(avg(unique_products), 6) AS avg_products, round(avg(unique_categories), 6) AS avg_categories, round(avg(discount_rate), 6) AS discount_rate, round(avg(pct_weekend_orders), 6) AS weekend_rate, round(avg(CASE WHEN total_orders > 1 THEN 1.0 ELSE 0 END), 6) AS repeat_rate FROM cx WHERE x.bucket IS NOT NULL GROUP BY 1, 2")
def agg_24(t):
    d = customers.contrasts(table_of(t))
    return d.select(*[r(c, 4 if c in ("avg_ltv", "avg_order_value") else 6).alias(c) if k == "double" else c for c, k in d.dtypes])


#: The trade that the driver's categories stand for, with thresholds in the middle of its figures.
TRADE = customers.Trade("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", spender=1_500_000, business_value=3_000_000, business_orders=18, reseller_orders=14, reseller_products=50, gift_value=120_000, project_value=170_000, browser_value=140_000, frequent=10, heavy_use=200, finishes=180, some_use=330, some_finishes=330, long_days=1100, breadth=6)
CLASSES = "cl AS (SELECT ct.*, coalesce(x.machine, 0) AS machine, coalesce(x.u, 0) AS u, coalesce(x.fin, 0) AS fin, coalesce(x.mat, 0) / CAST(total_items_purchased AS DOUBLE) AS mats, coalesce(x.oth, 0) / CAST(total_items_purchased AS DOUBLE) AS oths, coalesce(titled, false) AS titled FROM ct LEFT JOIN (SELECT customer_id, sum(q) FILTER (category = 'ECONOMY') AS machine, sum(q) FILTER (category = 'LARGE') AS u, sum(q) FILTER (category = 'MEDIUM') AS fin, sum(q) FILTER (category = 'PROMO') AS mat, sum(q) FILTER (category = 'SMALL') AS oth FROM cq GROUP BY 1) x USING (customer_id) LEFT JOIN (SELECT customer_id, bool_or(product_name LIKE '%7%') AS titled FROM lines GROUP BY 1) y USING (customer_id)), sg AS (SELECT *, list_filter([CASE WHEN lifetime_value > 1500000 THEN 'high_spender' END, CASE WHEN unique_categories >= 6 THEN 'multi_category' END, CASE WHEN machine > 0 THEN 'machine_owner' END, CASE WHEN total_orders >= 10 THEN 'frequent_buyer' END, CASE WHEN u >= 200 THEN 'heavy_user' END, CASE WHEN fin >= 180 THEN 'project_finisher' END, CASE WHEN customer_tenure_days > 1100 THEN 'long_term' END], lambda x: x IS NOT NULL) AS signals FROM cl)"


@query("FEAT-8", f"WITH {TABLE}, {CLASSES} SELECT customer_id, array_to_string(signals, ',') AS signals, CASE WHEN len(signals) >= 5 THEN 'Professional/Hardcore Enthusiast' WHEN len(signals) >= 3 THEN 'Serious Hobbyist' WHEN len(signals) >= 1 THEN 'Casual Hobbyist' ELSE 'Beginner/Dabbler' END AS expertise, CASE WHEN lifetime_value > 3000000 OR total_orders > 18 THEN 'Business/Professional' WHEN total_orders > 14 AND unique_products > 50 THEN 'Potential Reseller' WHEN total_orders = 1 AND avg_order_value < 120000 AND unique_categories = 1 THEN 'Gift Buyer' WHEN u >= 330 OR fin >= 330 THEN 'Active Maker' WHEN total_orders <= 3 AND avg_order_value > 170000 THEN 'Project-Based Buyer' WHEN unique_categories >= 3 AND avg_order_value < 140000 THEN 'Explorer/Browser' ELSE 'Casual Buyer' END AS customer_type, CASE WHEN (machine > 0 OR titled) AND total_orders > 5 THEN 'Machine (Professional)' WHEN machine > 0 OR titled THEN 'Machine (Home)' WHEN mats > 0.6 AND fin = 0 THEN 'Garment Maker' WHEN fin > 0 AND u > 0 THEN 'Traditional Maker' WHEN u / CAST(total_items_purchased AS DOUBLE) > 0.7 THEN 'Consumable Artist' WHEN fin / CAST(total_items_purchased AS DOUBLE) > 0.8 THEN 'Finishing Specialist' WHEN oths > 0.7 AND unique_products > 10 THEN 'Tool Enthusiast' WHEN unique_categories >= 6 THEN 'Generalist' WHEN primary_category = 'LARGE' THEN 'Consumable-Focused' WHEN primary_category = 'PROMO' THEN 'Material-Focused' WHEN primary_category = 'MEDIUM' THEN 'Finishing-Focused' ELSE 'General Maker' END AS project_type FROM sg")
def feat_8(t):
    titled = t.sales_lines.groupBy("customer_id").agg(F.bool_or(F.col("product_name").like("%7%")).alias("titled"))
    d = table_of(t).join(titled, "customer_id", "left")
    return customers.classify(d, TRADE, F.coalesce("titled", F.lit(False))).withColumn("signals", F.array_join("signals", ","))


@query("FEAT-9", f"WITH {WIDE} SELECT customer_id, round(product_concentration, 6) AS herfindahl FROM wide")
def feat_9(t):
    return wide_of(t).select("customer_id", r("product_concentration").alias("herfindahl"))


@query("TOP-12", "WITH q AS (SELECT * FROM embeddings WHERE vec_id % 20 = 0), p AS (SELECT q.vec_id AS query_id, e.vec_id AS other_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS c FROM q JOIN embeddings e ON q.vec_id <> e.vec_id), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, other_id) AS place FROM p) SELECT query_id, other_id FROM k WHERE place = 1")
def top_12(t):
    from patronage.operators.tickets import cosine_top

    e = t.read("embeddings")
    return cosine_top(e, e.where("vec_id % 20 = 0"), 1).select("query_id", "other_id")


@query("UDF-4", f"WITH {WIDE} SELECT customer_id, round(category_diversity, 6) AS entropy, round(product_concentration, 6) AS herfindahl FROM wide")
def udf_4(t):
    return wide_of(t).select("customer_id", r("category_diversity").alias("entropy"), r("product_concentration").alias("herfindahl"))


@query("UDF-3", f"WITH {ORDERS}, s AS (SELECT customer_id, total_price, row_number() OVER (PARTITION BY customer_id ORDER BY order_date, order_id) - 1 AS i FROM ord) SELECT customer_id, round(regr_slope(total_price, i), 6) AS slope FROM s GROUP BY 1 HAVING count(*) >= 3")
def udf_3(t):
    from pyspark.sql.window import Window as W

    s = orders_of(t).select("customer_id", "total_price", (F.row_number().over(W.partitionBy("customer_id").orderBy("order_date", "order_id")) - 1).alias("i"))
    return s.groupBy("customer_id").agg(F.regr_slope("total_price", "i").alias("slope"), F.count("*").alias("n")).where("n >= 3").select("customer_id", r("slope").alias("slope"))


@query("SC-3", "SELECT c_custkey AS customer_id, '+1' || lpad(CAST(c_custkey AS VARCHAR), 10, '5') AS phone FROM customer")
def sc_3(t):
    raw = F.concat(F.lit("("), F.substring(F.lpad(F.col("customer_id").cast("string"), 10, "5"), 1, 3), F.lit(") "), F.substring(F.lpad(F.col("customer_id").cast("string"), 10, "5"), 4, 7))
    digits = F.regexp_replace(raw, "[^0-9]", "")
    return t.stores.select("customer_id", F.when(F.length(digits) == 10, F.concat(F.lit("+1"), digits)).when((F.length(digits) == 11) & digits.startswith("1"), F.concat(F.lit("+"), digits)).alias("phone"))


@query("SC-4", "SELECT p_partkey AS product_id, 'vip,' || lower(p_brand) AS tags, true AS is_vip FROM part")
def sc_4(t):
    tags = F.filter(F.transform(F.split(F.concat(F.lit(" VIP , ,"), "product_type"), ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    return t.products.select("product_id", F.array_join(tags, ",").alias("tags"), F.exists(tags, lambda x: x == "vip").alias("is_vip"))


@query("SC-9", "SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, CASE WHEN day(o_orderdate) = 1 AND month(o_orderdate) = 1 THEN 'yearly' WHEN day(o_orderdate) = 1 AND month(o_orderdate) IN (4, 7, 10) THEN 'quarterly' WHEN day(o_orderdate) = 1 THEN 'monthly' WHEN isodow(o_orderdate) = 7 THEN 'weekly' ELSE 'daily' END AS snapshot_type, count(*) AS n FROM orders GROUP BY 1, 2")
def sc_9(t):
    from patronage.operators.snapshots import snapshot_type

    d = F.to_date("order_date")
    return t.headers.groupBy(d.cast("string").alias("day"), snapshot_type(d).alias("snapshot_type")).agg(F.count("*").alias("n"))


@query("SC-13", "SELECT event_id, 'k' AS keys, CAST(json_extract(props, '$.k') AS INT) AS k, true AS has_k FROM events")
def sc_13(t):
    m = F.from_json("props", "map<string,int>")
    return t.events.select("event_id", F.array_join(F.map_keys(m), ",").alias("keys"), m["k"].alias("k"), F.map_contains_key(m, "k").alias("has_k"))


@query("JOIN-10", f"WITH {PROF} SELECT count(*) AS total, round(avg(lifetime_value), 4) AS mean_value, (SELECT count(DISTINCT archetype_id) FROM prof) AS archetypes, (SELECT max(n) FROM (SELECT count(*) AS n FROM prof GROUP BY archetype_id)) AS largest, (SELECT string_agg(archetype_id || '=' || n, ',' ORDER BY archetype_id) FROM (SELECT archetype_id, count(*) AS n FROM prof GROUP BY 1 ORDER BY n DESC, archetype_id LIMIT 20)) AS top FROM prof")
def join_10(t):
    """Totals of all profiles beside the counts of archetypes: one row, with a map of the twenty largest alone, so it has the same size whatever the number of archetypes."""
    counts = profiles_of(t).groupBy("archetype_id").agg(F.count("*").alias("n"), F.sum("lifetime_value").alias("v"))
    totals = counts.agg(F.sum("n").alias("total"), (F.sum("v") / F.sum("n")).alias("mean_value"), F.count("*").alias("archetypes"), F.max("n").alias("largest"))
    top = counts.orderBy(F.col("n").desc(), "archetype_id").limit(20).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("archetype_id", "n")))).alias("stats"))
    joined = F.array_join(F.transform(F.map_entries("stats"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return totals.crossJoin(F.broadcast(top)).select("total", r("mean_value", 4).alias("mean_value"), "archetypes", "largest", joined.alias("top"))


@query("SC-1", "SELECT p_partkey AS product_id, contains(lower(p_name), 'red') OR contains(lower(p_name), 'ring') AS hit FROM part")
def sc_1(t):
    from patronage.operators.tickets import any_word

    return t.products.select("product_id", any_word(F.col("product_name"), ("red", "ring")).alias("hit"))


@query("SC-5", "SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey + 1 ELSE o_orderkey END AS order_number FROM orders")
def sc_5(t):
    name = F.when(F.col("order_id") % 2 == 0, F.concat(F.lit("#"), F.col("order_id") + 1)).otherwise("draft")
    return t.headers.select("order_id", F.coalesce(F.replace(name, F.lit("#"), F.lit("")).try_cast("long"), F.col("order_id")).alias("order_number"))


@query("SC-11", "SELECT c_custkey AS customer_id, round(sqrt(abs(c_acctbal)), 6) AS root, round(ln(1 + abs(c_acctbal)), 6) AS log, round(log2(1 + abs(c_acctbal)), 6) AS log2, round(exp(-abs(c_acctbal) / 10000), 6) AS decay, CAST(sign(c_acctbal) AS INT) AS side, greatest(least(c_acctbal, 5000), 0) AS clipped FROM customer")
def sc_11(t):
    b, a = F.col("balance"), F.abs("balance")
    return t.stores.select("customer_id", r(F.sqrt(a)).alias("root"), r(F.ln(1 + a)).alias("log"), r(F.log2(1 + a)).alias("log2"), r(F.exp(-a / 10000)).alias("decay"), F.signum(b).cast("int").alias("side"), F.greatest(F.least(b, F.lit(5000.0)), F.lit(0.0)).alias("clipped"))


@query("SC-12", f"WITH {PROF} SELECT customer_id, 'purchase_value' AS last_axis, seg_customer_maturity AS first_segment FROM prof")
def sc_12(t):
    entries = F.array_sort(F.map_entries("dominant_segments"))
    known = F.filter(entries, lambda e: e["key"].isin("purchase_value", "customer_maturity"))
    return profiles_of(t).select("customer_id", F.element_at(known, -1)["key"].alias("last_axis"), known[0]["value"].alias("first_segment"))
