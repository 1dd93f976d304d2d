"""Queries of support axes and of what is said about clusterings."""

from __future__ import annotations

from datetime import datetime, timezone

import numpy as np
from pyspark.sql import functions as F

from patronage.operators import axes, sampling, support
from patronage.operators import membership as mem
from patronage.operators.cleaning import to_items, to_orders
from patronage.plans import clustering as cl
from patronage.plans import diagnostics as dg
from patronage.queries.axes import wide_of
from patronage.queries.models import KEY_AXES, choice_points, points_of
from patronage.queries.registry import WIDE, query, r, rounded
from patronage.queries.sales import PROF, profiles_of
from patronage.queries.segments import CENTERS, MEMBER, member, scaled
from patronage.queries.tickets import T_SQL, tickets_of
from patronage.sources import landing

# The driver's texts are invented prose, so the topics are told apart by syllables.
TOPICS = {"return": ("ung",), "shipping": ("que",), "product": ("wh", "tion")}
WORDS_SQL = "len(list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''))"


@query("AXIS-14", f"""WITH {WIDE}, {T_SQL}, h AS (SELECT conv_id AS ticket_id, count(*) FILTER (role = 'user') AS asked, sum({WORDS_SQL}) FILTER (role = 'user') AS words, arg_min(coalesce(text, ''), turn) FILTER (role = 'user') AS opening FROM conversations GROUP BY 1),
k AS (SELECT *, CASE WHEN contains(lower(coalesce(opening, '')), 'ung') THEN 'return' WHEN contains(lower(coalesce(opening, '')), 'que') THEN 'shipping' WHEN contains(lower(coalesce(opening, '')), 'wh') OR contains(lower(coalesce(opening, '')), 'tion') THEN 'product' ELSE 'other' END AS topic FROM tk JOIN h USING (ticket_id)),
g AS (SELECT customer_id, count(*) AS tickets, avg(CASE WHEN topic = 'return' THEN 1.0 ELSE 0 END) AS return_rate, avg(CASE WHEN topic = 'shipping' THEN 1.0 ELSE 0 END) AS shipping_rate, avg(CASE WHEN topic = 'product' THEN 1.0 ELSE 0 END) AS product_rate, avg(CASE WHEN sentiment < 0.3 THEN 1.0 ELSE 0 END) AS complaint_rate,
 avg(CASE WHEN priority = 'urgent' THEN 1.0 ELSE 0 END) AS escalation_rate, 1 - CAST(count(DISTINCT topic) AS DOUBLE) / count(*) AS repeat_issue_rate, CAST(sum(words) AS DOUBLE) / nullif(sum(asked), 0) AS message_length_avg, avg(greatest(asked - 1, 0)) AS follow_up_rate FROM k GROUP BY 1)
SELECT g.customer_id, tickets, round(return_rate, 6) AS return_rate, round(shipping_rate, 6) AS shipping_rate, round(product_rate, 6) AS product_rate, round(complaint_rate, 6) AS complaint_rate, round(escalation_rate, 6) AS escalation_rate, round(repeat_issue_rate, 6) AS repeat_issue_rate, round(message_length_avg, 6) AS message_length_avg, round(follow_up_rate, 6) AS follow_up_rate, round(CAST(tickets AS DOUBLE) / n, 6) AS tickets_per_order FROM g LEFT JOIN wide USING (customer_id)""")  # fmt: skip
def axis_14(t):
    """Reply times and satisfaction are not in the driver's tables; the operator gives null for them."""
    orders = to_orders(t.sales_lines).groupBy("customer_id").agg(F.count("*").alias("total_orders"))
    return rounded(support.support_history(tickets_of(t), t.messages, orders, TOPICS).drop("avg_response_time_hours", "satisfaction_avg"))


@query("AXIS-15", f"""WITH {WIDE}, s AS (SELECT customer_id, avg(CASE WHEN source = 'shopify_draft_order' THEN 1.0 ELSE 0 END) AS custom FROM seq GROUP BY 1), e AS (SELECT customer_id, count(*) FILTER (refund_amount > 0) AS returned, count(DISTINCT category) AS categories FROM items GROUP BY 1)
SELECT customer_id, CASE WHEN nm >= na AND nm >= ne THEN 'morning' WHEN na > ne THEN 'afternoon' ELSE 'evening' END AS preferred_contact_time, round(custom, 6) AS custom_order_rate, round(CASE WHEN tm > 0 THEN coalesce(returned, 0) / tm ELSE 0 END, 6) AS return_frequency, round(CAST(coalesce(categories, 0) AS DOUBLE) / n, 6) AS category_switching_rate,
CAST(CASE WHEN n >= 3 THEN sign(round(vslope, 9)) ELSE 0 END AS INT) AS value_trend, CAST(CASE WHEN n >= 3 THEN sign(round(-gslope, 9)) ELSE 0 END AS INT) AS recency_momentum, CAST(CASE WHEN n >= 2 THEN floor(mg) ELSE 365 END AS BIGINT) AS expected_next_purchase_days FROM b JOIN s USING (customer_id) LEFT JOIN e USING (customer_id)""")  # fmt: skip
def axis_15(t):
    dated = t.headers.join(t.raw_lines.select("order_id"), "order_id", "left_semi")
    return rounded(support.support_variants(to_orders(t.sales_lines), to_items(t.sales_lines), axes.reference_date_of(dated)))


STAND_OUT = ("lifetime_value", "avg_order_value", "total_orders", "days_since_last_purchase", "orders_per_month", "discount_rate")
STAND_OUT_AXES = ("purchase_value", "purchase_frequency", "customer_maturity")


@query("TOP-13", f"WITH {PROF}, c AS (" + " UNION ALL ".join(f"SELECT '{a}' AS axis, seg_{a} AS segment, '{f}' AS feature, CAST(avg({f}) AS DOUBLE) AS value FROM prof GROUP BY 2" for a in STAND_OUT_AXES for f in STAND_OUT) + "), z AS (SELECT *, (value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-10) AS z FROM c WINDOW w AS (PARTITION BY axis, feature)), p AS (SELECT *, row_number() OVER (PARTITION BY axis, segment ORDER BY round(abs(z), 6) DESC, feature) AS place FROM z WHERE abs(z) > 0.5) SELECT axis, segment, feature, CASE WHEN z > 0 THEN 'high' ELSE 'low' END AS direction, round(z, 4) AS z, round(value, 4) AS value, CAST(place AS INT) AS place FROM p WHERE place <= 5")
def top_13(t):
    long = profiles_of(t).select(F.explode("dominant_segments").alias("axis", "segment"), *STAND_OUT).where(F.col("axis").isin(*STAND_OUT_AXES))
    means = long.groupBy("axis", "segment").agg(*[F.avg(c).alias(c) for c in STAND_OUT])
    return rounded(dg.distinctive(means.unpivot(["axis", "segment"], list(STAND_OUT), "feature", "value")), 4)


@query("SC-15", "WITH a AS (SELECT label, arg_min(embedding, vec_id) AS anchor FROM embeddings GROUP BY 1) SELECT vec_id, round(list_distance(CAST(embedding AS DOUBLE[]), CAST(anchor AS DOUBLE[])), 6) AS distance FROM embeddings JOIN a USING (label)")
def sc_15(t):
    e = t.read("embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    anchors = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("anchor"))
    return e.join(anchors, "label").select("vec_id", r(dg.l2(F.col("embedding"), F.col("anchor"))).alias("distance"))


@query("UDF-2", f"WITH {MEMBER} SELECT customer_id, segment, round(score, 6) AS score FROM m")
def udf_2(t):
    w, s = scaled(t)
    kernel = dg.membership_kernel(np.array(list(CENTERS.values())))
    named = F.map_from_arrays(F.array(*[F.lit(c) for c in CENTERS]), kernel(F.array(*s.columns())))
    return w.select("customer_id", F.explode(named).alias("segment", "score")).withColumn("score", r("score"))


@query("SRC-14", f"WITH {WIDE} SELECT 'run-1' AS run_id, count(*) AS customer_count, (SELECT count(*) FROM events) AS event_count, 2 AS axes, CAST(4 AS BIGINT) AS total_segments, true AS ordered, 'completed' AS status FROM wide UNION ALL SELECT 'run-2', 0, 0, 0, 0, NULL, 'failed'")
def src_14(t):
    """A finished and a failed run in the log."""
    path, began = landing.work_path(t.spark, "runs"), datetime.now(timezone.utc)
    found = [(axis, 2, cl.k_scores(points_of(t, f), range(2, 3), 3)[0]["silhouette"]) for axis, f in KEY_AXES.items()]
    dg.log_run(t.spark, path, "run-1", "all", wide_of(t).count(), t.events.count(), found, began)
    dg.log_run(t.spark, path, "run-2", "all", 0, 0, [], began, "failed", "no customers")
    ordered = (F.col("min_silhouette") <= F.col("avg_silhouette")) & (F.col("avg_silhouette") <= F.col("max_silhouette")) & (F.col("seconds") > 0)
    return t.spark.read.schema(dg.RUN_SCHEMA).parquet(path).select("run_id", "customer_count", "event_count", "axes", "total_segments", ordered.alias("ordered"), "status")


@query("SMP-4")
def smp_4(t):
    w = wide_of(t)
    p = cl.vectors(w, mem.fit_scaler(w, KEY_AXES["purchase_value"] + KEY_AXES["purchase_frequency"]))
    return dg.diverse(p, 200).select("customer_id")


def labelled_of(t):
    """Points of the value axis with the cluster of a k-means of three."""
    p = points_of(t, KEY_AXES["purchase_value"])
    centers = np.array(cl.k_scores(p, range(3, 4), 3)[0]["centers"])
    far = F.array(*[dg.l2(F.col("x"), F.array(*[F.lit(float(v)) for v in c])) for c in centers])
    return p.withColumn("d", far).withColumn("cluster", F.array_position("d", F.array_min("d")) - 1)


@query("CLU-5")
def clu_5(t):
    s = dg.silhouette_exact(labelled_of(t), "cluster")
    return s.groupBy("label").agg(F.count("*").alias("n"), r(F.avg("silhouette"), 4).alias("silhouette"))


@query("CLU-8")
def clu_8(t):
    """The choice of k over all axes and its summary."""
    found = cl.scores_by_group(choice_points(t), "axis", range(2, 9), 3)
    return rounded(dg.k_summary(t.spark.createDataFrame([(axis, *cl.vote(s)) for axis, s in sorted(found.items())], "axis string, k int, confidence double")))


KINDS = {"exp": "exp(-d)", "inverse": "1 / (1 + d)"}


@query("CLU-14", f"WITH {MEMBER}, u AS (" + " UNION ALL ".join(f"SELECT '{k}' AS axis, customer_id, segment, {e} / sum({e}) OVER (PARTITION BY customer_id) AS score, row_number() OVER (PARTITION BY customer_id ORDER BY d, segment) AS rn FROM ds" for k, e in KINDS.items()) + "), g AS (SELECT axis, segment, count(*) AS n, sum(score) AS s FROM u WHERE rn = 1 GROUP BY 1, 2), h AS (SELECT axis, count(*) AS k, CAST(sum(n) AS BIGINT) AS customers, 100.0 * max(n) / sum(n) AS largest_pct, 100.0 * min(n) / sum(n) AS smallest_pct, sum(s) / sum(n) AS mean_purity FROM g GROUP BY 1) SELECT axis, k, customers, round(largest_pct, 6) AS largest_pct, round(smallest_pct, 6) AS smallest_pct, round(mean_purity, 6) AS mean_purity, largest_pct <= 50 AND smallest_pct >= 3 AS balanced, mean_purity >= 0.5 AS descriptive, largest_pct <= 50 AND smallest_pct >= 3 AND mean_purity >= 0.5 AS passes FROM h")
def clu_14(t):
    top = lambda kind: member(t, kind).select(F.lit(kind).alias("axis"), mem.ranked(F.col("m"))[0].alias("top")).select("axis", "top.segment", "top.score")
    return rounded(dg.quality_report(top("exp").unionByName(top("inverse"))))


@query("CLU-16")
def clu_16(t):
    """Plain scaling with k by silhouette against robust scaling with k by vote, on one sample."""
    features = KEY_AXES["purchase_frequency"]
    sample = sampling.tiered(wide_of(t), "customer_id", "lifetime_value", 2000).persist()
    plain = cl.k_scores(cl.vectors(sample, mem.fit_scaler(sample, features)), range(2, 7), 3)
    robust = cl.k_scores(cl.vectors(sample, mem.fit_scaler(sample, features, "robust", winsorise=True)), range(2, 9), 3)
    best = {"plain": max(plain, key=lambda s: s["silhouette"]), "robust": next(s for s in robust if s["k"] == cl.vote(robust)[0])}
    sample.unpersist()
    return t.spark.createDataFrame([(n, s["k"], round(s["silhouette"], 4), s["largest"], s["smallest"], round(s["balance"], 4)) for n, s in best.items()], "configuration string, k int, silhouette double, largest long, smallest long, balance double")


@query("UDF-5", f"WITH {PROF}, m AS (SELECT seg_purchase_value AS label, lifetime_value > median(lifetime_value) OVER (PARTITION BY seg_purchase_value) AS up FROM prof) SELECT label, CAST(up AS INT) AS sub, count(*) AS n FROM m GROUP BY 1, 2")
def udf_5(t):
    """Each value segment is split at its median by a function of its matrix."""
    p = profiles_of(t).select("customer_id", F.col("dominant_segments")["purchase_value"].alias("segment"), F.array("lifetime_value").alias("x"))
    return dg.recluster(p, "segment", lambda x: x[:, 0] > np.median(x[:, 0]), spread=dg.above_median).groupBy("label", "sub").agg(F.count("*").alias("n"))
