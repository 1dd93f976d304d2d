"""Queries of scaling, membership, archetypes, snapshots, drift and outliers."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from patronage.operators import axes, profiles, snapshots
from patronage.operators import membership as mem
from patronage.plans import segmentation, star
from patronage.queries.axes import wide_of
from patronage.queries.registry import ORDERS, WIDE, query, r, rounded
from patronage.queries.sales import PROF, orders_of, profiles_of
from patronage.sources.landing import work_path

FEATURES = ("lifetime_value", "avg_order_value")
CENTERS = {"low": (-1.0, -1.0), "middle": (0.0, 0.0), "high": (1.5, 1.0)}
DATES = [date(1998, 1, 1), date(1999, 4, 1), date(2000, 1, 1), date(2000, 12, 31), date(2001, 8, 1)]
REFERENCE = date(2001, 8, 1)

SCALED = WIDE + ", st AS (SELECT avg(lifetime_value) AS a1, stddev_pop(lifetime_value) AS s1, avg(avg_order_value) AS a2, stddev_pop(avg_order_value) AS s2 FROM wide), x AS (SELECT customer_id, (lifetime_value - a1) / s1 AS x1, (avg_order_value - a2) / s2 AS x2 FROM wide, st), ds AS (" + " UNION ALL ".join(f"SELECT customer_id, '{n}' AS segment, sqrt((x1 - ({a})) * (x1 - ({a})) + (x2 - ({b})) * (x2 - ({b}))) AS d FROM x" for n, (a, b) in CENTERS.items()) + ")"
MEMBER = SCALED + ", m AS (SELECT customer_id, segment, d, exp(-d) / sum(exp(-d)) OVER (PARTITION BY customer_id) AS score, row_number() OVER (PARTITION BY customer_id ORDER BY exp(-d) DESC, segment) AS rn FROM ds)"
SNAPS = ORDERS + ", dt AS (SELECT unnest([" + ", ".join(f"DATE '{d}'" for d in DATES) + "]) AS snapshot_date), sn AS (SELECT customer_id, snapshot_date, count(*) AS orders_at, sum(total_price) AS value_at FROM ord JOIN dt ON CAST(order_date AS DATE) < snapshot_date GROUP BY 1, 2), e AS (SELECT *, " + ", ".join(f"exp(-abs({x} - {c[0]})) AS {s}" for a, x in (("frequency", "orders_at / 10.0"), ("value", "value_at / 1e6")) for s, c in snapshots.CENTERS[a].items()) + " FROM sn), ss AS (SELECT customer_id, snapshot_date, orders_at, value_at, " + ", ".join(f"{s} / ({' + '.join(c)}) AS {s}" for c in (list(v) for v in snapshots.CENTERS.values()) for s in c) + " FROM e), sd AS (SELECT *, " + ", ".join("CASE " + " ".join(f"WHEN {s} >= greatest({', '.join(o for o in c if o != s)}) THEN '{s}'" for s in sorted(c)) + f" END AS dom_{a}" for a, c in ((a, list(v)) for a, v in snapshots.CENTERS.items())) + " FROM ss), sq AS (SELECT *, dom_frequency || '/' || dom_value AS archetype, lag(snapshot_date) OVER w AS old_date, " + ", ".join(f"lag({s}) OVER w AS o_{s}" for v in snapshots.CENTERS.values() for s in v) + ", lag(dom_frequency) OVER w AS o_f, lag(dom_value) OVER w AS o_v, lag(value_at) OVER w AS o_value FROM sd WINDOW w AS (PARTITION BY customer_id ORDER BY snapshot_date))"
AXIS_DRIFT = {a: "least(1.0, sqrt(" + " + ".join(f"({s} - o_{s}) * ({s} - o_{s})" for s in v) + ") / sqrt(2))" for a, v in snapshots.CENTERS.items()}
STEPS = SNAPS + f", sp AS (SELECT *, date_diff('day', old_date, snapshot_date) AS days, {AXIS_DRIFT['frequency']} AS df, {AXIS_DRIFT['value']} AS dv, ({AXIS_DRIFT['frequency']} + {AXIS_DRIFT['value']}) / 2 AS drift FROM sq WHERE old_date IS NOT NULL)"
TYPE_SQL = "CASE WHEN day(snapshot_date) = 1 AND month(snapshot_date) = 1 THEN 'yearly' WHEN day(snapshot_date) = 1 AND month(snapshot_date) IN (4, 7, 10) THEN 'quarterly' WHEN day(snapshot_date) = 1 THEN 'monthly' WHEN isodow(snapshot_date) = 7 THEN 'weekly' ELSE 'daily' END"


_SHARES = {"low": 0.2, "middle": 0.5, "high": 0.8}
_COLUMNS = [(a, f, f"{a}__{f}") for a, fs in axes.AXES.items() for f in fs]


def _all_axes_sql() -> str:
    """Distances of all customers to the quantile segments of all axes, as ds13 (customer_id, axis, segment, d)."""
    flat = ", ".join(f"coalesce(CAST({f} AS DOUBLE), 0) AS {c}" for _, f, c in _COLUMNS)
    stats = ", ".join(f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS s_{c}, quantile_cont({c}, [0.2, 0.5, 0.8]) AS q_{c}" for *_, c in _COLUMNS)
    far = lambda a, k: "sqrt(" + " + ".join(f"pow(({c} - m_{c}) / s_{c} - round((q_{c}[{k}] - m_{c}) / s_{c}, 4), 2)" for x, _, c in _COLUMNS if x == a) + ")"
    each = ", ".join(f"{{'axis': '{a}', 'segment': '{n}', 'd': {far(a, k)}}}" for a in axes.AXES for k, n in enumerate(_SHARES, 1))
    return (
        WIDE + f", fl AS MATERIALIZED (SELECT customer_id, {flat} FROM wide), st AS MATERIALIZED (SELECT {stats} FROM fl), "
        f"ds13 AS MATERIALIZED (SELECT customer_id, u.axis AS axis, u.segment AS segment, u.d AS d FROM (SELECT customer_id, unnest([{each}]) AS u FROM fl, st)), "
        "m13 AS MATERIALIZED (SELECT *, exp(-d) / sum(exp(-d)) OVER w AS score, row_number() OVER (w ORDER BY exp(-d) DESC, segment) AS rn FROM ds13 WINDOW w AS (PARTITION BY customer_id, axis))"
    )


ALL_AXES = _all_axes_sql()
STRENGTH13 = "CASE WHEN a.score > 0.7 THEN 'strong' WHEN a.score > 0.4 AND b.score > 0.3 THEN 'balanced' ELSE 'weak' END"
TOP13 = f"t13 AS (SELECT a.customer_id, a.axis, a.segment AS one, {STRENGTH13} AS strength, a.segment || ':' || CAST(round(a.score, 1) AS VARCHAR) || ',' || b.segment || ':' || CAST(round(b.score, 1) AS VARCHAR) AS two FROM m13 a JOIN m13 b ON a.customer_id = b.customer_id AND a.axis = b.axis AND a.rn = 1 AND b.rn = 2)"
SIGNED13 = TOP13 + ", s13 AS (SELECT customer_id, string_agg(axis || '=' || one, ';' ORDER BY axis) AS level1, string_agg(axis || '=' || one || ':' || strength, ';' ORDER BY axis) AS level2, string_agg(axis || '=' || two, ';' ORDER BY axis) AS level3 FROM t13 GROUP BY 1)"


def quantiled_of(t, only: tuple[str, ...] = tuple(axes.AXES), keep: tuple[str, ...] = ()):
    """Features of the axes, with the columns of ``keep``, written once, and segments at the quantiles of each axis."""
    path = work_path(t.spark, "features")
    axes.flatten(wide_of(t), only, keep).write.parquet(path)
    features = t.spark.read.parquet(path)
    return features, segmentation.quantile_segments(features, tuple(_SHARES.values()), tuple(_SHARES), only)


def scored_of(t, kind: str = "exp"):
    """All customers on all axes, by the segments at the quantiles of each axis, and these segments; features and scores are written once, so that no explode works them out again."""
    scored = work_path(t.spark, "profiles")
    features, segments = quantiled_of(t)
    segmentation.assign(features, segments, kind).write.parquet(scored)
    return t.spark.read.parquet(scored), segments


def assigned_of(t, kind: str = "exp"):
    return scored_of(t, kind)[0]


def scaled(t):
    w = wide_of(t)
    return w, mem.fit_scaler(w, FEATURES)


def member(t, kind="exp"):
    w, s = scaled(t)
    d = mem.distances(s.columns(), CENTERS)
    return w.select("customer_id", d.alias("d"), mem.memberships(d, kind).alias("m"))


def snaps_of(t):
    return snapshots.snapshots(orders_of(t), DATES)


@query("CLU-1", f"WITH {WIDE}, q AS (SELECT quantile_cont(lifetime_value, 0.01) AS lo, quantile_cont(lifetime_value, 0.99) AS hi FROM wide) SELECT customer_id, round(least(greatest(lifetime_value, lo), hi), 4) AS lifetime_value FROM wide, q")
def clu_1(t):
    w = wide_of(t)
    low, high = mem.clip_limits(w, ("lifetime_value",))
    return w.select("customer_id", r(F.least(F.greatest("lifetime_value", F.lit(low[0])), F.lit(high[0])), 4).alias("lifetime_value"))


@query("CLU-2", f"WITH {WIDE}, q AS (SELECT quantile_cont(lifetime_value, 0.25) AS a, median(lifetime_value) AS b, quantile_cont(lifetime_value, 0.75) AS c, quantile_cont(has_returns, 0.75) - quantile_cont(has_returns, 0.25) AS z, median(has_returns) AS hm FROM wide) SELECT customer_id, round((lifetime_value - b) / (c - a), 6) AS lifetime_value, round((has_returns - hm) / CASE WHEN z = 0 THEN 1 ELSE z END, 6) AS has_returns FROM wide, q")
def clu_2(t):
    # Written once: the quantiles read the two columns twice before the customers are scaled.
    path = work_path(t.spark, "two-features")
    wide_of(t).select("customer_id", "lifetime_value", "has_returns").write.parquet(path)
    w = t.spark.read.parquet(path)
    x, y = mem.fit_scaler(w, ("lifetime_value", "has_returns"), "robust").columns()
    return w.select("customer_id", r(x).alias("lifetime_value"), r(y).alias("has_returns"))


@query("CLU-3", f"WITH {SCALED} SELECT customer_id, round(x1, 6) AS lifetime_value, round(x2, 6) AS avg_order_value FROM x")
def clu_3(t):
    w, s = scaled(t)
    x, y = s.columns()
    return w.select("customer_id", r(x).alias("lifetime_value"), r(y).alias("avg_order_value"))


@query("JOIN-7", f"WITH {SCALED} SELECT customer_id, segment, round(d, 6) AS distance FROM ds")
def join_7(t):
    return member(t).select("customer_id", F.explode("d").alias("segment", "distance")).withColumn("distance", r("distance"))


@query("MEM-1", f"WITH {ALL_AXES} SELECT customer_id, axis, segment, round(score, 6) AS score FROM m13")
def mem_1(t):
    m = assigned_of(t).select("customer_id", F.explode("memberships").alias("axis", "m"))
    return m.select("customer_id", "axis", F.explode("m").alias("segment", "score")).withColumn("score", r("score"))


@query("MEM-2", f"WITH {ALL_AXES} SELECT customer_id, axis, segment, round(1 / (1 + d) / sum(1 / (1 + d)) OVER (PARTITION BY customer_id, axis), 6) AS score FROM ds13")
def mem_2(t):
    m = assigned_of(t, "inverse").select("customer_id", F.explode("memberships").alias("axis", "m"))
    return m.select("customer_id", "axis", F.explode("m").alias("segment", "score")).withColumn("score", r("score"))


@query("MEM-3", f"WITH {ALL_AXES} SELECT customer_id, string_agg(axis || '=' || segment, ';' ORDER BY axis) AS segments, round(avg(1 / (1 + d)), 6) AS confidence FROM m13 WHERE rn = 1 GROUP BY 1")
def mem_3(t):
    nearest = F.array_join(F.array_sort(F.transform(F.map_entries("dominant"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";")
    return assigned_of(t, "nearest").select("customer_id", nearest.alias("segments"), r("confidence").alias("confidence"))


@query("MEM-4", f"WITH {MEMBER} SELECT a.customer_id, a.segment AS dominant, b.segment AS second, CASE WHEN a.score > 0.7 THEN 'strong' WHEN a.score > 0.4 AND b.score > 0.3 THEN 'balanced' ELSE 'weak' END AS strength FROM m a JOIN m b ON a.customer_id = b.customer_id AND a.rn = 1 AND b.rn = 2")
def mem_4(t):
    top = member(t).select("customer_id", mem.ranked(F.col("m")).alias("t"))
    return top.select("customer_id", F.col("t")[0]["segment"].alias("dominant"), F.col("t")[1]["segment"].alias("second"), mem.strength(F.col("t")).alias("strength"))


@query("TOP-2", f"WITH {MEMBER} SELECT customer_id, string_agg(segment, ',' ORDER BY rn) AS top2 FROM m WHERE rn <= 2 GROUP BY 1")
def top_2(t):
    return member(t).select("customer_id", F.array_join(F.transform(F.slice(mem.ranked(F.col("m")), 1, 2), lambda x: x["segment"]), ",").alias("top2"))


@query("MEM-5", f"WITH {MEMBER}, f AS (SELECT * FROM m WHERE NOT (segment = 'middle' AND customer_id % 2 = 0)), n AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY score DESC, segment) AS k FROM f) SELECT customer_id, segment AS best, round(score, 6) AS strength FROM n WHERE k = 1")
def mem_5(t):
    odd = F.transform_values("m", lambda k, v: F.when((k == "middle") & (F.col("customer_id") % 2 == 0), float("nan")).otherwise(v))
    clean = F.map_filter(odd, lambda k, v: ~F.isnan(v))
    return member(t).select("customer_id", mem.ranked(clean)[0].alias("b")).select("customer_id", F.col("b.segment").alias("best"), r("b.score").alias("strength"))


@query("MEM-6", f"WITH {PROF} SELECT customer_id, 'A ' || seg_purchase_frequency || ' buyer, ' || seg_purchase_value || ' value, ' || seg_customer_maturity || ', ' || seg_return_behavior AS profile FROM prof")
def mem_6(t):
    s = F.col("dominant_segments")
    return profiles_of(t).select("customer_id", F.concat(F.lit("A "), F.concat_ws(", ", F.concat(s["purchase_frequency"], F.lit(" buyer")), F.concat(s["purchase_value"], F.lit(" value")), s["customer_maturity"], s["return_behavior"])).alias("profile"))


@query("MEM-7", f"WITH {PROF}, q AS (SELECT quantile_cont(lifetime_value, 0.25) AS a, median(lifetime_value) AS b, quantile_cont(lifetime_value, 0.75) AS c FROM prof), s AS (SELECT seg_purchase_value AS segment, avg(lifetime_value) AS v FROM prof GROUP BY 1) SELECT segment, CASE WHEN v < a THEN 'very low' WHEN v < b THEN 'low' WHEN v < c THEN 'high' ELSE 'very high' END AS label FROM s, q")
def mem_7(t):
    p = profiles_of(t)
    q = p.agg(F.percentile("lifetime_value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    s = p.groupBy(F.col("dominant_segments")["purchase_value"].alias("segment")).agg(F.avg("lifetime_value").alias("v"))
    return s.crossJoin(F.broadcast(q)).select("segment", F.when(F.col("v") < F.col("q")[0], "very low").when(F.col("v") < F.col("q")[1], "low").when(F.col("v") < F.col("q")[2], "high").otherwise("very high").alias("label"))


@query("MEM-8", f"WITH {PROF} SELECT customer_id, axis, segment FROM seg")
def mem_8(t):
    return profiles_of(t).select("customer_id", F.explode("dominant_segments").alias("axis", "segment"))


@query("MEM-9", f"WITH {ALL_AXES} SELECT customer_id, string_agg(CAST(round(d, 3) AS VARCHAR), ' ' ORDER BY axis, segment) AS fingerprint FROM ds13 GROUP BY 1")
def mem_9(t):
    of = lambda m: F.transform(F.array_sort(F.map_entries(m)), lambda e: F.round(e["value"], 3).cast("string"))
    parts = F.flatten(F.transform(F.array_sort(F.map_keys("distances")), lambda a: of(F.col("distances")[a])))
    return assigned_of(t).select("customer_id", F.array_join(parts, " ").alias("fingerprint"))


@query("ARC-1", f"WITH {ALL_AXES}, {SIGNED13} SELECT customer_id, level1, level2, level3 FROM s13")
def arc_1(t):
    return segmentation.signatures(assigned_of(t))


@query("ARC-2", f"WITH {PROF} SELECT signature, count(*) AS members, round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM prof), 6) AS share FROM prof GROUP BY 1")
def arc_2(t):
    return rounded(segmentation.shares_of(profiles_of(t), "signature"))


@query("ARC-3", f"WITH {PROF}, c AS (SELECT signature, count(*) AS n FROM prof GROUP BY 1), k AS (SELECT n, row_number() OVER (ORDER BY n DESC, signature) AS i, row_number() OVER (ORDER BY n, signature) AS j, count(*) OVER () AS k FROM c) SELECT count(*) AS archetypes, count(*) FILTER (n = 1) AS singles, count(*) FILTER (n BETWEEN 2 AND 5) AS small, count(*) FILTER (n BETWEEN 6 AND 10) AS medium, count(*) FILTER (n > 10) AS large, round(avg(n), 6) AS mean_size, max(n) FILTER (j = k // 2 + 1) AS median_size, round(CAST(sum(n) FILTER (i <= 10) AS DOUBLE) / sum(n), 6) AS top10 FROM k")
def arc_3(t):
    from pyspark.sql.window import Window as W

    c = profiles_of(t).groupBy("signature").agg(F.count("*").alias("n"))
    k = c.select("n", F.row_number().over(W.orderBy(F.col("n").desc(), "signature")).alias("i"), F.row_number().over(W.orderBy("n", "signature")).alias("j"), F.count("*").over(W.partitionBy()).alias("k"))
    n = F.col("n")
    return k.agg(F.count("*").alias("archetypes"), F.count_if(n == 1).alias("singles"), F.count_if(n.between(2, 5)).alias("small"), F.count_if(n.between(6, 10)).alias("medium"), F.count_if(n > 10).alias("large"), r(F.avg("n")).alias("mean_size"), F.max(F.when(F.col("j") == F.floor(F.col("k") / 2) + 1, n)).alias("median_size"), r(F.sum(F.when(F.col("i") <= 10, n)) / F.sum("n")).alias("top10"))


@query("ARC-4", f"WITH {ALL_AXES}, {SIGNED13} SELECT count(DISTINCT level1) AS dominant_archetypes, count(DISTINCT level2) AS strength_archetypes, count(DISTINCT level3) AS fuzzy_archetypes, round(CAST(count(DISTINCT level3) AS DOUBLE) / count(DISTINCT level1), 6) AS gain FROM s13")
def arc_4(t):
    kinds = segmentation.archetypes(arc_1(t)).groupBy().agg(*[F.count_if(F.col("level") == k).alias(n) for k, n in enumerate(("dominant_archetypes", "strength_archetypes", "fuzzy_archetypes"), 1)])
    return kinds.withColumn("gain", r(F.col("fuzzy_archetypes") / F.col("dominant_archetypes")))


@query("ARC-5", f"WITH {PROF} SELECT archetype_id, count(*) AS members FROM prof GROUP BY 1 HAVING count(*) >= 10")
def arc_5(t):
    return profiles_of(t).groupBy("archetype_id").agg(F.count("*").alias("members")).where("members >= 10")


@query("ARC-6", f"WITH {PROF} SELECT DISTINCT archetype_id, replace(replace(signature, '=', ':'), ';', ',') AS traits FROM prof")
def arc_6(t):
    traits = F.array_join(F.array_sort(F.transform(F.map_entries("dominant_segments"), lambda e: F.concat_ws(":", e["key"], e["value"]))), ",")
    return profiles_of(t).select("archetype_id", traits.alias("traits")).distinct()


@query("SNP-1", f"WITH {SNAPS} SELECT customer_id, CAST(snapshot_date AS VARCHAR) AS snapshot_date, {TYPE_SQL} AS snapshot_type, orders_at, round(value_at, 4) AS value_at, archetype FROM sq")
def snp_1(t):
    return snaps_of(t).select("customer_id", F.col("snapshot_date").cast("string").alias("snapshot_date"), "snapshot_type", "orders_at", r("value_at", 4).alias("value_at"), "archetype")


@query("WIN-5", f"WITH {SNAPS} SELECT customer_id, CAST(snapshot_date AS VARCHAR) AS snapshot_date, CAST(old_date AS VARCHAR) AS old_snapshot_date, o_f || '/' || o_v AS old_archetype FROM sq WHERE old_date IS NOT NULL")
def win_5(t):
    return snapshots.consecutive(snaps_of(t)).select("customer_id", F.col("snapshot_date").cast("string").alias("snapshot_date"), F.col("old_snapshot_date").cast("string").alias("old_snapshot_date"), "old_archetype")


@query("WIN-6", f"WITH {SNAPS}, k AS (SELECT *, {TYPE_SQL} AS ty FROM sq), n AS (SELECT *, row_number() OVER (PARTITION BY customer_id, ty ORDER BY snapshot_date DESC) AS rn FROM k) SELECT customer_id, ty AS snapshot_type, CAST(snapshot_date AS VARCHAR) AS snapshot_date, archetype FROM n WHERE rn = 1")
def win_6(t):
    g = snaps_of(t).groupBy("customer_id", "snapshot_type").agg(F.max(F.struct("snapshot_date", "archetype")).alias("s"))
    return g.select("customer_id", "snapshot_type", F.col("s.snapshot_date").cast("string").alias("snapshot_date"), "s.archetype")


@query("DRF-1", f"WITH {STEPS} SELECT customer_id, CAST(snapshot_date AS VARCHAR) AS snapshot_date, 'frequency' AS axis, round(df, 6) AS drift, dom_frequency <> o_f AS changed FROM sp UNION ALL SELECT customer_id, CAST(snapshot_date AS VARCHAR), 'value', round(dv, 6), dom_value <> o_v FROM sp")
def drf_1(t):
    s = snapshots.consecutive(snaps_of(t))
    return s.select("customer_id", F.col("snapshot_date").cast("string").alias("snapshot_date"), "changed_axes", F.explode("axis_drift").alias("axis", "drift")).select("customer_id", "snapshot_date", "axis", r("drift").alias("drift"), F.array_contains("changed_axes", F.col("axis")).alias("changed"))


@query("DRF-2", f"WITH {STEPS} SELECT customer_id, CAST(snapshot_date AS VARCHAR) AS snapshot_date, CAST(days AS INT) AS days, round(drift, 6) AS drift, round(drift / days, 8) AS velocity, CASE WHEN drift < 0.1 THEN 'stable' WHEN drift < 0.3 THEN 'minor' WHEN drift < 0.5 THEN 'moderate' WHEN drift < 0.7 THEN 'major' ELSE 'severe' END AS severity, drift >= 0.5 AS anomaly, round(value_at - o_value, 4) AS value_delta FROM sp")
def drf_2(t):
    s = snapshots.consecutive(snaps_of(t))
    return s.select("customer_id", F.col("snapshot_date").cast("string").alias("snapshot_date"), "days", r("drift").alias("drift"), r("velocity", 8).alias("velocity"), "severity", "anomaly", r("value_delta", 4).alias("value_delta"))


@query("DRF-3", f"WITH {STEPS} SELECT customer_id, count(*) AS steps, CAST(sum(days) AS BIGINT) AS days FROM sp GROUP BY 1")
def drf_3(t):
    return snapshots.consecutive(snaps_of(t)).groupBy("customer_id").agg(F.count("*").alias("steps"), F.sum("days").alias("days"))


SUMMARY = "su AS (SELECT customer_id, count(*) AS n, avg(drift) AS mean_drift, max(drift) AS max_drift, min(drift) AS min_drift, stddev_pop(drift) AS drift_std, count(*) FILTER (drift >= 0.5) AS anomalies, count(*) FILTER (dom_frequency <> o_f OR dom_value <> o_v) AS transitions, CASE WHEN count(*) >= 3 THEN regr_slope(drift / days, i) END AS sl, avg(drift / days) AS mv FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY snapshot_date) - 1 AS i FROM sp) GROUP BY 1)"


@query("DRF-4", f"WITH {STEPS}, {SUMMARY} SELECT customer_id, n, round(mean_drift, 6) AS mean_drift, round(max_drift, 6) AS max_drift, round(min_drift, 6) AS min_drift, round(drift_std, 6) AS drift_std, anomalies, transitions FROM su")
def drf_4(t):
    return rounded(snapshots.drift_summary(snapshots.consecutive(snaps_of(t))).select("customer_id", "n", "mean_drift", "max_drift", "min_drift", "drift_std", "anomalies", "transitions"))


@query("DRF-5", f"WITH {STEPS}, {SUMMARY} SELECT customer_id, CASE WHEN n < 3 THEN 'insufficient_data' WHEN sl > 0.01 THEN 'accelerating' WHEN sl < -0.01 THEN 'stabilizing' WHEN mv > 0.02 THEN 'steady_drift' ELSE 'stable' END AS pattern, 0 AS oscillations FROM su")
def drf_5(t):
    return snapshots.drift_summary(snapshots.consecutive(snaps_of(t))).select("customer_id", "pattern", "oscillations")


L2_ALL = "sqrt(" + " + ".join(f"({s} - o_{s}) * ({s} - o_{s})" for v in snapshots.CENTERS.values() for s in v) + ")"


@query("DRF-6", f"WITH {STEPS} SELECT customer_id, CAST(snapshot_date AS VARCHAR) AS snapshot_date, round({L2_ALL}, 6) AS magnitude FROM sp ORDER BY round({L2_ALL}, 6) DESC, customer_id, snapshot_date LIMIT 20")
def drf_6(t):
    from pyspark.sql.window import Window as W

    w = W.partitionBy("customer_id").orderBy("snapshot_date")
    s = snaps_of(t).select("customer_id", "snapshot_date", "memberships", F.lag("memberships").over(w).alias("old")).where(F.col("old").isNotNull())
    return s.select("customer_id", F.col("snapshot_date").cast("string").alias("snapshot_date"), r(mem.membership_drift(F.col("old"), F.col("memberships"))).alias("magnitude")).orderBy(F.col("magnitude").desc(), "customer_id", "snapshot_date").limit(20)


@query("UDF-1", f"WITH {STEPS} SELECT customer_id, CAST(snapshot_date AS VARCHAR) AS snapshot_date, round({L2_ALL}, 6) AS magnitude FROM sp")
def udf_1(t):
    """The drift of two membership maps as a SQL function of the session."""
    t.spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION calculate_membership_drift(m1 MAP<STRING, MAP<STRING, DOUBLE>>, m2 MAP<STRING, MAP<STRING, DOUBLE>>) RETURNS DOUBLE
        RETURN sqrt(aggregate(map_values(map_zip_with(m1, m2, (k, a, b) -> CASE WHEN a IS NULL OR b IS NULL THEN 0D ELSE aggregate(map_values(map_zip_with(a, b, (s, x, y) -> power(coalesce(x, 0D) - coalesce(y, 0D), 2))), 0D, (p, q) -> p + q) END)), 0D, (p, q) -> p + q))""")
    from pyspark.sql.window import Window as W

    w = W.partitionBy("customer_id").orderBy("snapshot_date")
    s = snaps_of(t).select("customer_id", F.col("snapshot_date").cast("string").alias("snapshot_date"), "memberships", F.lag("memberships").over(w).alias("old")).where(F.col("old").isNotNull())
    return s.select("customer_id", "snapshot_date", r(F.call_function("calculate_membership_drift", F.col("old"), F.col("memberships"))).alias("magnitude"))


# Snapshots close enough for both horizons of days.
NEAR_DATES = [REFERENCE - timedelta(days=d) for d in (180, 90, 28, 14, 7, 0)]
NEAR_SNAPS = SNAPS.replace(", ".join(f"DATE '{d}'" for d in DATES), ", ".join(f"DATE '{d}'" for d in NEAR_DATES))
_SEGS = [s for v in snapshots.CENTERS.values() for s in v]
_GAP = lambda a, b: "sqrt(" + " + ".join(f"({a}.{s} - {b}.{s}) * ({a}.{s} - {b}.{s})" for s in _SEGS) + ")"
HORIZONS = "hz AS (SELECT a.*, " + ", ".join([f"date_diff('day', s7.snapshot_date, a.snapshot_date) AS d7, {_GAP('a', 's7')} AS g7, {_GAP('s7', 's14')} AS short_drift, {_GAP('s90', 's180')} AS long_drift, s28.archetype AS from_archetype, s28.dom_frequency AS f28, s28.dom_value AS v28, date_diff('day', s28.snapshot_date, a.snapshot_date) AS days_elapsed"]) + " FROM sq a " + " ".join(f"ASOF LEFT JOIN sq s{h} ON a.customer_id = s{h}.customer_id AND a.snapshot_date - {h} >= s{h}.snapshot_date" for h in (7, 14, 28, 90, 180)) + ")"


@query("DRF-7", f"WITH {NEAR_SNAPS}, {HORIZONS} SELECT customer_id, CAST(snapshot_date AS VARCHAR) AS snapshot_date, round(g7 / d7, 8) AS velocity, CASE WHEN g7 / d7 > 0.015 THEN 'RAPID_DRIFT' WHEN g7 / d7 > 0.008 THEN 'MODERATE_DRIFT' WHEN g7 IS NOT NULL THEN 'STABLE' END AS alert, round(short_drift, 6) AS short_drift, round(long_drift, 6) AS long_drift, round(short_drift - long_drift, 6) + 0 AS acceleration, from_archetype <> archetype AS migrated, from_archetype, archetype AS to_archetype, CASE WHEN f28 IS NOT NULL THEN concat_ws(',', CASE WHEN f28 <> dom_frequency THEN 'frequency:' || f28 || '>' || dom_frequency END, CASE WHEN v28 <> dom_value THEN 'value:' || v28 || '>' || dom_value END) END AS axes_changed, CAST(days_elapsed AS INT) AS days_elapsed, CASE WHEN f28 = 'heavy' AND dom_frequency <> 'heavy' AND g7 / d7 > 0.01 THEN 'HIGH' END AS churn_risk FROM hz")
def drf_7(t):
    h = snapshots.horizons(snapshots.snapshots(orders_of(t), NEAR_DATES))
    changed = F.array_join(F.transform("axes_changed", lambda x: F.concat(x["axis"], F.lit(":"), x["from"], F.lit(">"), x["to"])), ",")
    return h.withColumn("axes_changed", changed).withColumn("snapshot_date", F.col("snapshot_date").cast("string")).withColumn("velocity", r("velocity", 8)).select(*[(r(c) + 0.0).alias(c) if c.endswith("drift") or c == "acceleration" else c for c in ("customer_id", "snapshot_date", "velocity", "alert", "short_drift", "long_drift", "acceleration", "migrated", "from_archetype", "to_archetype", "axes_changed", "days_elapsed", "churn_risk")])


STAR_RUNS = (DATES[1], DATES[3])
_KEY = lambda level, c: f"substr(md5('{level}|' || {c}), 1, 16)"
STAR = f"p AS (SELECT *, {_KEY('l1', 'dom_frequency')} AS l1_id, {_KEY('l2', 'archetype')} AS l2_id FROM sq WHERE snapshot_date IN ({', '.join(f'DATE {chr(39)}{d}{chr(39)}' for d in STAR_RUNS)})), a AS (SELECT * FROM p WHERE snapshot_date = DATE '{STAR_RUNS[0]}'), b AS (SELECT * FROM p WHERE snapshot_date = DATE '{STAR_RUNS[1]}'), dm AS (SELECT l1_id AS k, 'l1' AS level, dom_frequency AS signature, snapshot_date, value_at FROM p UNION ALL SELECT l2_id, 'l2', archetype, snapshot_date, value_at FROM p), dg AS (SELECT k, level, signature, snapshot_date, count(*) AS n, avg(value_at) AS v FROM dm GROUP BY ALL), tt AS (SELECT snapshot_date, count(*) AS n FROM p GROUP BY 1), dx AS (SELECT dg.*, 100.0 * dg.n / tt.n AS pct, row_number() OVER (PARTITION BY k ORDER BY snapshot_date) AS nth FROM dg JOIN tt USING (snapshot_date)), hs AS (SELECT a.customer_id, a.l1_id, a.l2_id, a.orders_at, a.value_at, a.snapshot_date AS valid_from, CASE WHEN a.l1_id <> b.l1_id OR a.l2_id <> b.l2_id THEN b.snapshot_date END AS valid_to FROM a LEFT JOIN b USING (customer_id) UNION ALL SELECT b.customer_id, b.l1_id, b.l2_id, b.orders_at, b.value_at, b.snapshot_date, NULL FROM b LEFT JOIN a USING (customer_id) WHERE a.customer_id IS NULL OR a.l1_id <> b.l1_id OR a.l2_id <> b.l2_id)"


@query("SRC-15", f"WITH {SNAPS}, {STAR} SELECT 'dim_archetype' AS part, NULL::BIGINT AS customer_id, k AS l1_id, level AS l2_id, signature, n, round(v, 4) AS value, round(pct, 6) AS pct, CAST(snapshot_date AS VARCHAR) AS since, NULL AS until FROM dx WHERE nth = 1 UNION ALL SELECT 'fact_current', b.customer_id, b.l1_id, b.l2_id, NULL, b.orders_at, round(b.value_at, 4), NULL, CAST(coalesce(a.snapshot_date, b.snapshot_date) AS VARCHAR), CAST(b.snapshot_date AS VARCHAR) FROM b LEFT JOIN a USING (customer_id) UNION ALL SELECT 'fact_history', customer_id, l1_id, l2_id, NULL, orders_at, round(value_at, 4), NULL, CAST(valid_from AS VARCHAR), CAST(valid_to AS VARCHAR) FROM hs")
def src_15(t):
    """Two runs of the star schema, from customers as they were at two dates; all columns of its three tables."""
    path = work_path(t.spark, "star")
    snaps = snapshots.snapshots(orders_of(t), list(STAR_RUNS)).withColumn("frequency", F.col("dominant")["frequency"])
    for day in STAR_RUNS:
        star.load(snaps.where(F.col("snapshot_date") == day), path, datetime(day.year, day.month, day.day), {"l1": "frequency", "l2": "archetype"}, ("orders_at", "value_at"), "value_at")
    nothing, day = lambda kind: F.lit(None).cast(kind), lambda c: F.to_date(c).cast("string")
    dim = star.read(t.spark, path, "dim_archetype").select(F.lit("dim_archetype").alias("part"), nothing("long").alias("customer_id"), F.col("archetype_id").alias("l1_id"), F.col("level").alias("l2_id"), "signature", F.col("member_count").alias("n"), r("mean_value", 4).alias("value"), r("population_pct").alias("pct"), day("first_seen").alias("since"), nothing("string").alias("until"))
    facts = lambda name, since, until: star.read(t.spark, path, name).select(F.lit(name).alias("part"), "customer_id", "l1_id", "l2_id", nothing("string").alias("signature"), F.col("orders_at").alias("n"), r("value_at", 4).alias("value"), nothing("double").alias("pct"), day(since).alias("since"), day(until).alias("until"))
    return dim.unionByName(facts("fact_current", "first_seen", "last_updated")).unionByName(facts("fact_history", "valid_from", "valid_to"))


MOVES = "rs AS (SELECT *, max(CASE WHEN old_date IS NULL OR o_f || '/' || o_v <> archetype THEN snapshot_date END) OVER (PARTITION BY customer_id ORDER BY snapshot_date ROWS UNBOUNDED PRECEDING) AS run FROM sq), mv AS (SELECT customer_id, o_f || '/' || o_v AS from_archetype, archetype AS to_archetype, snapshot_date, old_date, date_diff('day', orun, snapshot_date) AS days_in_previous FROM (SELECT *, lag(run) OVER (PARTITION BY customer_id ORDER BY snapshot_date) AS orun FROM rs) WHERE old_date IS NOT NULL AND o_f || '/' || o_v <> archetype)"


@query("WIN-10", f"WITH {SNAPS}, {MOVES} SELECT customer_id, from_archetype, to_archetype, CAST(snapshot_date AS VARCHAR) AS snapshot_date, CAST(days_in_previous AS INT) AS days_in_previous FROM mv")
def win_10(t):
    return snapshots.transitions(snaps_of(t)).withColumn("snapshot_date", F.col("snapshot_date").cast("string"))


@query("AGG-19", f"WITH {STEPS}, {MOVES} SELECT from_archetype, to_archetype, count(*) AS n, round(avg(days_in_previous), 6) AS avg_days, round(avg(sp.drift), 6) AS avg_drift, round(avg(sp.drift / sp.days), 9) AS avg_velocity, CAST(min(mv.snapshot_date) AS VARCHAR) AS first_seen, CAST(max(mv.snapshot_date) AS VARCHAR) AS last_seen FROM mv JOIN sp ON sp.customer_id = mv.customer_id AND sp.snapshot_date = mv.snapshot_date GROUP BY 1, 2 HAVING count(*) >= 3")
def agg_19(t):
    p = rounded(snapshots.transition_paths(snaps_of(t)).withColumn("avg_velocity", r("avg_velocity", 9)), 6, ("avg_velocity",))
    return p.withColumn("first_seen", F.col("first_seen").cast("string")).withColumn("last_seen", F.col("last_seen").cast("string"))


@query("AGG-29", f"WITH {SNAPS} SELECT customer_id, count(*) AS snapshots FROM sn GROUP BY 1 HAVING count(*) >= 2")
def agg_29(t):
    return snaps_of(t).groupBy("customer_id").agg(F.count("*").alias("snapshots")).where("snapshots >= 2")


@query("JOIN-15", f"WITH {SNAPS}, w AS (SELECT * FROM sq WHERE snapshot_date BETWEEN DATE '1999-04-01' AND DATE '2001-08-01') SELECT customer_id, CAST(min(snapshot_date) AS VARCHAR) AS base_date, CAST(max(snapshot_date) AS VARCHAR) AS last_date, arg_min(archetype, snapshot_date) AS base, arg_max(archetype, snapshot_date) AS last FROM w GROUP BY 1")
def join_15(t):
    w = snaps_of(t).where(F.col("snapshot_date").between(date(1999, 4, 1), REFERENCE))
    return w.groupBy("customer_id").agg(F.min("snapshot_date").cast("string").alias("base_date"), F.max("snapshot_date").cast("string").alias("last_date"), F.min_by("archetype", "snapshot_date").alias("base"), F.max_by("archetype", "snapshot_date").alias("last"))


@query("JOIN-16", f"WITH {SNAPS} SELECT customer_id, " + ", ".join(f"arg_max(archetype, snapshot_date) FILTER (snapshot_date <= DATE '2001-08-01' - {h}) AS archetype_{h}d" for h in (0, 180, 400, 800)) + " FROM sq GROUP BY 1")
def join_16(t):
    return snapshots.as_of(snaps_of(t), REFERENCE, [0, 180, 400, 800], "archetype")


@query("FLT-6", f"WITH {SNAPS} SELECT customer_id, CAST(snapshot_date AS VARCHAR) AS snapshot_date, archetype FROM sq WHERE snapshot_date >= DATE '1999-01-01' AND {TYPE_SQL} = 'yearly' ORDER BY snapshot_date DESC, customer_id LIMIT 40")
def flt_6(t):
    s = snaps_of(t).where((F.col("snapshot_date") >= date(1999, 1, 1)) & (F.col("snapshot_type") == "yearly"))
    return s.orderBy(F.col("snapshot_date").desc(), "customer_id").limit(40).select("customer_id", F.col("snapshot_date").cast("string").alias("snapshot_date"), "archetype")


@query("FLT-7", f"WITH {SNAPS} SELECT customer_id, archetype FROM sq WHERE snapshot_date >= DATE '2001-08-01' - 30")
def flt_7(t):
    return snaps_of(t).where(F.col("snapshot_date") >= F.date_sub(F.lit(REFERENCE), 30)).select("customer_id", "archetype")


@query("FLT-8", f"WITH {SNAPS}, k AS (SELECT *, {TYPE_SQL} AS ty FROM sq) SELECT customer_id, CAST(snapshot_date AS VARCHAR) AS snapshot_date, ty AS snapshot_type FROM k WHERE date_diff('day', snapshot_date, DATE '2001-08-01') <= CASE ty WHEN 'daily' THEN 7 WHEN 'weekly' THEN 60 WHEN 'monthly' THEN 365 WHEN 'quarterly' THEN 730 ELSE 1825 END")
def flt_8(t):
    return snapshots.purge(snaps_of(t), REFERENCE).select("customer_id", F.col("snapshot_date").cast("string").alias("snapshot_date"), "snapshot_type")


@query("TOP-5", f"WITH {STEPS}, l AS (SELECT customer_id, 'frequency' AS axis, df AS d FROM sp UNION ALL SELECT customer_id, 'value', dv FROM sp), g AS (SELECT customer_id, axis, avg(d) AS mean_drift FROM l GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY round(mean_drift, 9) DESC, axis) AS place FROM g) SELECT customer_id, axis, round(mean_drift, 6) AS mean_drift, place FROM n WHERE place <= 5")
def top_5(t):
    from pyspark.sql.window import Window as W

    g = snapshots.consecutive(snaps_of(t)).select("customer_id", F.explode("axis_drift").alias("axis", "d")).groupBy("customer_id", "axis").agg(F.avg("d").alias("mean_drift"))
    n = g.withColumn("place", F.row_number().over(W.partitionBy("customer_id").orderBy(F.round("mean_drift", 9).desc(), "axis")).cast("long"))
    return n.where("place <= 5").withColumn("mean_drift", r("mean_drift"))


@query("SET-2", f"WITH {PROF} SELECT customer_id, 'a,b,' || seg_purchase_value AS all_keys FROM prof")
def set_2(t):
    old, new = F.create_map(F.lit("b"), F.lit(0.5), F.lit("a"), F.lit(0.5)), F.create_map(F.col("dominant_segments")["purchase_value"], F.lit(1.0), F.lit("a"), F.lit(0.0))
    return profiles_of(t).select("customer_id", F.array_join(F.array_sort(F.array_union(F.map_keys(old), F.map_keys(new))), ",").alias("all_keys"))


@query("SET-4", f"WITH {PROF} SELECT customer_id, 'support_history' AS missing, 'customer_maturity,return_behavior' AS extra FROM prof")
def set_4(t):
    known = F.array(F.lit("purchase_frequency"), F.lit("purchase_value"), F.lit("support_history"))
    have = F.map_keys("dominant_segments")
    return profiles_of(t).select("customer_id", F.array_join(F.array_except(known, have), ",").alias("missing"), F.array_join(F.array_sort(F.array_except(have, known)), ",").alias("extra"))


OUT13 = "o13 AS (SELECT customer_id, axis, greatest(0, 1 - max(score)) AS s FROM m13 GROUP BY 1, 2), p13 AS (SELECT customer_id, count(*) FILTER (s > 0.55) AS n, coalesce(avg(s) FILTER (s > 0.55), 0) AS mean, coalesce(string_agg(axis, ',' ORDER BY axis) FILTER (s > 0.55), '') AS axes FROM o13 GROUP BY 1)"


def _outliers(t):
    return assigned_of(t).select("customer_id", segmentation.outliers(F.col("memberships"), floor=1.0, cut=0.55, least_axes=2, least_mean=0.6).alias("o")).select("customer_id", "o.*")


@query("OUT-1", f"WITH {ALL_AXES}, {OUT13} SELECT customer_id, axes, round(mean, 6) AS outlier_score, n >= 2 AND mean >= 0.6 AS outlier FROM p13")
def out_1(t):
    return _outliers(t).select("customer_id", F.array_join("flagged", ",").alias("axes"), r("mean").alias("outlier_score"), "outlier")


@query("OUT-2", f"WITH {ALL_AXES}, {OUT13} SELECT axis, count(*) FILTER (s > 0.55) AS flagged, round(avg(s), 6) AS mean_score, count(*) FILTER (s >= 0.6) AS severe, count(*) FILTER (s >= 0.4 AND s < 0.6) AS medium, count(*) FILTER (s < 0.4) AS low FROM o13 GROUP BY 1")
def out_2(t):
    s = F.col("s")
    each = _outliers(t).select(F.explode("axis_scores").alias("axis", "s"))
    return each.groupBy("axis").agg(F.count_if(s > 0.55).alias("flagged"), r(F.avg("s")).alias("mean_score"), F.count_if(s >= 0.6).alias("severe"), F.count_if((s >= 0.4) & (s < 0.6)).alias("medium"), F.count_if(s < 0.4).alias("low"))


@query("W1")
def w1(t):
    """The segments that the whole run finds, with their population; a fit has no SQL."""
    run = segmentation.run(axes.flatten(wide_of(t)), work_path(t.spark, "segmentation"))
    return run["segments"].select("axis", "segment", "k", r("silhouette").alias("silhouette"), "customer_count", r("population_pct").alias("population_pct"))
