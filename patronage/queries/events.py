"""Queries over the event log, batch and streaming."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from patronage.operators import events as ev
from patronage.queries.registry import query, r, rounded
from patronage.sources.landing import work_path
from patronage.streaming import jobs

E_SQL = "ev AS (SELECT event_id, user_id AS entity, ts, event_type FROM events)"
SESS = E_SQL + ", g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS nw FROM ev WINDOW w AS (PARTITION BY entity ORDER BY ts, event_id)), sn AS (SELECT *, sum(nw) OVER (PARTITION BY entity ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS no FROM g), se AS (SELECT entity, no, min(ts) AS a, max(ts) AS b, count(*) AS events, greatest(1.0, epoch_us(max(ts)) / 6e7 - epoch_us(min(ts)) / 6e7) AS minutes FROM sn GROUP BY 1, 2)"
TYPES_N = 5


@query("EVT-1", f"WITH {SESS} SELECT entity, CAST(no AS BIGINT) AS session_no, CAST(a AS VARCHAR) AS session_start, events, round(minutes, 4) AS minutes FROM se")
def evt_1(t):
    return ev.sessions(t.events).select("entity", "session_no", F.col("session_start").cast("string").alias("session_start"), "events", r("minutes", 4).alias("minutes"))


@query("EVT-2", f"WITH {E_SQL}, c AS (SELECT entity, event_type, count(*) AS n FROM ev GROUP BY 1, 2), p AS (SELECT *, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY entity) AS p FROM c) SELECT entity, CAST(sum(n) AS BIGINT) AS events, count(*) AS types, round(CASE WHEN count(*) > 1 THEN sum(-p * log2(p)) / log2(count(*)) ELSE 0 END, 6) AS entropy, round(sum(p * p), 6) AS herfindahl FROM p GROUP BY 1")
def evt_2(t):
    return rounded(ev.engagement(t.events))


STREAK = "dy AS (SELECT DISTINCT entity, CAST(ts AS DATE) AS d FROM ev), il AS (SELECT entity, d - CAST(row_number() OVER (PARTITION BY entity ORDER BY d) AS INT) AS g, count(*) OVER () FROM dy), rn AS (SELECT entity, g, count(*) AS n FROM il GROUP BY 1, 2), st AS (SELECT entity, max(n) AS longest_streak, avg(n) AS mean_streak FROM rn GROUP BY 1)"


@query("WIN-11", f"WITH {E_SQL}, {STREAK} SELECT entity, longest_streak, round(mean_streak, 6) AS mean_streak FROM st")
def win_11(t):
    return rounded(ev.streaks(t.events))


_HOURS = ", ".join(f"avg(CASE WHEN hour(ts) = {h} THEN 1.0 ELSE 0 END) AS h{h}" for h in range(24))
_DAYS = ", ".join(f"avg(CASE WHEN isodow(ts) = {d + 1} THEN 1.0 ELSE 0 END) AS d{d}" for d in range(7))
_SHARES = ", ".join(f"round({c}, 6) AS {c}" for c in (*(f"h{h}" for h in range(24)), *(f"d{d}" for d in range(7))))


@query("EVT-3", f"WITH {SESS}, {STREAK}, h AS (SELECT entity, hour(ts) AS h, row_number() OVER (PARTITION BY entity ORDER BY count(*) DESC, hour(ts)) AS k FROM ev GROUP BY 1, 2), b AS (SELECT entity, {_HOURS}, {_DAYS}, avg(CASE WHEN isodow(ts) >= 6 THEN 1.0 ELSE 0 END) AS wr, avg(CASE WHEN hour(ts) < 6 THEN 1.0 ELSE 0 END) AS nr, count(DISTINCT CAST(ts AS DATE)) AS ad, date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) + 1 AS sd FROM ev GROUP BY 1), s AS (SELECT entity, count(*) AS sessions, avg(minutes) AS mm, CASE WHEN count(*) > 1 THEN var_samp(minutes) END AS vm, avg(events) AS me FROM se GROUP BY 1), gp AS (SELECT entity, (epoch_us(a) - epoch_us(lag(b) OVER (PARTITION BY entity ORDER BY no))) / 3.6e9 AS gap FROM se), gg AS (SELECT entity, coalesce(avg(gap), 0) AS mg, coalesce(CASE WHEN count(gap) > 1 THEN var_samp(gap) END, 0) AS vg FROM gp GROUP BY 1) SELECT entity, {_SHARES}, round(wr, 6) AS weekend_ratio, round(nr, 6) AS night_ratio, CAST(h AS INT) AS busiest_hour, ad AS active_days, sessions, round(mm, 4) AS mean_minutes, round(vm, 4) AS var_minutes, round(me, 4) AS mean_events, round(mg, 4) AS mean_gap_hours, round(vg, 3) AS var_gap_hours, longest_streak, round(mean_streak, 4) AS mean_streak, round(CAST(ad AS DOUBLE) / sd, 6) AS active_ratio FROM b JOIN s USING (entity) JOIN st USING (entity) JOIN gg USING (entity) JOIN h USING (entity) WHERE k = 1")
def evt_3(t):
    d = ev.temporal(t.events)
    digits = {"mean_minutes": 4, "var_minutes": 4, "mean_events": 4, "mean_streak": 4, "mean_gap_hours": 4, "var_gap_hours": 3}
    shares = [r(F.col(c)[k]).alias(f"{c[0]}{k}") for c, n in (("hour_shares", 24), ("day_shares", 7)) for k in range(n)]
    return d.select(*shares, *[r(c, digits.get(c, 6)).alias(c) if k == "double" else c for c, k in d.dtypes if not c.endswith("_shares")])


@query("EVT-4", f"WITH {E_SQL}, d AS (SELECT entity, CAST(ts AS DATE) AS d, count(*) AS n FROM ev GROUP BY 1, 2), q AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY d) - 1 AS i, date_diff('day', d, max(d) OVER (PARTITION BY entity)) AS age FROM d) SELECT entity, round(avg(n), 6) AS per_day, round(CASE WHEN count(*) >= 3 THEN regr_slope(n, i) ELSE 0 END, 6) AS slope, count(*) AS days, round(CASE WHEN count(*) > 1 THEN var_samp(n) END, 6) AS variance, round(CASE WHEN count(*) > 1 THEN stddev_samp(n) / avg(n) END, 6) AS cv, CAST(coalesce(sum(n) FILTER (age < 7), 0) AS BIGINT) AS last_7d, CAST(coalesce(sum(n) FILTER (age BETWEEN 7 AND 13), 0) AS BIGINT) AS prior_7d, round(CAST(coalesce(sum(n) FILTER (age < 7), 0) AS DOUBLE) / greatest(coalesce(sum(n) FILTER (age BETWEEN 7 AND 13), 0), 1), 6) AS trend_ratio FROM q GROUP BY 1")
def evt_4(t):
    return rounded(ev.intensity(t.events))


FIRST = E_SQL + ", sq AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY entity) AS n FROM ev), f AS (SELECT entity, event_type, min(i) AS fi, min(ts) AS ft, max(n) AS n FROM sq GROUP BY 1, 2), fk AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY fi) - 1 AS k, fi - lag(fi) OVER (PARTITION BY entity ORDER BY fi) AS wait FROM f)"


@query("WIN-12", f"WITH {FIRST} SELECT entity, event_type, fi AS first_index, CAST(ft AS VARCHAR) AS first_ts FROM f")
def win_12(t):
    return ev.first_seen(t.events).select("entity", "event_type", F.col("first_index").cast("long").alias("first_index"), F.col("first_ts").cast("string").alias("first_ts"))


PROG = f"WITH {FIRST}, p AS (SELECT entity, CAST(max(n) AS BIGINT) AS events, count(*) AS types, CASE WHEN count(*) >= 3 THEN regr_slope(k, fi) ELSE 0 END AS sl, date_diff('day', CAST(min(ft) AS DATE), CAST(max(ft) AS DATE)) AS dd, avg(wait) AS mw, max(fi) FILTER (k + 1 = 3) AS hi FROM fk GROUP BY 1)"


@query("EVT-5", PROG + " SELECT entity, events, types, round(types / 5.0, 6) AS coverage, round(1 - CAST(types AS DOUBLE) / events, 6) AS repeat_ratio, round(sl, 6) AS discovery_slope, CAST(dd AS INT) AS discovery_days FROM p")
def evt_5(t):
    return rounded(ev.progression(t.events, TYPES_N).select("entity", "events", "types", "coverage", "repeat_ratio", "discovery_slope", "discovery_days"))


@query("EVT-6", f"WITH {E_SQL}, g AS (SELECT entity, count(*) AS n, count(DISTINCT event_type) AS ty, count(DISTINCT CAST(ts AS DATE)) AS d FROM ev GROUP BY 1) SELECT entity, round(ty / 5.0, 6) AS coverage, round(CAST(n AS DOUBLE) / d, 6) AS velocity, round(1 - CAST(ty AS DOUBLE) / n, 6) AS replay_ratio, CASE WHEN ty / 5.0 > 0.9 AND 1 - CAST(ty AS DOUBLE) / n > 0.95 THEN 'critical' WHEN ty / 5.0 > 0.9 THEN 'high' WHEN ty / 5.0 > 0.7 THEN 'medium' ELSE 'low' END AS exhaustion_risk FROM g")
def evt_6(t):
    return rounded(ev.consumption(t.events, TYPES_N))


@query("EVT-7", PROG + " SELECT entity, round(mw, 6) AS mean_wait, CAST(hi + 1 AS BIGINT) AS events_to_half FROM p")
def evt_7(t):
    return rounded(ev.progression(t.events, TYPES_N).select("entity", "mean_wait", F.col("events_to_half").cast("long").alias("events_to_half")))


THIRD = E_SQL + ", sq AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY entity) AS n FROM ev), th AS (SELECT entity, CASE WHEN i < n // 3 THEN 0 WHEN i < 2 * (n // 3) THEN 1 ELSE 2 END AS third, event_type, count(*) AS n FROM sq GROUP BY 1, 2, 3)"


QUARTER = "qt AS (SELECT entity, event_type, unnest(['early', 'late']) AS quarter, i, n FROM sq), qc AS (SELECT entity, quarter, event_type, count(*) AS n FROM qt WHERE CASE quarter WHEN 'early' THEN i < greatest(1, n // 4) ELSE i >= n - greatest(1, n // 4) END GROUP BY 1, 2, 3)"


@query("WIN-13", f"WITH {THIRD}, {QUARTER} SELECT entity, 'third ' || third AS part, event_type, n FROM th UNION ALL SELECT entity, quarter, event_type, n FROM qc")
def win_13(t):
    thirds = ev.thirds(t.events).select("entity", F.concat(F.lit("third "), "third").alias("part"), "event_type", "n")
    return thirds.unionByName(ev.quarters(t.events).withColumnRenamed("quarter", "part"))


@query("WIN-13-growth", f"WITH {THIRD}, {QUARTER}, g AS (SELECT entity, count(*) FILTER (quarter = 'early') AS a, count(*) FILTER (quarter = 'late') AS b FROM qc GROUP BY 1) SELECT entity, a AS early_diversity, b AS late_diversity, b - a AS diversity_growth, round(b / CAST(greatest(a, 1) AS DOUBLE), 6) AS diversity_growth_ratio FROM g")
def win_13_growth(t):
    return rounded(ev.growth(t.events))


VOLATILE = (
    SESS + THIRD[len(E_SQL) :] + """, gp AS (SELECT entity, (epoch_us(a) - epoch_us(lag(b) OVER (PARTITION BY entity ORDER BY no))) / 3.6e9 AS gap FROM se),
sl AS (SELECT entity, count(*) AS sessions, avg(minutes) AS lm, coalesce(var_samp(minutes), 0) AS lv FROM se GROUP BY 1), sg AS (SELECT entity, CASE WHEN count(gap) > 1 THEN avg(gap) ELSE 0 END AS gm, CASE WHEN count(gap) > 1 THEN var_samp(gap) ELSE 0 END AS gv FROM gp GROUP BY 1),
kn AS (SELECT entity, event_type, coalesce(sum(n) FILTER (third = 0), 0) AS n0, coalesce(sum(n) FILTER (third = 1), 0) AS n1, coalesce(sum(n) FILTER (third = 2), 0) AS n2 FROM th GROUP BY 1, 2),
sh AS (SELECT entity, greatest(coalesce(n0 / nullif(sum(n0) OVER e, 0), 0), 1e-10) AS p0, greatest(coalesce(n1 / nullif(sum(n1) OVER e, 0), 0), 1e-10) AS p1, greatest(coalesce(n2 / nullif(sum(n2) OVER e, 0), 0), 1e-10) AS p2 FROM kn WINDOW e AS (PARTITION BY entity)),
kl AS (SELECT entity, greatest(sum(p0 * log2(p0 / p1)), 0) AS k1, greatest(sum(p1 * log2(p1 / p2)), 0) AS k2 FROM sh GROUP BY 1),
vo AS (SELECT *, sqrt(lv) / lm AS lc, CASE WHEN gm > 0 THEN sqrt(gv) / gm ELSE 0 END AS gc, (k1 + k2) / 2 AS v FROM sl JOIN sg USING (entity) JOIN kl USING (entity))"""
)


@query("EVT-8", f"WITH {VOLATILE} SELECT entity, sessions, round(lm, 4) AS session_length_mean, round(lv, 4) AS session_length_variance, round(k1, 4) AS kl_early, round(k2, 4) AS kl_late, round(gm, 4) AS session_gap_mean, round(gv, 3) AS session_gap_variance, round(lc, 4) AS session_length_cv, round(gc, 4) AS session_gap_cv, round(v, 4) AS event_distribution_volatility, round(1 / (1 + v), 4) AS event_distribution_stability, round((lc + gc + v) / 3, 4) AS volatility_score, round(1 / (1 + (lc + gc + v) / 3), 4) AS predictability FROM vo")
def evt_8(t):
    return rounded(ev.volatility(t.events).withColumn("session_gap_variance", r("session_gap_variance", 3)), 4, ("session_gap_variance",))


@query("EVT-9", f"WITH {E_SQL}, m AS (SELECT entity, date_diff('day', DATE '2023-12-31', CAST(min(ts) AS DATE)) AS d FROM ev GROUP BY 1) SELECT entity, CAST(d AS INT) AS days_after_launch, CASE WHEN d <= 1 THEN 0 WHEN d <= 7 THEN 1 WHEN d <= 30 THEN 2 ELSE 3 END AS timing FROM m")
def evt_9(t):
    return ev.launch_timing(t.events, date(2023, 12, 31))


@query("EVT-10", "SELECT user_id AS entity, user_id % 3 AS store, CAST(date_trunc('hour', ts) AS VARCHAR) AS ts, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY 1, 2, 3")
def evt_10(t):
    coarse = t.events.withColumn("store", F.col("entity") % 3).withColumn("ts", F.date_trunc("hour", "ts"))
    return ev.deduplicated(coarse).withColumn("ts", F.col("ts").cast("timestamp_ntz").cast("string"))


def _place(t, name: str) -> tuple[str, str]:
    base = work_path(t.spark, name)
    return f"{base}/out", f"{base}/state"


def _stream(t):
    path = f"{t.sf_dir}/events.parquet"
    schema = t.spark.read.parquet(path).schema
    return jobs.event_stream(t.spark, f"{path}*", schema).select("event_id", F.col("user_id").alias("entity"), "ts", "event_type", "value")


@query("STR-1", "SELECT event_id, user_id AS entity, event_type, round(value, 6) AS value FROM events")
def str_1(t):
    return rounded(jobs.drain(_stream(t).select("event_id", "entity", "event_type", "value"), *_place(t, "ingest")))


CLOSED = "(SELECT max(ts) FROM events) - INTERVAL 1 HOUR"


@query("STR-2", f"SELECT CAST(time_bucket(INTERVAL 1 HOUR, ts) AS VARCHAR) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2, time_bucket(INTERVAL 1 HOUR, ts) HAVING time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= {CLOSED}")
def str_2(t):
    d = jobs.drain(jobs.volumes(_stream(t)), *_place(t, "volumes"))
    return d.withColumn("window_start", F.col("window_start").cast("timestamp_ntz").cast("string"))


@query("STR-3", f"WITH w AS (SELECT event_type, date_trunc('day', ts) - INTERVAL (k) DAY AS s FROM events, (SELECT unnest(range(7)) AS k)) SELECT CAST(s AS VARCHAR) AS window_start, event_type, count(*) AS n FROM w GROUP BY s, 2 HAVING s + INTERVAL 7 DAY <= {CLOSED}")
def str_3(t):
    d = jobs.drain(jobs.volumes(_stream(t), "7 days", "1 day"), *_place(t, "sliding"))
    return d.withColumn("window_start", F.col("window_start").cast("timestamp_ntz").cast("string"))


@query("STR-4", f"WITH h AS (SELECT event_type, count(*) / 720.0 AS expected FROM events GROUP BY 1), v AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS s, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= {CLOSED}) SELECT CAST(s AS VARCHAR) AS window_start, event_type, n, round(n / expected, 6) AS magnitude, CASE WHEN n / expected >= 3 THEN 'critical' WHEN n / expected >= 2 THEN 'high' ELSE 'medium' END AS severity FROM v JOIN h USING (event_type) WHERE n / expected >= 1.5")
def str_4(t):
    history = t.events.groupBy("event_type").agg((F.count("*") / 720.0).alias("expected"))
    d = jobs.drain(jobs.surges(jobs.volumes(_stream(t)), history), *_place(t, "surges"))
    return d.select(F.col("window_start").cast("timestamp_ntz").cast("string").alias("window_start"), "event_type", "n", r("magnitude").alias("magnitude"), "severity")


@query("STR-5", f"WITH {SESS} SELECT entity, CAST(a AS VARCHAR) AS session_start, events, round(minutes, 4) AS minutes FROM se WHERE b + INTERVAL 30 MINUTE <= {CLOSED}")
def str_5(t):
    d = jobs.drain(jobs.session_windows(_stream(t)), *_place(t, "sessions"))
    return d.select("entity", F.col("session_start").cast("timestamp_ntz").cast("string").alias("session_start"), "events", r("minutes", 4).alias("minutes"))


@query("STR-6", "SELECT user_id AS entity, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def str_6(t):
    out, state = _place(t, "upsert")
    jobs.drain_each(_stream(t).select("entity", "event_id", "event_type"), jobs.latest_by_key(out, ["entity"], "event_id"), state, "append")
    return jobs.read_latest(t.spark, out, ["entity"], "event_id")


@query("STR-7", "SELECT event_id, user_id AS entity, CASE WHEN value < 10 THEN 'low' WHEN value < 50 THEN 'middle' ELSE 'high' END AS segment FROM events WHERE event_type = 'purchase'")
def str_7(t):
    bands = t.spark.createDataFrame([("low", -1e9, 10.0), ("middle", 10.0, 50.0), ("high", 50.0, 1e9)], "segment string, low double, high double")
    bought = _stream(t).where("event_type = 'purchase'")
    return jobs.drain(bought.join(F.broadcast(bands), (F.col("value") >= F.col("low")) & (F.col("value") < F.col("high"))).select("event_id", "entity", "segment"), *_place(t, "enrich"))
