"""Queries of tickets and the knowledge base, over conversations, documents, embeddings and error events."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from patronage.operators import identities as ids
from patronage.operators import tickets as tk
from patronage.operators import volumes as vo
from patronage.queries.registry import LINES, query, r, rounded
from patronage.queries.sales import PROF, profiles_of

NOW = datetime(2024, 3, 1)
M_SQL = "ms AS (SELECT conv_id AS ticket_id, turn AS message_no, role <> 'user' AS from_agent, text AS content FROM conversations)"
T_SQL = "tk AS (SELECT DISTINCT conv_id AS ticket_id, conv_id % 1500 + 1 AS customer_id, TIMESTAMP '2024-01-01' + conv_id * INTERVAL 37 MINUTE AS created_at, CASE conv_id % 4 WHEN 0 THEN 'urgent' WHEN 1 THEN 'high' WHEN 2 THEN 'normal' ELSE 'low' END AS priority, CASE conv_id % 3 WHEN 0 THEN 'email' WHEN 1 THEN 'chat' ELSE 'sms' END AS channel, CASE conv_id % 5 WHEN 0 THEN 'open' WHEN 1 THEN 'closed' ELSE 'pending' END AS status, (conv_id % 10) / 10.0 AS sentiment FROM conversations)"
LAST = "lm AS (SELECT ticket_id, count(*) AS messages, arg_max(content, message_no) AS last, arg_max(content, message_no) FILTER (NOT from_agent AND trim(content) <> '') AS customer_message FROM ms GROUP BY 1)"


def pick(c, names):
    out = F.lit(names[-1])
    for k, n in enumerate(names[:-1]):
        out = F.when(c % len(names) == k, n).otherwise(out)
    return out


def tickets_of(t):
    c = F.col("ticket_id")
    ids = t.messages.select("ticket_id").distinct()
    at = F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), (c * 37).cast("int"))
    return ids.select("ticket_id", (c % 1500 + 1).alias("customer_id"), at.alias("created_at"), pick(c, ["urgent", "high", "normal", "low"]).alias("priority"), pick(c, ["email", "chat", "sms"]).alias("channel"), F.when(c % 5 == 0, "open").when(c % 5 == 1, "closed").otherwise("pending").alias("status"), ((c % 10) / 10).alias("sentiment"))


@query("TOP-9", f"WITH {M_SQL}, {LAST} SELECT ticket_id, messages, CASE WHEN length(last) > 100 THEN substr(last, 1, 100) || '...' ELSE last END AS preview FROM lm")
def top_9(t):
    return tk.last_messages(t.messages).select("ticket_id", "messages", "preview")


@query("TOP-10", f"WITH {M_SQL}, {LAST} SELECT ticket_id, customer_message FROM lm")
def top_10(t):
    return tk.last_messages(t.messages).select("ticket_id", "customer_message")


@query("FLT-5", f"WITH {T_SQL} SELECT ticket_id, priority, status FROM tk WHERE status = 'open' AND priority IN ('urgent', 'high') AND channel = 'email' ORDER BY created_at DESC LIMIT 20 OFFSET 1")
def flt_5(t):
    d = tickets_of(t).where((F.col("status") == "open") & F.col("priority").isin("urgent", "high") & (F.col("channel") == "email"))
    return d.orderBy(F.col("created_at").desc()).offset(1).limit(20).select("ticket_id", "priority", "status")


SMART = "sm AS (SELECT ticket_id, churn_risk_score IS NOT NULL AS known, churn_risk_score * 3 AS churn_part, lifetime_value / 1000 * 2 AS value_part, CASE priority WHEN 'urgent' THEN 4 WHEN 'high' THEN 3 WHEN 'normal' THEN 2 ELSE 1 END * 1.5 AS urgency_part, 1 / greatest(0.1, (epoch_us(TIMESTAMP '2024-03-01') - epoch_us(created_at)) / 3.6e9) AS age_part, CASE WHEN contains(lower(last), 'que') OR contains(lower(last), 'wh') THEN 1.0 WHEN contains(lower(last), 'ung') THEN -1.5 ELSE 0 END AS difficulty_part, CASE WHEN sentiment < 0.3 THEN 2.0 ELSE 0 END AS sentiment_part, CASE WHEN contains(lower(last), 'tion') THEN 5.0 ELSE 0 END AS alert_part FROM tk JOIN lm USING (ticket_id) LEFT JOIN prof USING (customer_id))"


def smart_of(t):
    p = profiles_of(t).select("customer_id", F.col("churn_risk_score").alias("churn"), F.col("lifetime_value").alias("ltv"))
    joined = tickets_of(t).join(tk.last_messages(t.messages), "ticket_id").join(p, "customer_id", "left")
    return tk.score_tickets(joined, NOW, ("tion",), ("que", "wh"), ("ung",))


@query("TKT-1", f"WITH {PROF}, {M_SQL}, {T_SQL}, {LAST}, {SMART} SELECT ticket_id, round(coalesce(churn_part, 0), 4) AS churn_part, round(urgency_part, 4) AS urgency_part, round(age_part, 6) AS age_part, round(difficulty_part, 2) AS difficulty_part, sentiment_part, alert_part, CASE WHEN known THEN round(churn_part + value_part + urgency_part + age_part + difficulty_part + sentiment_part + alert_part, 2) ELSE 0 END AS score FROM sm")
def tkt_1(t):
    s = smart_of(t)
    return s.select("ticket_id", r("churn_part", 4).alias("churn_part"), r("urgency_part", 4).alias("urgency_part"), r("age_part").alias("age_part"), r("difficulty_part", 2).alias("difficulty_part"), "sentiment_part", "alert_part", "score")


@query("TOP-8", f"WITH {PROF}, {M_SQL}, {T_SQL}, {LAST}, {SMART} SELECT ticket_id FROM sm ORDER BY CASE WHEN known THEN round(churn_part + value_part + urgency_part + age_part + difficulty_part + sentiment_part + alert_part, 2) ELSE 0 END DESC, ticket_id LIMIT 10 OFFSET 5")
def top_8(t):
    return smart_of(t).orderBy(F.col("score").desc(), "ticket_id").offset(5).limit(10).select("ticket_id")


@query("JOIN-8", f"WITH {PROF}, {M_SQL}, {T_SQL}, {LAST} SELECT ticket_id, messages, round(lifetime_value, 4) AS lifetime_value, archetype_id FROM tk JOIN lm USING (ticket_id) LEFT JOIN prof USING (customer_id)")
def join_8(t):
    p = profiles_of(t).select("customer_id", r("lifetime_value", 4).alias("lifetime_value"), "archetype_id")
    return tickets_of(t).join(tk.last_messages(t.messages), "ticket_id").join(p, "customer_id", "left").select("ticket_id", "messages", "lifetime_value", "archetype_id")


LADDER = {"urgent": ("que", "wh"), "billing": ("ung",), "shipping": ("tion",)}


#: Urgency classes over the driver's invented words: level, category, tag, words; the first that matches wins.
URGENCY = (("urgent", "cancel_request", "urgent_cancel", ("que", "wh")), ("high", "billing", "billing_issue", ("ung", "aux")), ("normal", "shipping", "shipping_issue", ("tion", "heit")))


def _urgency_sql(place: int, rest: str) -> str:
    hit = lambda words: "(" + " OR ".join(f"contains(lower(content), '{w}')" for w in words) + ")"
    return "CASE " + " ".join(f"WHEN {hit(u[3])} THEN '{u[place]}'" for u in URGENCY) + f" ELSE '{rest}' END"


MATCHED_SQL = "CASE " + " ".join("WHEN (" + " OR ".join(f"contains(lower(content), '{w}')" for w in u[3]) + ") THEN array_to_string(list_filter([" + ", ".join(f"'{w}'" for w in u[3]) + "], lambda w: contains(lower(content), w)), ',')" for u in URGENCY) + " ELSE '' END"


@query("TKT-2", f"WITH {M_SQL} SELECT ticket_id, message_no, {_urgency_sql(0, 'normal')} AS level, {_urgency_sql(1, 'other')} AS category, {_urgency_sql(2, '')} AS tag, {MATCHED_SQL} AS matched FROM ms")
def tkt_2(t):
    u = F.col("u")
    return t.messages.select("ticket_id", "message_no", tk.urgency(F.col("content"), URGENCY).alias("u")).select("ticket_id", "message_no", u["level"].alias("level"), u["category"].alias("category"), u["tag"].alias("tag"), F.array_join(u["matched"], ",").alias("matched"))


# The six classes by syllables that the invented messages have, beside those by the fixed words.
SYLLABLES = dict(zip(tk.CATEGORIES, (("ung", "refund"), ("que",), ("tion", "where is"), ("ern",), ("ar",)), strict=True))


def _ladder_sql(column, ladder):
    any_of = lambda words: " OR ".join("contains(lower(" + column + "), '" + w.replace("'", "''") + "')" for w in words)
    return "CASE " + " ".join(f"WHEN {any_of(words)} THEN '{name}'" for name, words in ladder.items()) + f" ELSE '{tk.GENERAL}' END"


@query("TKT-3", f"WITH {M_SQL} SELECT ticket_id, message_no, {_ladder_sql('content', tk.CATEGORIES)} AS category, {_ladder_sql('content', SYLLABLES)} AS by_syllable FROM ms WHERE NOT from_agent")
def tkt_3(t):
    own = t.messages.where(~F.col("from_agent"))
    return own.select("ticket_id", "message_no", tk.category(F.col("content")).alias("category"), tk.category(F.col("content"), SYLLABLES).alias("by_syllable"))


@query("TKT-4", f"WITH {PROF}, {T_SQL} SELECT ticket_id, CASE WHEN tk.priority = 'urgent' AND lifetime_value > 1500000 THEN 'urgent' WHEN churn_risk_score > 0.7 THEN 'high' WHEN lifetime_value > 1000000 THEN 'high' ELSE 'normal' END AS new_priority, concat_ws(',', CASE WHEN lifetime_value > 1500000 THEN 'vip' END, CASE WHEN churn_risk_score > 0.7 THEN 'churn_risk' END, tk.channel) AS tags FROM tk LEFT JOIN prof USING (customer_id)")
def tkt_4(t):
    p = profiles_of(t).select("customer_id", "lifetime_value", "churn_risk_score")
    v, c = F.col("lifetime_value"), F.col("churn_risk_score")
    new = F.when((F.col("priority") == "urgent") & (v > 1_500_000), "urgent").when(c > 0.7, "high").when(v > 1_000_000, "high").otherwise("normal")
    tags = F.array_union(F.array_compact(F.array(F.when(v > 1_500_000, "vip"), F.when(c > 0.7, "churn_risk"))), F.array("channel"))
    return tickets_of(t).join(p, "customer_id", "left").select("ticket_id", new.alias("new_priority"), F.array_join(tags, ",").alias("tags"))


CAME = "cm AS (SELECT ticket_id, lower(coalesce(arg_min(content, message_no), '')) AS subject, CASE ticket_id % 6 WHEN 0 THEN 'sms' WHEN 1 THEN 'gorgias_chat' WHEN 2 THEN 'voice' WHEN 3 THEN 'api' WHEN 4 THEN 'email' END AS via, CASE ticket_id % 5 WHEN 0 THEN 'SMS' WHEN 1 THEN 'chat' WHEN 2 THEN 'voice' WHEN 3 THEN 'email' ELSE 'web' END AS channel, CASE WHEN ticket_id % 7 = 0 THEN 'notify@RingCentral.example' END AS email FROM ms GROUP BY 1)"


@query("TKT-5", f"WITH {M_SQL}, {CAME} SELECT ticket_id, CASE WHEN email IS NOT NULL OR contains(subject, 'ringcentral') THEN 'ringcentral' WHEN lower(channel) = 'sms' OR via = 'sms' OR contains(subject, 'text message') OR contains(subject, 'sms') THEN 'sms' WHEN channel = 'chat' OR via = 'gorgias_chat' THEN 'chat' WHEN channel = 'voice' OR via = 'voice' THEN 'phone' WHEN via = 'api' THEN 'api' WHEN channel = 'email' OR via = 'email' THEN 'email' ELSE 'unknown' END AS source FROM cm")
def tkt_5(t):
    """Where each ticket came from: its first message stands for the subject; via, channel and address are dealt by its number."""
    c = F.col("ticket_id")
    came = t.messages.groupBy("ticket_id").agg(F.min_by("content", "message_no").alias("subject")).select(
        "ticket_id", "subject", pick(c, ["sms", "gorgias_chat", "voice", "api", "email", None]).alias("via"), pick(c, ["SMS", "chat", "voice", "email", "web"]).alias("channel"), F.when(c % 7 == 0, "notify@RingCentral.example").alias("email"),
    )
    return came.select("ticket_id", tk.source(F.col("via"), F.col("channel"), F.col("subject"), F.col("email")).alias("source"))


CLASSED = f"ct AS (SELECT tk.*, {_ladder_sql('last', SYLLABLES)} AS category FROM tk JOIN lm USING (ticket_id))"
_MAPS = ", ".join(f"(SELECT string_agg(k || '=' || n, ',' ORDER BY k) FROM (SELECT {d} AS k, count(*) AS n FROM gr b WHERE b.granularity = a.granularity AND b.p = a.p GROUP BY 1)) AS tickets_by_{d}" for d in vo.DIMENSIONS)
CUBE = f"gr AS (SELECT *, CASE granularity WHEN 'hour' THEN date_trunc('hour', created_at) WHEN 'day' THEN date_trunc('day', created_at) WHEN 'week' THEN date_trunc('week', created_at) ELSE date_trunc('month', created_at) END AS p FROM (SELECT *, unnest(['hour', 'day', 'week', 'month']) AS granularity FROM ct)), cu AS (SELECT granularity, p, count(*) AS n FROM gr GROUP BY 1, 2)"


def classed_of(t):
    """Tickets with the class of their last message."""
    last = tk.last_messages(t.messages).select("ticket_id", tk.category(F.col("last"), SYLLABLES).alias("category"))
    return tickets_of(t).join(last, "ticket_id")


@query("TKT-6", f"WITH {M_SQL}, {T_SQL}, {LAST}, {CLASSED}, {CUBE} SELECT granularity, CAST(CAST(p AS TIMESTAMP) AS VARCHAR) AS period_start, CAST(CASE granularity WHEN 'hour' THEN p + INTERVAL 1 HOUR WHEN 'day' THEN p + INTERVAL 1 DAY WHEN 'week' THEN p + INTERVAL 7 DAY ELSE p + INTERVAL 1 MONTH END AS VARCHAR) AS period_end, n AS ticket_count, {_MAPS}, CASE WHEN granularity IN ('hour', 'day') THEN CAST(isodow(p) - 1 AS INT) END AS day_of_week, CASE WHEN granularity = 'hour' THEN CAST(hour(CAST(p AS TIMESTAMP)) AS INT) END AS hour_of_day, granularity IN ('hour', 'day') AND isodow(p) >= 6 AS is_weekend, granularity IN ('hour', 'day') AND CAST(p AS DATE) = DATE '2024-01-01' AS is_holiday, CAST(weekofyear(p) AS INT) AS week_of_year, CAST(month(p) AS INT) AS month_of_year, CAST(quarter(p) AS INT) AS quarter FROM cu a")
def tkt_6(t):
    d = vo.volume_cube(classed_of(t), (date(2024, 1, 1),))
    pairs = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return d.select(*[pairs(c).alias(c) if c.startswith("tickets_by") else F.col(c).cast("string").alias(c) if c.startswith("period") else c for c in d.columns])


HOURLY = "hv AS (SELECT event_type, date_trunc('hour', ts) AS period, count(*) AS n FROM events GROUP BY 1, 2)"


def hourly_of(t):
    return t.events.groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("period")).agg(F.count("*").alias("n"))


@query("TKT-8", f"WITH {HOURLY}, s AS (SELECT *, avg(n) OVER (PARTITION BY event_type ORDER BY period ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS e FROM hv) SELECT event_type, CAST(period AS VARCHAR) AS period, n, round(e, 6) AS expected, round(n / e, 6) AS magnitude, CASE WHEN n / e >= 4 THEN 'critical' WHEN n / e >= 3 THEN 'high' ELSE 'medium' END AS severity, round(n - e, 6) AS excess FROM s WHERE n / e >= 2")
def tkt_8(t):
    return rounded(tk.surges(hourly_of(t), ["event_type"])).withColumn("period", F.col("period").cast("string"))


@query("FLT-10", f"WITH {HOURLY}, s AS (SELECT *, avg(n) OVER (PARTITION BY event_type ORDER BY period ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS e FROM hv), m AS (SELECT *, coalesce(n / e >= 0.8, false) AS hit, lead(period) OVER (PARTITION BY event_type ORDER BY period) AS nxt FROM s), g AS (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY event_type ORDER BY period ROWS UNBOUNDED PRECEDING) AS run FROM m), u AS (SELECT event_type, run, min(period) AS a, arg_max(CASE WHEN nxt IS NULL THEN 1 ELSE 0 END, period) AS lasts, count(*) AS periods, max(n / e) AS peak FROM g WHERE hit GROUP BY 1, 2) SELECT event_type, CAST(a AS VARCHAR) AS surge_start, periods, round(peak, 6) AS peak, round(date_diff('minute', a, TIMESTAMP '2024-03-01') / 60.0, 6) AS hours FROM u WHERE lasts = 1 ORDER BY a DESC, event_type")
def flt_10(t):
    """Surges that still last at the end of the log; the factor is low, so that there are some."""
    return rounded(tk.active_surges(tk.surge_events(hourly_of(t), ["event_type"], 24, 0.8), NOW)).withColumn("surge_start", F.col("surge_start").cast("string"))


# Forecasts of daily counts: each day's count stands for the days 1, 5, 7, 14 and 25 later, said at eight in the evening,
# and the count itself is said a day too late.
AHEAD = (1, 5, 7, 14, 25)
FORECAST = f"dc AS (SELECT event_type AS series, CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1, 2), fc AS (SELECT 'naive' AS model, series, CAST(d + h AS TIMESTAMP) AS period, CAST(d AS TIMESTAMP) + INTERVAL 20 HOUR AS made_at, CAST(n + h % 3 AS DOUBLE) AS predicted FROM dc, (SELECT unnest([{', '.join(map(str, AHEAD))}]) AS h) UNION ALL SELECT 'naive', series, CAST(d AS TIMESTAMP), CAST(d AS TIMESTAMP) + INTERVAL 1 DAY, CAST(n AS DOUBLE) FROM dc)"
JUDGED = "bf AS (SELECT *, CASE WHEN k <= 1 THEN '1d' WHEN k <= 7 THEN '7d' WHEN k <= 30 THEN '30d' ELSE 'beyond' END AS horizon FROM (SELECT *, date_diff('day', CAST(made_at AS DATE), CAST(period AS DATE)) AS k FROM fc WHERE made_at <= period)), al AS (SELECT * FROM bf UNION ALL SELECT * REPLACE ('latest' AS horizon) FROM bf), ls AS (SELECT *, row_number() OVER (PARTITION BY model, series, period, horizon ORDER BY made_at DESC, predicted DESC) AS nth FROM al), jd AS (SELECT ls.*, dc.n AS actual, dc.n - predicted AS e FROM ls JOIN dc ON dc.series = ls.series AND CAST(dc.d AS TIMESTAMP) = period WHERE nth = 1)"


def counts_of(t):
    return t.events.groupBy(F.col("event_type").alias("series"), F.to_date("ts").cast("timestamp_ntz").alias("period")).agg(F.count("*").alias("actual"))


def forecasts_of(t):
    d = counts_of(t)
    h = F.col("h")
    later = d.select("series", "period", "actual", F.explode(F.array(*[F.lit(x) for x in AHEAD])).alias("h"))
    said = later.select(F.lit("naive").alias("model"), "series", F.date_add(F.to_date("period"), h).cast("timestamp_ntz").alias("period"), (F.col("period") + F.expr("INTERVAL '20' HOUR")).alias("made_at"), (F.col("actual") + h % 3).cast("double").alias("predicted"))
    late = d.select(F.lit("naive").alias("model"), "series", "period", (F.col("period") + F.expr("INTERVAL '1' DAY")).alias("made_at"), F.col("actual").cast("double").alias("predicted"))
    return said.unionByName(late)


@query("TKT-7", f"WITH {FORECAST}, {JUDGED} SELECT model, horizon, count(*) AS total_forecasts, round(avg(abs(e)), 6) AS mae, round(avg(abs(100 * e / actual)), 6) AS mape, round(sqrt(avg(e * e)), 6) AS rmse, round(1 - avg(e * e) / nullif(var_pop(CAST(actual AS DOUBLE)), 0), 6) AS r2 FROM jd GROUP BY 1, 2")
def tkt_7(t):
    return rounded(vo.accuracy(vo.judged(forecasts_of(t), counts_of(t))))


@query("WIN-7", f"WITH {FORECAST}, w AS (SELECT *, row_number() OVER (PARTITION BY series, period ORDER BY made_at DESC, predicted DESC) AS nth, count(*) OVER (PARTITION BY series, period) AS forecasts FROM fc WHERE CAST(period AS DATE) >= DATE '2024-01-15') SELECT series, CAST(CAST(period AS DATE) AS VARCHAR) AS day, CAST(made_at AS VARCHAR) AS made_at, predicted, forecasts FROM w WHERE nth = 1")
def win_7(t):
    d = vo.latest_forecasts(forecasts_of(t), date(2024, 1, 15))
    return d.withColumn("day", F.col("day").cast("string")).withColumn("made_at", F.col("made_at").cast("string"))


DAILY = "SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1"
BE = [("new year", "2024-01-01", "2024-01-03"), ("sale", "2024-01-15", None), ("storm", "2024-01-20", "2024-01-24")]
BE_SQL = "be AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', DATE '{a}', {f'DATE {chr(39)}{b}{chr(39)}' if b else 'NULL'})" for n, a, b in BE) + ") v(name, a, b))"


def daily_of(t):
    return t.events.where("event_type = 'error'").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


def calendar_of(t):
    return t.spark.createDataFrame(BE, "name string, a string, b string").select("name", F.to_date("a").alias("a"), F.to_date("b").alias("b"))


@query("JOIN-17", f"WITH dv AS ({DAILY}), {BE_SQL} SELECT name, CAST(d AS VARCHAR) AS day, n FROM dv JOIN be ON d BETWEEN a AND coalesce(b, a)")
def join_17(t):
    e = F.broadcast(calendar_of(t))
    return daily_of(t).join(e, F.col("day").between(F.col("a"), F.coalesce("b", "a"))).select("name", F.col("day").cast("string").alias("day"), "n")


@query("TKT-10", f"WITH dv AS ({DAILY}), {BE_SQL}, z AS (SELECT name, avg(n) AS v FROM dv JOIN be ON d BETWEEN a AND coalesce(b, a) GROUP BY 1) SELECT name, round(v, 6) AS volume, round(v / (SELECT avg(n) FROM dv), 6) AS multiplier FROM z")
def tkt_10(t):
    base = daily_of(t).agg(F.avg("n").alias("base"))
    return join_17(t).groupBy("name").agg(F.avg("n").alias("v")).crossJoin(F.broadcast(base)).select("name", r("v").alias("volume"), r(F.col("v") / F.col("base")).alias("multiplier"))


@query("WIN-14", f"WITH {T_SQL} SELECT ticket_id, 'T-' || lpad(CAST(1000 + row_number() OVER (PARTITION BY channel ORDER BY ticket_id) AS VARCHAR), 6, '0') AS ticket_number FROM tk")
def win_14(t):
    from pyspark.sql.window import Window as W

    n = 1000 + F.row_number().over(W.partitionBy("channel").orderBy("ticket_id"))
    return tickets_of(t).select("ticket_id", F.concat(F.lit("T-"), F.lpad(n.cast("string"), 6, "0")).alias("ticket_number"))


QUERY = ["the", "que", "und"]


def articles_of(t):
    text = F.col("text")
    return t.read("documents").select(F.col("doc_id").alias("article_id"), F.split(text, "\n")[0].alias("title"), F.coalesce(F.get(F.split(text, "\n"), 1), F.lit("")).alias("summary"), text.alias("content"), "lang", "source")


@query("KB-1", "WITH a AS (SELECT doc_id, string_split(text, chr(10)) AS l, text FROM documents), f AS (SELECT doc_id, 1.0 AS w, l[1] AS x FROM a UNION ALL SELECT doc_id, 0.4, coalesce(l[2], '') FROM a UNION ALL SELECT doc_id, 0.2, text FROM a), k AS (SELECT doc_id, w, unnest(regexp_split_to_array(lower(x), '[^\\p{L}\\p{N}]+')) AS token FROM f), h AS (SELECT doc_id, token, max(w) AS w, count(*) AS n FROM k WHERE token IN ('the', 'que', 'und') GROUP BY 1, 2) SELECT doc_id AS article_id, round(sum(w * ln(1 + n)), 6) AS rank, count(*) AS matched FROM h GROUP BY 1 ORDER BY round(sum(w * ln(1 + n)), 9) DESC, doc_id LIMIT 20")
def kb_1(t):
    return rounded(tk.text_search(articles_of(t), QUERY, 20))


COS = "WITH q AS (SELECT * FROM embeddings WHERE vec_id % 20 = 0), p AS (SELECT q.vec_id AS query_id, e.vec_id AS other_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS c FROM q JOIN embeddings e ON q.vec_id <> e.vec_id), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, other_id) AS place FROM p) SELECT query_id, other_id, round(c, 6) AS cosine, CAST(place AS INT) AS place FROM k WHERE place <= 5"


@query("KB-2", COS)
def kb_2(t):
    e = t.read("embeddings")
    return rounded(tk.cosine_top(e, e.where("vec_id % 20 = 0"), 5))


@query("KB-3", "WITH v AS (SELECT conv_id AS article_id, turn AS changed_at, substr(text, 1, 1) AS title, role AS summary, CASE WHEN turn % 3 = 0 THEN text END AS content FROM conversations), c AS (SELECT *, lag(title) OVER w AS bt, lag(summary) OVER w AS bs, lag(content) OVER w AS bc, row_number() OVER w AS nth FROM v WINDOW w AS (PARTITION BY article_id ORDER BY changed_at)) SELECT article_id, changed_at, title, summary, content, CAST(row_number() OVER (PARTITION BY article_id ORDER BY changed_at) AS INT) AS version FROM c WHERE nth = 1 OR title IS DISTINCT FROM bt OR summary IS DISTINCT FROM bs OR content IS DISTINCT FROM bc")
def kb_3(t):
    """Turns stand for changes; title, summary and content change at different ones."""
    c = t.read("conversations")
    return tk.versions(c.select(F.col("conv_id").alias("article_id"), F.col("turn").alias("changed_at"), F.substring("text", 1, 1).alias("title"), F.col("role").alias("summary"), F.when(F.col("turn") % 3 == 0, F.col("text")).alias("content")))


@query("WIN-9", "SELECT conv_id AS article_id, turn AS changed_at, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS version FROM conversations")
def win_9(t):
    from pyspark.sql.window import Window as W

    d = t.read("conversations").select(F.col("conv_id").alias("article_id"), F.col("turn").alias("changed_at"))
    return d.withColumn("version", F.row_number().over(W.partitionBy("article_id").orderBy("changed_at")))


LINKS = "li AS (SELECT conv_id AS ticket_id, conv_id % 300 AS article_id, conv_id % 3 = 0 AS helpful FROM (SELECT DISTINCT conv_id FROM conversations))"


def links_of(t):
    return t.messages.select("ticket_id").distinct().select("ticket_id", (F.col("ticket_id") % 300).alias("article_id"), (F.col("ticket_id") % 3 == 0).alias("helpful"))


@query("JOIN-11", f"WITH {LINKS} SELECT doc_id AS article_id, count(ticket_id) AS links FROM documents LEFT JOIN li ON doc_id = article_id GROUP BY 1")
def join_11(t):
    n = links_of(t).groupBy("article_id").agg(F.count("*").alias("links"))
    return articles_of(t).select("article_id").join(n, "article_id", "left").fillna(0, ["links"])


@query("AGG-28", f"WITH {LINKS} SELECT article_id, count(*) AS links, round(100.0 * count(*) FILTER (helpful) / count(*), 6) AS helpful_pct FROM li GROUP BY 1")
def agg_28(t):
    return links_of(t).groupBy("article_id").agg(F.count("*").alias("links"), r(100 * F.count_if("helpful") / F.count("*")).alias("helpful_pct"))


@query("FLT-11", "SELECT doc_id AS article_id, lang || '/' || source AS category FROM documents WHERE source IN ('src1', 'src2') AND lang = 'en'")
def flt_11(t):
    return articles_of(t).where(F.col("source").isin("src1", "src2") & (F.col("lang") == "en")).select("article_id", F.concat_ws("/", "lang", "source").alias("category"))


# Contacts made of customers: each step decides some, some name an unknown or a shared key, and some stay unresolved.
CONTACTS = "co AS (SELECT c_custkey AS k, CASE k % 11 WHEN 0 THEN k WHEN 1 THEN -k END AS external_id, CASE k % 11 WHEN 1 THEN k WHEN 2 THEN k END AS meta_id, CASE k % 11 WHEN 3 THEN k END AS integration_id, CASE k % 11 WHEN 4 THEN 'sys-' || k WHEN 5 THEN 'sys-shared' END AS system_id, CASE k % 11 WHEN 5 THEN '(555) ' || (1000000 + k) WHEN 6 THEN '+1 555 ' || (1000000 + k) WHEN 7 THEN '1-800-7777777' END AS phone, CASE k % 11 WHEN 7 THEN ' ' || upper(c_name) || '@shop.example ' WHEN 8 THEN c_name || '@shop.example' WHEN 9 THEN 'nobody@shop.example' WHEN 10 THEN '' END AS email FROM customer)"
BOOK = "bk AS (SELECT c_custkey AS customer_id, CASE WHEN c_custkey % 22 IN (5, 16) THEN 'sys-shared' ELSE 'sys-' || c_custkey END AS system_id, CASE WHEN c_custkey % 11 = 7 THEN '+18007777777' ELSE '+1555' || (1000000 + c_custkey) END AS phone, lower(c_name) || '@shop.example' AS email FROM customer)"
_UNIQUE = lambda kind, c: f"SELECT '{kind}' AS kind, CAST({c} AS VARCHAR) AS key, min(customer_id) AS customer_id FROM bk GROUP BY 2 HAVING count(DISTINCT customer_id) = 1"
_E164 = "CASE WHEN starts_with(d, '+') THEN d WHEN length(d) = 10 THEN '+1' || d ELSE '+' || d END"
IDENTITIES = f"ix AS ({' UNION ALL '.join(_UNIQUE(k, c) for k, c in (('customer', 'customer_id'), ('system', 'system_id'), ('phone', 'phone'), ('email', 'email')))}), ph AS (SELECT k, CASE WHEN d <> '' THEN {_E164} END AS p FROM (SELECT k, regexp_replace(phone, '[^0-9+]', '', 'g') AS d FROM co))"
_STEP = lambda no, name, kind, key: f"SELECT co.k, {no} AS place, '{name}' AS step, ix.customer_id FROM co JOIN ph ON ph.k = co.k JOIN ix ON ix.kind = '{kind}' AND ix.key = CAST({key} AS VARCHAR)"
HITS = "hi AS (" + " UNION ALL ".join(_STEP(n, *x) for n, x in enumerate((("external", "customer", "external_id"), ("meta", "customer", "meta_id"), ("integration", "customer", "integration_id"), ("system", "system", "co.system_id"), ("phone", "phone", "p"), ("email", "email", "lower(trim(co.email))")))) + ")"


@query("JOIN-14", f"WITH {CONTACTS}, {BOOK}, {IDENTITIES}, {HITS}, b AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY place) AS nth FROM hi) SELECT co.k AS contact_id, b.customer_id, b.step FROM co LEFT JOIN b ON b.k = co.k AND nth = 1")
def join_14(t):
    k, name = F.col("customer_id"), F.col("customer_name")
    on = lambda *pairs: F.coalesce(*[F.when(k % 11 == n, c) for n, c in pairs])
    contacts = t.stores.select(
        k.alias("contact_id"), on((0, k), (1, -k)).alias("external_id"), on((1, k), (2, k)).alias("meta_id"), on((3, k)).alias("integration_id"), on((4, F.concat(F.lit("sys-"), k)), (5, F.lit("sys-shared"))).alias("system_id"),
        on((5, F.concat(F.lit("(555) "), 1_000_000 + k)), (6, F.concat(F.lit("+1 555 "), 1_000_000 + k)), (7, F.lit("1-800-7777777"))).alias("phone"),
        on((7, F.concat(F.lit(" "), F.upper(name), F.lit("@shop.example "))), (8, F.concat(name, F.lit("@shop.example"))), (9, F.lit("nobody@shop.example")), (10, F.lit(""))).alias("email"),
    )
    shared = (k % 22).isin(5, 16)
    book = t.stores.select("customer_id", F.when(shared, "sys-shared").otherwise(F.concat(F.lit("sys-"), k)).alias("system_id"), F.when(k % 11 == 7, "+18007777777").otherwise(F.concat(F.lit("+1555"), 1_000_000 + k)).alias("phone"), F.concat(F.lower(name), F.lit("@shop.example")).alias("email"))
    return ids.resolve(contacts, book)


@query("JOIN-18", f"WITH {PROF}, {T_SQL}, ls AS (SELECT customer_id, arg_max(product_type, struct_pack(d := order_date, o := order_id, l := line_number, p := product_id, s := supplier_id)) AS product_type FROM lines GROUP BY 1), tp AS (SELECT product_type, count(*) AS tickets FROM tk JOIN ls USING (customer_id) GROUP BY 1), sp AS (SELECT product_type, CAST(sum(quantity) AS BIGINT) AS units, count(DISTINCT customer_id) AS customers FROM lines GROUP BY 1) SELECT product_type, units, customers, coalesce(tickets, 0) AS tickets FROM sp FULL JOIN tp USING (product_type)")
def join_18(t):
    last = t.sales_lines.groupBy("customer_id").agg(F.max_by("product_type", F.struct("order_date", "order_id", "line_number", "product_id", "supplier_id")).alias("product_type"))
    asked = tickets_of(t).join(last, "customer_id").groupBy("product_type").agg(F.count("*").alias("tickets"))
    sold = t.sales_lines.groupBy("product_type").agg(F.sum("quantity").alias("units"), F.countDistinct("customer_id").alias("customers"))
    return sold.join(asked, "product_type", "full").fillna(0, ["tickets"])


CORRELATION = f"{LINES}, {T_SQL}, ls AS (SELECT customer_id, arg_max(product_id, struct_pack(d := order_date, o := order_id, l := line_number, p := product_id)) AS product_id FROM lines GROUP BY 1), tp AS (SELECT product_id, count(*) AS tickets FROM tk JOIN ls USING (customer_id) GROUP BY 1), sp AS (SELECT product_id, max(product_type) AS product_type, CAST(sum(quantity) AS BIGINT) AS units, sum(line_item_sales) AS revenue, count(DISTINCT customer_id) AS customers FROM lines GROUP BY 1), z AS (SELECT *, coalesce(tickets, 0) / CAST(units AS DOUBLE) AS rate FROM sp LEFT JOIN tp USING (product_id)), y AS (SELECT *, avg(rate) OVER (PARTITION BY product_type) AS type_rate FROM z)"


@query("TKT-9", f"WITH {CORRELATION} SELECT product_id, product_type, units, round(revenue, 4) AS revenue, customers, coalesce(tickets, 0) AS tickets, round(rate, 8) AS rate, round(type_rate, 8) AS type_rate, rate > 1.5 * type_rate AS high FROM y")
def tkt_9(t):
    d = vo.product_tickets(t.sales_lines, tickets_of(t))
    return d.select("product_id", "product_type", "units", r("revenue", 4).alias("revenue"), "customers", "tickets", r("rate", 8).alias("rate"), r("type_rate", 8).alias("type_rate"), "high")


@query("TOP-4", f"WITH {CORRELATION.replace('FROM tk JOIN ls', 'FROM (SELECT * FROM tk WHERE created_at >= TIMESTAMP ' + chr(39) + '2024-01-02' + chr(39) + ') JOIN ls').replace('FROM lines GROUP BY 1), z', 'FROM lines WHERE order_date >= TIMESTAMP ' + chr(39) + '1998-01-01' + chr(39) + ' GROUP BY 1), z')} SELECT product_id, product_type, units, coalesce(tickets, 0) AS tickets, round(rate, 8) AS rate, round(type_rate, 8) AS type_rate FROM y WHERE rate > 1.5 * type_rate ORDER BY rate DESC, product_id LIMIT 50")
def top_4(t):
    """The fifty products of the highest rate among those far above their type, of a period of sales and of tickets."""
    recent = tickets_of(t).where(F.col("created_at") >= F.lit(datetime(2024, 1, 2)).cast("timestamp_ntz"))
    d = vo.product_tickets(t.sales_lines, recent, since=datetime(1998, 1, 1))
    return vo.high_ticket_products(d, 50).select("product_id", "product_type", "units", "tickets", r("rate", 8).alias("rate"), r("type_rate", 8).alias("type_rate"))


@query("TOP-11", f"WITH {PROF}, f AS (SELECT customer_id, product_name, max(order_date) AS d FROM lines GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY d DESC, product_name) AS place FROM f) SELECT customer_id, product_name, CAST(place AS INT) AS place FROM k WHERE place <= 20")
def top_11(t):
    from pyspark.sql.window import Window as W

    f = t.sales_lines.groupBy("customer_id", "product_name").agg(F.max("order_date").alias("d"))
    return f.withColumn("place", F.row_number().over(W.partitionBy("customer_id").orderBy(F.col("d").desc(), "product_name"))).where("place <= 20").drop("d")


@query("JOIN-19", f"WITH {PROF} SELECT c_custkey AS customer_id, coalesce(CASE WHEN c_acctbal > 5000 THEN c_acctbal END, round(lifetime_value, 4), 0) AS value, total_orders IS NULL AS is_new, coalesce(archetype_id, 'none') AS archetype FROM customer LEFT JOIN prof ON c_custkey = customer_id")
def join_19(t):
    p = profiles_of(t).select("customer_id", "lifetime_value", "total_orders", "archetype_id")
    d = t.stores.join(p, "customer_id", "left")
    return d.select("customer_id", F.coalesce(F.when(F.col("balance") > 5000, F.col("balance")), r("lifetime_value", 4), F.lit(0.0)).alias("value"), F.col("total_orders").isNull().alias("is_new"), F.coalesce("archetype_id", F.lit("none")).alias("archetype"))


MAIL = "ml AS (SELECT ticket_id, messages, CASE ticket_id % 23 WHEN 0 THEN ['AI_Ignore'] WHEN 1 THEN ['vip', 'force-ai'] ELSE ['vip'] END AS tags, CASE ticket_id % 13 WHEN 0 THEN 'Spam' WHEN 1 THEN 'closed' ELSE 'open' END AS status, CASE ticket_id % 17 WHEN 0 THEN 'New SMS to you' WHEN 1 THEN 'Text message notification' ELSE 'Hello' END AS subject, CASE ticket_id % 7 WHEN 0 THEN 'No-Reply@shop.example' WHEN 1 THEN 'news@mailchimp.com' WHEN 2 THEN 'call@ringcentral.com' ELSE 'ada@shop.example' END AS email, CASE ticket_id % 19 WHEN 0 THEN 'Support Team' WHEN 1 THEN 'The Teamwork Shop' ELSE 'Ada' END AS name, CASE ticket_id % 5 WHEN 0 THEN 'api' ELSE 'email' END AS via, CASE ticket_id % 3 WHEN 0 THEN 'sms' ELSE 'email' END AS channel, CASE WHEN ticket_id % 4 = 0 THEN '555' END AS phone, least(longest, 20 + ticket_id % 60) AS longest, by_agent AND ticket_id % 2 = 0 AS by_agent FROM lm JOIN (SELECT ticket_id, max(length(trim(content))) AS longest, bool_or(from_agent) AS by_agent FROM ms GROUP BY 1) USING (ticket_id))"
RULES = "CASE WHEN list_has_any(list_transform(tags, lambda x: lower(x)), ['ai_ignore', 'no-ai', 'human-only']) THEN 'tag_skip' WHEN list_has_any(list_transform(tags, lambda x: lower(x)), ['ai_force', 'force-ai']) THEN 'tag_force' WHEN lower(status) IN ('closed', 'spam', 'deleted') THEN 'status' WHEN contains(lower(email), 'ringcentral.com') AND longest <= 50 AND phone IS NULL THEN 'empty_call' WHEN contains(lower(email), 'ringcentral.com') THEN 'call' WHEN contains(lower(email), 'no-reply') THEN 'no_reply' WHEN NOT sms AND contains(lower(email), 'mailchimp.com') THEN 'platform' WHEN contains(lower(subject), 'new sms to') OR contains(lower(subject), 'text message notification') THEN 'notice' WHEN NOT sms AND (lower(name) LIKE '% team' OR lower(name) LIKE 'the %team%') THEN 'team' WHEN via = 'api' AND messages > 0 AND NOT by_agent THEN 'interface' ELSE 'person' END"


@query("FLT-9", f"WITH {M_SQL}, {LAST}, {MAIL} SELECT ticket_id, rule, rule NOT IN ('tag_force', 'call', 'person') AS automated FROM (SELECT ticket_id, {RULES} AS rule FROM (SELECT *, channel = 'sms' OR via = 'sms' OR contains(lower(subject), 'sms') AS sms FROM ml))")
def flt_9(t):
    k = F.col("ticket_id")
    own = t.messages.groupBy("ticket_id").agg(F.count("*").alias("messages"), F.max(F.length(F.trim("content"))).alias("longest"), F.bool_or("from_agent").alias("by_agent"))
    one = lambda n, *values: F.coalesce(*[F.when(k % n == i, v) for i, v in enumerate(values[:-1])], F.lit(values[-1]))
    tags = F.when(k % 23 == 0, F.array(F.lit("AI_Ignore"))).when(k % 23 == 1, F.array(F.lit("vip"), F.lit("force-ai"))).otherwise(F.array(F.lit("vip")))
    a = ids.automated(
        tags, one(13, "Spam", "closed", "open"), one(17, "New SMS to you", "Text message notification", "Hello"), one(7, "No-Reply@shop.example", "news@mailchimp.com", "call@ringcentral.com", "ada@shop.example"), one(19, "Support Team", "The Teamwork Shop", "Ada"),
        one(5, "api", "email"), one(3, "sms", "email"), F.when(k % 4 == 0, "555"), F.least("longest", 20 + k % 60), F.col("messages"), F.col("by_agent") & (k % 2 == 0),
    )
    return own.select("ticket_id", a.alias("a")).select("ticket_id", "a.rule", "a.automated")
