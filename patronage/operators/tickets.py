"""Support tickets: last messages, scores, classes, volumes, forecasts, surges; and the knowledge base."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from patronage.operators.events import seconds_between

# Fixed values of the rules.
PRIORITY = {"urgent": 4.0, "high": 3.0, "normal": 2.0, "low": 1.0}
EASY = ("tracking", "status", "when", "where is", "can you")
HARD = ("refund", "broken", "wrong", "damaged", "defective")


def any_word(text: Column, words: tuple[str, ...]) -> Column:
    """Whether the text holds one of the words (SC-1)."""
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower(text), w))


def last_messages(messages: DataFrame, preview: int = 100) -> DataFrame:
    """Count, last message's preview and the last from the customer of each ticket, in one aggregation (TOP-9, TOP-10, JOIN-8)."""
    g = messages.groupBy("ticket_id").agg(F.count("*").alias("messages"), F.max_by("content", "message_no").alias("last"), F.max(F.when(~F.col("from_agent") & (F.trim("content") != ""), F.struct("message_no", "content")))["content"].alias("customer_message"))
    short = F.when(F.length("last") > preview, F.concat(F.substring("last", 1, preview), F.lit("..."))).otherwise(F.col("last"))
    return g.select("ticket_id", "messages", short.alias("preview"), "customer_message", "last")


def score_tickets(tickets: DataFrame, now: datetime, alerts: tuple[str, ...] = (), easy: tuple[str, ...] = EASY, hard: tuple[str, ...] = HARD) -> DataFrame:
    """Smart score with its parts (TKT-1). Needs ticket_id, churn, ltv, priority, created_at, sentiment, last; a ticket without profile scores 0."""
    hours = F.greatest(seconds_between(F.lit(now), F.col("created_at")) / 3600, F.lit(0.1))
    urgency = F.coalesce(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])[F.col("priority")], F.lit(2.0))
    parts = {
        "churn_part": F.coalesce("churn", F.lit(0.0)) * 3, "value_part": F.coalesce("ltv", F.lit(0.0)) / 1000 * 2, "urgency_part": urgency * 1.5, "age_part": 1 / hours,
        "difficulty_part": F.when(F.col("last").isNull(), 0.0).when(any_word(F.col("last"), easy), 1.0).when(any_word(F.col("last"), hard), -1.5).otherwise(0.0),
        "sentiment_part": F.when(F.col("sentiment") < 0.3, 2.0).otherwise(0.0), "alert_part": F.when(any_word(F.coalesce("last", F.lit("")), alerts), 5.0).otherwise(0.0) if alerts else F.lit(0.0),
    }
    out = tickets.select("ticket_id", F.col("churn").isNotNull().alias("known"), *[c.alias(k) for k, c in parts.items()])
    total = sum((F.col(k) for k in parts), F.lit(0.0))
    return out.withColumn("score", F.when(F.col("known"), F.round(total, 2)).otherwise(0.0)).drop("known")


# Classes of a ticket in order, each with its words.
CATEGORIES = {
    "Return/Exchange Request": ("return", "refund", "send back", "not what i expected"),
    "Product Issue - Damaged/Wrong Item": ("broken", "damaged", "defective", "wrong item", "incorrect"),
    "Order Status/Delivery Inquiry": ("where is", "tracking", "hasn't arrived", "not received", "delayed"),
    "Product Question": ("how to", "question about", "can you tell me", "wondering"),
    "Order Modification": ("cancel", "change order", "modify"),
}
GENERAL = "General Inquiry"


def category(text: Column, ladder: dict[str, tuple[str, ...]] | None = None) -> Column:
    """The class of a ticket from its words; a text that is missing is a general inquiry (TKT-3)."""
    return first_class(F.coalesce(text, F.lit("")), ladder or CATEGORIES, GENERAL)


def first_class(text: Column, ladder: dict[str, tuple[str, ...]], rest: str) -> Column:
    """The first class of the ladder of which the text holds a word (TKT-2, TKT-3)."""
    out = F.lit(rest)
    for name, words in reversed(ladder.items()):
        out = F.when(any_word(text, words), name).otherwise(out)
    return out


def urgency(text: Column, classes: tuple[tuple[str, str, str, tuple[str, ...]], ...]) -> Column:
    """A struct of level, category, tag and matched words of the first class of which the text holds a word (TKT-2)."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.struct(F.lit("normal").alias("level"), F.lit("other").alias("category"), F.lit("").alias("tag"), F.array().cast("array<string>").alias("matched"))
    for level, category, tag, words in reversed(classes):
        matched = F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w))
        out = F.when(F.size(matched) > 0, F.struct(F.lit(level).alias("level"), F.lit(category).alias("category"), F.lit(tag).alias("tag"), matched.alias("matched"))).otherwise(out)
    return out


# Which entries of via and channel name a source, and which words of subject and address do, in order of
# precedence. Of the words of "ringcentral" either place counts.
SOURCES = (
    ("ringcentral", (), (), ("ringcentral",), ("ringcentral",)),
    ("sms", ("sms",), ("sms",), ("text message", "sms"), ()),
    ("chat", ("chat", "gorgias_chat"), ("chat",), (), ()),
    ("phone", ("voice",), ("voice",), (), ()),
    ("api", ("api",), (), (), ()),
    ("email", ("email",), ("email",), (), ()),
)


def source(via: Column, channel: Column, subject: Column, email: Column) -> Column:
    """Where a ticket came from, by the first source that one of its fields names; missing fields are empty (TKT-5)."""
    via, channel, subject, email = (F.lower(F.coalesce(c, F.lit(""))) for c in (via, channel, subject, email))
    out = F.lit("unknown")
    for name, vias, channels, in_subject, in_email in reversed(SOURCES):
        hits = [via == v for v in vias] + [channel == c for c in channels] + [F.contains(subject, F.lit(w)) for w in in_subject] + [F.contains(email, F.lit(w)) for w in in_email]
        any_hit = hits[0]
        for h in hits[1:]:
            any_hit = any_hit | h
        out = F.when(any_hit, name).otherwise(out)
    return out


def _expected(volumes: DataFrame, keys: list[str], trailing: int) -> DataFrame:
    before = W.partitionBy(*keys).orderBy("period").rowsBetween(-trailing, -1)
    s = volumes.withColumn("expected", F.avg("n").over(before))
    return s.withColumn("magnitude", F.col("n") / F.col("expected"))


def surges(volumes: DataFrame, keys: list[str], trailing: int = 24, factor: float = 2.0) -> DataFrame:
    """Periods whose count is ``factor`` times the mean of the ``trailing`` periods before (TKT-8)."""
    m = F.col("magnitude")
    hit = _expected(volumes, keys, trailing).where(m >= factor)
    return hit.withColumn("severity", F.when(m >= 4, "critical").when(m >= 3, "high").otherwise("medium")).withColumn("excess", F.col("n") - F.col("expected"))


def surge_events(volumes: DataFrame, keys: list[str], trailing: int = 24, factor: float = 2.0) -> DataFrame:
    """Runs of neighbouring surge periods: surge_start, surge_end (the first period after the run, null while it lasts), periods, peak magnitude (FLT-10)."""
    w = W.partitionBy(*keys).orderBy("period")
    on = F.coalesce(F.col("magnitude") >= factor, F.lit(False))
    marked = _expected(volumes, keys, trailing).withColumn("on", on).withColumn("next_period", F.lead("period").over(w)).withColumn("next_on", F.lead("on").over(w))
    runs = marked.withColumn("run", F.sum((~F.col("on")).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))).where("on")
    last = F.max(F.struct("period", "next_period"))
    return runs.groupBy(*keys, "run").agg(F.min("period").alias("surge_start"), last.alias("last"), F.count("*").alias("periods"), F.max("magnitude").alias("peak")).select(*keys, "surge_start", F.col("last.next_period").alias("surge_end"), "periods", "peak")


def active_surges(events: DataFrame, now: datetime) -> DataFrame:
    """Surges that last, newest first, with the hours since they began (FLT-10)."""
    return events.where("surge_end IS NULL").withColumn("hours", seconds_between(F.lit(now).cast("timestamp_ntz"), F.col("surge_start").cast("timestamp_ntz")) / 3600).drop("surge_end").orderBy(F.col("surge_start").desc(), *[c for c in events.columns if not c.startswith("surge")][:1])


def text_search(docs: DataFrame, query: list[str], limit: int, weights: dict[str, float] | None = None) -> DataFrame:
    """Articles by the weighted share of query words they hold (KB-1): words of the query are broadcast to the tokens."""
    weights = weights or {"title": 1.0, "summary": 0.4, "content": 0.2}
    fields = F.explode(F.array(*[F.struct(F.lit(w).alias("weight"), F.split(F.lower(F.col(c)), "[^\\p{L}\\p{N}]+").alias("tokens")) for c, w in weights.items()]))
    tokens = docs.select("article_id", fields.alias("f")).select("article_id", "f.weight", F.explode("f.tokens").alias("token"))
    hits = tokens.where(F.col("token").isin(*query)).groupBy("article_id", "token").agg(F.max("weight").alias("w"), F.count("*").alias("n"))
    return hits.groupBy("article_id").agg(F.sum(F.col("w") * F.log1p("n")).alias("rank"), F.count("*").alias("matched")).orderBy(F.round("rank", 9).desc(), "article_id").limit(limit)


#: Queries that one matrix product compares with a batch.
BLOCK = 256


def cosine_top(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k nearest vectors by cosine of each query vector (KB-2, TOP-12).

    ``queries`` is a stated set, broadcast after a check of its size; each batch of vectors is one matrix product and
    keeps k candidates for each query before anything moves.
    """
    import numpy as np
    import pandas as pd

    rows = queries.select(id_col, vec_col).limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("at most 10000 query vectors in one call; split the set")
    ids = np.array([r[0] for r in rows])
    q = np.array([r[1] for r in rows], float)
    q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)

    def each(batches):
        for batch in batches:
            if not len(batch):
                continue
            x = np.array(batch[vec_col].tolist(), float)
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            own = batch[id_col].to_numpy()
            for at in range(0, len(q), BLOCK):
                of = ids[at : at + BLOCK]
                s = q[at : at + BLOCK] @ x.T
                s[of[:, None] == own[None, :]] = -2.0
                least = min(k, len(own)) - 1
                # The k-th largest of each query by selection; only rows that reach it are ordered, by cosine and id.
                bound = -np.partition(-s, least, axis=1)[:, least]
                row, column = np.nonzero(s >= bound[:, None])
                order = np.lexsort((own[column], -s[row, column], row))
                row, column = row[order], column[order]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                keep = place < k
                yield pd.DataFrame({"query_id": of[row[keep]], "other_id": own[column[keep]], "cosine": s[row[keep], column[keep]]})

    near = vectors.select(id_col, vec_col).mapInPandas(each, "query_id long, other_id long, cosine double").where("cosine > -2")
    ranked = near.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("cosine").desc(), "other_id")))
    return ranked.where(F.col("place") <= k)


def versions(changes: DataFrame, fields: tuple[str, ...] = ("title", "summary", "content")) -> DataFrame:
    """Version numbers of articles, a new one whenever one of ``fields`` differs from the state before, missing ones included (KB-3)."""
    w = W.partitionBy("article_id").orderBy("changed_at")
    state = F.struct(*fields)
    seq = changes.withColumn("before", F.lag(state).over(w)).withColumn("now", state)
    return seq.where(~F.col("now").eqNullSafe(F.col("before"))).withColumn("version", F.row_number().over(w)).drop("before", "now")
