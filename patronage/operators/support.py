"""Axes of support history, and the order features that support staff read (AXIS-14, AXIS-15)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from patronage.operators.axes import MONTH, days_between
from patronage.operators.tickets import first_class

#: What a ticket is about, by words of the customer's first message; the first class that fits counts.
TOPICS = {"return": ("return", "refund", "exchange"), "shipping": ("shipping", "delivery", "tracking", "package"), "product": ("size", "fit", "how do", "how to", "which")}


def support_history(tickets: DataFrame, messages: DataFrame, orders: DataFrame, topics: dict[str, tuple[str, ...]] = TOPICS) -> DataFrame:
    """Features of each customer's tickets, against its orders (AXIS-14).

    ``tickets``: ticket_id, customer_id, priority, sentiment, and where known reply_hours and satisfaction; ``messages``:
    ticket_id, message_no, from_agent, content; ``orders``: customer_id, total_orders. Messages shrink to one row for each
    ticket before they meet the tickets; a customer without orders has no tickets_per_order.
    """
    asked = ~F.col("from_agent")
    words = F.size(F.filter(F.split("content", "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))
    heard = messages.groupBy("ticket_id").agg(F.count_if(asked).alias("asked"), F.sum(F.when(asked, words)).alias("words"), F.min(F.when(asked, F.struct("message_no", "content")))["content"].alias("opening"))
    known = tickets.join(heard, "ticket_id", "left").withColumn("topic", first_class(F.coalesce("opening", F.lit("")), topics, "other"))
    share = lambda c: F.avg(c.cast("double"))
    told = [F.avg(c).alias(n) if c in tickets.columns else F.lit(None).cast("double").alias(n) for c, n in (("reply_hours", "avg_response_time_hours"), ("satisfaction", "satisfaction_avg"))]
    g = known.groupBy("customer_id").agg(
        F.count("*").alias("tickets"), *[share(F.col("topic") == name).alias(f"{name}_rate") for name in topics], share(F.col("sentiment") < 0.3).alias("complaint_rate"), share(F.col("priority") == "urgent").alias("escalation_rate"),
        (1 - F.countDistinct("topic") / F.count("*")).alias("repeat_issue_rate"), (F.sum("words") / F.nullif(F.sum("asked"), F.lit(0))).alias("message_length_avg"), F.avg(F.greatest(F.col("asked") - 1, F.lit(0))).alias("follow_up_rate"), *told,
    )
    return g.join(orders.select("customer_id", "total_orders"), "customer_id", "left").withColumn("tickets_per_order", F.col("tickets") / F.nullif("total_orders", F.lit(0))).drop("total_orders")


def support_variants(orders: DataFrame, items: DataFrame, reference_date: datetime) -> DataFrame:
    """Order features in the forms that support staff read (AXIS-15): preferred time as a word, signs of trends, days to the next order.

    Trends are of three orders or more. Slopes are rounded before their sign is taken, so that even gaps count as no trend.
    """
    by_date = W.partitionBy("customer_id").orderBy("order_date", "order_id")
    seq = orders.select("*", (F.row_number().over(by_date) - 1).alias("seq"), days_between(F.col("order_date"), F.lag("order_date").over(by_date)).alias("gap"))
    hour = F.hour("order_date")
    a = seq.groupBy("customer_id").agg(
        F.count("*").alias("n"), F.min("order_date").alias("first_order"), F.avg("gap").alias("mean_gap"), F.avg((F.col("source") == "shopify_draft_order").cast("double")).alias("custom_order_rate"),
        F.regr_slope("total_price", "seq").alias("value_slope"), F.regr_slope("gap", F.when(F.col("gap").isNotNull(), F.col("seq"))).alias("gap_slope"),
        F.count_if(hour < 12).alias("morning"), F.count_if(hour.between(12, 17)).alias("afternoon"), F.count_if(hour >= 17).alias("evening"),
    )
    b = items.groupBy("customer_id").agg(F.count_if(F.col("refund_amount") > 0).alias("returned"), F.countDistinct("category").alias("categories"))
    n, months = F.col("n"), days_between(F.lit(reference_date), F.col("first_order")) / MONTH
    sign = lambda c: F.when(n >= 3, F.signum(F.round(c, 9))).otherwise(0.0).cast("int")
    first = (F.col("morning") >= F.col("afternoon")) & (F.col("morning") >= F.col("evening"))
    return a.join(b, "customer_id", "left").select(
        "customer_id", F.when(first, "morning").when(F.col("afternoon") > F.col("evening"), "afternoon").otherwise("evening").alias("preferred_contact_time"), "custom_order_rate",
        F.when(months > 0, F.coalesce("returned", F.lit(0)) / months).otherwise(0.0).alias("return_frequency"), (F.coalesce("categories", F.lit(0)) / n).alias("category_switching_rate"),
        sign(F.col("value_slope")).alias("value_trend"), sign(-F.col("gap_slope")).alias("recency_momentum"), F.when(n >= 2, F.floor("mean_gap")).otherwise(365).cast("long").alias("expected_next_purchase_days"),
    )
