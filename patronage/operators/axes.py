"""Thirteen axes of behavioural features for each customer.

All axes come from two aggregates, one over orders and one over items, each of which reads its table once. Feature tables keep null
where a figure is undefined (one gap has no spread); ``flatten`` makes them 0 for matrices.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

MONTH = 30.44

#: Axis -> its features; those of ``ALIASES`` are columns of another name in the wide table.
AXES = {
    "purchase_frequency": ("orders_per_month", "avg_days_between_orders", "purchase_consistency", "recent_orders_90d", "days_since_last_purchase", "total_orders"),
    "purchase_value": ("lifetime_value", "avg_order_value", "median_order_value", "max_order_value", "value_trend", "value_consistency"),
    "category_exploration": ("unique_categories", "unique_products", "category_diversity", "product_diversity", "primary_category_dominance", "exploration_breadth"),
    "price_sensitivity": ("discount_rate", "avg_discount_amount", "avg_discount_pct", "full_price_ratio", "discount_dependency"),
    "purchase_cadence": ("weekend_vs_weekday_ratio", "business_hours_ratio", "weekend_rate", "preferred_time_numeric"),
    "customer_maturity": ("tenure_months", "customer_maturity_score", "lifecycle_stage", "orders_per_tenure_month", "acceleration"),
    "repurchase_behavior": ("repeat_product_rate", "avg_repurchase_count", "loyalty_index", "purchase_variety"),
    "return_behavior": ("refund_rate", "items_returned_pct", "total_refunds", "has_returns"),
    "communication_preference": ("primary_channel_numeric", "channel_diversity", "channel_switching_rate", "weekend_vs_weekday_ratio"),
    "problem_complexity_profile": ("refund_rate", "items_returned_pct", "unique_products_vs_orders", "category_switching", "discount_dependency"),
    "loyalty_trajectory": ("order_frequency_trend", "trajectory_value_trend", "recency_momentum", "acceleration_phase", "deceleration_phase", "churn_risk_score"),
    "product_knowledge": ("product_concentration", "repeat_product_rate", "categories_mastered", "primary_category_dominance", "exploration_vs_loyalty"),
    "value_sophistication": ("avg_item_price", "price_variance", "discount_hunt_score", "full_price_comfort", "spend_consistency", "big_splurge_rate"),
}
ALIASES = {"discount_dependency": "discount_rate", "discount_hunt_score": "discount_rate", "full_price_comfort": "full_price_ratio", "category_switching": "unique_categories", "spend_consistency": "value_consistency", "exploration_vs_loyalty": "product_diversity"}
#: The number of each channel.
CHANNEL_NO = {"web": 0, "pos": 1, "shopify_draft_order": 2}


def days_between(later: Column, earlier: Column) -> Column:
    """Whole 24-hour periods from the earlier to the later time, free of time zones."""
    return F.extract(F.lit("DAY"), later - earlier)


def reference_date_of(orders: DataFrame) -> datetime:
    """The date that features look back from: the last order's."""
    return orders.agg(F.max("order_date")).first()[0]


def _or(c: Column, instead: float) -> Column:
    return F.when(c == 0, instead).otherwise(c)


def order_features(orders: DataFrame, reference_date: datetime) -> DataFrame:
    """One row for each customer from its orders: one shuffle on customer_id, a window and the aggregate behind it."""
    ref = F.lit(reference_date)
    mine = W.partitionBy("customer_id")
    by_date = mine.orderBy("order_date", "order_id")
    seq = orders.select(
        "*", (F.row_number().over(by_date) - 1).alias("seq"), days_between(F.col("order_date"), F.lag("order_date").over(by_date)).alias("gap"),
        F.lag("source").over(by_date).alias("before"), F.min("order_date").over(mine).alias("first_date"), F.avg("total_price").over(mine).alias("mean_price"),
    )
    since = days_between(F.col("order_date"), F.col("first_date")) / MONTH
    recent, prior = F.col("order_date") >= F.lit(reference_date - timedelta(days=90)), F.col("order_date") >= F.lit(reference_date - timedelta(days=180))
    hour, weekend, cut = F.hour("order_date"), F.weekday("order_date") >= 5, F.col("discount_amount") > 0
    a = seq.groupBy("customer_id").agg(
        F.count("*").alias("total_orders"), F.min("order_date").alias("first_order"), F.max("order_date").alias("last_order"), F.avg("gap").alias("mean_gap"), F.stddev_samp("gap").alias("gap_std"),
        F.count_if(recent).alias("recent_orders_90d"), F.count_if(prior & ~recent).alias("prior_orders_90d"),
        F.sum("total_price").alias("lifetime_value"), F.avg("total_price").alias("avg_order_value"), F.median("total_price").alias("median_order_value"), F.max("total_price").alias("max_order_value"), F.stddev_samp("total_price").alias("value_std"),
        F.regr_slope("total_price", "seq").alias("value_slope"), F.regr_slope("gap", F.when(F.col("gap").isNotNull(), F.col("seq"))).alias("gap_slope"),
        F.count_if(cut).alias("n_cut"), F.avg(F.when(cut, F.col("discount_amount"))).alias("mean_cut"), F.avg(F.when(cut & (F.col("total_price") != 0), F.col("discount_amount") / F.col("total_price"))).alias("mean_cut_pct"),
        F.count_if(weekend).alias("n_weekend"), F.avg(hour.between(9, 17).cast("double")).alias("business_hours_ratio"), F.count_if(hour < 12).alias("n_morning"), F.count_if(hour.between(12, 17)).alias("n_afternoon"), F.count_if(hour >= 17).alias("n_evening"),
        F.mode("source", True).alias("primary_channel"), F.countDistinct("source").alias("channel_diversity"), F.count_if((F.col("seq") > 0) & ~F.col("source").eqNullSafe(F.col("before"))).alias("n_switches"),
        F.max(since).alias("max_months"), F.sum(F.floor(since)).alias("sum_months"), F.count_if(F.col("total_price") > 2 * F.col("mean_price")).alias("n_splurges"),
    )
    n = F.col("total_orders")
    tenure_days, months = days_between(ref, F.col("first_order")), F.col("tenure_months")
    buckets = F.ceil(F.col("max_months") + 1)
    a = a.withColumn("tenure_days", tenure_days).withColumn("tenure_months", tenure_days / MONTH).withColumn("k", buckets.cast("double"))
    a = a.withColumn("avg_days_between_orders", F.when(n > 1, F.col("mean_gap")).otherwise(F.col("tenure_days").cast("double"))).withColumn("days_since_last_purchase", days_between(ref, F.col("last_order")))
    k, sx = F.col("k"), F.col("k") * (F.col("k") - 1) / 2
    trend = (k * F.col("sum_months") - sx * n) / F.nullif(k * ((k - 1) * k * (2 * k - 1) / 6) - sx * sx, F.lit(0.0))
    historic = n / F.nullif(months, F.lit(0.0))
    two = lambda c: F.when(n >= 2, c)
    score = F.when(months >= 24, 2).when(months >= 12, 1).otherwise(0) + F.when(n >= 20, 3).when(n >= 10, 2).when(n >= 5, 1).otherwise(0)
    weekday_orders = n - F.col("n_weekend")
    return a.select(
        "customer_id", "first_order", "last_order", "tenure_days", "prior_orders_90d",
        F.when(months > 0, n / months).otherwise(0.0).alias("orders_per_month"), "avg_days_between_orders",
        F.when(n == 1, 1.0).otherwise(1 / (1 + F.col("gap_std") / _or(F.col("mean_gap"), 1.0))).alias("purchase_consistency"), "recent_orders_90d", "days_since_last_purchase", "total_orders",
        "lifetime_value", "avg_order_value", "median_order_value", "max_order_value", F.when(n >= 3, F.col("value_slope")).otherwise(0.0).alias("value_trend"),
        (1 / (1 + F.col("value_std") / _or(F.col("avg_order_value"), 1.0))).alias("value_consistency"),
        (F.col("n_cut") / n).alias("discount_rate"), F.coalesce("mean_cut", F.lit(0.0)).alias("avg_discount_amount"), F.coalesce("mean_cut_pct", F.lit(0.0)).alias("avg_discount_pct"), (1 - F.col("n_cut") / n).alias("full_price_ratio"),
        (F.col("n_weekend") / _or(weekday_orders, 1)).alias("weekend_vs_weekday_ratio"), "business_hours_ratio", (F.col("n_weekend") / n).alias("weekend_rate"),
        F.when((F.col("n_afternoon") > F.col("n_morning")) & (F.col("n_afternoon") > F.col("n_evening")), 1).when((F.col("n_evening") > F.col("n_morning")) & (F.col("n_evening") > F.col("n_afternoon")), 2).otherwise(0).alias("preferred_time_numeric"),
        "tenure_months", score.alias("customer_maturity_score"), F.when(months < 3, 0).when(months < 12, 1).when(months < 24, 2).otherwise(3).alias("lifecycle_stage"), (n / _or(months, 1.0)).alias("orders_per_tenure_month"),
        F.when(months >= 6, (F.col("recent_orders_90d") / 3 - historic) / historic).otherwise(0.0).alias("acceleration"),
        F.coalesce(F.create_map(*[F.lit(x) for kv in CHANNEL_NO.items() for x in kv])[F.col("primary_channel")], F.lit(-1)).alias("primary_channel_numeric"), "primary_channel", "channel_diversity", F.when(n > 1, F.col("n_switches") / n).otherwise(0.0).alias("channel_switching_rate"),
        two(F.when((n >= 3) & (F.col("max_months") > 0) & (k >= 2), trend).otherwise(0.0)).alias("order_frequency_trend"), two(F.when(n >= 3, F.col("value_slope")).otherwise(0.0)).alias("trajectory_value_trend"), two(F.when(n >= 3, -F.col("gap_slope")).otherwise(0.0)).alias("recency_momentum"),
        two((F.col("recent_orders_90d") > 1.5 * F.col("prior_orders_90d")).cast("double")).alias("acceleration_phase"), two((F.col("recent_orders_90d") < 0.5 * F.col("prior_orders_90d")).cast("double")).alias("deceleration_phase"),
        two(F.when(F.col("mean_gap") == 0, 1.0).otherwise(F.least(F.lit(1.0), F.col("days_since_last_purchase") / (2 * F.nullif(F.col("mean_gap"), F.lit(0.0)))))).alias("churn_risk_score"),
        (F.col("n_splurges") / n).alias("big_splurge_rate"),
    )


def item_features(items: DataFrame) -> DataFrame:
    """One row for each customer from its items.

    The items are dealt out by customer once, as they are; windows by product and by category, the rank of the products
    for the top fifth and the aggregate all work on that one exchange. The first line of a product or category stands for it.
    """
    price, refund = F.col("price"), F.col("refund_amount")
    mine, product, category = W.partitionBy("customer_id"), W.partitionBy("customer_id", "product_id"), W.partitionBy("customer_id", "category")
    rows = items.select("customer_id", "product_id", "category", "quantity", "price", "refund_amount").repartition("customer_id")
    rows = rows.select("*", F.count("*").over(product).alias("pn"), F.sum("quantity").over(product).alias("pq"), (F.row_number().over(product.orderBy("product_id")) == 1).alias("is_product"))
    rows = rows.select("*", F.count("category").over(category).alias("cn"), F.sum("quantity").over(category).alias("cq"), ((F.row_number().over(category.orderBy("category")) == 1) & F.col("category").isNotNull()).alias("is_category"))
    ranked = rows.select(
        "*", F.row_number().over(mine.orderBy(F.col("is_product").desc(), F.col("pq").desc(), "product_id")).alias("r"),
        F.count_if("is_product").over(mine).alias("m"), F.sum("quantity").over(mine).alias("all_q"), F.count("category").over(mine).alias("all_n"),
    )
    of = lambda name, c: F.when(F.col(name), c)
    pn, share, p = F.col("pn"), F.col("pq") / F.nullif("all_q", F.lit(0)), F.col("cn") / F.col("all_n")
    kinds = F.count_if("is_category")
    return ranked.groupBy("customer_id").agg(
        F.count("*").alias("total_items"), F.sum(refund).alias("total_refunds"), (F.count_if(refund > 0) / F.count("*")).alias("items_returned_pct"), F.avg(price).alias("avg_item_price"), F.stddev_samp(price).alias("price_std"),
        F.count_if("is_product").alias("unique_products"), F.sum(of("is_product", share * share)).alias("product_concentration"), (F.count_if(F.col("is_product") & (pn > 1)) / F.count_if("is_product")).alias("repeat_product_rate"),
        F.coalesce(F.avg(of("is_product", F.when(pn > 1, pn))), F.lit(0.0)).alias("avg_repurchase_count"), F.sum(of("is_product", F.when(F.col("r") <= F.greatest(F.lit(1), F.floor(F.col("m") * 0.2)), share))).alias("loyalty_index"),
        kinds.alias("unique_categories"), F.coalesce(F.sum(of("is_category", -p * F.ln(p))) / F.when(kinds > 1, F.ln(kinds)).otherwise(1.0), F.lit(0.0)).alias("category_diversity"),
        (F.max(of("is_category", F.col("cq"))) / F.nullif(F.sum(of("is_category", F.col("cq"))), F.lit(0))).alias("primary_category_dominance"), F.count_if(F.col("is_category") & (F.col("cn") >= 3)).alias("categories_mastered"),
    ).select(
        "customer_id", "total_items", "total_refunds", "items_returned_pct", F.when(F.col("total_refunds") > 0, 1.0).otherwise(0.0).alias("has_returns"), "avg_item_price", (F.col("price_std") / _or(F.col("avg_item_price"), 1.0)).alias("price_variance"),
        "unique_products", "product_concentration", (1 - F.col("product_concentration")).alias("product_diversity"), "repeat_product_rate", "avg_repurchase_count", "loyalty_index", (1 - F.col("loyalty_index")).alias("purchase_variety"),
        "unique_categories", "category_diversity", "primary_category_dominance", "categories_mastered", (F.col("unique_products") / F.col("total_items")).alias("exploration_breadth"),
    )


def wide_features(orders: DataFrame, items: DataFrame, reference_date: datetime | None = None) -> DataFrame:
    """All features of every customer that has orders, under their plain names (FEAT-1)."""
    ref = reference_date or reference_date_of(orders)
    joined = order_features(orders, ref).join(item_features(items), "customer_id", "left")
    return joined.withColumn("refund_rate", F.when(F.col("lifetime_value") > 0, F.coalesce("total_refunds", F.lit(0.0)) / F.col("lifetime_value")).otherwise(0.0)).withColumn("unique_products_vs_orders", F.coalesce("unique_products", F.lit(0)) / F.col("total_orders"))


def axis(wide: DataFrame, name: str) -> DataFrame:
    """customer_id and the features of one axis."""
    return wide.select("customer_id", *[F.col(ALIASES.get(f, f)).alias(f) for f in AXES[name]])


def flatten(wide: DataFrame, only: tuple[str, ...] = tuple(AXES), keep: tuple[str, ...] = ()) -> DataFrame:
    """All features of all axes or of some as ``axis__feature`` doubles, null as 0 (FEAT-2); columns of ``keep`` stay beside them as they are."""
    return wide.select("customer_id", *keep, *[F.coalesce(F.col(ALIASES.get(f, f)).cast("double"), F.lit(0.0)).alias(f"{a}__{f}") for a in only for f in AXES[a]])
