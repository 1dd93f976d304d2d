"""The wide customer table of the warehouse, and the classes of customers that rules make of it."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from patronage.operators.axes import MONTH, days_between
from patronage.operators.quantiles import quantiles

ACTIVE_DAYS, AT_RISK_DAYS, RECENT_DAYS = 90, 180, 90
#: Shares of these sources are columns.
SOURCES = {"pct_pos": "pos", "pct_web": "web", "pct_shopify": "shopify_draft_order"}


def customer_table(orders: DataFrame, items: DataFrame, reference_date: datetime) -> DataFrame:
    """One row for each customer (FEAT-3): RFM, tenure, items and discounts of an order, weekends, status, channels, season, products, main category, refunds, gaps.

    ``orders``: customer_id, order_id, order_date, total_price, discount_amount, source; ``items``: customer_id, product_id,
    category, product_type, quantity, refund_amount. Each is aggregated by customer once, items by category before that.
    Ties go to the smallest channel, quarter, month and category; gaps are null for one order, their spread for two.
    """
    ref, recent = F.lit(reference_date), F.lit(reference_date - timedelta(days=RECENT_DAYS))
    before = F.lag("order_date").over(W.partitionBy("customer_id").orderBy("order_date", "order_id"))
    cut = F.col("discount_amount") > 0
    o = orders.withColumn("gap", days_between(F.col("order_date"), before)).groupBy("customer_id").agg(
        F.count("*").alias("total_orders"), F.min("order_date").alias("first_purchase_date"), F.max("order_date").alias("last_purchase_date"), F.sum("total_price").alias("lifetime_value"), F.avg("total_price").alias("avg_order_value"),
        F.avg((F.weekday("order_date") >= 5).cast("double")).alias("pct_weekend_orders"), F.avg(F.coalesce(cut, F.lit(False)).cast("double")).alias("discount_rate"), F.coalesce(F.avg(F.when(cut, F.col("discount_amount"))), F.lit(0.0)).alias("avg_discount_when_used"),
        F.count_if(F.col("order_date") >= recent).alias("recent_orders_3mo"), F.mode("source", True).alias("primary_channel"), F.countDistinct("source").alias("channels_used"), *[F.avg(F.coalesce(F.col("source") == s, F.lit(False)).cast("double")).alias(c) for c, s in SOURCES.items()],
        F.mode(F.quarter("order_date"), True).alias("peak_quarter"), F.mode(F.month("order_date"), True).alias("peak_month"), F.avg("gap").alias("avg_days_between_purchases"), F.stddev_samp("gap").alias("std_days_between_purchases"),
    )
    by_category = items.groupBy("customer_id", "category").agg(F.collect_set("product_id").alias("p"), F.collect_set("product_type").alias("t"), F.sum("quantity").alias("q"), F.sum("refund_amount").alias("f"))
    total = F.sum("q")
    i = by_category.groupBy("customer_id").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("p")))).cast("long").alias("unique_products"), F.count("category").alias("unique_categories"), F.size(F.array_distinct(F.flatten(F.collect_list("t")))).cast("long").alias("unique_product_types"),
        total.alias("total_items_purchased"), F.sum("f").alias("total_refunds"), F.min(F.when(F.col("category").isNotNull(), F.struct((-F.col("q")).alias("n"), "category"))).alias("main"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("category").isNotNull(), F.struct("category", "q"))))).alias("category_quantities"),
    )
    tenure, last = days_between(ref, F.col("first_purchase_date")), days_between(ref, F.col("last_purchase_date"))
    n, value = F.col("total_orders"), F.col("lifetime_value")
    d = o.join(i, "customer_id", "left").withColumn("customer_tenure_days", tenure).withColumn("days_since_last_purchase", last)
    days = F.col("customer_tenure_days")
    return d.select(
        *[c for c in d.columns if c != "main"], (F.coalesce("total_items_purchased", F.lit(0)) / n).alias("avg_items_per_order"), (n / F.when(days == 0, 1).otherwise(days) * MONTH).alias("orders_per_month"),
        F.col("days_since_last_purchase").alias("rfm_recency"), n.alias("rfm_frequency"), value.alias("rfm_monetary"),
        F.when(F.col("days_since_last_purchase") <= ACTIVE_DAYS, "Active").when(F.col("days_since_last_purchase") <= AT_RISK_DAYS, "At Risk").otherwise("Churned").alias("customer_status"), (n > 1).alias("is_repeat_customer"),
        F.col("main.category").alias("primary_category"), (-F.col("main.n") / F.nullif("total_items_purchased", F.lit(0))).alias("primary_category_pct"), F.coalesce(F.col("total_refunds") / F.nullif(value, F.lit(0.0)), F.lit(0.0)).alias("refund_rate"),
    )


@dataclass(frozen=True)
class Trade:
    """What a shop sells, and from where on its figures count: names of categories and thresholds of the rules."""

    machine: str
    consumable: str
    finishing: str
    material: str
    other: str
    spender: float = 1000
    business_value: float = 5000
    business_orders: int = 50
    reseller_orders: int = 20
    reseller_products: int = 50
    gift_value: float = 50
    project_value: float = 100
    browser_value: float = 75
    frequent: int = 10
    heavy_use: int = 10
    finishes: int = 5
    some_use: int = 5
    some_finishes: int = 3
    long_days: int = 365
    breadth: int = 4


def _ladder(rungs: list[tuple[Column, str]], rest: str) -> Column:
    out = F.lit(rest)
    for hit, name in reversed(rungs):
        out = F.when(hit, name).otherwise(out)
    return out


def classify(table: DataFrame, trade: Trade, titled: Column | None = None) -> DataFrame:
    """customer_id, seven signals, expertise, customer_type and project_type of the customer table (FEAT-8).

    ``titled``: whether a product's title names a machine of the professional kind; such a customer counts as owner of one
    for the project type.
    """
    q = lambda name: F.coalesce(F.col("category_quantities")[name], F.lit(0))
    share = lambda name: q(name) / F.nullif("total_items_purchased", F.lit(0))
    above = lambda c, limit: F.coalesce(c > limit, F.lit(False))
    n, value, average, kinds, products = (F.col(c) for c in ("total_orders", "lifetime_value", "avg_order_value", "unique_categories", "unique_products"))
    machine, use, finish = q(trade.machine), q(trade.consumable), q(trade.finishing)
    signals = F.array_compact(F.array(
        F.when(value > trade.spender, "high_spender"), F.when(kinds >= trade.breadth, "multi_category"), F.when(machine > 0, "machine_owner"), F.when(n >= trade.frequent, "frequent_buyer"), F.when(use >= trade.heavy_use, "heavy_user"),
        F.when(finish >= trade.finishes, "project_finisher"), F.when(F.col("customer_tenure_days") > trade.long_days, "long_term"),
    ))
    k = F.size("signals")
    expertise = _ladder([(k >= 5, "Professional/Hardcore Enthusiast"), (k >= 3, "Serious Hobbyist"), (k >= 1, "Casual Hobbyist")], "Beginner/Dabbler")
    kind = _ladder([
        ((value > trade.business_value) | (n > trade.business_orders), "Business/Professional"), ((n > trade.reseller_orders) & (products > trade.reseller_products), "Potential Reseller"),
        ((n == 1) & (average < trade.gift_value) & (kinds == 1), "Gift Buyer"), ((use >= trade.some_use) | (finish >= trade.some_finishes), "Active Maker"), ((n <= 3) & (average > trade.project_value), "Project-Based Buyer"),
        ((kinds >= 3) & (average < trade.browser_value), "Explorer/Browser"),
    ], "Casual Buyer")
    owner = (machine > 0) | (F.lit(False) if titled is None else titled)
    project = _ladder([
        (owner & (n > 5), "Machine (Professional)"), (owner, "Machine (Home)"), (above(share(trade.material), 0.6) & (finish == 0), "Garment Maker"), ((finish > 0) & (use > 0), "Traditional Maker"), (above(share(trade.consumable), 0.7), "Consumable Artist"),
        (above(share(trade.finishing), 0.8), "Finishing Specialist"), (above(share(trade.other), 0.7) & (products > 10), "Tool Enthusiast"), (kinds >= trade.breadth, "Generalist"), (F.col("primary_category") == trade.consumable, "Consumable-Focused"),
        (F.col("primary_category") == trade.material, "Material-Focused"), (F.col("primary_category") == trade.finishing, "Finishing-Focused"),
    ], "General Maker")
    return table.withColumn("signals", signals).select("customer_id", "signals", expertise.alias("expertise"), kind.alias("customer_type"), project.alias("project_type"))


def contrasts(table: DataFrame, often: float = 0.5, seldom: float = 0.3) -> DataFrame:
    """(contrast, bucket) with figures of the customers on each side of five contrasts (AGG-24): status, repeat or one order, top or bottom quarter by value, discounts, weekends.

    Quarters are cut at exact quantiles. A customer counts once for each contrast, all in one aggregation.
    """
    low, high = quantiles(table, [F.col("lifetime_value")], (0.25, 0.75))[0]
    value, cut, free = F.col("lifetime_value"), F.col("discount_rate"), F.col("pct_weekend_orders")
    sides = {
        "status": F.col("customer_status"), "repeat": F.when(F.col("is_repeat_customer"), "repeat").otherwise("one-time"), "value": F.when(value >= high, "top").when(value <= low, "bottom"),
        "discount": F.when(cut > often, "high").when(cut == 0, "never"), "weekend": F.when(free > often, "weekend").when(free < seldom, "weekday"),
    }
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("contrast"), c.alias("bucket")) for k, c in sides.items()]))
    d = table.select("*", each.alias("x")).where("x.bucket IS NOT NULL")
    mean = lambda c: F.avg(F.col(c).cast("double"))
    return d.groupBy("x.contrast", "x.bucket").agg(
        F.count("*").alias("n"), mean("lifetime_value").alias("avg_ltv"), mean("total_orders").alias("avg_orders"), mean("avg_order_value").alias("avg_order_value"), mean("customer_tenure_days").alias("avg_tenure_days"), mean("unique_products").alias("avg_products"),
        mean("unique_categories").alias("avg_categories"), mean("discount_rate").alias("discount_rate"), mean("pct_weekend_orders").alias("weekend_rate"), mean("is_repeat_customer").alias("repeat_rate"),
    )
