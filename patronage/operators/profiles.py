"""Customer profiles: business figures with a segment for each axis, by rules (MEM-8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lower bounds of the segments of each axis, highest first, and the figure they cut.
RULES = {
    "purchase_frequency": ("orders_per_month", ((0.2, "frequent"), (0.1, "regular"), (0.0, "rare"))),
    "purchase_value": ("lifetime_value", ((1_500_000.0, "high"), (800_000.0, "medium"), (0.0, "low"))),
    "customer_maturity": ("tenure_months", ((70.0, "veteran"), (50.0, "settled"), (0.0, "young"))),
    "return_behavior": ("refund_rate", ((0.06, "returner"), (0.0, "keeper"))),
}


def segment_of(axis: str) -> Column:
    figure, bounds = RULES[axis]
    out = F.lit(bounds[-1][1])
    for low, name in reversed(bounds[:-1]):
        out = F.when(F.col(figure) >= low, name).otherwise(out)
    return out


def signature(segments: Column) -> Column:
    """``axis=segment`` pairs in axis order, joined by semicolons (ARC-1, level 1)."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(segments), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";")


def archetype_id(sig: Column) -> Column:
    """A stable id of a signature."""
    return F.concat(F.lit("arch_"), F.substring(F.sha2(sig, 256), 1, 12))


def profiles(wide: DataFrame, stores: DataFrame | None = None) -> DataFrame:
    """One row for each customer: figures, dominant_segments map, signature and archetype_id."""
    out = wide.select(
        "customer_id", "lifetime_value", "total_orders", "avg_order_value", "days_since_last_purchase", "tenure_days", "tenure_months", "orders_per_month", "refund_rate", "discount_rate", "unique_categories",
        F.coalesce("churn_risk_score", F.lit(0.5)).alias("churn_risk_score"), "primary_channel", "recent_orders_90d", "first_order", "last_order",
        F.create_map(*[x for a in RULES for x in (F.lit(a), segment_of(a))]).alias("dominant_segments"),
    )
    out = out.withColumn("signature", signature(F.col("dominant_segments"))).withColumn("archetype_id", archetype_id(F.col("signature")))
    return out.join(stores.select("customer_id", "store_id"), "customer_id", "left") if stores is not None else out
