"""Order lines to orders and items, and the cleaning of numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What orders the lines of one order; line numbers alone repeat.
LINE_ORDER = ("line_number", "product_id", "supplier_id", "ship_date", "list_price")


def to_orders(lines: DataFrame) -> DataFrame:
    """One row for each order: its header fields, and the discount of its first line (CLEAN-1).

    Lines without a customer are dropped. The aggregation combines before its one shuffle.
    """
    first = F.struct(*LINE_ORDER)
    return lines.where(F.col("customer_id").isNotNull()).groupBy("customer_id", "order_id").agg(
        F.min_by("order_date", first).alias("order_date"), F.min_by(F.col("order_total").cast("double"), first).alias("total_price"),
        F.min_by("line_item_discount", first).alias("discount_amount"), F.min_by("sales_channel", first).alias("source"),
    )


def to_items(lines: DataFrame) -> DataFrame:
    """Lines with a product, null figures as 0 (CLEAN-3)."""
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    known = lines.where(F.col("customer_id").isNotNull() & F.col("product_id").isNotNull())
    return known.select("customer_id", "order_id", "product_id", "category", "product_type", F.coalesce("quantity", F.lit(0)).alias("quantity"), zero("line_item_sales").alias("price"), zero("line_item_refunds").alias("refund_amount"))


def order_totals(lines: DataFrame) -> DataFrame:
    """Orders with summed sales and quantity (CLEAN-2)."""
    first = F.struct(*LINE_ORDER)
    return lines.groupBy("customer_id", "order_id").agg(F.min_by("order_date", first).alias("order_date"), F.sum("line_item_sales").alias("sales"), F.sum("quantity").alias("quantity"))


def nan_to_zero(c: Column) -> Column:
    """Null and NaN to 0, infinities to +-1e10 (CLEAN-5)."""
    return F.when(c.isNull() | F.isnan(c), 0.0).when(c == float("inf"), 1e10).when(c == float("-inf"), -1e10).otherwise(c)


def nan_to_mean(df: DataFrame, columns: list[str]) -> DataFrame:
    """Null and NaN to the column's mean, or 0 where no value is there (CLEAN-6)."""
    real = lambda c: F.when(~F.isnan(c), F.col(c))
    means = df.agg(*[F.avg(real(c)).alias(f"mean_{c}") for c in columns])
    return df.crossJoin(F.broadcast(means)).select(*[c for c in df.columns if c not in columns], *[F.coalesce(real(c), f"mean_{c}", F.lit(0.0)).alias(c) for c in columns])
