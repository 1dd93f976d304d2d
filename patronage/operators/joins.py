"""Joins of the sales data: reconciliation, tolerant dates, orphans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def combine_sales(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """Lines with their header fields; lines without a header stay (JOIN-1)."""
    return lines.join(headers, "order_id", "left")


def join_date_tolerant(a: DataFrame, b: DataFrame, days: int = 1) -> DataFrame:
    """Rows of ``a`` and ``b`` (customer_id, day, ...) of one customer at most ``days`` days apart (JOIN-2).

    Each day of ``a`` is dealt to the days around it, which makes the range join an equi-join on customer and day.
    """
    near = a.withColumn("near", F.explode(F.sequence(F.date_sub("day", days), F.date_add("day", days))))
    right = b.select(*[F.col(c).alias(f"other_{c}") if c != "customer_id" else F.col(c) for c in b.columns])
    return near.join(right.withColumn("near", F.col("other_day")), ["customer_id", "near"]).drop("near")


def nearest_by_date(a: DataFrame, b: DataFrame, key: str = "order_id", days: int = 1) -> DataFrame:
    """Rows of ``a`` (customer_id, day, ...) with the one row of ``b`` (customer_id, day, ``key``) of the same customer that is nearest in time (JOIN-2).

    At most ``days`` days away; of equally near ones the earlier day, then the smaller key. Rows of ``a`` without one stay.
    Each day of ``b`` keeps its smallest key and offers itself to the days around it; the best offer for each customer and
    day is an aggregate within the tasks first, so a row of ``a`` meets one row, however many orders a customer has.
    """
    on_day = b.where(F.col("day").isNotNull()).groupBy("customer_id", "day").agg(F.min(key).alias("other"))
    offers = on_day.select("customer_id", F.explode(F.sequence(F.date_sub("day", days), F.date_add("day", days))).alias("near"), F.col("day").alias("other_day"), "other")
    best = offers.groupBy("customer_id", F.col("near").alias("day")).agg(F.min(F.struct(F.abs(F.datediff("other_day", "near")).alias("days_apart"), "other_day", "other")).alias("best"))
    return a.join(best, ["customer_id", "day"], "left").select(*a.columns, F.col("best.other").alias(f"other_{key}"), "best.other_day", "best.days_apart")


def orphans(lines: DataFrame, headers: DataFrame, key: str = "order_id") -> DataFrame:
    """Keys of lines that no header has (JOIN-4, SET-3)."""
    return lines.select(key).distinct().join(headers.select(key), key, "left_anti")


def mismatches(lines: DataFrame, headers: DataFrame, columns: list[str], key: str = "order_id") -> DataFrame:
    """(column, mismatches): rows where both sides have a value and they differ, all columns in one pass (JOIN-12)."""
    right = headers.select(key, *[F.col(c).alias(f"h_{c}") for c in columns])
    one = lines.select(key, *columns).join(right, key, "left").agg(*[F.count_if(F.col(c) != F.col(f"h_{c}")).alias(c) for c in columns])
    return one.select(F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c))])).alias("column_name", "mismatches"))


def match_profile(lines: DataFrame, headers: DataFrame, key: str = "order_id") -> DataFrame:
    """Total, matched and unmatched lines (AGG-20)."""
    flagged = lines.select(key).join(headers.select(key, F.lit(1).alias("hit")).distinct(), key, "left")
    hit = F.count("hit")
    return flagged.agg(F.count("*").alias("total"), hit.alias("matched"), (F.count("*") - hit).alias("unmatched"), (100 * hit / F.count("*")).alias("match_pct"))
