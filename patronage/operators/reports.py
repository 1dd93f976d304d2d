"""Aggregate reports over sales lines and customer profiles."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from patronage.operators.axes import days_between


def revenue_by_category(lines: DataFrame, reference_date: datetime, months: int = 12, limit: int | None = 10) -> DataFrame:
    """Revenue, orders, customers, units and revenue per customer of each category in the last months (AGG-1).

    Two levels: lines first combine to (category, customer, order), so distinct counts need no expansion of rows.
    """
    recent = lines.where(F.col("order_date") >= F.add_months(F.lit(reference_date), -months))
    by_order = recent.groupBy("category", "customer_id", "order_id").agg(F.sum("line_item_sales").alias("s"), F.count("*").alias("n"), F.sum("quantity").alias("q"))
    by_customer = by_order.groupBy("category", "customer_id").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.sum("q").alias("q"), F.count("*").alias("o"))
    out = by_customer.groupBy("category").agg(F.sum("s").alias("revenue"), F.sum("o").alias("orders"), F.count("*").alias("customers"), (F.sum("s") / F.sum("n")).alias("avg_line_value"), F.sum("q").alias("units"), (F.sum("s") / F.count("*")).alias("revenue_per_customer"))
    return out.orderBy(F.col("revenue").desc(), "category").limit(limit) if limit else out


def category_repurchase(lines: DataFrame) -> DataFrame:
    """Share of customers with more than one order in a category (AGG-2)."""
    orders = lines.select("category", "customer_id", "order_id").distinct().groupBy("category", "customer_id").agg(F.count("*").alias("n"))
    return orders.groupBy("category").agg(F.count("*").alias("customers"), F.count_if(F.col("n") > 1).alias("repeat_customers"), (100 * F.count_if(F.col("n") > 1) / F.count("*")).alias("repurchase_pct"), F.avg("n").alias("avg_orders"))


def repeat_customers(orders: DataFrame, least: int = 3) -> DataFrame:
    """Customers with at least ``least`` orders, with the months they bought in (AGG-3)."""
    return orders.groupBy("customer_id").agg(
        F.count("*").alias("orders"), F.sum("total_price").alias("spend"), F.min("order_date").alias("first_order"), F.max("order_date").alias("last_order"), F.countDistinct(F.date_trunc("month", "order_date")).alias("active_months")
    ).where(F.col("orders") >= least)


def one_time_customers(orders: DataFrame, reference_date: datetime) -> DataFrame:
    """Customers with one order and the band of its age: 30, 90, 180, 365 days and beyond (AGG-4)."""
    one = orders.groupBy("customer_id").agg(F.count("*").alias("n"), F.max("order_date").alias("order_date"), F.sum("total_price").alias("spend")).where("n = 1")
    age = days_between(F.lit(reference_date), F.col("order_date"))
    return one.select("customer_id", "spend", age.alias("days"), F.when(age <= 30, 0).when(age <= 90, 1).when(age <= 180, 2).when(age <= 365, 3).otherwise(4).alias("band"))


def distribution(df: DataFrame, segments: str) -> DataFrame:
    """Customers of each (axis, segment) of a map column (AGG-5)."""
    return df.select(F.explode(segments).alias("axis", "segment")).groupBy("axis", "segment").agg(F.count("*").alias("n"))


def coverage(df: DataFrame, segments: str) -> DataFrame:
    """How many rows have segments (AGG-6)."""
    some = F.count_if(F.size(segments) > 0)
    return df.agg(F.count("*").alias("total"), some.alias("with_segments"), (some / F.count("*")).alias("rate"))


def balance(counts: DataFrame) -> DataFrame:
    """Spread of segment sizes for each axis: coefficient of variation, Gini and a label (AGG-7)."""
    ranked = counts.withColumn("i", F.row_number().over(W.partitionBy("axis").orderBy("n", "segment"))).withColumn("k", F.count("*").over(W.partitionBy("axis")))
    out = ranked.groupBy("axis").agg((F.stddev_pop("n") / F.avg("n")).alias("cv"), (F.sum((2 * F.col("i") - F.col("k") - 1) * F.col("n")) / (F.max("k") * F.sum("n"))).alias("gini"), F.max("n").alias("largest"), F.min("n").alias("smallest"), (F.max("n") / F.min("n")).alias("ratio"))
    return out.withColumn("quality", F.when(F.col("cv") < 0.3, "excellent").when(F.col("cv") < 0.5, "good").when(F.col("cv") < 0.7, "fair").otherwise("poor"))


def odd_segments(counts: DataFrame, low: float = 0.01, high: float = 0.8) -> DataFrame:
    """Segments that hold too little or too much of their axis (AGG-8)."""
    share = F.col("n") / F.sum("n").over(W.partitionBy("axis"))
    return counts.withColumn("share", share).where((F.col("share") < low) | (F.col("share") > high)).withColumn("kind", F.when(F.col("share") < low, "tiny").otherwise("dominant"))


def segment_values(df: DataFrame, segments: str) -> DataFrame:
    """Customers, average and total lifetime value of each axis:segment (AGG-9, AGG-15)."""
    pairs = df.select("lifetime_value", F.explode(segments).alias("axis", "segment")).select("lifetime_value", F.concat_ws(":", "axis", "segment").alias("name"))
    return pairs.groupBy("name").agg(F.count("*").alias("member_count"), F.avg("lifetime_value").alias("avg_ltv"), F.sum("lifetime_value").alias("total_ltv"))


def heat_map(df: DataFrame, segments: str, down: str, across: str, values: list[str]) -> DataFrame:
    """Customers for each pair of segments of two axes, one column for each of ``values`` (AGG-11)."""
    pairs = df.select(F.col(segments)[down].alias("down"), F.col(segments)[across].alias("across"))
    return pairs.groupBy("down").pivot("across", values).count().fillna(0)


def churn_bands(df: DataFrame, score: str = "churn_risk_score") -> DataFrame:
    """Mean, median, shares of four bands and the share at risk (AGG-14)."""
    s, n = F.col(score), F.count(score)
    pct = lambda c: 100 * F.count_if(c) / n
    return df.agg(F.avg(s).alias("mean_risk"), F.median(s).alias("median_risk"), pct(s < 0.2).alias("low_pct"), pct((s >= 0.2) & (s < 0.5)).alias("medium_pct"), pct((s >= 0.5) & (s < 0.75)).alias("high_pct"), pct(s >= 0.75).alias("critical_pct"), pct(s >= 0.5).alias("at_risk_pct"))


def archetype_stats(df: DataFrame) -> DataFrame:
    """Members, share and averages of each archetype (AGG-16)."""
    out = df.groupBy("archetype_id").agg(F.count("*").alias("member_count"), F.avg("lifetime_value").alias("avg_ltv"), F.avg("total_orders").alias("avg_orders"), F.avg("churn_risk_score").alias("avg_churn"))
    total = out.agg(F.sum("member_count").alias("all"))
    return out.crossJoin(F.broadcast(total)).select("archetype_id", "member_count", (F.col("member_count") / F.col("all")).alias("population_pct"), "avg_ltv", "avg_orders", "avg_churn")


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, nulls, percentage) in one pass (AGG-22)."""
    one = df.agg(F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return one.select("rows", F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c))])).alias("column_name", "nulls")).select("column_name", "nulls", (100 * F.col("nulls") / F.col("rows")).alias("null_pct"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def correlations(df: DataFrame, columns: list[str], least: float = 0.4) -> DataFrame:
    """Pairs of columns whose correlation is at least ``least`` in size, in one aggregation (AGG-23)."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*[F.corr(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{k}").alias("r")) for k, (a, b) in enumerate(pairs)])
    out = one.select(F.explode(rows).alias("x")).select("x.*").where(F.abs("r") >= least)
    return out.withColumn("strength", F.when(F.abs("r") > 0.7, "strong").otherwise("moderate"))


def top_by(df: DataFrame, order: Column, limit: int, *ties: str) -> DataFrame:
    """The first rows by an order, ties by the named columns."""
    return df.orderBy(order, *ties).limit(limit)


def column_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, min, max, mean, median, p25, p75) of each column, in one aggregation (AGG-26)."""
    one = df.agg(*[F.struct(F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"), F.avg(c).alias("mean"), F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("p")).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("s")) for c in columns])).alias("x")).select("x.feature", "x.s.min", "x.s.max", "x.s.mean", F.col("x.s.p")[1].alias("median"), F.col("x.s.p")[0].alias("p25"), F.col("x.s.p")[2].alias("p75"))


def rankings(df: DataFrame, keys: dict[str, bool], n: int, tie: str) -> DataFrame:
    """The first n rows by each sort key (True: smallest first), marked with the key (AGG-17)."""
    out = None
    for key, up in keys.items():
        one = top_by(df, F.col(key).asc() if up else F.col(key).desc(), n, tie).select(F.lit(key).alias("sort_key"), *df.columns)
        out = one if out is None else out.unionByName(one)
    return out
