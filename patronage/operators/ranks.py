"""Ranks over a whole table without a window that takes all rows into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def global_percentile(df: DataFrame, value: str, name: str, buckets: int = 256) -> DataFrame:
    """Share of rows with a strictly smaller value (WIN-8).

    Rows are dealt to ranges between approximate quantiles; a row's rank is the number of rows in lower ranges, which is
    a sum over ``buckets`` counts, and its rank within its range. Nulls get null.
    """
    some = df.where(F.col(value).isNotNull())
    cuts = some.approxQuantile(value, [k / buckets for k in range(1, buckets)], 0.2 / buckets)
    bounds = F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<double>")
    dealt = some.withColumn("range_no", F.size(F.filter(bounds, lambda b: b <= F.col(value))))
    sizes = dealt.groupBy("range_no").agg(F.count("*").alias("n"))
    below = sizes.select("range_no", (F.sum("n").over(W.orderBy("range_no")) - F.col("n")).alias("below"), F.sum("n").over(W.partitionBy()).alias("all_n"))
    ranked = dealt.withColumn("place", F.rank().over(W.partitionBy("range_no").orderBy(value)) - 1).join(F.broadcast(below), "range_no")
    out = ranked.select(*df.columns, ((F.col("below") + F.col("place")) / F.col("all_n")).alias(name))
    return out.unionByName(df.where(F.col(value).isNull()).withColumn(name, F.lit(None).cast("double")))
