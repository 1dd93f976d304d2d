"""What is said about a clustering: exact silhouettes of a sample, summaries of k, quality, comparisons, run log, features that stand out."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from patronage.operators.sampling import draw

RUN_SCHEMA = "run_id string, store_id string, customer_count long, event_count long, axes int, total_segments long, avg_silhouette double, min_silhouette double, max_silhouette double, started_at timestamp, seconds double, status string, error string"


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays of numbers (SC-15)."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) ** 2), F.lit(0.0), lambda s, x: s + x))


def membership_kernel(centers: np.ndarray):
    """Distances and exp(-d) shares as one vectorised function of an array column, for many centres or dimensions (UDF-2)."""

    @F.pandas_udf("array<double>")
    def shares(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        p = np.stack(x.to_numpy())
        d = np.sqrt(((p[:, None] - centers) ** 2).sum(-1))
        w = np.exp(d.min(1, keepdims=True) - d)
        return pd.Series(list(w / w.sum(1, keepdims=True)))

    return shares


def silhouette_exact(points: DataFrame, label: str, most: int = 2000, key: str = "customer_id", seed: int = 1) -> DataFrame:
    """(key, label, silhouette) of a hashed sample of at most ``most`` points against each other (CLU-5).

    The sample is the feature's limit: exact silhouettes need all pairs. Its points are sent to the tasks, each of which
    scores its own batches. A point alone in its cluster scores 0, and so does every point where there is one cluster.
    """
    if most > 5000:
        raise ValueError("at most 5000 points; use the linear-time evaluator for whole tables")
    sample = points.select(key, F.col(label).cast("string").alias("label"), "x").orderBy(draw(key, seed), key).limit(most)
    rows = sample.collect()
    names = sorted({r["label"] for r in rows})
    all_x = np.array([r["x"] for r in rows], float)
    member = np.array([[r["label"] == n for n in names] for r in rows], float)
    sizes = member.sum(0)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            own = b["label"].map(names.index).to_numpy()
            d = np.sqrt(((np.stack(b["x"].to_numpy())[:, None] - all_x) ** 2).sum(-1)) @ member
            at = np.arange(len(b))
            inner = d[at, own] / np.maximum(sizes[own] - 1, 1)
            outer = d / sizes
            outer[at, own] = np.inf
            other = outer.min(1) if len(names) > 1 else inner
            s = np.where(sizes[own] > 1, (other - inner) / np.maximum(np.maximum(inner, other), 1e-300), 0.0)
            yield pd.DataFrame({key: b[key], "label": b["label"], "silhouette": s})

    sent = points.sparkSession.createDataFrame(rows, sample.schema)
    return sent.mapInPandas(each, f"{key} {dict(points.dtypes)[key]}, label string, silhouette double")


def k_summary(chosen: DataFrame, unsure: float = 0.5, many: int = 6) -> DataFrame:
    """One row about the chosen k of all axes (CLU-8); ``chosen``: axis, k, confidence."""
    names = lambda c: F.array_join(F.sort_array(F.collect_list(F.when(c, F.col("axis")))), ",")
    return chosen.agg(F.count("*").alias("axes"), F.avg("k").alias("mean_k"), F.median("k").alias("median_k"), F.avg("confidence").alias("mean_confidence"), names(F.col("confidence") < unsure).alias("low_confidence"), names(F.col("k") > many).alias("high_k"))


def quality_report(assigned: DataFrame, largest: float = 50.0, smallest: float = 3.0, pure: float = 0.5) -> DataFrame:
    """For each axis: segments, shares of the largest and smallest, mean purity, and whether these pass (CLU-14).

    ``assigned``: axis, segment, score (membership in that segment). Segments are counted before axes are compared.
    """
    sizes = assigned.groupBy("axis", "segment").agg(F.count("*").alias("n"), F.sum("score").alias("s"))
    total = F.sum("n")
    g = sizes.groupBy("axis").agg(F.count("*").alias("k"), total.alias("customers"), (100 * F.max("n") / total).alias("largest_pct"), (100 * F.min("n") / total).alias("smallest_pct"), (F.sum("s") / total).alias("mean_purity"))
    balanced, described = (F.col("largest_pct") <= largest) & (F.col("smallest_pct") >= smallest), F.col("mean_purity") >= pure
    return g.select("*", balanced.alias("balanced"), described.alias("descriptive"), (balanced & described).alias("passes"))


def distinctive(centers: DataFrame, least: float = 0.5, most: int = 5) -> DataFrame:
    """Features by which a segment stands out from the other segments of its axis (TOP-13); ``centers``: axis, segment, feature, value."""
    of = W.partitionBy("axis", "feature")
    z = (F.col("value") - F.avg("value").over(of)) / (F.stddev_pop("value").over(of) + 1e-10)
    far = centers.withColumn("z", z).where(F.abs("z") > least)
    order = W.partitionBy("axis", "segment").orderBy(F.round(F.abs("z"), 6).desc(), "feature")
    return far.select("axis", "segment", "feature", F.when(F.col("z") > 0, "high").otherwise("low").alias("direction"), "z", "value", F.row_number().over(order).alias("place")).where(F.col("place") <= most)


def log_run(spark: SparkSession, path: str, run_id: str, store_id: str, customers: int, events: int, found: list[tuple[str, int, float]], started: datetime, status: str = "completed", error: str | None = None) -> None:
    """Append a row about a clustering run (SRC-14); ``found``: (axis, segments, silhouette)."""
    s = [x[2] for x in found]
    seconds = (datetime.now(timezone.utc) - started).total_seconds()
    row = (run_id, store_id, customers, events, len(found), sum(x[1] for x in found), float(np.mean(s)) if s else None, min(s, default=None), max(s, default=None), started, seconds, status, error)
    spark.createDataFrame([row], RUN_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def recluster(points: DataFrame, label: str, fn: Callable[[np.ndarray], np.ndarray], most: int = 200_000, key: str = "customer_id", spread: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(key, label, sub): a custom function of a segment's matrix gives labels within it (UDF-5).

    Segments are counted first; one with more than ``most`` rows does not go to one task but to ``spread``, which adds
    sub to the rows (key, label, x) of all such segments on Spark; without it they keep sub = -1, for
    ``clustering.subdivide`` to split. Within a segment rows come in the order of their key.
    """
    p = points.select(key, F.col(label).cast("string").alias("label"), "x")
    sized = p.join(p.groupBy("label").agg((F.count("*") > most).alias("large")), "label")

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        return pd.DataFrame({key: pdf[key], "label": pdf["label"], "sub": np.asarray(fn(np.stack(pdf["x"].to_numpy())), int)})

    small = sized.where(~F.col("large")).select(key, "label", "x").groupBy("label").applyInPandas(each, f"{key} {dict(points.dtypes)[key]}, label string, sub int")
    large = sized.where("large").select(key, "label", "x")
    split = spread(large) if spread else large.withColumn("sub", F.lit(-1))
    return small.unionByName(split.select(key, "label", F.col("sub").cast("int").alias("sub")))


def above_median(rows: DataFrame) -> DataFrame:
    """sub = 1 where the first feature is above the exact median of its label, else 0; the median is an aggregate."""
    m = rows.groupBy(F.col("label").alias("of")).agg(F.median(F.get("x", F.lit(0))).alias("middle"))
    return rows.join(m, F.col("label").eqNullSafe(F.col("of"))).withColumn("sub", (F.get("x", F.lit(0)) > F.col("middle")).cast("int"))


def diverse(points: DataFrame, n: int, rounds: int = 5, key: str = "customer_id", seed: int = 1) -> DataFrame:
    """A sample of n rows spread over the space: each round adds n / rounds of them, farther points with higher chance (SMP-4).

    The first row is the one with the lowest hash. A round measures every row against those drawn so far and draws by the
    distance to the nearest of them, without replacement; only drawn rows reach the driver. A point is drawn once, so
    there are fewer than n rows where the table has fewer different points.
    """
    if not 1 <= n <= 10_000:
        raise ValueError("a sample has 1 to 10000 rows")
    got = points.select(key, "x").orderBy(draw(key, seed), key).limit(1).collect()
    for no in range(rounds):
        want = -(-(n - len(got)) // (rounds - no))
        if want <= 0 or not got:
            break
        centers = np.array([r["x"] for r in got], float)

        def measure(batches: Iterator[pd.DataFrame], centers=centers) -> Iterator[pd.DataFrame]:
            for b in batches:
                for at in range(0, len(b), 500):
                    part = b.iloc[at : at + 500]
                    x = np.stack(part["x"].to_numpy())
                    square = (x * x).sum(1)[:, None] + (centers * centers).sum(1)
                    d = np.maximum(square - 2 * x @ centers.T, 0)
                    d[d <= 1e-12 * square] = 0  # the same point, but for rounding
                    yield part.assign(far=np.sqrt(d.min(1)))

        measured = points.select(key, "x").mapInPandas(measure, f"{key} {dict(points.dtypes)[key]}, x array<double>, far double").where("far > 0")
        got += measured.orderBy(-F.ln(draw(key, seed + no + 1)) / F.col("far"), key).limit(want).select(key, "x").collect()
    return points.sparkSession.createDataFrame([(r[key], r["x"]) for r in got], f"{key} {dict(points.dtypes)[key]}, x array<double>")
