"""The segmentation run: features of all axes, segments from a sample, memberships of every customer, archetypes.

Features are written once and scanned from there. Segments are found on a tiered sample whose size is bounded by a
rule (SMP-1, SMP-5), one task for each axis; the table of segments, a few rows for each axis, then scores every
customer in one pass of column expressions, so the population is never clustered or shuffled.
"""

from __future__ import annotations

import zlib
from datetime import datetime, timezone

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.operators import membership as mem
from patronage.operators.axes import AXES
from patronage.operators.quantiles import quantiles
from patronage.operators.sampling import sample_size, tiered
from patronage.plans.clustering import most_k

SEGMENTS = "axis string, segment string, center array<double>, feature_names array<string>, scaler struct<type:string,center:array<double>,scale:array<double>>, k int, silhouette double"
#: Segments of one run beyond this number are not expressions any more.
MOST_SEGMENTS = 1000
SILHOUETTE_ROWS = 1500


def columns_of(axis: str) -> tuple[str, ...]:
    """The columns of an axis in the flattened features (FEAT-2)."""
    return tuple(f"{axis}__{f}" for f in AXES[axis])


def kmeans(x: np.ndarray, k: int, restarts: int, rng: np.random.Generator, rounds: int = 50) -> tuple[float, np.ndarray, np.ndarray]:
    """(inertia, centres, labels) of the best of several starts, each from spread points."""
    best = None
    for _ in range(restarts):
        centers = x[[rng.integers(len(x))]]
        while len(centers) < k:
            far = ((x[:, None] - centers) ** 2).sum(-1).min(1)
            if far.sum() <= 0:
                break
            centers = np.concatenate((centers, x[[rng.choice(len(x), p=far / far.sum())]]))
        for _ in range(rounds):
            d = ((x[:, None] - centers) ** 2).sum(-1)
            label = d.argmin(1)
            new = np.stack([x[label == c].mean(0) if (label == c).any() else centers[c] for c in range(len(centers))])
            if np.allclose(new, centers):
                break
            centers = new
        inertia = float(d.min(1).sum())
        if best is None or inertia < best[0]:
            best = inertia, centers, label
    return best


def silhouette(x: np.ndarray, label: np.ndarray) -> float:
    """Mean silhouette of points against each other; -1 where there is one cluster."""
    names = np.unique(label)
    if len(names) < 2:
        return -1.0
    member = label[:, None] == names
    sizes = member.sum(0)
    square = (x * x).sum(1)
    d = np.sqrt(np.maximum(square[:, None] + square - 2 * x @ x.T, 0)) @ member
    own, at = np.searchsorted(names, label), np.arange(len(x))
    inner = d[at, own] / np.maximum(sizes[own] - 1, 1)
    outer = d / sizes
    outer[at, own] = np.inf
    other = outer.min(1)
    return float(np.where(sizes[own] > 1, (other - inner) / np.maximum(np.maximum(inner, other), 1e-300), 0).mean())


def fit_axis(axis: str, x: np.ndarray, restarts: int = 10, least: int = 100, most: int = 6, seed: int = 1) -> list[tuple]:
    """Rows of ``SEGMENTS`` for one axis: the k of the best silhouette from 2 on, one segment below ``least`` rows (CLU-4)."""
    rng = np.random.default_rng([seed, zlib.crc32(axis.encode())])
    mean, std = x.mean(0), x.std(0)
    std[std == 0] = 1.0
    z = (x - mean) / std
    check = rng.permutation(len(z))[:SILHOUETTE_ROWS]
    found = (0.0, z.mean(0)[None])
    if len(z) >= least:
        for k in range(2, most_k(len(z), most) + 1):
            _, centers, label = kmeans(z, k, restarts, rng)
            score = silhouette(z[check], label[check])
            if len(centers) == k and score > found[0]:
                found = score, centers
    score, centers = found
    centers = centers[np.lexsort(centers.T[::-1])]
    return [(axis, f"{axis}_{c}", centers[c].tolist(), list(columns_of(axis)), ("standard", mean.tolist(), std.tolist()), len(centers), score) for c in range(len(centers))]


def discover(features: DataFrame, size: int | None = None, restarts: int = 10, least: int = 100, seed: int = 1, value: str = "purchase_value__lifetime_value") -> DataFrame:
    """The table of segments of all axes, from a tiered sample of flattened features: ``size`` rows, or as many as the rule gives."""
    sample = tiered(features, "customer_id", value, size or sample_size(features.count()), seed)
    points = F.array(*[F.struct(F.lit(a).alias("axis"), F.array(*columns_of(a)).alias("x")) for a in AXES])

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        names = [c.split()[0] for c in SEGMENTS.replace(",array", ";array").split(", ")]
        found = fit_axis(key[0], np.stack(rows.sort_values("customer_id")["x"].to_numpy()), restarts, least, seed=seed)
        return pd.DataFrame([(*r[:4], dict(zip(("type", "center", "scale"), r[4], strict=True)), *r[5:]) for r in found], columns=names)

    long = sample.select("customer_id", F.explode(points).alias("p")).select("customer_id", "p.*")
    return long.groupBy("axis").applyInPandas(fit, SEGMENTS)


def quantile_segments(features: DataFrame, shares: tuple[float, ...] = (0.2, 0.5, 0.8), names: tuple[str, ...] = ("low", "middle", "high"), only: tuple[str, ...] = tuple(AXES)) -> DataFrame:
    """A table of segments without a fit: for each axis, or each of ``only``, the points at the same quantile of all its features, scaled by the population."""
    columns = [c for a in only for c in columns_of(a)]
    scaler = mem.fit_scaler(features, tuple(columns))
    at = dict(zip(columns, zip(quantiles(features, [F.col(c) for c in columns], shares), scaler.center, scaler.scale, strict=True), strict=True))
    rows = []
    for a in only:
        own = columns_of(a)
        scale = ("standard", [at[c][1] for c in own], [at[c][2] for c in own])
        rows += [(a, n, [round((at[c][0][k] - at[c][1]) / at[c][2], 4) for c in own], list(own), scale, len(names), None) for k, n in enumerate(names)]
    return features.sparkSession.createDataFrame(rows, SEGMENTS)


def _by_axis(value, only: tuple[str, ...] = tuple(AXES)) -> Column:
    return F.create_map(*[x for a in only for x in (F.lit(a), value(a))])


def by_axis(features: DataFrame, segments: DataFrame, kind: str = "exp", only: tuple[str, ...] = tuple(AXES), keep: tuple[str, ...] = ()) -> DataFrame:
    """customer_id, the columns of ``keep``, and for each axis, or each of ``only``, a column of its name with the distances and m_ of it with the memberships."""
    rows = segments.limit(MOST_SEGMENTS + 1).collect()
    if len(rows) > MOST_SEGMENTS:
        raise ValueError(f"more than {MOST_SEGMENTS} segments")
    of = {a: [r for r in rows if r["axis"] == a] for a in only}
    far = []
    for a, own in of.items():
        if not own:
            raise ValueError(f"no segment of {a}")
        s = own[0]["scaler"]
        point = mem.Scaler(tuple(own[0]["feature_names"]), tuple(s["center"]), tuple(s["scale"])).columns()
        far.append(mem.distances(point, {r["segment"]: tuple(r["center"]) for r in own}).alias(a))
    return features.select("customer_id", *keep, *far).select("*", *[mem.memberships(F.col(a), kind).alias(f"m_{a}") for a in only])


def dominants(features: DataFrame, segments: DataFrame, only: tuple[str, ...], keep: tuple[str, ...] = ()) -> DataFrame:
    """customer_id, the columns of ``keep`` and dominant (axis -> segment) of the axes of ``only``, in one pass."""
    shares = by_axis(features, segments, "exp", only, keep)
    return shares.select("customer_id", *keep, _by_axis(lambda a: mem.ranked(F.col(f"m_{a}"))[0]["segment"], only).alias("dominant"))


def assign(features: DataFrame, segments: DataFrame, kind: str = "exp") -> DataFrame:
    """Every customer on every axis (MEM-1 to MEM-4, CLU-15).

    customer_id, distances and memberships (axis -> segment -> value), dominant and strength (axis -> value), and
    confidence, the mean over the axes of 1 / (1 + distance to the nearest centre).
    """
    shares = by_axis(features, segments, kind)
    ranked = shares.select("*", *[mem.ranked(F.col(f"m_{a}")).alias(f"r_{a}") for a in AXES])
    near = [1 / (1 + F.array_min(F.map_values(F.col(a)))) for a in AXES]
    return ranked.select(
        "customer_id", _by_axis(F.col).alias("distances"), _by_axis(lambda a: F.col(f"m_{a}")).alias("memberships"), _by_axis(lambda a: F.col(f"r_{a}")[0]["segment"]).alias("dominant"),
        _by_axis(lambda a: mem.strength(F.col(f"r_{a}"))).alias("strength"), (sum(near[1:], near[0]) / len(near)).alias("confidence"),
    )


def signatures(assigned: DataFrame, digits: int = 1) -> DataFrame:
    """customer_id and its signatures at three levels (ARC-1): dominant segments; with their strengths; the two largest shares of each axis, rounded."""
    axes = F.array(*[F.lit(a) for a in sorted(AXES)])
    dominant = lambda a: F.concat(a, F.lit("="), F.col("dominant")[a])
    two = lambda a: F.array_join(F.transform(F.slice(mem.ranked(F.col("memberships")[a]), 1, 2), lambda x: F.concat(x["segment"], F.lit(":"), F.round(x["score"], digits).cast("string"))), ",")
    return assigned.select(
        "customer_id", F.array_join(F.transform(axes, dominant), ";").alias("level1"), F.array_join(F.transform(axes, lambda a: F.concat(dominant(a), F.lit(":"), F.col("strength")[a])), ";").alias("level2"),
        F.array_join(F.transform(axes, lambda a: F.concat(a, F.lit("="), two(a))), ";").alias("level3"),
    )


def archetypes(signed: DataFrame) -> DataFrame:
    """(level, signature, members) of all three levels, counted within the tasks first (ARC-2)."""
    levels = F.array(*[F.struct(F.lit(k).alias("level"), F.col(f"level{k}").alias("signature")) for k in (1, 2, 3)])
    return signed.select(F.explode(levels).alias("s")).groupBy("s.level", "s.signature").agg(F.count("*").alias("members"))


def shares_of(profiles: DataFrame, key: str) -> DataFrame:
    """(key, members, share) of an archetype; the total is a sum of the counts, so both read one exchange and profiles are made once (ARC-2)."""
    counts = profiles.groupBy(key).agg(F.count("*").alias("members"))
    total = counts.agg(F.sum("members").alias("all"))
    return counts.crossJoin(F.broadcast(total)).select(key, "members", (F.col("members") / F.col("all")).alias("share"))


def population(assigned: DataFrame, segments: DataFrame) -> DataFrame:
    """The table of segments with customer_count and population_pct, counted over all customers (CLU-12)."""
    sizes = assigned.select(F.explode("dominant").alias("axis", "segment")).groupBy("axis", "segment").agg(F.count("*").alias("customer_count"))
    total = sizes.groupBy("axis").agg(F.sum("customer_count").alias("all"))
    known = segments.join(F.broadcast(sizes), ["axis", "segment"], "left").join(F.broadcast(total), "axis", "left").fillna(0, ["customer_count"])
    return known.withColumn("population_pct", 100 * F.col("customer_count") / F.col("all")).drop("all")


def described(segments: DataFrame) -> DataFrame:
    """The table of segments with their centres in the units of the features, and names by the first of these (CLU-12).

    Fixed values: above 0.5 is high, above -0.5 medium, else low.
    """
    scaled = F.zip_with("center", F.col("scaler.scale"), lambda c, s: c * s)
    first = F.get(F.col("center_original"), F.lit(0))
    level = F.when(first > 0.5, "high").when(first > -0.5, "medium").otherwise("low")
    told = segments.withColumn("center_original", F.zip_with(scaled, F.col("scaler.center"), lambda c, m: c + m))
    return told.withColumn("name", F.concat(level, F.lit("_"), "axis")).withColumn("interpretation", F.concat(F.lit("Customers with "), level, F.lit(" "), F.get(F.split(F.get(F.col("feature_names"), F.lit(0)), "__"), F.lit(1))))


def outliers(memberships: Column, floor: float = 0.3, cut: float = 0.0, least_axes: int = 2, least_mean: float = 0.6) -> Column:
    """A struct of axis_scores (1 - largest share / floor, 0 at least), flagged axes (score above ``cut``), mean score of these, and outlier: enough axes and mean (OUT-1)."""
    scores = F.transform_values(memberships, lambda a, m: F.greatest(F.lit(0.0), 1 - F.array_max(F.map_values(m)) / floor))
    flagged = F.filter(F.map_entries(scores), lambda e: e["value"] > cut)
    mean = F.coalesce(F.aggregate(flagged, F.lit(0.0), lambda s, e: s + e["value"]) / F.nullif(F.size(flagged), F.lit(0)), F.lit(0.0))
    return F.struct(scores.alias("axis_scores"), F.array_sort(F.transform(flagged, lambda e: e["key"])).alias("flagged"), mean.alias("mean"), ((F.size(flagged) >= least_axes) & (mean >= least_mean)).alias("outlier"))


def run(features: DataFrame, path: str, size: int | None = None, store_id: str = "all", seed: int = 1) -> dict[str, DataFrame]:
    """The whole run (W1): features, segments, profiles, archetypes and a line of the run log, each written below ``path`` and read again."""
    from patronage.plans.diagnostics import log_run

    spark, began = features.sparkSession, datetime.now(timezone.utc)

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}")

    features = kept(features, "features")
    found = kept(discover(features, size, seed=seed), "fitted")
    profiles = kept(assign(features, found), "profiles")
    segments = kept(described(population(profiles, found)), "segments")
    groups = kept(archetypes(signatures(profiles)), "archetypes")
    chosen = [(r["axis"], r["k"], r["silhouette"]) for r in segments.groupBy("axis").agg(F.max("k").alias("k"), F.max("silhouette").alias("silhouette")).orderBy("axis").collect()]
    log_run(spark, f"{path}/runs", f"{store_id}-{began:%Y%m%d%H%M%S}", store_id, profiles.count(), 0, chosen, began)
    return {"features": features, "segments": segments, "profiles": profiles, "archetypes": groups, "runs": spark.read.parquet(f"{path}/runs")}
