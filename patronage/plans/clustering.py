"""Clustering of axes: choice of k, fuzzy choice of k, splitting of segments; all on ``plans.many``, models hold centres only."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.operators.membership import Scaler
from patronage.operators.quantiles import quantiles_by
from patronage.plans.many import Model, fuzzy_many, kmeans_many, labelled, stash_points
from patronage.sources.landing import work_path

# Customers of a cluster on average at least, and clusters at most.
PER_CLUSTER, MOST_CLUSTERS = 50, 10


def vectors(df: DataFrame, scaler: Scaler, key: str = "customer_id") -> DataFrame:
    """(key, x, v): scaled features as array and vector."""
    x = df.select(key, F.array(*scaler.columns()).alias("x"))
    return x.withColumn("v", array_to_vector("x"))


def axis_points(features: DataFrame, columns: dict[str, tuple[str, ...]], scaler: Scaler, key: str = "customer_id") -> DataFrame:
    """(key, axis, x): one row for each customer and axis, scaled; ``columns`` names the features of each axis, all of them in the scaler."""
    at = dict(zip(scaler.features, scaler.columns(), strict=True))
    every = F.array(*[F.struct(F.lit(a).alias("axis"), F.array(*[at[c] for c in own]).alias("x")) for a, own in columns.items()])
    return features.select(key, F.explode(every).alias("p")).select(key, "p.axis", "p.x")


def most_k(n: int, most: int = 6) -> int:
    """The largest k that a population of n is worth (CLU-6)."""
    return max(1, int(min((n / 2) ** 0.5, n / PER_CLUSTER, MOST_CLUSTERS, most)))


def figures(m: Model, total: float) -> dict:
    """What is known of a model (CLU-6); ``total`` is the squared distance of all rows to their mean."""
    n = int(m.sizes.sum())
    ch = ((total - m.inertia) / max(m.k - 1, 1)) / max(m.inertia / max(n - m.k, 1), 1e-12)
    return {
        "k": m.k, "silhouette": m.silhouette, "inertia": m.inertia, "calinski_harabasz": float(ch), "largest": int(m.sizes.max()), "smallest": int(m.sizes.min()),
        "balance": float(np.std(m.sizes) / np.mean(m.sizes)), "centers": m.centers.tolist(), "dims": m.centers.shape[1],
    }


def scores_by_group(points: DataFrame, group: str, ks: range = range(2, 7), restarts: int = 10, least: int = 100, by_population: bool = True, seed: int = 1, key: str = "customer_id") -> dict[str, list[dict]]:
    """Figures of every k of every group, all fitted in the same passes (CLU-4, CLU-6).

    A group of fewer than ``least`` rows is not clustered and has no figures; with ``by_population`` k goes up to what
    the group's size is worth only. Each k is the best of ``restarts`` starts by inertia. Rows are never collected.
    """
    stored = stash_points(points, group, key)
    # Sizes and spread of each group, from one aggregation over dimensions.
    spread = stored.select("group", F.posexplode("x").alias("i", "t")).groupBy("group", "i").agg(F.count("*").alias("n"), (F.var_pop("t") * F.count("*")).alias("ss"))
    known = {r["group"]: (r["n"], r["ss"]) for r in spread.groupBy("group").agg(F.max("n").alias("n"), F.sum("ss").alias("ss")).collect()}
    wanted = {g: [k for k in ks if not by_population or k <= most_k(n, max(ks))] for g, (n, _) in known.items() if n >= least}
    found = kmeans_many(stored, {g: w for g, w in wanted.items() if w}, restarts, seed=seed)
    out: dict[str, list[dict]] = {g: [] for g in known}
    for (g, _), model in sorted(found.items(), key=lambda x: (str(x[0][0]), x[0][1])):
        out[g].append(figures(model, known[g][1] or 0.0))
    return out


def k_scores(points: DataFrame, ks: range, restarts: int = 10, seed: int = 1, key: str = "customer_id") -> list[dict]:
    """Figures of each k of one table (CLU-4 to CLU-6)."""
    return next(iter(scores_by_group(points.select(key, F.lit("all").alias("one"), "x"), "one", ks, restarts, 1, False, seed, key).values()), [])


def vote(scores: list[dict]) -> tuple[int, float]:
    """k by three votes (silhouette with balance, elbow, Calinski-Harabasz with balance) and the share that agree (CLU-7)."""
    def angle(a: dict, b: dict, c: dict) -> float:
        u, v = np.array([-1.0, a["inertia"] - b["inertia"]]), np.array([1.0, c["inertia"] - b["inertia"]])
        return float(np.arccos(np.clip(u @ v / (np.linalg.norm(u) * np.linalg.norm(v) + 1e-12), -1, 1)))

    good = [s for s in scores if s["silhouette"] >= 0.3] or scores
    first = max(good, key=lambda s: 0.4 * s["silhouette"] + 0.6 * (1 - min(1.0, s["balance"])))["k"]
    second = min(zip(scores, scores[1:], scores[2:], strict=False), key=lambda t: angle(*t))[1]["k"] if len(scores) > 2 else scores[0]["k"]
    top = max(s["calinski_harabasz"] for s in scores) or 1.0
    third = max(scores, key=lambda s: 0.4 * s["calinski_harabasz"] / top + 0.6 * (1 - min(1.0, s["balance"])))["k"]
    votes = [first, second, third]
    best = max(sorted(set(votes)), key=votes.count)
    return best, votes.count(best) / 3


def balanced_choice(scores: list[dict], total: int) -> dict:
    """The best silhouette among splits that are balanced enough, else the best at all (CLU-9)."""
    good = [s for s in scores if s["silhouette"] >= 0.35 and s["largest"] <= 0.5 * total and s["smallest"] >= 0.03 * total]
    return max(good or scores, key=lambda s: s["silhouette"])


def fuzzy_choice(points: DataFrame, ks: range = range(3, 8), largest: float = 0.55, smallest: float = 0.03, m: float = 2.0, rounds: int = 150, tolerance: float = 1e-5, seed: int = 5, key: str = "customer_id") -> tuple[int, dict[int, Model], bool]:
    """Balance-aware k of fuzzy c-means: (k, models of all k, whether it is balanced) (CLU-10).

    Rows count for the segment of their largest membership. Among the k whose largest and smallest segments are within
    the two shares the best silhouette wins; where there is none, the best silhouette of all. The first of equals wins.
    """
    models = fuzzy_many(stash_points(points, None, key), list(ks), m, rounds, tolerance, seed)
    found = [x for x in models.values() if len(x.sizes)]
    good = [x for x in found if x.sizes.max() <= largest * x.sizes.sum() and x.sizes.min() >= smallest * x.sizes.sum()]
    best = max(good or found, key=lambda x: x.silhouette)
    return best.k, models, bool(good)


def fuzzy_centers(points: DataFrame, starts: np.ndarray, m: float = 2.0, rounds: int = 150, tolerance: float = 1e-5, key: str = "customer_id") -> np.ndarray | None:
    """Centres of fuzzy c-means from given starting centres, in the order of their coordinates; None without rows (CLU-11)."""
    stored = stash_points(points, None, key)
    if stored.isEmpty():
        return None
    k = len(starts)
    return fuzzy_many(stored, [k], m, rounds, tolerance, starts={k: starts})[k].centers


def fuzzy_membership(x: Column, centers: np.ndarray, m: float = 2.0) -> Column:
    """Memberships of a point from the centres, as an array column (CLU-11)."""
    far = [F.greatest(F.aggregate(F.zip_with(x, F.array(*[F.lit(float(v)) for v in c]), lambda a, b: (a - b) ** 2), F.lit(0.0), lambda s, t: s + t), F.lit(1e-20)) for c in centers]
    near = [F.pow(d, F.lit(-1 / (m - 1))) for d in far]
    total = sum(near[1:], near[0])
    return F.array(*[n / total for n in near])


def _shape(stored: DataFrame) -> dict[str, tuple[int, np.ndarray, float]]:
    """(rows, mean, mean squared distance to it) of each group."""
    each = stored.select("group", F.posexplode("x").alias("i", "t")).groupBy("group", "i").agg(F.count("*").alias("n"), F.avg("t").alias("mean"), F.var_pop("t").alias("v"))
    rows = each.groupBy("group").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "mean"))).alias("mean"), F.sum("v").alias("v")).collect()
    return {r["group"]: (r["n"], np.array([x["mean"] for x in r["mean"]]), r["v"]) for r in rows}


def subdivide(
    points: DataFrame, labels: str, least: int = 100, variance: float = 2.0, spread: float = 1.5, share: float = 0.6, depth: int = 3, floor: int = 30, gain: float = 0.1,
    ks: tuple[int, ...] = (2, 3), restarts: int = 5, seed: int = 3, key: str = "customer_id",
) -> tuple[DataFrame, list[dict]]:
    """Split segments that are too wide, level by level (CLU-13): (key, path) of all rows, and what was found of each segment.

    A segment of at least ``least`` rows is looked at again if its mean squared distance to its centre is above
    ``variance``, its farthest row is beyond ``spread`` times the 95th percentile of the distances, or it holds more
    than ``share`` of all rows. The k of best silhouette splits it, and the split stays only if each part has ``floor``
    rows and its silhouette, which is 0 for the unsplit segment, gains ``gain``. Paths are such as root.0.1.

    A level reads the rows of all its segments together, whatever their number: their shapes, exact percentiles and
    k-means come from the same passes; the next level is written to the shared folder.
    """
    stored = stash_points(points.select(key, "x", F.concat(F.lit("root."), F.col(labels).cast("string")).alias("path")), "path", key)
    schema = f"group string, key {dict(points.dtypes)[key]}, h long, x array<double>"
    nodes, leaves, total = [], set(), None
    for level in range(depth + 1):
        shapes = _shape(stored)
        total = total or sum(n for n, *_ in shapes.values())
        new = {g: s for g, s in shapes.items() if g not in leaves}
        large = {g: s[1][None] for g, s in new.items() if s[0] >= least and level < depth}
        far = quantiles_by(labelled(stored, large, schema).where("label >= 0"), "group", F.col("far"), (0.95, 1.0)) if large else {}
        reasons = {}
        for g, (n, _, v) in new.items():
            why = [name for name, hit in (("variance", v > variance), ("distance", g in far and far[g][1] > spread * far[g][0]), ("share", n > share * total)) if hit]
            reasons[g] = why if g in large else []
        flagged = [g for g, why in reasons.items() if why]
        found = kmeans_many(stored, {g: list(ks) for g in flagged}, restarts, seed=seed) if flagged else {}
        accepted = {}
        for g in flagged:
            best = max((m for (of, _), m in found.items() if of == g), key=lambda m: m.silhouette, default=None)
            if best is not None and best.sizes.min() >= floor and best.silhouette >= gain:
                accepted[g] = best.centers
        for g, (n, _, v) in sorted(new.items()):
            nodes.append({"path": g, "depth": level, "rows": n, "variance": v, "p95": far[g][0] if g in far else None, "farthest": far[g][1] if g in far else None, "reasons": ",".join(reasons[g]), "split": g in accepted})
            if g not in accepted:
                leaves.add(g)
        if not accepted:
            break
        path = work_path(points.sparkSession, "segments")
        down = labelled(stored, accepted, schema)
        down.withColumn("group", F.when(F.col("label") >= 0, F.concat_ws(".", "group", F.col("label").cast("string"))).otherwise(F.col("group"))).drop("label", "far").write.parquet(path)
        stored = points.sparkSession.read.parquet(path)
    return stored.select(F.col("key").alias(key), F.col("group").alias("path")), nodes
