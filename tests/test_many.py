"""Simultaneous clusterings against plain numpy on planted clusters."""

import numpy as np
import pandas as pd
import pytest
from patronage.plans import clustering as cl
from patronage.plans import many
from pyspark.sql import functions as F

SHAPES = {"a": (((0, 0), 200), ((9, 0), 120), ((0, 9), 80)), "b": (((0, 0, 0), 150), ((7, 7, 7), 150)), "tiny": (((0,), 60),)}


def planted(seed=4, scale=0.4):
    rng = np.random.default_rng(seed)
    rows = [(g, x.tolist()) for g, parts in SHAPES.items() for mean, n in parts for x in rng.normal(mean, scale, (n, len(mean)))]
    order = rng.permutation(len(rows))
    return [(int(k), *rows[i]) for k, i in enumerate(order)]


@pytest.fixture(scope="module")
def rows():
    return planted()


@pytest.fixture(scope="module")
def points(spark, rows):
    return spark.createDataFrame(rows, "customer_id long, axis string, x array<double>").repartition(5)


def matrix(rows, g):
    return np.array([x for _, a, x in rows if a == g])


def silhouette(x, label):
    """Squared Euclidean silhouette by its definition."""
    d = ((x[:, None] - x) ** 2).sum(-1)
    out = []
    for i in range(len(x)):
        own = label == label[i]
        if own.sum() == 1:
            out.append(0.0)
            continue
        inner = d[i][own].sum() / (own.sum() - 1)
        other = min(d[i][label == c].mean() for c in set(label) - {label[i]})
        out.append((other - inner) / max(inner, other))
    return np.mean(out)


def test_choice_of_k_by_group(points, rows):
    found = cl.scores_by_group(points, "axis", range(2, 7), restarts=4)
    assert found["tiny"] == []  # below the least population
    assert [s["k"] for s in found["a"]] == [2, 3, 4, 5, 6] and [s["k"] for s in found["b"]] == [2, 3, 4, 5, 6]
    for g, k in (("a", 3), ("b", 2)):
        x = matrix(rows, g)
        best = max(found[g], key=lambda s: s["silhouette"])
        assert best["k"] == k
        for s in found[g]:
            c = np.array(s["centers"])
            label = ((x[:, None] - c) ** 2).sum(-1).argmin(1)
            inertia = ((x - c[label]) ** 2).sum()
            total = ((x - x.mean(0)) ** 2).sum()
            assert s["inertia"] == pytest.approx(inertia) and sorted([s["largest"], s["smallest"]]) == sorted([np.bincount(label).max(), np.bincount(label).min()])
            assert s["silhouette"] == pytest.approx(silhouette(x, label))
            assert s["calinski_harabasz"] == pytest.approx((total - inertia) / (s["k"] - 1) / (inertia / (len(x) - s["k"])))
            # A fixed point of Lloyd's step, up to the tolerance.
            assert np.abs(np.array([x[label == j].mean(0) for j in range(s["k"])]) - c).max() < 0.02
        assert [s["inertia"] for s in found[g]] == sorted([s["inertia"] for s in found[g]], reverse=True)


def test_population_bounds_k(points):
    found = cl.scores_by_group(points.where("axis = 'b'"), "axis", range(2, 9), restarts=1)
    assert [s["k"] for s in found["b"]] == [2, 3, 4, 5, 6]  # 300 rows are worth 6 clusters
    assert [cl.most_k(n, 10) for n in (10, 60, 150, 400, 10_000)] == [1, 1, 3, 8, 10]


def test_reruns_and_partitions_agree(points):
    once = many.kmeans_many(many.stash_points(points, "axis"), {"a": [3, 4]}, 3)
    again = many.kmeans_many(many.stash_points(points.repartition(2), "axis"), {"a": [3, 4]}, 3)
    for k in once:
        assert np.allclose(once[k].centers, again[k].centers)


def test_few_different_rows(spark):
    df = spark.createDataFrame([(k, "g", [float(k % 2)]) for k in range(50)], "customer_id long, axis string, x array<double>")
    found = many.kmeans_many(many.stash_points(df, "axis"), {"g": [2, 3]}, 2)
    assert set(found) == {("g", 2)} and found["g", 2].silhouette == 1.0
    assert many.kmeans_many(many.stash_points(df.where("false"), "axis"), {"g": [2]}, 2) == {}


def test_blocks_of_models_agree(points, monkeypatch):
    whole = many.kmeans_many(many.stash_points(points, "axis"), {"a": [2, 3], "b": [2]}, 2)
    monkeypatch.setattr(many, "MOST_CENTRES", 4)
    parts = many.kmeans_many(many.stash_points(points, "axis"), {"a": [2, 3], "b": [2]}, 2)
    assert all(np.allclose(whole[k].centers, parts[k].centers) and whole[k].silhouette == pytest.approx(parts[k].silhouette) for k in whole)


def numpy_fuzzy(x, h, k, seed=5, m=2.0, rounds=150, tolerance=1e-5):
    u = np.stack([many._unit(h, 7919 * seed + 31 * k + c) for c in range(k)], 1)
    u /= u.sum(1, keepdims=True)
    for _ in range(rounds):
        c = (u**m).T @ x / (u**m).sum(0)[:, None]
        d = np.sqrt(np.maximum(((x[:, None] - c) ** 2).sum(-1), 1e-20))
        new = 1 / ((d[:, :, None] / d[:, None]) ** (2 / (m - 1))).sum(2)
        shift, u = np.linalg.norm(new - u), new
        if shift < tolerance:
            break
    return c[np.lexsort(c.T[::-1])]


def test_fuzzy_choice_equals_numpy(spark, points, rows):
    df = points.where("axis = 'a'")
    h = {r.customer_id: r.h for r in df.select("customer_id", F.xxhash64("customer_id").alias("h")).collect()}
    own = [(i, x) for i, a, x in rows if a == "a"]
    x, hashes = np.array([v for _, v in own]), np.array([h[i] for i, _ in own])
    k, models, balanced = cl.fuzzy_choice(df, range(3, 6))
    scores = {}
    for of, model in models.items():
        c = numpy_fuzzy(x, hashes, of)
        assert np.allclose(model.centers, c, atol=1e-4)
        label = ((x[:, None] - model.centers) ** 2).sum(-1).argmin(1)
        sizes = np.bincount(label, minlength=of)
        assert model.sizes.tolist() == sizes.tolist() and model.silhouette == pytest.approx(silhouette(x, label))
        scores[of] = sizes.max() <= 0.55 * len(x) and sizes.min() >= 0.03 * len(x), model.silhouette
    good = [of for of in scores if scores[of][0]] or list(scores)
    assert k == max(good, key=lambda of: scores[of][1]) == 3 and balanced
    u = df.select(cl.fuzzy_membership(F.col("x"), models[3].centers).alias("u")).collect()
    assert all(abs(sum(r.u) - 1) < 1e-9 for r in u)


def test_unbalanced_everywhere_takes_the_best_silhouette(spark):
    df = spark.createDataFrame([(k, [float(k % 3) / 100 if k < 290 else 9.0 + k % 2]) for k in range(300)], "customer_id long, x array<double>")
    k, models, balanced = cl.fuzzy_choice(df, range(3, 5), largest=0.2)
    assert not balanced and k == max(models.values(), key=lambda m: m.silhouette).k


def tree(spark, rows, **options):
    df = spark.createDataFrame(rows, "customer_id long, label int, x array<double>").repartition(4)
    got, nodes = cl.subdivide(df, "label", **options)
    return {r.customer_id: r.path for r in got.collect()}, {n["path"]: n for n in nodes}


def test_splits_by_reason_and_gain(spark):
    """Segments that hide groups are split, however many at once; tight, small and shapeless ones are not."""
    rng = np.random.default_rng(1)
    parts = {0: [((0, 0), 150), ((8, 8), 150)], 1: [((50, 0), 200), ((53, 0), 150), ((50, 30), 90)], 2: [((99, 99), 200)], 3: [((-40, 0), 40), ((-60, 0), 40)]}
    rows, truth = [], {}
    for label, groups in parts.items():
        for g, (mean, n) in enumerate(groups):
            for x in np.array(mean) + rng.uniform(-0.5, 0.5, (n, 2)):  # no row far beyond the others
                truth[len(rows)] = (label, g)
                rows.append((len(rows), label, x.tolist()))
    got, nodes = tree(spark, rows, ks=(2,))
    assert nodes["root.0"]["split"] and nodes["root.1"]["split"] and not nodes["root.2"]["split"] and not nodes["root.3"]["split"]
    assert nodes["root.3"]["reasons"] == "" and nodes["root.3"]["rows"] == 80  # wide but too small to split
    by_path = {}
    for i, path in got.items():
        by_path.setdefault(path, set()).add(truth[i])
    assert all(len(v) == 1 or path == "root.3" for path, v in by_path.items())
    assert {p for p in by_path if p.startswith("root.1")} == {"root.1.0", "root.1.1.0", "root.1.1.1"} and by_path["root.1.0"] == {(1, 2)}
    for path, node in nodes.items():
        x = np.array([v for i, _, v in rows if (got[i] + ".").startswith(path + ".")])
        d = np.sqrt(((x - x.mean(0)) ** 2).sum(1))
        assert node["rows"] == len(x) and node["variance"] == pytest.approx((d**2).mean())
        if node["p95"] is not None:
            assert node["p95"] == pytest.approx(np.quantile(d, 0.95)) and node["farthest"] == pytest.approx(d.max())
            assert ("distance" in node["reasons"]) == (d.max() > 1.5 * np.quantile(d, 0.95)) and ("variance" in node["reasons"]) == ((d**2).mean() > 2)


def test_floor_gain_depth_and_share(spark):
    rng = np.random.default_rng(6)
    far = [(k, 0, [float(v)]) for k, v in enumerate(np.concatenate([rng.normal(0, 0.1, 290), rng.normal(40, 0.1, 10)]))]
    got, nodes = tree(spark, far, ks=(2,))
    assert set(got.values()) == {"root.0"} and "distance" in nodes["root.0"]["reasons"]  # one part would have 10 rows
    got, _ = tree(spark, far, ks=(2,), floor=10)
    assert len(set(got.values())) >= 2
    flat = [(k, 0, [float(k)]) for k in range(400)]
    assert set(tree(spark, flat, ks=(2,), gain=0.95)[0].values()) == {"root.0"}
    assert {p.count(".") for p in tree(spark, flat, ks=(2,), depth=1)[0].values()} == {2}
    one = [(k, 0, [float(v)]) for k, v in enumerate(rng.uniform(0, 0.5, 200))]
    assert tree(spark, one, ks=(2,))[1]["root.0"]["reasons"] == "share"


def test_empty_and_single(spark):
    assert tree(spark, []) == ({}, {})
    got, nodes = tree(spark, [(1, 0, [1.0])])
    assert got == {1: "root.0"} and nodes["root.0"]["rows"] == 1
