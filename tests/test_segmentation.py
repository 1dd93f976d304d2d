"""The segmentation run: invariants of the fit, scores against plain Python, a run written and read again."""

import math

import numpy as np
from patronage.operators import axes
from patronage.plans import segmentation as sg
from patronage.queries.axes import wide_of
from patronage.sources.tables import Tables
from tests.conftest import SMALL


def test_fit_finds_separate_groups():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(m, 0.1, (n, 6)) for m, n in (((0,) * 6, 150), ((5,) * 6, 90), ((0, 5, 0, 5, 0, 5), 60))])
    rows = sg.fit_axis("purchase_value", x)
    assert [r[5] for r in rows] == [3, 3, 3] and rows[0][6] > 0.9
    assert len(sg.fit_axis("purchase_value", x[:80])) == 1  # fewer than the least population: one segment
    assert len(sg.fit_axis("purchase_value", np.ones((300, 6)))) == 1
    assert [sg.most_k(n) for n in (60, 150, 400, 10_000)] == [1, 3, 6, 6]


def test_silhouette_by_definition():
    rng = np.random.default_rng(0)
    x, label = rng.random((40, 3)), rng.integers(0, 3, 40)
    far = lambda a, b: math.dist(a, b)
    want = []
    for k in range(40):
        mean = {c: np.mean([far(x[k], x[j]) for j in range(40) if j != k and label[j] == c]) for c in set(label)}
        inner, outer = mean[label[k]], min(v for c, v in mean.items() if c != label[k])
        want.append((outer - inner) / max(inner, outer))
    assert np.isclose(sg.silhouette(x, label), np.mean(want))


def test_run_is_written_and_scores_follow_the_table(spark, tmp_path):
    features = axes.flatten(wide_of(Tables(spark, SMALL)))
    run = sg.run(features, str(tmp_path / "run"), size=120)
    segments = run["segments"].collect()
    n = run["features"].count()
    assert {r["axis"] for r in segments} == set(axes.AXES) and run["profiles"].count() == n
    for a in axes.AXES:
        own = [r for r in segments if r["axis"] == a]
        assert sum(r["customer_count"] for r in own) == n and abs(sum(r["population_pct"] for r in own) - 100) < 1e-9 and {r["k"] for r in own} == {len(own)}
    table = {r["customer_id"]: r for r in run["features"].collect()}
    for p in run["profiles"].limit(20).collect():
        for a in axes.AXES:
            own = [r for r in segments if r["axis"] == a]
            s = own[0]["scaler"]
            z = [(table[p["customer_id"]][c] - m) / v for c, m, v in zip(sg.columns_of(a), s["center"], s["scale"], strict=True)]
            d = {r["segment"]: math.dist(z, r["center"]) for r in own}
            least = min(d.values())
            total = sum(math.exp(least - v) for v in d.values())
            got = p["memberships"][a]
            assert all(abs(got[k] - math.exp(least - v) / total) < 1e-9 for k, v in d.items())
            assert d[p["dominant"][a]] <= least + 1e-9
    groups = run["archetypes"].collect()
    assert all(sum(g["members"] for g in groups if g["level"] == k) == n for k in (1, 2, 3))
    assert run["runs"].count() == 1


def test_outliers_need_axes_and_mean(spark):
    one = lambda *v: {f"s{k}": x for k, x in enumerate(v)}
    rows = [(1, {"a": one(0.8, 0.2), "b": one(0.7, 0.3), "c": one(0.9, 0.1)}), (2, {"a": one(0.1, 0.1), "b": one(0.05, 0.1), "c": one(0.9, 0.1)}), (3, {"a": one(0.1, 0.1), "b": one(0.8, 0.2), "c": one(0.9, 0.1)})]
    df = spark.createDataFrame(rows, "id int, m map<string,map<string,double>>")
    got = {r.id: r.o for r in df.select("id", sg.outliers(df["m"]).alias("o")).collect()}
    assert (got[1]["outlier"], got[2]["outlier"], got[3]["outlier"]) == (False, True, False)
    assert got[2]["flagged"] == ["a", "b"] and abs(got[2]["mean"] - 2 / 3) < 1e-9
