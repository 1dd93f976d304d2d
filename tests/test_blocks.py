"""Points in blocks, and a step of many models at once against one model at a time (CLU-4, CLU-8)."""

import numpy as np
import pytest
from patronage.plans import many
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(4)
    # A group of three values on a line, of which many lie just between two centres, one far from the origin, and one without a name.
    x = [("line", [float(v), 0.0]) for v in rng.integers(0, 3, 500)] + [("far", (1e5 + rng.normal(0, 1, 3)).tolist()) for _ in range(2500)] + [(None, [1.0])] * 7
    df = spark.createDataFrame([(k, g, v) for k, (g, v) in enumerate(x)], "customer_id long, g string, x array<double>")
    return many.stash_points(df.repartition(3), "g"), x


def test_blocks_hold_all_rows(points):
    stored, x = points
    blocks = many.packed(stored)
    rows = blocks.collect()
    got = sorted((r["group"] or "", *v) for r in rows for v in np.frombuffer(r["x"]).reshape(r["n"], -1).tolist())
    assert got == sorted((g or "", *v) for g, v in x)
    assert len(rows) <= 9 and max(r["n"] for r in rows) <= many.STEP_ROWS
    assert sorted(h for r in rows for h in np.frombuffer(r["h"], np.int64).tolist()) == sorted(r["h"] for r in stored.select("h").collect())


def test_step_of_many_equals_one_by_one(points):
    stored, _ = points
    model = lambda g, c: many.Model(g, len(c), 1, np.array(c, float))
    models = [
        model("line", [[0.5, 0], [1.5, 0]]), model("line", [[2, 0], [0, 0]]), model("line", [[0, 0], [0, 0], [2, 0]]), model("line", [[9, 9], [1, 0], [1, 1]]),
        model("far", [[1e5 - 1] * 3, [1e5 + 1] * 3]), model("far", [[1e5, 1e5, 1e5 - 2], [1e5, 1e5, 1e5 + 2]]), model(None, [[0.0], [2.0]]), model("nobody", [[0.0]]),
    ]
    want = many.sums_by_centre(stored, models, 6, many._lloyd)
    for rows in (stored, many.packed(stored)):
        got = many._step(rows, models, 3)
        assert sorted(got) == sorted(want) == list(range(7))
        for m in want:
            assert np.allclose(got[m], want[m], rtol=1e-12, atol=1e-7)


def test_fit_reads_blocks_only(spark, points, monkeypatch):
    stored, _ = points
    seen = []
    step = many._step
    monkeypatch.setattr(many, "_step", lambda rows, models, d: seen.append(rows.columns) or step(rows, models, d))
    found = many.kmeans_many(stored, {"line": [2, 3], "far": [2]}, restarts=3)
    assert seen and all(c == ["group", "n", "h", "x"] for c in seen)
    assert found["line", 3].inertia == pytest.approx(0, abs=1e-9) and found["line", 3].silhouette == pytest.approx(1)
    assert stored.where(F.col("group") == "far").count() == found["far", 2].sizes.sum()
