"""Exact quantiles against numpy, on few and many rows, in one and in many ranges, for columns and groups."""

from unittest import mock

import numpy as np
import pandas as pd
import pytest
from patronage.operators import quantiles as qs
from pyspark.sql import functions as F

SHARES = (0.0, 0.01, 0.25, 0.5, 0.8, 0.95, 1.0)


def table(n):
    rng = np.random.default_rng(n)
    df = pd.DataFrame({"id": range(n), "a": rng.normal(0, 9, n), "b": np.round(rng.exponential(2, n), 1), "c": np.where(np.arange(n) % 3 < 2, 7.0, rng.random(n)), "g": rng.choice(["x", "y", "z"], n, p=[0.7, 0.29, 0.01])})
    df.loc[df.index % 11 == 0, "a"] = np.nan
    return df


@pytest.mark.parametrize("n,large", [(1, False), (2, False), (700, False), (30_000, False), (30_000, True)])
def test_columns_match_numpy(spark, n, large):
    df = table(n)
    with mock.patch.object(qs, "RANGE_ROWS", 10 if large else qs.RANGE_ROWS), mock.patch.object(qs, "RANGES", 7):
        got = qs.quantiles(spark.createDataFrame(df).repartition(5), [F.col(c) for c in "abc"], SHARES)
    for c, have in zip("abc", got, strict=True):
        v = df[c].dropna()
        assert have == pytest.approx(list(np.quantile(v, SHARES)) if len(v) else [0.0] * len(SHARES))


@pytest.mark.parametrize("large", [False, True])
def test_groups_match_numpy(spark, large):
    df = table(20_000)
    with mock.patch.object(qs, "RANGE_ROWS", 10 if large else qs.RANGE_ROWS), mock.patch.object(qs, "RANGES", 5):
        got = qs.quantiles_by(spark.createDataFrame(df).withColumn("g", F.when(F.col("g") != "z", F.col("g"))), "g", F.col("b"), SHARES)
    assert set(got) == {"x", "y", None}
    for g, have in got.items():
        assert have == pytest.approx(list(np.quantile(df[df["g"] == (g or "z")]["b"], SHARES)))


def test_no_rows(spark):
    empty = spark.createDataFrame([], "g string, v double")
    assert qs.quantiles(empty, [F.col("v")], (0.1, 0.9)) == [[0.0, 0.0]]
    assert qs.quantiles_by(empty, "g", F.col("v"), (0.5,)) == {}
    nulls = spark.createDataFrame([("a", None), ("a", float("nan"))], "g string, v double")
    assert qs.quantiles(nulls, [F.col("v")], (0.5,)) == [[0.0]]


def test_equals_sql(spark):
    """The same numbers as Spark's own exact percentile, whose state grows with the values."""
    df = spark.createDataFrame(table(9_000))
    want = df.agg(F.percentile("b", F.array(*[F.lit(s) for s in SHARES])).alias("p")).first()["p"]
    assert qs.quantiles(df, [F.col("b")], SHARES)[0] == pytest.approx(want)
