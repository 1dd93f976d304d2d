"""Shares that only rounding sets apart are ties, told by name (ARC-1)."""

import pytest
from patronage.operators import membership as mem
from pyspark.sql import functions as F

NAMES = ("low", "middle", "high")


@pytest.mark.parametrize("noise", [0.0, 3e-14, -3e-14])
def test_noise_orders_nothing(spark, noise):
    d = {"low": 1.5 + noise, "middle": 1.0, "high": 1.5}
    rows = spark.createDataFrame([(d,)], "d map<string,double>")
    top = rows.select(mem.ranked(mem.memberships(F.col("d"))).alias("t")).first()["t"]
    assert [x["segment"] for x in top] == ["middle", "high", "low"]
    assert sum(x["score"] for x in top) == pytest.approx(1.0, abs=1e-12)


def test_real_differences_and_missing_shares(spark):
    shares = [{"a": 0.2, "b": 0.5, "c": 0.3}, {"a": 0.3, "b": 0.3 + 1e-6, "c": 0.4}, {"b": 1.0, "a": float("nan")}, {}]
    rows = spark.createDataFrame([(k, m) for k, m in enumerate(shares)], "k int, m map<string,double>")
    got = {r["k"]: [x["segment"] for x in r["t"]] for r in rows.select("k", mem.ranked(F.col("m")).alias("t")).collect()}
    assert got == {0: ["b", "c", "a"], 1: ["c", "b", "a"], 2: ["b", "a"], 3: []}
