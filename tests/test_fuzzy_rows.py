"""CLU-11 against plain numpy: centres fitted on the customers with orders, memberships of all customers."""

from datetime import datetime

import numpy as np
import pytest
from patronage.plans import clustering as cl

STARTS = ((-1.0, -1.0, -1.0), (0.0, 0.0, 0.0), (1.0, 1.0, 1.0))


def soft(x, c):
    near = 1 / np.maximum(((x[:, None] - c) ** 2).sum(-1), 1e-20)
    return near / near.sum(1, keepdims=True)


def numpy_centers(x, c, rounds=150, tolerance=1e-5):
    u = soft(x, c)
    for _ in range(rounds):
        c = (u**2).T @ x / (u**2).sum(0)[:, None]
        shift, u = np.linalg.norm(soft(x, c) - u), soft(x, c)
        if shift < tolerance:
            break
    return c[np.lexsort(c.T[::-1])]


def write_tables(spark, folder, customers, orders):
    """Orders are (order, customer, total), of one or two lines each."""
    day = datetime(2000, 1, 1)
    spark.createDataFrame([(k, 0.0) for k in customers], "c_custkey long, c_acctbal double").selectExpr("c_custkey", "'n' AS c_name", "0 AS c_nationkey", "c_acctbal", "'s' AS c_mktsegment").write.parquet(f"{folder}/customer.parquet")
    spark.createDataFrame([(o, c, "O", v, day, "1-URGENT") for o, c, v in orders], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{folder}/orders.parquet")
    lines = [(o, n) for o, *_ in orders for n in range(1 + o % 2)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int").selectExpr("*", "1L AS l_partkey", "1L AS l_suppkey", "1.0D AS l_quantity", "9.0D AS l_extendedprice", "0.0D AS l_discount", "'N' AS l_returnflag", "timestamp '2000-01-02' AS l_shipdate").write.parquet(f"{folder}/lineitem.parquet")


def memberships(spark, folder):
    from patronage import catalog

    return {r[0]: r[1:] for r in catalog.queries()["CLU-11"](spark, str(folder)).collect()}


def test_fit_and_new_rows_equal_numpy(spark, tmp_path):
    rng = np.random.default_rng(2)
    # Customers 1 to 60 have orders of three levels, 61 to 64 none, and 99 has orders but no row of its own.
    orders = [(100 * c + i, c, float(rng.normal((100, 500, 2000)[c % 3], 40))) for c in (*range(1, 61), 99) for i in range(1 + c % 4)]
    # Prices that are missing or not finite change nothing.
    bad = [(9000 + k, k, v) for k, v in ((1, float("nan")), (2, float("inf")), (3, None), (3, float("-inf")))]
    write_tables(spark, tmp_path, range(1, 65), orders + [(o + i, c, v) for i, (o, c, v) in enumerate(bad)])
    got = memberships(spark, tmp_path)
    of = {c: [v for _, k, v in orders if k == c] for c in (*range(1, 65), 99)}
    known = np.array([(sum(v), np.mean(v), max(v)) for v in of.values() if v])
    low, high = np.quantile(known, (0.01, 0.99), axis=0)
    a, b, c = np.quantile(np.clip(known, low, high), (0.25, 0.5, 0.75), axis=0)
    scaled = lambda x: (np.clip(x, low, high) - b) / (c - a)
    centers = numpy_centers(scaled(known), np.array(STARTS))
    every = np.array([(sum(v), np.mean(v), max(v)) if v else (0.0, 0.0, 0.0) for v in of.values()])
    assert sorted(got) == sorted(of)
    want = soft(scaled(every), centers)
    for k, w in zip(of, want, strict=True):
        assert len(got[k]) == 3 and got[k] == pytest.approx(w, abs=2e-6) and sum(got[k]) == pytest.approx(1, abs=2e-6)


def test_without_orders_nothing_is_fitted(spark, tmp_path):
    write_tables(spark, tmp_path, range(3), [])
    assert memberships(spark, tmp_path) == {k: (None, None, None) for k in range(3)}


def test_customers_that_are_all_alike(spark, tmp_path):
    write_tables(spark, tmp_path, range(5), [(k, k, 7.0) for k in range(4)])
    got = memberships(spark, tmp_path)
    assert len(got) == 5 and all(sum(u) == pytest.approx(1, abs=2e-6) for u in got.values())


def test_centers_from_given_starts(spark):
    x = np.concatenate([np.random.default_rng(s).normal(m, 0.3, (40, 2)) for s, m in enumerate(((0, 0), (6, 0), (0, 6)))])
    starts = np.array([[-1.0, -1.0], [1.0, 0.0], [0.0, 1.0]])
    points = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "customer_id long, x array<double>")
    once, again = cl.fuzzy_centers(points.repartition(5), starts), cl.fuzzy_centers(points.repartition(2), starts)
    assert np.allclose(once, numpy_centers(x, starts), atol=1e-9) and np.allclose(once, again, atol=1e-9)
    assert cl.fuzzy_centers(points.where("false"), starts) is None
