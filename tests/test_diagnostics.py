"""Support axes and clustering diagnostics against plain Python and on odd tables."""

import random
from datetime import datetime, timezone

import numpy as np
from patronage.operators import support
from patronage.plans import diagnostics as dg
from pyspark.sql import functions as F


def points(spark, rows):
    return spark.createDataFrame(rows, "customer_id long, x array<double>, cluster int")


def test_silhouette_matches_all_pairs(spark):
    rng = random.Random(2)
    rows = [(k, [rng.gauss(3 * (k % 3), 1), rng.gauss(0, 1)], k % 3) for k in range(60)] + [(99, [50.0, 50.0], 7)]
    got = {r.customer_id: r.silhouette for r in dg.silhouette_exact(points(spark, rows), "cluster").collect()}
    for i, x, c in rows:
        mean = {d: [np.linalg.norm(np.subtract(x, y)) for j, y, e in rows if e == d and j != i] for d in {r[2] for r in rows}}
        if not mean[c]:
            assert got[i] == 0
            continue
        a, b = np.mean(mean[c]), min(np.mean(v) for d, v in mean.items() if d != c)
        assert abs(got[i] - (b - a) / max(a, b)) < 1e-9
    assert {r.silhouette for r in dg.silhouette_exact(points(spark, rows[:1] + rows[3:4]), "cluster").collect()} == {0.0}
    assert dg.silhouette_exact(points(spark, []), "cluster").collect() == []


def test_diverse_spreads_and_repeats(spark):
    rows = [(k, [0.001 * (k % 50), 0.0], 0) for k in range(2000)] + [(3000 + k, [100.0 * k, 5.0], 0) for k in range(1, 11)]
    p = points(spark, rows)
    got = {r.customer_id for r in dg.diverse(p, 40).collect()}
    assert len(got) == 40 and len({i for i in got if i > 3000}) >= 8
    assert got == {r.customer_id for r in dg.diverse(p.repartition(7), 40).collect()}
    assert len(dg.diverse(points(spark, [(k, [1.0, 1.0], 0) for k in range(9)]), 5).collect()) == 1
    assert dg.diverse(points(spark, []), 5).collect() == []


def test_recluster_leaves_large_segments(spark):
    rows = [(k, [float(k)], 0) for k in range(10)] + [(100 + k, [float(k)], 1) for k in range(50)]
    got = {r.customer_id: r["sub"] for r in dg.recluster(points(spark, rows), "cluster", lambda x: x[:, 0] >= 5, most=20).collect()}
    assert {got[k] for k in range(5)} == {0} and {got[k] for k in range(5, 10)} == {1}
    assert {got[100 + k] for k in range(50)} == {-1}


def test_kernel_matches_columns(spark):
    centers = np.array([[0.0, 0.0], [3.0, 4.0]])
    df = points(spark, [(1, [0.0, 0.0], 0), (2, [3.0, 4.0], 0), (3, [900.0, 900.0], 0)])
    got = {r.customer_id: r.m for r in df.select("customer_id", dg.membership_kernel(centers)("x").alias("m")).collect()}
    assert abs(got[1][0] - 1 / (1 + np.exp(-5))) < 1e-12 and abs(sum(got[3]) - 1) < 1e-12
    assert df.where("customer_id = 2").select(dg.l2(F.col("x"), F.array(F.lit(0.0), F.lit(0.0)))).first()[0] == 5.0


def test_summary_report_and_log(spark, tmp_path):
    one = dg.k_summary(spark.createDataFrame([("a", 2, 1.0), ("b", 8, 0.3)], "axis string, k int, confidence double")).first()
    assert (one.axes, one.mean_k, one.low_confidence, one.high_k) == (2, 5.0, "b", "b")
    rows = [("a", "p", 0.9)] * 6 + [("a", "q", 0.7)] * 6 + [("b", "p", 0.4)] * 9 + [("b", "q", 0.4)]
    got = {r.axis: r for r in dg.quality_report(spark.createDataFrame(rows, "axis string, segment string, score double")).collect()}
    assert got["a"].passes and abs(got["a"].mean_purity - 0.8) < 1e-9 and not got["b"].balanced and not got["b"].descriptive
    for k in range(2):
        dg.log_run(spark, str(tmp_path / "log"), f"r{k}", "s", 1, 2, [("a", 3, 0.5), ("b", 2, 0.1)] if k else [], datetime.now(timezone.utc))
    log = {r.run_id: r for r in spark.read.parquet(str(tmp_path / "log")).collect()}
    assert log["r1"].total_segments == 5 and abs(log["r1"].avg_silhouette - 0.3) < 1e-9 and log["r0"].avg_silhouette is None


def test_distinctive(spark):
    rows = [("a", s, f, v) for s, vs in {"p": (1, 5), "q": (2, 5), "r": (9, 5)}.items() for f, v in zip(("x", "y"), map(float, vs), strict=True)]
    got = dg.distinctive(spark.createDataFrame(rows, "axis string, segment string, feature string, value double")).collect()
    assert {(r.segment, r.feature, r.direction) for r in got} == {("p", "x", "low"), ("q", "x", "low"), ("r", "x", "high")}


def test_support_history_on_odd_tickets(spark):
    tickets = spark.createDataFrame([(1, 7, "urgent", 0.1), (2, 7, None, None), (3, None, "low", 0.9), (4, 8, "low", 0.9)], "ticket_id long, customer_id long, priority string, sentiment double")
    messages = spark.createDataFrame([(1, 0, False, "I want a refund please"), (1, 1, True, "sure"), (1, 2, False, "thanks"), (2, 0, False, None), (4, 0, True, "only us")], "ticket_id long, message_no int, from_agent boolean, content string")
    orders = spark.createDataFrame([(7, 4)], "customer_id long, total_orders long")
    got = {r.customer_id: r for r in support.support_history(tickets, messages, orders).collect()}
    seven = got[7]
    assert (seven.tickets, seven.tickets_per_order, seven.return_rate, seven.complaint_rate, seven.follow_up_rate) == (2, 0.5, 0.5, 1.0, 0.5)
    assert got[8].message_length_avg is None and got[8].tickets_per_order is None and got[None].tickets == 1
    assert support.support_history(tickets.where("false"), messages, orders).collect() == []


def test_support_variants(spark):
    at = lambda d, h: datetime(2024, 1, d, h)
    orders = spark.createDataFrame([(1, 10, at(1, 9), 5.0, "web"), (1, 11, at(3, 14), 6.0, "shopify_draft_order"), (1, 12, at(5, 18), 7.0, "web"), (2, 13, at(2, 20), 1.0, None)], "customer_id long, order_id long, order_date timestamp_ntz, total_price double, source string")
    items = spark.createDataFrame([(1, "a", 2.0), (1, "b", 0.0)], "customer_id long, category string, refund_amount double")
    got = {r.customer_id: r for r in support.support_variants(orders, items, datetime(2024, 1, 31)).collect()}
    assert (got[1].value_trend, got[1].recency_momentum, got[1].expected_next_purchase_days, got[1].preferred_contact_time) == (1, 0, 2, "morning")
    assert (got[2].expected_next_purchase_days, got[2].preferred_contact_time, got[2].return_frequency) == (365, "evening", 0.0)


def test_large_segments_split_as_small_ones(spark):
    """UDF-5 gives the same labels whether a segment fits a task or not; ties and even counts included."""
    from unittest import mock

    from patronage.queries import diagnostics as dq

    rows = spark.range(101).selectExpr("id AS customer_id", "map('purchase_value', concat('s', id % 3)) AS dominant_segments", "CAST(id * 37 % 23 AS double) AS lifetime_value")
    with mock.patch.object(dq, "profiles_of", lambda t: rows):
        want = sorted(map(tuple, dq.udf_5(None).collect()))
        whole = dg.recluster
        with mock.patch.object(dg, "recluster", lambda *a, **b: whole(*a, most=33, **b)):
            got = sorted(map(tuple, dq.udf_5(None).collect()))
    assert got == want and len(want) == 6
