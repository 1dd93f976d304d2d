"""Hand-made edge cases of the customer operators."""

from datetime import datetime

import pytest
from patronage.operators import axes, cleaning, membership, scoring, tickets
from patronage.operators.events import sessions
from patronage.plans import clustering
from patronage.sources import landing
from pyspark.sql import functions as F

D = datetime


@pytest.fixture(scope="module")
def orders(spark):
    rows = [
        (1, 10, D(2024, 1, 1), 100.0, 0.0, "web"),
        (2, 20, D(2024, 1, 1), 50.0, 5.0, "pos"), (2, 21, D(2024, 1, 31), 70.0, 0.0, "web"),
        (3, 30, D(2024, 2, 3, 17), 10.0, 0.0, "web"), (3, 31, D(2024, 2, 3, 17), 20.0, 0.0, "web"), (3, 32, D(2024, 2, 4, 9), 30.0, 0.0, None),
    ]
    return spark.createDataFrame(rows, "customer_id long, order_id long, order_date timestamp_ntz, total_price double, discount_amount double, source string")


def test_axes_of_few_orders(orders):
    got = {r.customer_id: r for r in axes.order_features(orders, D(2024, 3, 1)).collect()}
    assert got[1].purchase_consistency == 1.0 and got[1].value_consistency is None and got[1].churn_risk_score is None
    assert got[1].avg_days_between_orders == 60.0 and got[1].channel_switching_rate == 0.0
    assert got[2].purchase_consistency is None and got[2].avg_days_between_orders == 30.0 and got[2].channel_switching_rate == 0.5
    assert got[2].churn_risk_score == pytest.approx(30 / 60)
    assert got[3].churn_risk_score == 1.0 and got[3].weekend_vs_weekday_ratio == 3.0  # no weekday order: divided by 1
    assert got[3].preferred_time_numeric == 0  # hour 17 counts as afternoon and as evening, so neither is ahead


def test_one_shuffle_of_orders_for_all_order_features(orders):
    plan = axes.order_features(orders, D(2024, 3, 1))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 3


def test_numbers_are_cleaned(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (float("inf"),), (float("-inf"),)], "x double")
    assert [r.x for r in df.select(cleaning.nan_to_zero(F.col("x")).alias("x")).collect()] == [1.0, 0.0, 0.0, 1e10, -1e10]
    odd = spark.createDataFrame([(1.0, None), (3.0, None), (None, None)], "x double, y double")
    assert sorted(tuple(r) for r in cleaning.nan_to_mean(odd, ["x", "y"]).collect()) == [(1.0, 0.0), (2.0, 0.0), (3.0, 0.0)]


def test_memberships_sum_to_one_and_match_the_example(spark):
    d = spark.createDataFrame([({"a": 0.5, "b": 2.0, "c": 3.5},), ({"a": 1e6, "b": 1e6, "c": 2e6},)], "d map<string,double>")
    got = [r.m for r in d.select(membership.memberships(F.col("d")).alias("m")).collect()]
    assert [round(got[0][k], 3) for k in "abc"] == [0.786, 0.175, 0.039]
    assert all(abs(sum(m.values()) - 1) < 1e-12 for m in got) and got[1]["a"] == 0.5


def test_drift_example(spark):
    df = spark.createDataFrame([({"a": 0.920, "b": 0.065, "c": 0.015}, {"a": 0.786, "b": 0.175, "c": 0.039}), ({"a": 1.0}, {"b": 1.0})], "o map<string,double>, n map<string,double>")
    got = [r.d for r in df.select(membership.drift(F.col("o"), F.col("n")).alias("d")).collect()]
    assert got[0] * 2**0.5 == pytest.approx(0.175, abs=0.001) and got[1] == pytest.approx(1.0)


def test_zero_spread_divides_by_one(spark):
    s = membership.fit_scaler(spark.createDataFrame([(1.0, 5.0), (2.0, 5.0)], "a double, b double"), ("a", "b"), "robust")
    assert s.scale[1] == 1.0


def test_session_gap_of_exactly_half_an_hour_merges(spark):
    rows = [(1, 7, D(2024, 1, 1, 0, 0), "x"), (2, 7, D(2024, 1, 1, 0, 30), "x"), (3, 7, D(2024, 1, 1, 1, 0, 1), "x")]
    got = sorted((r.events, r.minutes) for r in sessions(spark.createDataFrame(rows, "event_id long, entity long, ts timestamp_ntz, event_type string")).collect())
    assert got == [(1, 1.0), (2, 30.0)]


def test_cold_start_rules(spark):
    df = spark.createDataFrame([(1, 3, 14, 90.0, 5), (2, 15, 180, 2000.0, 40)], "customer_id long, total_orders long, tenure_days int, lifetime_value double, days_since_last_purchase int")
    got = {r.customer_id: r for r in scoring.cold_start(df).collect()}
    assert (got[1].lifecycle_stage, got[1].sufficiency) == ("warming_up", "minimal")
    assert (got[2].lifecycle_stage, got[2].sufficiency, got[2].days_to_mature) == ("mature", "rich", 0)


def test_smart_score_order(spark):
    now = D(2024, 1, 2)
    rows = [(1, 0.85, 3500.0, "urgent", D(2024, 1, 1, 19), 0.1, "x"), (2, 0.15, 450.0, "normal", D(2024, 1, 1, 23), 0.7, "x"), (3, 0.75, 5200.0, "urgent", D(2024, 1, 1), 0.2, "x"), (4, None, None, "urgent", D(2024, 1, 1), 0.1, "x")]
    df = spark.createDataFrame(rows, "ticket_id long, churn double, ltv double, priority string, created_at timestamp_ntz, sentiment double, last string")
    got = {r.ticket_id: r.score for r in tickets.score_tickets(df, now).collect()}
    assert got[1] == pytest.approx(2.55 + 7.0 + 6.0 + 0.2 + 2.0) and got[4] == 0.0 and got[3] > got[2]


def test_upsert_keeps_what_it_should(spark):
    base = spark.createDataFrame([(1, "a", 5), (2, "b", 5)], "id long, v string, at long")
    new = spark.createDataFrame([(2, "c", 6), (2, "d", 7), (3, "e", 1)], "id long, v string, at long")
    got = sorted(tuple(r) for r in landing.upsert(base, new, ["id"], "at").collect())
    assert got == [(1, "a", 5), (2, "d", 7), (3, "e", 1)]


def test_vote_of_k():
    s = [{"k": k, "silhouette": v, "inertia": i, "calinski_harabasz": c, "balance": b} for k, v, i, c, b in [(2, 0.5, 100, 50, 0.4), (3, 0.6, 40, 90, 0.1), (4, 0.4, 35, 70, 0.5)]]
    assert clustering.vote(s) == (3, 1.0)
