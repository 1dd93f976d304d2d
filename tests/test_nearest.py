"""Nearest dates, thirds of event logs, shares and names of segments: against plain Python."""

import math
import random
import statistics
from collections import Counter, defaultdict
from datetime import date, datetime, timedelta

import pytest
from patronage.operators import events as ev
from patronage.operators import joins
from patronage.plans import segmentation


def test_nearest_date_of_the_same_customer(spark):
    rng = random.Random(2)
    day = lambda: None if rng.random() < 0.05 else date(2024, 1, 1) + timedelta(days=rng.randint(0, 40))
    who = lambda: rng.choice([None, 1, 1, 1, 2, 3, 4])
    a = [(who(), day(), f"a{k}") for k in range(120)]
    a += a[:5]  # repeated rows stay
    b = [(who(), day(), k) for k in range(60)]
    got = joins.nearest_by_date(spark.createDataFrame(a, "customer_id int, day date, name string"), spark.createDataFrame(b, "customer_id int, day date, order_id int"), days=2)
    assert got.columns == ["customer_id", "day", "name", "other_order_id", "other_day", "days_apart"]

    def best(c, d):
        near = [(abs((x - d).days), x, k) for o, x, k in b if c is not None and d is not None and x is not None and o == c and abs((x - d).days) <= 2]
        return min(near, default=(None, None, None))

    want = [(c, d, n, best(c, d)[2], best(c, d)[1], best(c, d)[0]) for c, d, n in a]
    assert Counter(tuple(r) for r in got.collect()) == Counter(want)
    empty = got.sparkSession.createDataFrame([], "customer_id int, day date, order_id int")
    assert joins.nearest_by_date(spark.createDataFrame(a, "customer_id int, day date, name string"), empty).where("other_order_id IS NOT NULL").count() == 0


def test_nearest_date_never_pairs_a_crowd(spark):
    crowd = spark.createDataFrame([(1, date(2024, 1, 1), k) for k in range(400)], "customer_id int, day date, order_id int")
    d = joins.nearest_by_date(crowd, crowd, days=1)
    assert d.count() == 400 and {r.other_order_id for r in d.collect()} == {0}


def plain_volatility(events, gap=30):
    """All figures of one entity's (ts, type) rows in order."""
    spans = []
    for ts, _ in events:
        if spans and (ts - spans[-1][1]).total_seconds() <= gap * 60:
            spans[-1][1] = ts
        else:
            spans.append([ts, ts])
    minutes = [max(1.0, (b - a).total_seconds() / 60) for a, b in spans]
    gaps = [(spans[k][0] - spans[k - 1][1]).total_seconds() / 3600 for k in range(1, len(spans))]
    length_cv = statistics.stdev(minutes) / statistics.mean(minutes) if len(minutes) > 1 else 0.0
    gap_cv = statistics.stdev(gaps) / statistics.mean(gaps) if len(gaps) > 1 else 0.0
    third, moved = len(events) // 3, [0.0, 0.0]
    if third:
        parts = [Counter(t for _, t in p) for p in (events[:third], events[third : 2 * third], events[2 * third :])]
        dist = [{k: n / p.total() for k, n in p.items()} for p in parts]
        for k in (0, 1):
            p, q = dist[k], dist[k + 1]
            moved[k] = max(0.0, sum(p.get(t, 1e-10) * math.log2(p.get(t, 1e-10) / q.get(t, 1e-10)) for t in set(p) | set(q)))
    v = sum(moved) / 2
    return len(minutes), statistics.mean(minutes), length_cv, statistics.mean(gaps) if len(gaps) > 1 else 0.0, gap_cv, *moved, v, 1 / (1 + v), 1 / (1 + (length_cv + gap_cv + v) / 3)


def test_volatility_by_definition(spark):
    rng = random.Random(6)
    rows, per = [], defaultdict(list)
    for entity, n in ((1, 40), (2, 1), (3, 2), (4, 7), (5, 90), (6, 3)):
        ts = datetime(2024, 1, 1)
        for k in range(n):
            ts += timedelta(minutes=rng.choice([1, 5, 29, 30, 31, 600]))
            kind = rng.choice(["view", "view", "click", "login" if k > n / 2 else "error"])
            rows.append((len(rows), entity, ts, kind))
            per[entity].append((ts, kind))
    rng.shuffle(rows)
    d = ev.volatility(spark.createDataFrame(rows, "event_id long, entity int, ts timestamp_ntz, event_type string"))
    names = ("sessions", "session_length_mean", "session_length_cv", "session_gap_mean", "session_gap_cv", "kl_early", "kl_late", "event_distribution_volatility", "event_distribution_stability", "predictability")
    got = {r.entity: tuple(r[n] for n in names) for r in d.collect()}
    assert got.keys() == per.keys()
    for entity, events in per.items():
        assert got[entity] == pytest.approx(plain_volatility(events), abs=1e-9), entity


def test_shares_read_profiles_once(spark):
    d = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "signature string")
    out = segmentation.shares_of(d, "signature")
    assert {(r.signature, r.members, r.share) for r in out.collect()} == {("a", 2, 0.5), ("b", 1, 0.25), (None, 1, 0.25)}
    assert segmentation.shares_of(d.where("signature = 'z'"), "signature").count() == 0


def test_segments_in_the_units_of_their_features(spark):
    scaler = ("standard", [10.0, 1.0], [2.0, 0.5])
    rows = [("value", "value_0", [1.0, -2.0], ["value__spend", "value__rate"], scaler, 3, 0.5), ("value", "value_1", [-5.0, 0.0], ["value__spend", "value__rate"], scaler, 3, 0.5), ("value", "value_2", [-5.5, 0.0], ["value__spend", "value__rate"], scaler, 3, 0.5)]
    got = {r.segment: r for r in segmentation.described(spark.createDataFrame(rows, segmentation.SEGMENTS)).collect()}
    assert got["value_0"].center_original == [12.0, 0.0] and got["value_1"].center_original == [0.0, 1.0]
    assert [got[f"value_{k}"].name for k in range(3)] == ["high_value", "medium_value", "low_value"]
    assert got["value_2"].interpretation == "Customers with low spend"
