"""Volumes, forecasts, identities, the automated filter and drift horizons against plain Python."""

import math
import random
from collections import Counter
from datetime import date, datetime, timedelta

import pytest
from patronage.operators import events as ev
from patronage.operators import identities as ids
from patronage.operators import snapshots as sn
from patronage.operators import volumes as vo
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def tickets(spark):
    rng = random.Random(5)
    rows = [(k, datetime(2023, 12, 28) + timedelta(minutes=rng.randint(0, 60_000)), rng.choice(["email", "chat", None]), rng.choice(["high", "low"]), rng.choice(["a", "b", "c"]), rng.choice(["open", None])) for k in range(300)] + [(900, None, "email", "low", "a", "open")]
    return rows, spark.createDataFrame(rows, "ticket_id long, created_at timestamp_ntz, channel string, priority string, category string, status string").repartition(3)


def start(grain, t):
    day = datetime(t.year, t.month, t.day)
    return {"hour": day + timedelta(hours=t.hour), "day": day, "week": day - timedelta(days=day.weekday()), "month": day.replace(day=1)}[grain]


def test_cube_of_all_grains_from_one_scan(tickets):
    rows, df = tickets
    cube = vo.volume_cube(df, (date(2024, 1, 1),))
    got = {(r.granularity, r.period_start): r for r in cube.collect()}
    want = {(g, start(g, t[1])) for t in rows if t[1] for g in vo.GRAINS}
    assert set(got) == want
    for (g, p), r in got.items():
        own = [t for t in rows if t[1] and start(g, t[1]) == p]
        assert r.ticket_count == len(own)
        for i, d in enumerate(vo.DIMENSIONS, 2):
            assert r[f"tickets_by_{d}"] == dict(Counter(t[i] or "unknown" for t in own))
        end = {"hour": p + timedelta(hours=1), "day": p + timedelta(days=1), "week": p + timedelta(days=7), "month": datetime(p.year + p.month // 12, p.month % 12 + 1, 1)}[g]
        assert r.period_end == end and r.quarter == (p.month + 2) // 3 and r.week_of_year == p.isocalendar()[1]
        assert (r.day_of_week, r.hour_of_day) == (p.weekday() if g in ("hour", "day") else None, p.hour if g == "hour" else None)
        assert r.is_holiday == (g in ("hour", "day") and p.date() == date(2024, 1, 1)) and r.is_weekend == (g in ("hour", "day") and p.weekday() >= 5)
    plan = cube._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1


def test_forecasts_before_the_event(spark):
    at = lambda d, h=0: datetime(2024, 1, 1) + timedelta(days=d, hours=h)
    rows = [
        ("m", "s", at(40), at(39, 20), 10.0), ("m", "s", at(40), at(39, 22), 11.0), ("m", "s", at(40), at(40, 1), 99.0), ("m", "s", at(40), at(35), 14.0), ("m", "s", at(40), at(12), 16.0), ("m", "s", at(40), at(0), 20.0),
        ("m", "s", at(41), at(41), 5.0), ("m", "s", at(42), at(30), 7.0), ("m", "u", at(40), at(39), 1.0), ("n", "s", at(40), at(33), 13.0),
    ]
    f = spark.createDataFrame(rows, "model string, series string, period timestamp_ntz, made_at timestamp_ntz, predicted double")
    a = spark.createDataFrame([("s", at(40), 12), ("s", at(41), 0), ("s", at(42), 9), ("t", at(40), 3)], "series string, period timestamp_ntz, actual long")
    got = {(r.model, r.period, r.horizon): (r.predicted, r.error, r.error_pct and round(r.error_pct, 6)) for r in vo.judged(f, a).collect()}
    pct = lambda e, y: round(100 * e / y, 6)
    assert got == {
        ("m", at(40), "1d"): (11.0, 1.0, pct(1, 12)), ("m", at(40), "7d"): (14.0, -2.0, pct(-2, 12)), ("m", at(40), "30d"): (16.0, -4.0, pct(-4, 12)), ("m", at(40), "beyond"): (20.0, -8.0, pct(-8, 12)), ("m", at(40), "latest"): (11.0, 1.0, pct(1, 12)),
        ("m", at(41), "1d"): (5.0, -5.0, None), ("m", at(41), "latest"): (5.0, -5.0, None), ("m", at(42), "30d"): (7.0, 2.0, pct(2, 9)), ("m", at(42), "latest"): (7.0, 2.0, pct(2, 9)), ("n", at(40), "7d"): (13.0, -1.0, pct(-1, 12)), ("n", at(40), "latest"): (13.0, -1.0, pct(-1, 12)),
    }
    m = {(r.model, r.horizon): r for r in vo.accuracy(vo.judged(f, a)).collect()}
    e, y = [1.0, -5.0, 2.0], [12, 0, 9]
    mean = sum(y) / 3
    r = m["m", "latest"]
    assert (r.total_forecasts, r.mae, r.rmse) == (3, pytest.approx(8 / 3), pytest.approx(math.sqrt(10))) and r.mape == pytest.approx((100 / 12 + 200 / 9) / 2)
    assert r.r2 == pytest.approx(1 - sum(x * x for x in e) / sum((v - mean) ** 2 for v in y)) and m["n", "7d"].r2 is None
    latest = {(r.series, r.day): (r.made_at, r.predicted, r.forecasts) for r in vo.latest_forecasts(f, at(41).date()).collect()}
    assert latest == {("s", at(41).date()): (at(41), 5.0, 1), ("s", at(42).date()): (at(30), 7.0, 1)}


def test_identity_steps(spark):
    book = spark.createDataFrame([(1, "s1", "(555) 123-4567", "A@x.example"), (2, "s2", "5559990000", "b@x.example"), (3, "s2", "+445551", "b@x.example "), (4, None, "", None), (5, "s5", "15550001111", "")], "customer_id long, system_id string, phone string, email string")
    rows = [
        ("c1", "1", "2", None, "s5", None, None), ("c2", "77", "2", "3", None, None, None), ("c3", None, "x", "3", "s1", None, None), ("c4", None, None, "0", "s1", "5559990000", None), ("c5", None, None, None, "s2", "+1 555 999 0000", None),
        ("c6", "", "", "", "", "1-555-000-1111", "a@x.example"), ("c7", None, None, None, "s2", "call me", " A@X.EXAMPLE"), ("c8", None, None, None, None, None, "b@x.example"), ("c9", None, None, None, None, None, None), ("c10", None, None, None, None, "", ""),
    ]
    got = {r.contact_id: (r.customer_id, r.step) for r in ids.resolve(spark.createDataFrame(rows, "contact_id string, external_id string, meta_id string, integration_id string, system_id string, phone string, email string"), book).collect()}
    assert got == {
        "c1": (1, "external"), "c2": (2, "meta"), "c3": (3, "integration"), "c4": (1, "system"), "c5": (2, "phone"), "c6": (5, "phone"), "c7": (1, "email"),
        "c8": (None, None), "c9": (None, None), "c10": (None, None),  # b@ names two customers
    }
    phones = ["(555) 123-4567", "+15551234567", "15551234567", "447700", "x", None, ""]
    df = spark.createDataFrame([(p,) for p in phones], "p string").select(ids.e164(F.col("p")).alias("e"))
    assert [r.e for r in df.collect()] == ["+15551234567", "+15551234567", "+15551234567", "+447700", None, None, None]


def test_automated_rules_in_order(spark):
    names = "tags array<string>, status string, subject string, email string, name string, via string, channel string, phone string, longest int, messages int, from_agent boolean"
    base = ([], "open", "Hello", "ada@x.example", "Ada", "email", "email", None, 10, 1, False)
    change = lambda **c: tuple(c.get(n.split()[0], v) for n, v in zip(names.split(", "), base, strict=True))
    cases = [
        (base, False, "person"), (change(tags=["AI_Ignore", "ai_force"]), True, "tag_skip"), (change(tags=["Force-AI"], status="spam"), False, "tag_force"), (change(status="Closed", email="x@ringcentral.com"), True, "status"),
        (change(email="no-reply@ringcentral.com"), True, "empty_call"), (change(email="x@RingCentral.com", longest=51), False, "call"), (change(email="noreply@ringcentral.com", phone="1"), False, "call"), (change(email="NoReply@x.example"), True, "no_reply"),
        (change(email="x@klaviyo.com"), True, "platform"), (change(email="x@klaviyo.com", via="sms"), False, "person"), (change(email="x@klaviyo.com", subject="New SMS to you"), True, "notice"), (change(name="The Blue Team Shop"), True, "team"), (change(name="Support Team"), True, "team"),
        (change(name="Support Team", channel="SMS"), False, "person"), (change(name="Teamwork"), False, "person"), (change(via="api"), True, "interface"), (change(via="api", from_agent=True), False, "person"), (change(via="api", messages=0), False, "person"), ((None,) * 11, False, "person"),
    ]
    df = spark.createDataFrame([(k, *c[0]) for k, c in enumerate(cases)], "k int, " + names)
    columns = [F.col(n.split()[0]) for n in names.split(", ")]
    got = {r.k: (r.a["automated"], r.a["rule"]) for r in df.select("k", ids.automated(*columns).alias("a")).collect()}
    assert [got[k] for k in range(len(cases))] == [c[1:] for c in cases]


def test_drift_over_two_horizons(spark):
    rng = random.Random(2)
    days = [0, 3, 9, 11, 20, 29, 45, 100, 120, 190, 200, 214, 221]
    share = lambda: (lambda a: {"x": a, "y": 1 - a})(rng.random())
    rows = []
    for customer in (1, 2):
        for d in days[customer - 1 :]:
            f, v = share(), share()
            dom = {"frequency": "heavy" if f["x"] > 0.5 else "light", "value": max(v, key=v.get)}
            rows.append((customer, date(2024, 1, 1) + timedelta(days=d), {"frequency": f, "value": v}, dom, f"{dom['frequency']}/{dom['value']}"))
    df = spark.createDataFrame(rows, "customer_id long, snapshot_date date, memberships map<string,map<string,double>>, dominant map<string,string>, archetype string").repartition(3)
    got = {(r.customer_id, r.snapshot_date): r for r in sn.horizons(df, rapid=0.06, moderate=0.03, risky=0.02).collect()}
    far = lambda a, b: math.sqrt(sum((a[2][x][s] - b[2][x][s]) ** 2 for x in a[2] for s in a[2][x])) if a and b else None
    seen = Counter()
    for row in rows:
        as_of = lambda lag: max((o for o in rows if o[0] == row[0] and o[1] <= row[1] - timedelta(days=lag)), key=lambda o: o[1], default=None)  # noqa: B023, E731
        s7, old, r = as_of(7), as_of(28), got[row[0], row[1]]
        v = far(row, s7) / (row[1] - s7[1]).days if s7 else None
        short, long = far(s7, as_of(14)), far(as_of(90), as_of(180))
        assert r.velocity == (pytest.approx(v) if v is not None else None) and r.short_drift == (pytest.approx(short) if short is not None else None) and r.long_drift == (pytest.approx(long) if long is not None else None)
        assert r.acceleration == (pytest.approx(short - long) if short is not None and long is not None else None)
        assert r.alert == (None if v is None else "RAPID_DRIFT" if v > 0.06 else "MODERATE_DRIFT" if v > 0.03 else "STABLE")
        assert (r.migrated, r.days_elapsed) == ((old[4] != row[4], (row[1] - old[1]).days) if old else (None, None))
        changed = [(a, old[3][a], row[3][a]) for a in sorted(row[3]) if old[3][a] != row[3][a]] if old else None
        assert (None if r.axes_changed is None else [tuple(x) for x in r.axes_changed]) == changed
        risk = bool(old) and old[3]["frequency"] == "heavy" and row[3]["frequency"] != "heavy" and v is not None and v > 0.02
        assert r.churn_risk == ("HIGH" if risk else None)
        seen.update([r.alert, r.migrated, r.churn_risk])
    assert all(seen[x] for x in ("RAPID_DRIFT", "MODERATE_DRIFT", "STABLE", True, False, "HIGH"))


def test_shares_and_quarters(spark):
    at = lambda k: datetime(2024, 1, 6, 22) + timedelta(hours=k)
    rows = [(k, "e", at(5 * k), f"t{k % 3 if k < 6 else 9}") for k in range(11)] + [(50, "one", at(0), "t0")]
    df = spark.createDataFrame(rows, "event_id long, entity string, ts timestamp_ntz, event_type string")
    got = {r.entity: r for r in ev.temporal(df).collect()}
    own = [r[2] for r in rows if r[1] == "e"]
    assert got["e"].hour_shares == pytest.approx([sum(t.hour == h for t in own) / 11 for h in range(24)]) and got["e"].day_shares == pytest.approx([sum(t.weekday() == d for t in own) / 11 for d in range(7)])
    assert got["e"].mean_gap_hours == pytest.approx(5) and got["one"].mean_gap_hours == 0 and got["one"].var_gap_hours == 0
    q = {(r.entity, r.quarter, r.event_type): r.n for r in ev.quarters(df).collect()}
    assert q == {("e", "early", "t0"): 1, ("e", "early", "t1"): 1, ("e", "late", "t9"): 2, ("one", "early", "t0"): 1, ("one", "late", "t0"): 1}
    g = {r.entity: (r.early_diversity, r.late_diversity, r.diversity_growth, r.diversity_growth_ratio) for r in ev.growth(df).collect()}
    assert g == {"e": (2, 1, -1, 0.5), "one": (1, 1, 0, 1.0)}
