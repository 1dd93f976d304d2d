"""Churn models in the order of time, preparation of features, ticket desk: against plain Python."""

import random
import statistics
from datetime import date

import pytest
from patronage.operators import scoring
from patronage.plans import churn
from pyspark.sql import functions as F

DATES = [date(2024, m, 1) for m in range(1, 8)]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    out = []
    for d in DATES:
        for c in range(30):
            recency = rng.randint(0, 180)
            out.append((c, d, rng.randint(2, 9), None if c == 0 else rng.random() * 100, recency, int(recency + rng.gauss(0, 30) > 100)))
    return spark.createDataFrame(out, "customer_id long, obs_date date, orders long, value double, recency int, churned int").persist()


def test_folds_never_learn_from_later_dates():
    folds = churn.time_folds(DATES, 5)
    assert [(len(a), b) for a, b in folds] == [(k, [DATES[k]]) for k in range(2, 7)]
    wide = churn.time_folds(list(range(13)), 5)
    assert [(a[-1], b) for a, b in wide] == [(2, [3, 4]), (4, [5, 6]), (6, [7, 8]), (8, [9, 10]), (10, [11, 12])]
    assert churn.time_folds([3, 1], 5) == [([1], [3])] and churn.time_folds([1], 5) == []
    assert churn.final_split(dict.fromkeys(DATES, 30)) == (DATES[:5], DATES[5:])
    assert churn.final_split({1: 1000, 2: 1}) == ([1], [2]) and churn.final_split({1: 1, 2: 1000}) == ([1], [2])


def plain_figures(pairs):
    """AUC by all pairs of a churned and a kept row, precision, recall and F1 at one half."""
    up, down = [p for p, y in pairs if y], [p for p, y in pairs if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in up for b in down) / (len(up) * len(down))
    tp, fp, fn = sum(p >= 0.5 for p in up), sum(p >= 0.5 for p in down), sum(p < 0.5 for p in up)
    precision, recall = tp / (tp + fp) if tp + fp else 0.0, tp / (tp + fn)
    return auc, precision, recall, 2 * precision * recall / (precision + recall) if precision + recall else 0.0


def test_figures_of_a_fold_by_definition(rows):
    columns = ["orders", "value", "recency"]
    found = {r.fold: r for r in churn.cross_validate(rows, columns, n=2, rounds=3).collect()}
    assert set(found) == {"fold 1", "fold 2", "mean", "std", "final"}
    learned, tested = DATES[:3], DATES[3:5]
    assert (found["fold 1"].train_rows, found["fold 1"].test_rows, found["fold 1"].last_learned, found["fold 1"].first_tested) == (90, 60, str(learned[-1]), str(tested[0]))
    model = churn.fit(rows.where(F.col("obs_date").isin(learned)), columns, rounds=3)
    scored = churn.scored(model, rows.where(F.col("obs_date").isin(tested)), columns)
    want = plain_figures([(r.probability, r.churned) for r in scored.collect()])
    got = tuple(found["fold 1"][m] for m in churn.METRICS)
    assert got == pytest.approx(want, abs=1e-9) and got[0] > 0.8
    for m in churn.METRICS:
        both = [found["fold 1"][m], found["fold 2"][m]]
        assert found["mean"][m] == pytest.approx(statistics.mean(both)) and found["std"][m] == pytest.approx(statistics.pstdev(both))
    top = churn.importances(model, columns, rows.sparkSession).first()
    assert top.feature == "recency"
    with pytest.raises(ValueError):
        churn.cross_validate(rows.where(F.col("obs_date") == DATES[0]), columns)


def test_levels_and_confidence_of_scores(spark):
    d = spark.createDataFrame([(p,) for p in (0.1, 0.3, 0.35, 0.4, 0.5, 0.6, 0.65, 0.7, 0.75, 0.8, 0.9)], "probability double")
    got = [(r.at_risk, r.confidence, r.level) for r in churn.risk_report(d).orderBy("probability").collect()]
    assert [g[0] for g in got] == [False] * 4 + [True] * 7
    assert [g[1] for g in got] == ["high", "medium", "medium", "low", "low", "low", "low", "low", "medium", "medium", "high"]
    assert [g[2] for g in got] == ["low"] * 4 + ["medium"] * 2 + ["high"] * 4 + ["critical"]


def test_prepared_features(spark):
    d = spark.createDataFrame([(1, 2.0, 0.1, None), (2, None, 0.1, None), (3, float("nan"), 0.1, None), (4, 6.0, 0.1, None)], "id int, a double, b double, c double")
    out, kept = scoring.preprocess(d, ["a", "b", "c"])
    assert kept == ["a"] and out.columns == ["id", "a"]
    plain = [2.0, 0.0, 0.0, 6.0]
    want = [(v - statistics.mean(plain)) / statistics.pstdev(plain) for v in plain]
    assert [r.a for r in out.orderBy("id").collect()] == pytest.approx(want)
    assert scoring.preprocess(d.where("id > 9"), ["a", "b"])[1] == []


def test_desk_and_outreach(spark):
    much, falling, expert, other = {"problem_complexity_profile": "high_touch_shopper", "loyalty_trajectory": "declining_risk"}, {"loyalty_trajectory": "declining_risk"}, {"product_knowledge": "category_expert"}, {}
    rows = [(1, much, 600.0, 3.0, 0.9, "evening", 0.6), (2, falling, 500.0, 2.0, 0.9, "evening", None), (3, expert, 900.0, None, 0.8, "evening", 0.9), (4, other, 900.0, 1.0, None, None, 0.1)]
    d = spark.createDataFrame(rows, "customer_id long, dominant map<string,string>, lifetime_value double, weekend_vs_weekday_ratio double, business_hours_ratio double, preferred_contact_time string, recent_return_rate double")
    assert {tuple(r) for r in scoring.route_tickets(d).collect()} == {(1, "senior_agent_queue", "saturday_9am"), (2, "retention_specialist", "weekday_2pm"), (3, "product_specialist", "weekday_6pm"), (4, "general_support", None)}
    assert {tuple(r)[:3] for r in scoring.outreach(d).collect()} == {(1, "declining", "high"), (1, "returns", "medium")}
