"""A database read by ranges, and the star schema against a plain model of its rules."""

import uuid
from datetime import date, datetime, timedelta

import pytest
from patronage.plans import star
from patronage.sources import database as db
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def url(spark):
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", "/dev/null")
    return f"jdbc:derby:memory:t{uuid.uuid4().hex};create=true"


@pytest.fixture(scope="module")
def stored(spark, url):
    rows = [(k, datetime(2024, 1, 1) + timedelta(hours=7 * k), k % 5, f"n{k}") for k in range(400)] + [(900, None, 1, "none"), (901, datetime(2024, 1, 31), 1, "at the end"), (902, datetime(2024, 1, 30, 23, 59, 59, 999_999), 1, "just before")]
    df = spark.createDataFrame(rows, "order_id long, order_date timestamp_ntz, store int, name string")
    db.write_table(df, url, "orders_t", "name VARCHAR(20)")
    lines = df.select("order_id", "order_date", F.explode(F.sequence(F.lit(1), F.col("store") + 1)).alias("line_no"))
    db.write_table(lines, url, "lines_t")
    return rows


@pytest.mark.parametrize("partitions", [1, 4, 1000])
def test_range_is_read_once_in_parallel(spark, url, stored, partitions):
    since, until = date(2024, 1, 10), date(2024, 1, 31)
    d = db.read_range(spark, url, "orders_t", "order_date", since, until, partitions)
    assert d.rdd.getNumPartitions() == min(partitions, 21)
    got = sorted(r.order_id for r in d.collect())
    assert got == sorted(i for i, at, *_ in stored if at is not None and datetime(2024, 1, 10) <= at < datetime(2024, 1, 31)) and 902 in got and 901 not in got


def test_filters_and_columns_reach_the_database(spark, url, stored):
    d = db.read_range(spark, url, "orders_t", "order_date", date(2024, 1, 1), date(2024, 3, 1), 3).where("store = 2").select("order_id")
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(STORE,2)" in plan.replace("store", "STORE") and "PushedFilters" in plan and "name" not in plan.lower().split("readschema")[-1]
    assert sorted(r.order_id for r in d.collect()) == [i for i, at, s, _ in stored if at is not None and s == 2 and at < datetime(2024, 3, 1)]


def test_both_tables_by_range(spark, url, stored):
    got = db.read_sales(spark, url, "orders_t", "lines_t", date(2024, 1, 5), date(2024, 1, 6)).collect()
    want = [(i, k) for i, at, s, _ in stored if at is not None and datetime(2024, 1, 5) <= at < datetime(2024, 1, 6) for k in range(1, s + 2)]
    assert sorted((r.order_id, r.line_no) for r in got) == sorted(want)
    with pytest.raises(ValueError):
        db.read_range(spark, url, "orders_t", "order_date", date(2024, 1, 5), date(2024, 1, 5))


RUNS = [
    {1: ("a", "a/x", 3, 1.0), 2: ("a", "a/y", 4, 2.0), 3: ("b", "b/x", 5, 3.0)},
    {1: ("a", "a/x", 9, 1.5), 2: ("b", "b/y", 4, 2.0), 4: ("b", "b/x", 1, 7.0), 5: (None, None, 1, 1.0)},
    {2: ("a", "a/y", 4, 2.0), 3: ("b", "b/x", 6, 3.5), 5: ("a", "a/z", 2, 2.0)},
]


def test_star_run_by_run(spark, tmp_path):
    path = str(tmp_path / "star")
    dim, current, history = {}, {}, []
    for no, rows in enumerate(RUNS, 1):
        at = datetime(2024, no, 1)
        df = spark.createDataFrame([(i, *v, "x") for i, v in rows.items()] + [(next(iter(rows)), *rows[next(iter(rows))], "x")], "customer_id long, one string, two string, orders long, value double, run string")
        if no == 2:  # a run that died after some of its tables
            df.limit(1).write.parquet(f"{path}/dim_archetype/run=2")
        assert star.load(df, path, at, {"l1": "one", "l2": "two"}, ("orders", "value"), "value") == no == star.last_run(spark, path)
        for level, place in (("l1", 0), ("l2", 1)):
            for s in {v[place] for v in rows.values()} - {None}:
                own = [v[3] for v in rows.values() if v[place] == s]
                dim.setdefault((level, s), (len(own), round(100 * len(own) / len(rows), 6), round(sum(own) / len(own), 6), at))
        for i, v in rows.items():
            current[i] = (*v, current[i][4] if i in current else at, at)
            old = next((h for h in history if h[0] == i and h[6] is None), None)
            if old is None or (old[1], old[2]) != v[:2]:
                if old is not None:
                    history[history.index(old)] = (*old[:6], at)
                history.append((i, *v, at, None))
        key = {(r.level, r.signature): r.archetype_id for r in star.read(spark, path, "dim_archetype").collect()}
        got = {(r.level, r.signature): (r.member_count, round(r.population_pct, 6), round(r.mean_value, 6), r.first_seen) for r in star.read(spark, path, "dim_archetype").collect()}
        assert got == dim and len(set(key.values())) == len(key)
        ids = lambda v: (key.get(("l1", v[0])), key.get(("l2", v[1])))  # noqa: B023, E731
        assert {r.customer_id: (r.l1_id, r.l2_id, r.orders, r.value, r.first_seen, r.last_updated) for r in star.read(spark, path, "fact_current").collect()} == {i: (*ids(v), *v[2:]) for i, v in current.items()}
        have = sorted(((r.customer_id, r.l1_id, r.l2_id, r.orders, r.value, r.valid_from, r.valid_to) for r in star.read(spark, path, "fact_history").collect()), key=str)
        assert have == sorted(((h[0], *ids(h[1:3]), *h[3:]) for h in history), key=str)


def test_nothing_loaded(spark, tmp_path):
    with pytest.raises(ValueError):
        star.read(spark, str(tmp_path / "none"), "fact_current")
