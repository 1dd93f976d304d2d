import numpy as np
from patronage.llm.mixing import flight, mix_sources, source_targets


def brute_targets(sizes):
    """Share by weight, cap at three times, share the excess again, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (k % 3) + 1 for k, s in enumerate(names)}
    left, open_, out = float(sum(sizes.values())), set(names), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def test_targets(spark):
    sizes = {"a": 1000, "b": 3, "c": 40, "ä": 0, "Z": 700, None: 90, "e": 5}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in source_targets(df).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_mix_keeps_rules(spark, make_docs, odd_texts):
    rows = odd_texts + [(100 + k, "w " * (1 + k * 7 % 90)) for k in range(600)]
    for block in (40, 4000):
        got = mix_sources(make_docs(rows), block=block).collect()
        assert len(got) == len(rows)
        assert all(0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size for r in got)
        by = {}
        for r in got:
            a = by.setdefault((r.source_size, r.target), 0)
            by[r.source_size, r.target] = a + r.taken
        assert all(abs(taken - target) <= 0.02 * target + 5 for (_, target), taken in by.items() if target < 30_000)
        assert sorted(map(str, got)) == sorted(map(str, mix_sources(make_docs(rows), block=block).collect()))


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(1)
    pi, size = np.full(500, 0.37), rng.integers(0, 300, 500)
    out = flight(pi, size, rng.random(501), False)
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert abs(out.sum() - pi.sum()) < 1e-6 and abs((out * size).sum() - (pi * size).sum()) < 1e-3
    means = np.mean([flight(np.full(9, 0.4), np.arange(9), np.random.default_rng(s).random(10), True) for s in range(400)], axis=0)
    assert abs(means.mean() - 0.4) < 0.08
    assert mix_empty_ok()


def mix_empty_ok():
    return len(flight(np.zeros(0), np.zeros(0), np.zeros(1), True)) == 0


def test_repeated_rows_and_null_ids_are_blocks_of_their_own(spark, make_docs):
    """Rows that are all alike, or without doc_id, keep to the rate; alike rows differ by one copy at most."""
    rows = [(None, f"w{k} " * (1 + k % 9)) for k in range(300)] + [(7, "same words " * 4)] * 200 + [(7, "other " * (k + 9)) for k in range(50)] + [(k, "x " * (k % 40)) for k in range(1000, 1200)]
    got = mix_sources(make_docs(rows), block=30).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault((r.source, r.source_size, r.target), []).append(r)
    for (_, size, target), of in by.items():
        assert sum(r["size"] for r in of) == size and abs(sum(r.taken for r in of) - target) <= 0.03 * target + 5
    alike = [r.copies for r in got if r.doc_id == 7 and r["size"] == 8]
    assert len(alike) == 200 and max(alike) - min(alike) <= 1
    assert all(0 <= r.copies <= 3 for r in got)


def test_targets_of_many_sources(spark):
    sizes = {f"s{k:04d}": (k * 7919) % 1000 for k in range(2500)}
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: (r.source_no, r.target) for r in source_targets(df).collect()}
    want = brute_targets(sizes)
    assert all(abs(got[s][1] - want[s]) < 1e-6 * (1 + want[s]) for s in want)
    assert [s for s, _ in sorted(got.items(), key=lambda x: x[1][0])] == sorted(sizes) and sorted(x[0] for x in got.values()) == list(range(1, 2501))


def test_alike_rows_beyond_one_array(make_docs, monkeypatch):
    from patronage.llm import mixing

    rows = [(None, "same words of a row that repeats")] * 2500 + [(k, "other words here") for k in range(50)]
    want = sorted((r.doc_id is None, r.doc_id, r.size, r.taken) for r in mixing.mix_sources(make_docs(rows)).collect() if r.doc_id is None)
    monkeypatch.setattr(mixing, "RUN", 7)
    got = sorted((r.doc_id is None, r.doc_id, r.size, r.taken) for r in mixing.mix_sources(make_docs(rows)).collect() if r.doc_id is None)
    assert got == want and len(got) == 2500


def test_empty_table(make_docs):
    assert mix_sources(make_docs([])).collect() == []
