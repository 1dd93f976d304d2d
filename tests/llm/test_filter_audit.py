"""The filter audit against plain Python that applies every order to every document."""

import itertools
import random
import re

from pyspark.sql import functions as F

from patronage.llm import filter_audit as fa


def fails_of(text):
    t = text or ""
    w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
    return {
        x
        for x, bad in (("A", len(w) < 50), ("B", 100 * len(set(w)) < 65 * len(w)), ("C", 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t)), ("D", any(c in "#$%&*|" for c in t)))
        if bad
    }


def brute(rows, labels):
    """rows: (doc_id, text, part); the contract's rows, one document and one order after the other."""
    key = lambda i: (i is None, i or 0)
    best = {}
    for i, q, x in labels:
        if i is not None:
            a, b = best.get(i, (0, 0))
            best[i] = max(a, q or 0), max(b, x or 0)
    failed = []
    for i, t, p in rows:
        f = fails_of(t)
        if any((u or "") == (t or "") and key(j) < key(i) for j, u, _ in rows):
            f.add("E")
        failed.append((p or "", f, *(v == 1 for v in best.get(i, (0, 0)))))
    out = {}
    for part in {x[0] for x in failed}:
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left, gone = [x for x in failed if x[0] == part], []
            for step, f in enumerate(order, 1):
                hit = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                unique = sum(x[1] == {f} for x in failed if x[0] == part)
                out[part, "".join(order), step] = [len(left), len(hit), sum(f in x[1] for x in gone), unique, sum(x[2] for x in hit), sum(x[3] for x in hit)]
                shapley[f] += len(hit)
                gone += hit
        for order in itertools.permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                out[part, "".join(order), step].append(shapley[f])
    return out


def check(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, p, "x", "y", 1, "z") for i, t, p in rows], "doc_id long, text string, source string, part string, mask string, rows int, first string")
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = fa.filter_audit(docs, marked).collect()
    have = {(r.part, r.filter_order, r.step): [r[m] for m in (*fa.METRICS, "shapley")] for r in got}
    assert len(have) == len(got)
    assert have == brute(rows, labels)


def test_matches_brute_force(spark, odd_texts):
    rng = random.Random(3)
    plain = lambda n: " ".join(rng.choice(["", "Big "]) + f"w{rng.randint(0, 9 * n)}" for _ in range(n))
    texts = [plain(rng.choice((10, 49, 50, 80))) + rng.choice(["", "", " #1", " ABCDEFGHIJ KLMNOP"]) + rng.choice(["", " same" * 30]) for _ in range(40)]
    rows = [(k, rng.choice(texts), rng.choice(["s1", "s2", "s3", None, ""])) for k in range(100, 220)]
    rows += [(i, t, "odd") for i, t in odd_texts] + [(None, texts[0], "odd"), (None, texts[0], "odd"), (None, "only of null ids", "nulls"), (None, "only of null ids", "nulls"), (100, "a second text of an id", "s1")]
    labels = [(k, rng.choice((0, 1, None)), rng.choice((0, 1, None))) for k in range(90, 200, 2)] + [(100, 1, 0), (100, 0, 1), (None, 1, 1)]
    check(spark, rows, labels)


def test_edges_of_the_conditions(spark):
    words = [f"w{k}" for k in range(60)]
    rows = [(1, " ".join(words[:50]), "s"), (2, " ".join(words[:49]), "s"), (3, " ".join(words[:39] + words[:21]), "s"), (4, " ".join(words[:38] + words[:22]), "s")]
    rows += [(5, "A" * 5 + "b" * 95, "s"), (6, "A" * 6 + "b" * 94, "s"), (7, "é" * 94 + "A" * 6, "s"), (8, "Ä" * 50, "s")] + [(20 + k, x, "s") for k, x in enumerate("#$%&*|")]
    check(spark, rows, [(k, 1, k % 2) for k in range(1, 30)])


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert fa.filter_audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []


def test_other_filters(spark):
    """Two row filters of the caller's own and copies, over columns of other names."""
    rows = [("a", "long text", "x"), ("b", "long text", "x"), ("c", "tiny", "y"), ("d", "", "y")]
    docs = spark.createDataFrame(rows, "name string, body string, site string")
    labels = spark.createDataFrame([("a", 1, 0), ("c", 1, 0)], "name string, quality int, toxic int")
    got = fa.filter_audit(docs, labels, "SLC", F.array(F.length("body") < 5, F.length("body") > 5), "name", "body", "site").collect()
    assert len(got) == 2 * 6 * 3
    at = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.shapley) for r in got}
    assert at["x", "SLC", 2] == (0, 2, 0, 1, 1, 9) and at["x", "CLS", 1] == (1, 1, 0, 0, 0, 3) and at["y", "SLC", 3] == (0, 0, 0, 0, 0, 0)
