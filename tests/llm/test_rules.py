"""Quality rules against plain Python: base counts, ratio and verdict of every document."""

import math
import random
import re
from collections import Counter

from patronage.llm import target_ratio as tr

BLANK = "[\x20\x09-\x0d]+"


def words_of(text):
    return [w for w in re.split(BLANK, text or "") if w]


def base(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    w, t = words_of(text), text or ""
    lines = [x for x in t.split("\n") if words_of(x)]
    places = {}
    for k in range(len(w) - 2):
        places.setdefault(tuple(w[k : k + 3]), []).append(k)
    covered = {k + d for of in places.values() if len(of) > 1 for k in of for d in range(3)}
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def grams(text):
    w = words_of(text)
    return [(x[:3],) for x in w] + [(x[-3:], "", 1) for x in w] + [(a[-2:], b[:2]) for a, b in zip(w, w[1:], strict=False)]


def test_matches_brute_force(spark, make_docs, odd_texts):
    rng = random.Random(4)
    good = [" ".join(rng.choice("stone river wall mill north frost crew summer".split()) + rng.choice(["", "s", ","]) for _ in range(rng.randint(45, 90))) for _ in range(12)]
    junk = [" ".join(rng.choice("zx#qv xkcd!! $$buy$$ ww|ww <<go>> aaa*".split()) + str(rng.randint(0, 99)) for _ in range(rng.randint(45, 90))) for _ in range(12)]
    mixed = [" ".join((g + " " + j).split()[: rng.randint(49, 130)]) for g, j in zip(good, junk, strict=True)]
    rows = [*odd_texts, (None, good[0]), (900, good[1] + "\n" + good[1] + "\n \n" + good[1]), *enumerate(good + junk + mixed, 100)]
    trusted = set(range(100, 106))
    labels = spark.createDataFrame([(i, 1, 0) for i in trusted] + [(115, 0, 0), (116, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = tr.quality_rules(make_docs(rows), labels).collect()
    assert len(got) == len(rows)

    known = sorted({g for _, t in rows for g in grams(t)}, key=str)
    starts = spark.createDataFrame([(k, *g) for k, g in enumerate(known) if len(g) == 1], "k int, a string").selectExpr("k", f"pmod(xxhash64(a), {tr.BUCKETS}) AS h")
    gaps = spark.createDataFrame([(k, *g) for k, g in enumerate(known) if len(g) == 2], "k int, a string, b string").selectExpr("k", f"pmod(xxhash64(a, b), {tr.BUCKETS}) AS h")
    ends = spark.createDataFrame([(k, g[0]) for k, g in enumerate(known) if len(g) == 3], "k int, a string").selectExpr("k", f"pmod(xxhash64(a, 1), {tr.BUCKETS}) AS h")
    bucket = {known[r.k]: r.h for r in starts.unionByName(gaps).unionByName(ends).collect()}
    raw = Counter(bucket[g] for _, t in rows for g in grams(t))
    target = Counter(bucket[g] for i, t in rows if i in trusted for g in grams(t))
    n, m = sum(raw.values()), sum(target.values())

    def ratio(text):
        found = [bucket[g] for g in grams(text)]
        share = {b: (raw[b] + 1) / (n + tr.BUCKETS) for b in found}
        each = [math.log((target[b] + tr.PRIOR * share[b]) / (m + tr.PRIOR) / share[b]) for b in found]
        return sum(each) / len(each) if each else 0.0

    have = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, round(r.ratio, 9)) for r in got), key=str)
    want = []
    for i, t in rows:
        counts = base(t)
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        want.append((i, *counts, failed, not failed and ratio(t) >= tr.THRESHOLD, round(ratio(t), 9)))
    assert have == sorted(want, key=str)


def test_a_text_at_the_threshold_is_kept(spark, make_docs):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, text), (2, " ".join(f"z{k}" for k in range(60)))]
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    at = {r.doc_id: r.ratio for r in tr.quality_rules(make_docs(rows), labels).collect()}
    for threshold, kept in ((at[2], True), (math.nextafter(at[2], 1), False)):
        assert {r.doc_id: r.kept for r in tr.quality_rules(make_docs(rows), labels, threshold=threshold).collect()}[2] is kept
