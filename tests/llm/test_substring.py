import hashlib
import random
import re

import pytest
from patronage.llm.substring import substring_dedup


def brute(rows, window):
    words = [(i, [w for w in re.split("[\x20\x09-\x0d]+", t or "") if w]) for i, t in rows]
    first = {}
    for i, w in sorted(words, key=lambda x: (x[0] is None, x[0] or 0)):
        for p in range(len(w) - window + 1):
            first.setdefault(tuple(w[p : p + window]), i)
    out = []
    for i, w in words:
        gone = set()
        for p in range(len(w) - window + 1):
            of = first[tuple(w[p : p + window])]
            if of is not None and (i is None or of < i):
                gone |= set(range(p, p + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("parts", [1, 5])
def test_matches_brute_force(make_docs, odd_texts, monkeypatch, parts):
    monkeypatch.setattr("patronage.llm.substring.text_parts", lambda *a: parts)
    rng = random.Random(parts)
    word = lambda: "w" + str(rng.randint(0, 9999))
    passage = [[word() for _ in range(rng.randint(45, 90))] for _ in range(5)]
    rows = list(odd_texts) + [(None, " ".join(passage[0]))]
    for i in range(100, 140):
        text = []
        for _ in range(3):
            text += [word() for _ in range(rng.randint(0, 40))] + (passage[rng.randrange(5)] if rng.random() < 0.6 else [])
        rows.append((i, (" \n\t" if i % 2 else " ").join(text)))
    got = sorted([tuple(r) for r in substring_dedup(make_docs(rows)).collect()], key=str)
    assert got == brute(rows, 50)


def test_rows_without_an_id_spread(spark, make_docs, monkeypatch):
    """A hundred thousand rows without an id, or of one, are not one group; each has its result."""
    from pyspark.sql import functions as F

    monkeypatch.setattr("patronage.llm.substring.text_parts", lambda *a: 16)
    passage = " ".join(f"p{k}" for k in range(55))
    df = spark.range(100_000).select(F.when(F.col("id") % 2 == 0, 7).cast("long").alias("doc_id"), F.concat(F.col("id").cast("string"), F.lit(" "), F.when(F.col("id") % 1000 < 2, passage).otherwise("few words")).alias("text"))
    docs = df.unionByName(make_docs([(1, "a " + passage)], extra=False).select("doc_id", "text"))
    groups = []
    plain = F.pmod
    monkeypatch.setattr("patronage.llm.substring.F.pmod", lambda a, b: groups.append(plain(a, b)) or groups[-1])
    got = substring_dedup(docs).groupBy("doc_id", "n_words", "n_removed").count().collect()
    assert {(r.doc_id, r.n_words, r.n_removed): r["count"] for r in got} == {(7, 56, 55): 100, (7, 3, 0): 49_900, (None, 56, 55): 100, (None, 3, 0): 49_900, (1, 56, 0): 1}
    largest = docs.groupBy(groups[0].alias("g")).count().agg({"count": "max"}).first()[0]
    assert largest < 100_000 / 16 * 1.2


def test_empty_table_and_text_output(make_docs):
    assert substring_dedup(make_docs([])).collect() == []
    text = " ".join(map(str, range(60)))
    got = {r.doc_id: r.kept_text for r in substring_dedup(make_docs([(1, text), (2, "a " + text + " b")]), with_text=True).collect()}
    assert got == {1: text, 2: "a b"}


def test_cover_must_give_all_differences(make_docs):
    with pytest.raises(ValueError):
        substring_dedup(make_docs([(1, "a")]), period=7, cover=(0, 1))
