import re

from patronage.llm.decontaminate import decontaminate


def brute(text, items, window=10):
    norm = lambda t: [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if w]
    w, hit, found = norm(text), set(), set()
    for item, t in items:
        q = norm(t)
        for p in range(max(1, len(q) - window + 1)) if q else ():
            part = q[p : p + window]
            for k in range(len(w) - len(part) + 1):
                if w[k : k + len(part)] == part:
                    hit |= set(range(k, k + len(part)))
                    found.add(str(item))
    return len(w), len(hit), sorted(x for x in found if x != "None"), w, hit


def test_matches_brute_force(spark, make_docs, odd_texts):
    items = [(1, "One two three four five six seven eight nine ten eleven twelve"), (10, "short item"), (2, "short ITEM"), (3, None), (4, "..."), (5, "漢字 ünï x"), (None, "漢字—ünï x"), (7, "short item")]
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, pattern string")
    rows = odd_texts + [(50, "say: one, two THREE four five six seven eight nine ten!"), (51, "a short-item short item"), (52, "two three four five six seven eight nine ten eleven twelve 13"), (53, "漢字 Ünï x"), (54, "ä “漢字—ünï x” Short Item, ünï x SHORT item")]
    for block in (200_000, 2):
        got = decontaminate(make_docs(rows), bench, block_pairs=block, carry=("key",)).collect()
        assert len(got) == len(rows)
        for r in got:
            n, hit, found, words, places = brute(dict(rows)[r.doc_id], items)
            text = dict(rows)[r.doc_id] or ""
            assert {k for h in r.hits for k in range(h["first"], h["last"] + 1)} == places
            assert all(a["last"] + 1 < b["first"] for a, b in zip(r.hits, r.hits[1:], strict=False))
            for h in r.hits:  # the offsets lead back to the same words of the original, with nothing around them
                part = text[h["start"] : h["stop"]]
                assert brute(part, [])[3] == words[h["first"] : h["last"] + 1] and brute(part[1:], [])[3] != brute(part, [])[3] != brute(part[:-1], [])[3]
            assert (r.n_words, r.n_hit, r["items"], r.n_items, r.contaminated, r.key) == (n, hit, found, len(found), hit > 0, "x")


def test_empty_tables(spark, make_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in decontaminate(make_docs([(1, "a b"), (2, None)]), none).collect()] == [False, False]
    assert decontaminate(make_docs([]), none).collect() == []
