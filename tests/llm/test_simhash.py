import random

import pytest
import xxhash
from patronage.llm.common import text_marks
from patronage.llm.links import components
from patronage.llm.simhash import _alike, _shingle_sets, _unlinked_pairs, fingerprints, near_groups, near_pairs, simhash_groups


def brute_fingerprint(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", lower) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(marks):
    """marks: (doc_id, fingerprint); component by plain search over all pairs."""
    parent = {d: d for d, _ in marks}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, fa in marks:
        for b, fb in marks:
            if (fa ^ fb).bit_count() <= 3 and top(a) != top(b):
                parent[max(top(a), top(b))] = min(top(a), top(b))
    return {d: top(d) for d, _ in marks}


def test_groups_match_brute_force(make_docs, odd_texts):
    rng = random.Random(5)
    rows = list(odd_texts)
    for k in range(12):
        base = [rng.choice("abcdefgh") * rng.randint(1, 5) + str(rng.randint(0, 60)) for _ in range(150)]
        rows.append((100 + 10 * k, " ".join(base)))
        for j in range(1, 5):
            words = list(base)
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(150)] = "new" + str(rng.randint(0, 9))
            rows.append((100 + 10 * k + j, " ".join(words)))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_groups(make_docs(rows)).collect()}
    want = {d: brute_fingerprint(t) for d, t in rows}
    assert {d: int(f, 16) for d, (f, _) in got.items()} == want
    assert {d: c for d, (_, c) in got.items()} == brute_groups(list(want.items()))
    assert simhash_groups(make_docs(rows)).count() == len(rows)


def test_empty_table(make_docs):
    assert simhash_groups(make_docs([])).collect() == []


def test_crowded_segments_lose_no_pair(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(6)]
    marks = set()
    for b in base:
        for _ in range(60):
            x = b
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            marks.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in marks]
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3}
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    for crowded in (2, 8, 10_000):
        assert {tuple(r) for r in near_pairs(df, crowded=crowded).collect()} == want


def test_components_of_long_chains(spark):
    pairs = [(i, i + 1) for i in range(1, 200)] + [(500, 700), (700, 600), (900, 900)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 201)} | {500: 500, 600: 500, 700: 500}


def test_fingerprint_of_null_is_zero(make_docs):
    assert [r.fp for r in fingerprints(make_docs([(1, None), (2, " ")])).collect()] == [0, 0]


def word_sets(text, shingle=5):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else set()


def brute_near(rows, similarity=0.8):
    """Row number -> row that stays of its group, by comparing all pairs of shingle sets."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    sets, parent = [word_sets(t) for _, t in rows], list(range(len(rows)))
    rank = {k: i for i, k in enumerate(order)}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in order:
        for b in order:
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or both >= similarity * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)), key=rank.get)
                parent[y] = x
    return [top(k) for k in range(len(rows))]


def edited(rng, base, share):
    return " ".join(w if rng.random() > share else f"new{rng.randint(0, 999)}" for w in base.split())


def near_rows(rng, groups=10):
    rows = []
    for k in range(groups):
        base = " ".join(rng.choice("abcdefgh") * rng.randint(1, 5) + str(rng.randint(0, 60)) for _ in range(rng.choice([40, 150, 400])))
        rows += [(100 + 10 * k, base)] + [(100 + 10 * k + j, edited(rng, base, share)) for j, share in enumerate((0.005, 0.01, 0.015, 0.02, 0.06), 1)]
    return rows


def test_near_groups_match_brute_force(make_docs, odd_texts):
    rows = [*odd_texts[:-2], *near_rows(random.Random(8)), (900, "Same WORDS here"), (None, "no id at all"), (None, "another without id"), (901, "no id  at all")]
    stays = {(rows[k][0], rows[k][1]) for k in set(brute_near(rows))}
    got = near_groups(make_docs(rows)).where("stays").collect()
    marks = {(r.doc_id, r.t1, r.t2) for r in got}
    docs = make_docs(rows)
    t1, t2 = text_marks(docs["text"])
    kept = {(r.doc_id, r.text) for r in docs.select("doc_id", "text", t1.alias("a"), t2.alias("b")).collect() if (r.doc_id, r.a, r.b) in marks}
    assert kept == stays
    assert near_groups(make_docs([])).collect() == []


def test_no_alike_pair_under_a_key_is_left_out(spark):
    """Every pair that shares a key, has other labels and is alike gets through the bitmaps, in blocks of any size, once."""
    rng = random.Random(6)
    base = [" ".join(f"w{rng.randint(0, 5000)}" for _ in range(size)) for size in (30, 120, 3000)]
    texts = dict(enumerate([edited(rng, base[k % 3], rng.choice((0.0, 0.004, 0.01, 0.03))) for k in range(60)] + ["", "one", "one two"]))
    sets = _shingle_sets(spark.createDataFrame(list(texts.items()), "cid long, doc_text string"), 5).cache()
    label = {c: c - c % 2 if c < 20 else c for c in texts}
    keys = {(key, c) for c in texts for key in (c % 3, 10, 20 + c)}
    labelled = spark.createDataFrame([(key, c, label[c]) for key, c in keys], "key long, cid long, label long")
    of = {c: word_sets(t) for c, t in texts.items()}
    met = [(a, b) for a in texts for b in texts if a < b and label[a] != label[b]]
    want = {(a, b) for a, b in met if 10 * len(of[a] & of[b]) >= 8 * len(of[a] | of[b])}
    assert len(want) > 50
    for block in (3, 20, 1000):
        pairs = _unlinked_pairs(labelled, sets, 0.8, block)
        got = [tuple(r) for r in pairs.collect()]
        assert want <= set(got) <= set(met) and len(got) == len(set(got)) < len(met) / 2
        assert {tuple(r) for r in _alike(pairs, sets, 0.8).collect()} == want


@pytest.mark.parametrize(("share", "least"), [(0.01, 0.999), (0.02, 0.99)])
def test_near_recall(make_docs, share, least):
    """Two crowds of 150 edited copies: pairs that brute force links are put together, nothing else is linked."""
    rng = random.Random(2)
    base = " ".join(f"w{rng.randint(0, 400)}" for _ in range(200))
    rows = [(k, edited(rng, base if k < 150 else base[::-1], share)) for k in range(300)]
    want = brute_near(rows)
    got = {r.doc_id: r.group_id for r in near_groups(make_docs(rows)).collect()}
    linked = [(a, b) for a in range(300) for b in range(a) if want[a] == want[b]]
    found = sum(got[a] == got[b] for a, b in linked) / len(linked)
    assert len(linked) > 1000 and found >= least, found
    assert all(want[a] == want[b] for a in range(300) for b in range(a) if got[a] == got[b])
