"""The license scan against plain Python: base places by word lists, all rules without a gate, suppression by all pairs."""

import random
import re

from pyspark.sql import functions as F

from patronage.llm import license_rules as lr
from patronage.llm import licenses as li
from patronage.llm.queries import license_digest

RULES = lr.rules()
WORD = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"
UPPER = {c: c + 32 for c in range(65, 91)}


def words_of(text):
    return [(m.group().encode(), m.start(), m.end()) for m in re.finditer(WORD, (text or "").translate(UPPER))]


def brute(text):
    """(n_words, detections) with every rule tried and every two detections compared."""
    found = words_of(text)
    words = [w for w, _, _ in found]
    joined, starts, at = b" " + b" ".join(words) + b" ", {}, 1
    for k, w in enumerate(words):
        starts[at] = k
        at += len(w) + 1
    hits = []
    for k, r in enumerate(RULES):
        if r.base:
            phrase = next(p for p, label in lr.BASE if label == r.label).encode().split()
            hits += [(i, i + len(phrase) - 1, k) for i in range(len(words)) if words[i : i + len(phrase)] == phrase]
        else:
            for m in r.pattern.finditer(joined):
                first = starts[m.start()]
                hits.append((first, first + m.group().count(b" "), k))
    stays = []
    for d in sorted(hits, key=lambda d: (RULES[d[2]].kind, d[0] - d[1], d[0], d[2])):
        nested = any((a <= d[0] and d[1] <= b) or (d[0] <= a and b <= d[1]) for a, b, _ in stays)
        if RULES[d[2]].base or not nested:
            stays.append(d)
    return len(words), [(RULES[k].name, a, b, found[a][1], found[b][2]) for a, b, k in sorted(stays)]


LINES = [
    "Licensed under the Apache License, Version 2.0 (the \"License\");", "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.",
    "SPDX-License-Identifier: GPL-2.0-or-later", "SPDX-License-Identifier: Unheard-Of-1.0", "see https://www.apache.org/licenses/LICENSE-2.0.html", "the GNU Lesser General Public License v2.1", "mit license MIT License cc-by CC BY", "BSD 3-Clause License",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "Copyright (c) 2004-2010, all rights reserved.", "Creative Commons Attribution-NonCommercial-ShareAlike 3.0 Unported", "veröffentlicht unter der MIT Lizenz",
    "released into the public domain", "licensed under the Some Odd Community License", "under the terms of the Mozilla Public License, v. 2.0", "apache", "mit", "license", "gnu general public", "gnu general\npublic -- license", "CC BYE", "MITLICENSE", "limit license", "© CC BY é", "Open Database License (ODbL) v1.0",
]


def compared(docs, rows):
    got = li.scan_licenses(docs, carry=("lang", "size")).collect()
    have = sorted(((r.doc_id, r.n_words, [(d.rule, d["first"], d["last"], d.start, d.stop) for d in r.detections]) for r in got), key=str)
    assert have == sorted(((i, *brute(t)) for i, t in rows), key=str)
    assert {(r.lang, r["size"]) for r in got} <= {("en", "x")}
    return {r.doc_id: r for r in got}


def test_matches_brute_force(make_docs, odd_texts):
    rng = random.Random(8)
    filler = "the river é mit stone under public wall 漢字 license by cc 12".split()
    rows = [(100 + k, x) for k, x in enumerate(LINES)]
    for k in range(300):
        parts = [rng.choice(LINES) if rng.random() < 0.5 else " ".join(rng.choice(filler) for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 6))]
        rows.append((1000 + k, rng.choice([" ", "\n", ", "]).join(parts)))
    rows += [*odd_texts, (None, LINES[0]), (None, None), (5000, " ".join(LINES * 60))]
    got = compared(make_docs(rows), rows)
    text = dict(rows)[5000]
    assert all(text[d.start : d.stop].translate(UPPER)[:3] in text.translate(UPPER) for d in got[5000].detections)


def test_digest_of_the_contract(make_docs):
    rows = [(1, LINES[0]), (2, LINES[3]), (3, "no licence at all, mit Absicht"), (4, None), (5, "MIT license; mit-license! gnu general public license"), (6, "Licensed under the Some Odd Community License")]
    got = {r.doc_id: r for r in license_digest(make_docs(rows)).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels, got[1].labels) == (1, 3, 3, "apache", "apache,apache-2.0")
    assert (got[2].base_labels, got[2].labels) == ("cc-by", "cc-by,cc-by-nc-4.0")
    assert (got[3].n_base, got[3].first_word, got[3].last_word, got[3].base_labels, got[3].labels, got[3].score) == (0, None, None, "", "", 0.0)
    assert (got[4].n_words, got[4].n_base, got[4].labels) == (0, 0, "")
    assert (got[5].n_words, got[5].n_base, got[5].first_word, got[5].last_word, got[5].base_labels) == (8, 3, 0, 4, "gpl,mit")
    assert (got[6].n_base, got[6].labels) == (0, "other-license") and got[6].score == 0.4
    assert all(0 <= r.score <= 1 for r in got.values())


def sample(rng, parsed):
    """A random text that a parsed pattern matches."""
    out = ""
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            out += chr(arg)
        elif name == "NOT_LITERAL":
            out += "q"
        elif name == "IN":
            kind, value = rng.choice(arg)
            out += {"LITERAL": lambda v: chr(v), "RANGE": lambda v: chr(rng.randint(*v)), "CATEGORY": lambda v: "7"}[str(kind)](value)
        elif name == "BRANCH":
            out += sample(rng, rng.choice(arg[1]))
        elif name == "SUBPATTERN":
            out += sample(rng, arg[3])
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            out += "".join(sample(rng, arg[2]) for _ in range(rng.randint(arg[0], min(arg[1], arg[0] + 2))))
        else:
            assert name in ("ASSERT", "ASSERT_NOT"), name
    return out


def test_gates_never_hide_a_match():
    """Random texts of each rule's own pattern: the gate lets the rule through."""
    rng, scanner, wrong = random.Random(2), li.Scanner(RULES), set()
    for k, r in enumerate(RULES):
        tree = re._parser.parse(r.pattern.pattern.decode("latin-1"))
        for _ in range(30):
            text = sample(rng, tree).encode("latin-1")
            assert r.pattern.search(b" " + text + b" "), (r.name, text)
            if k not in {of for *_, of in scanner.matches(text.split())}:
                wrong.add((r.name, text))
    assert not wrong, sorted(wrong)[:20]


def test_empty_table_and_own_rules(spark, make_docs):
    assert li.scan_licenses(make_docs([])).collect() == []
    own = (lr.Rule("a", "first", lr.NAME, re.compile(rb"(?<= )red stone(?= )"), (frozenset([b"red"]),)), lr.Rule("b", "second", lr.TAG, re.compile(rb"(?<= )stone(?= )"), (frozenset([b"stone"]),)))
    df = spark.createDataFrame([("k", "Red stone, red.")], "name string, body string")
    assert [[d.label for d in r.detections] for r in li.scan_licenses(df, "name", "body", own).collect()] == [["second"]]


def test_surest_detection_of_each_label(spark):
    rows = [([("x", 0.5), ("x", 0.8), ("y", 0.5), ("y", 0.5)],), ([],)]
    df = spark.createDataFrame(rows, "d array<struct<label:string,sure:double>>")
    assert [round(r.s, 9) for r in df.select(li.sureness(F.col("d")).alias("s")).collect()] == [0.9, 0.0]
