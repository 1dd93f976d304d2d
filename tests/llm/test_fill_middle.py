"""Fill-in-middle against plain Python over code points, and the exact round trip."""

import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from patronage.llm import fill_middle as fm
from patronage.llm.common import text_bytes


def brute(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output) of a row."""
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def check(docs, rows):
    made = fm.fill_in_middle(docs, carry=("lang", "size"))
    got = made.withColumn("back", fm.restored(F.col("output"), F.col("form"))).collect()
    have = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in got), key=str)
    assert have == sorted(((i, *brute(i, t), t or "") for i, t in rows), key=str)
    return got


def test_matches_brute_force(make_docs, odd_texts):
    rng = random.Random(11)
    letters = "ab é漢😀́\n<>PSM "
    rows = [(k, "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))) for k in range(100, 700)]
    rows += [*odd_texts, (None, "no id, 漢字"), (None, None), (800, "<P>"), (801, "a<S>"), (802, "x<M>y"), (803, "<<P<S<M"), (804, "😀" * 50_000), (805, "x" * (1 << 20) + "漢"), (806, "\x00\x00\x00")]
    got = check(make_docs(rows), rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert {(r.lang, r["size"]) for r in got} == {("en", "x")}


def test_each_form_rejoins_parts_that_look_like_markers(make_docs):
    rows = [(k, t) for k, t in enumerate(["<<S", "<P<S<M<", "S>P>M>", "<", ">", "<P >"] * 40)]
    check(make_docs(rows), rows)


def test_empty_table_and_other_ids(spark, make_docs):
    assert fm.fill_in_middle(make_docs([])).collect() == []
    df = spark.createDataFrame([("k1", "häh"), ("", "x y")], "name string, body string")
    got = {r.doc_id: (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in fm.fill_in_middle(df, "name", "body").collect()}
    assert got == {"k1": brute("k1", "häh"), "": brute("", "x y")}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=("Cs",)), max_size=20), min_size=1, max_size=8))
def test_places_of_code_points(texts):
    import pyarrow as pa

    data, offs = text_bytes(pa.array(texts, pa.string()))
    units = fm.Units(data)
    whole = "".join(texts)
    assert units.count(offs).tolist() == np.cumsum([0, *map(len, texts)]).tolist()
    assert units.place(np.arange(len(whole) + 1)).tolist() == [len(whole[:k].encode()) for k in range(len(whole) + 1)]
