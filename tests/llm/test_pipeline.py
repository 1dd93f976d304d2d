import random

import corpus_pipeline
from tests.conftest import SMALL


def test_stages_keep_columns_and_decisions(spark, tmp_path):
    base = spark.read.parquet(f"{SMALL}/documents.parquet")
    clean = base.where("length(text) > 300").limit(40).selectExpr("doc_id + 5000 AS doc_id", "text", "lang", "source", "n_chars")
    leak = spark.read.parquet(f"{SMALL}/benchmark.parquet").where("length(text) > 150").limit(1).selectExpr("CAST(90000 AS BIGINT) AS doc_id", "concat('Vor ', text, ' nach') AS text", "'en' AS lang", "'s' AS source", "CAST(1 AS BIGINT) AS n_chars")
    docs = base.select(*corpus_pipeline.COLUMNS).unionByName(clean).unionByName(leak)
    left = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, SMALL).write.parquet(path)
        docs = spark.read.parquet(path)
        left.append(docs.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    assert left == sorted(left, reverse=True) and left[-1] > 0
    assert docs.where("doc_id = 90000").isEmpty()
    assert docs.where("doc_id BETWEEN 5000 AND 6000").count() <= 1  # copies went by lines or as near-duplicates
    assert "taken" in docs.columns


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select(*corpus_pipeline.COLUMNS).where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SMALL).count() == 0


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "text").collect()), key=str)


def test_stages_match_brute_force(spark, make_docs, odd_texts):
    """Each middle stage against the plain versions of its operator, on rows with repeats, odd texts and clashing columns."""
    from test_decontaminate import brute as leaks
    from test_lines import brute as lines
    from test_simhash import brute_near, edited

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    long = next(t for _, t in items if len((t or "").split()) > 12)
    same = " ".join(f"word{k}" for k in range(80))
    texts = [t for i, t in odd_texts if i != 5] + ["a\nb\nc\nd", "x\na\nb\nc\ny", "a\nb\nc", same, same + " end", edited(random.Random(4), same, 0.015), "before " + long + " after", "A\nB\nC"]
    rows = list(enumerate(texts, 20)) + [(90, "one two\nthree"), (90, "four five six"), (90, "four five six")]
    docs = make_docs(rows)
    kept = lines(list(enumerate(texts, 20)))
    blank = lambda t: not (t or "").strip(" \t\n\x0b\x0c\r")
    want = [(i, t if t is None else kept[i][2]) for i, t in enumerate(texts, 20) if blank(t) or not blank(kept[i][2])]
    assert rows_of(corpus_pipeline.lines(spark, docs.where("doc_id <> 90"), SMALL)) == sorted(want, key=str)

    stay = sorted({rows[k] for k in brute_near(rows)}, key=str)
    assert (90, "one two\nthree") in stay and rows.count((90, "four five six")) == 2  # other texts of one id are other documents
    assert len(stay) < len(rows) - 3 and rows_of(corpus_pipeline.near(spark, docs, SMALL)) == stay

    clean = [(i, t) for i, t in rows if not leaks(t, items)[1]]
    assert len(clean) < len(rows) and rows_of(corpus_pipeline.benchmark(spark, docs, SMALL)) == sorted(clean, key=str)


def test_null_ids_and_repeated_rows_pass_all_stages(spark, make_docs, odd_texts):
    german = [(None, "das ist der Hund und die Katze " * 4 + "\nmit Haus"), (300, None)] + [(1000 + k, f"das ist der Hund {k} und die Katze {k * 7} im Haus {k * k} " * 3) for k in range(40)]
    docs = make_docs(odd_texts + german)
    left = docs.count()
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
        assert 0 < docs.count() <= left
        left = docs.count()
    assert docs.where("doc_id IS NULL").count() <= 1 and docs.where("doc_id = 300").isEmpty()


def test_near_keeps_each_text_without_id(spark, make_docs):
    """Rows without doc_id that are no near copies all stay; near copies of a document with a doc_id go, with or without one."""
    texts = [" ".join(f"w{k}x{j}" for j in range(60)) for k in range(4)]
    rows = [(5, texts[0]), (None, texts[0]), *[(None, x) for x in texts[1:]], (None, texts[1])]
    want = [(5, texts[0]), *[(None, x) for x in texts[1:]]]
    assert rows_of(corpus_pipeline.near(spark, make_docs(rows), SMALL)) == sorted(want, key=str)
    assert rows_of(corpus_pipeline.near(spark, make_docs(rows[:-1]), SMALL)) == sorted(want, key=str)


def test_mix_gives_every_row_its_own_figures(spark, make_docs):
    """Rows of one doc_id with other texts, and without doc_id, get the figures of their own text; sums come near the targets."""
    rows = [(None, f"w{k} " * (1 + k % 9)) for k in range(120)] + [(7, "other " * k) for k in range(40)] + [(k, "x " * (k % 40)) for k in range(1000, 1200)]
    got = corpus_pipeline.mix(spark, make_docs(rows), SMALL).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(rows, key=str)
    assert all(r["size"] == len(r.text.split()) and r.taken == r.copies * r["size"] and 0 <= r.copies <= 3 for r in got)
    by = {}
    for r in got:
        by.setdefault((r.source, r.target), []).append(r.taken)
    assert all(abs(sum(v) - target) <= 0.03 * target + 5 for (_, target), v in by.items())


def test_language_stage_keeps_what_is_accepted(spark, make_docs):
    from patronage.llm.langid import identify

    train = [(1000 + k, f"das ist der Hund {k} und die Katze {k * 7} im Haus {k * k} " * 3) for k in range(60)]
    docs = make_docs([*train, (1, None), (2, "\U0001f600"), (None, "das ist die Katze und der Hund im Haus " * 3)])
    want = sorted(((r.doc_id, r.text) for r in identify(docs, keep=["doc_id", "text"]).where("accepted").collect()), key=str)
    got = rows_of(corpus_pipeline.language(spark, docs, SMALL))
    assert got == want and {i for i, _ in got} >= {1000, 1059} and not {i for i, _ in got} & {1, 2}
