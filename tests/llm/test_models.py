"""Classifiers: language, quality, page text; held-out accuracy and odd input."""

import random

import numpy as np
from patronage.llm import html_content, quality_gam
from patronage.llm.labelled_pages import PAGES
from patronage.llm.langid import Model, identify
from patronage.llm.target_ratio import quality_rules
from tests.conftest import SMALL


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = identify(docs, keep=["doc_id", "lang"]).where("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.98
    assert np.mean([r.accepted for r in got]) > 0.98


def test_language_of_odd_texts(make_docs, odd_texts):
    train = [(1000 + k, "das ist der Hund und die Katze " * 4) for k in range(40)]
    got = {r.doc_id: r for r in identify(make_docs(odd_texts + train + [(9, "12 34 !!")])).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and not got[i].accepted for i in (1, 2, 3, 9))
    assert got[5].lang_pred == "en" and 0 <= got[5].score <= 1
    assert identify(make_docs([])).collect() == []


def test_kneser_ney_sums_to_one(spark):
    from patronage.llm import langid

    rng = random.Random(1)
    rows = [("".join(rng.choice("abcd ") for _ in range(300)), "x", k) for k in range(30)]
    model, _ = langid.train(spark.createDataFrame(rows, "text string, lang string, doc_id long"))
    assert isinstance(model, Model) and model.langs == ["x"]
    context = [*map(ord, "abc")]
    total = 0.0
    for c in [0, *map(ord, "abcd")]:
        found = [langid._hashes(np.array([[*context, c]], np.uint64), n) for n in range(1, 5)]
        total += float(np.exp(-model.surprise([x[0] for x in found], [x[1] for x in found])[0, 0]))
    assert 0.8 < total <= 1.0001


def brute_kneser_ney(texts, order=4):
    """-ln p of every character of a text by the textbook recursion, from plain dictionaries."""
    from collections import Counter

    def chars(t):
        words = "".join(c if c.isalpha() else " " for c in t.lower()).split()
        return [0] * (order - 1) + [x for w in words for x in [*map(ord, w), 0]]

    raw = Counter(tuple(s[i - n + 1 : i + 1]) for t in texts for s in [chars(t)] for i in range(order - 1, len(s)) for n in [order])
    lower = {n: Counter() for n in range(1, order)}
    seen = {n: {tuple(s[i - n + 1 : i + 1]) for t in texts for s in [chars(t)] for i in range(order - 1, len(s))} for n in range(1, order + 1)}
    for n in range(1, order):
        for g in seen[n + 1]:
            lower[n][g[1:]] += 1
    table = {**lower, order: raw}

    def p(gram):
        n = len(gram)
        if n == 0:
            return 1.0 / (2 * len(table[1]) + 2)
        counts = table[n]
        once, twice = (sum(v == k for v in counts.values()) for k in (1, 2))
        cut = once / (once + 2 * twice) if once + twice else 0.5
        of = {g: v for g, v in counts.items() if g[:-1] == gram[:-1]}
        if not of:
            return p(gram[1:])
        return max(counts.get(gram, 0) - cut, 0) / sum(of.values()) + cut * len(of) / sum(of.values()) * p(gram[1:])

    def entropy(t):
        s = chars(t)
        found = [-np.log(p(tuple(s[i - order + 1 : i + 1]))) for i in range(order - 1, len(s))]
        return sum(found) / len(found), len(found)

    return entropy


def test_kneser_ney_matches_brute_force(spark):
    from patronage.llm import langid

    texts = ["der Hund, die Katze und das Haus", "Die Maus im Haus", "und der Hund", "Katze 12 im Haus!"]
    learn = spark.createDataFrame([(t, "de", k) for k, t in enumerate(texts)], "text string, lang string, doc_id long")
    held = {r.doc_id for r in learn.selectExpr("doc_id", "pmod(xxhash64(xxhash64(doc_id, 7)), 10) = 0 AS held").collect() if r.held}
    model, _ = langid.train(learn)
    entropy = brute_kneser_ney([t for k, t in enumerate(texts) if k not in held])
    for t in ["das ist die Maus", "Hund", "  Zebra -- 7", *texts]:
        got, n = model.entropies([t, None, "12 !"])
        want, m = entropy(t)
        assert n.tolist() == [m, 0, 0] and np.isclose(got[0, 0], want, rtol=1e-5)


def test_steps_do_not_show():
    """Cut anywhere, a text is the same characters with the same contexts."""
    from patronage.llm import langid

    for t in ("Das, ist... ein\n\nSATZ  mit \U0001d538 und \U0001f600 am Ende!", "abc", "  a", "a  ", "", "1 2", "x" * 50):
        whole = [x.tolist() for x in langid._tails([*langid._steps(t)])] if [*langid._steps(t)] else []
        for most in (1, 2, 3, 7):
            cut = [*langid._steps(t, most)]
            assert ([x.tolist() for x in langid._tails(cut)] if cut else []) == whole


def test_und_without_letters(make_docs):
    train = [(1000 + k, "das ist der Hund und die Katze " * 4) for k in range(40)]
    odd = [(1, "\U0001f600 \U0001f680\U0001f600"), (2, "\U0001d7d8\U0001d7d9"), (3, "\u0661\u0662"), (4, "\U00020000\U00020001"), (5, None), (None, "Hund"), (None, "!")]
    got = [(r.doc_id, r.lang_pred) for r in identify(make_docs(odd + train)).collect() if (r.doc_id or 0) < 1000]
    assert sorted(got, key=str) == sorted([(1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "und"), (None, "en"), (None, "und")], key=str)


def test_quality_held_out_accuracy(spark, make_docs, odd_texts):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality_gam.train(docs, labels.where(quality_gam.learnable()))
    got = quality_gam.score(docs, model).join(labels.where(~quality_gam.learnable()), "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.95
    odd = quality_gam.score(make_docs(odd_texts), model).collect()
    assert len(odd) == len(odd_texts) and all(0 <= r.score <= 1 for r in odd)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality_gam.score(make_docs(odd_texts), quality_gam.train(make_docs(odd_texts), none)).collect()} == {0.5}


def test_quality_pairs_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_gam.fit(x, y)
    assert (0, 1) in model.pairs and np.mean((model.scores(x) > 0.5) == y) > 0.95


def test_rules_on_odd_texts(spark, make_docs, odd_texts):
    labels = spark.createDataFrame([(6, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_rules(make_docs(odd_texts), labels).collect()}
    assert (got[1].n_words, got[1].base_failed, got[1].kept, got[1].ratio) == (0, True, False, 0.0)
    assert (got[5].n_words, got[5].n_repeat_words, got[5].base_failed) == (60_000, 60_000, True)
    assert quality_rules(make_docs(odd_texts), labels).count() == len(odd_texts)
    assert quality_rules(make_docs([]), labels).collect() == []


def test_all_good_labels_are_trusted(spark):
    """Each of 25,000 good texts is one word of its own: none may count as if it were untrusted."""
    docs = spark.range(25_000).selectExpr("id AS doc_id", "lpad(conv(id, 10, 36), 3, '_') AS text")
    labels = docs.selectExpr("doc_id", "1 AS quality")
    assert quality_rules(docs, labels).agg({"ratio": "min"}).first()[0] > -0.5


def test_pages(spark):
    model = html_content.train()
    right = wrong = 0
    for page in PAGES:
        nodes = html_content.parse(page)
        html_content.features(nodes)
        for n, p in zip(nodes, model.marginals(nodes), strict=True):
            if n.tag == "#":
                right, wrong = right + ((p >= 0.5) == n.marked), wrong + ((p >= 0.5) != n.marked)
    assert right / (right + wrong) > 0.95
    cases = [(1, "u", None), (2, "u", ""), (3, None, "plain &amp; simple\n text"), (4, "u", "<p>a<p>b <script>x<y</script>c</div>" * 3), (5, "u", "<" * 5000), (5, "u", "<div>" * 3000 + "deep text here")]
    df = spark.createDataFrame([(*c, "x") for c in cases], "page_id long, url string, html string, text string")
    got = html_content.extract_text(df, model).collect()
    assert len(got) == len(cases)
    by = {r.page_id: r for r in got if r.page_id < 5}
    assert by[1].text == by[2].text == "" and by[3].n_chars == len(by[3].text)
    assert html_content.parse("plain &amp; simple\n text")[1].text == "plain & simple text"


def test_held_out_layouts():
    """Each hand-labelled layout by a model of the others."""
    right = total = 0
    for k, page in enumerate(PAGES):
        model = html_content.fit([html_content.parse(p) for j, p in enumerate(PAGES) if j != k for _ in range(html_content.COPIES)])
        nodes = html_content.parse(page)
        html_content.features(nodes)
        found = [(p >= 0.5) == n.marked for n, p in zip(nodes, model.marginals(nodes), strict=True) if n.tag == "#"]
        right, total = right + sum(found), total + len(found)
    assert right / total > 0.9


def test_blocks_of_a_page():
    texts = lambda page: [n.text for n in html_content.parse(page) if n.tag == "#"]
    assert texts("<p>The sum <math><mi>a</mi>&plus;<mi>b</mi></math> is<script>x < y</script> small<!-- no --> &amp;\n so</p>") == ["The sum a+b is small & so"]
    assert texts("<ul><li>a<li>b <b>c</ul>d") == ["a", "b c", "d"]
    assert texts("<table><tr><td>a<td>b<tr><td>c</table>") == ["a", "b", "c"]
    assert texts("a<br>b<hr>c</b></i><i>d<div>e</i>f</div>") == ["a b", "cd", "ef"]
    assert texts("<p title='a>b'>c</p><p title='d>e</p>") == ["c", "e"]
    assert texts("<select><option>no</select>yes <svg><text>no</text></svg>too") == ["yes too"]


def test_bare_and_cued_text_is_kept():
    model = html_content.train()
    long = "Some bare text that is the whole article and goes on for a while, with commas and such, to the end."
    for page in (f"<html><body>{long}</body></html>", f"<main><div class='legal'><p>{long}</p></div></main>", f"<p>{long}</p>", long):
        assert html_content.main_text(page, model) == long


def test_the_only_block_of_a_page_is_its_text():
    model = html_content.train()
    long = "Filling the form needs care, since the office returns each one that lacks a date, a name or a stamp."
    assert html_content.main_text("<html><body><div class=x><p>Short.</p></div></body></html>", model) == "Short."
    assert html_content.main_text(f'<div class="form-guide content"><p>{long}</p></div>', model) == long
    assert html_content.main_text("<body><nav><a href=x>Home</a></nav></body>", model) == ""
    assert html_content.main_text("<body><script>x = 1</script><p> \n </p></body>", model) == ""


def test_a_language_of_few_long_documents_is_learned(spark):
    """Two documents beyond the bound of characters: one is drawn, whatever their hashes."""
    from unittest import mock

    from patronage.llm import langid

    rows = [(k, "the cat and the dog sat on the old mat near the door " * 3, "en") for k in range(30)] + [(900 + k, "zwölf boxkämpfer jagen viktor quer über den großen sylter deich " * 40, "de") for k in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    with mock.patch.object(langid, "LANGUAGE_CHARS", 50):
        for seed in range(3):
            model, _ = langid.train(df, seed=seed)
            assert set(model.langs) == {"de", "en"}


def test_parsing_is_linear():
    import time

    model = html_content.train()
    n = 40_000
    began = time.time()
    for page in ("<div>" * n, '<a "' * n, "<a 'x' " * n + '">"', "<b>" * n + "</i>" * n, "<i><div>" + "<b></i>" * n, "<ul>" + "<b>" * n + "<li>x" * n, "<!--" * n):
        html_content.main_text(page, model)
    assert time.time() - began < 40


def test_marginals_match_enumeration():
    import itertools

    model = html_content.Model({}, {("root", "box"): ((0.7, 0.3), (0.2, 0.8)), ("box", "text"): ((0.9, 0.1), (0.4, 0.6))})
    nodes = html_content.parse("<div>one</div><div>two<p>x</p></div>")
    html_content.features(nodes)
    model.weights = {name: (hash(name) % 7 - 3) / 3 for n in nodes for name in n.own}
    got = model.marginals(nodes)
    own = [1 / (1 + np.exp(-model.trust * sum(model.weights[x] for x in n.own))) for n in nodes]
    total, good = 0.0, np.zeros(len(nodes))
    for y in itertools.product((0, 1), repeat=len(nodes)):
        p = 1.0
        for k, n in enumerate(nodes):
            p *= own[k] if y[k] else 1 - own[k]
            if k:
                p *= model.edges.get((nodes[n.parent].kind, n.kind), ((0.9, 0.1), (0.1, 0.9)))[y[n.parent]][y[k]]
        total += p
        good += p * np.array(y)
    assert np.allclose(got, good / total)


def test_small_tables_run(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    assert html_content.extract_text(pages, html_content.train(pages)).count() == pages.count()
