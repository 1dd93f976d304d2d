"""Quality rules with a hashed n-gram likelihood ratio, in DataFrame functions only.

The character n-grams at the start and at the end of every word and the one across every gap between two words (the end of one
word and the start of the next) are hashed into ``buckets``: dense enough that a small corpus says something of texts it has not seen, which n-grams of whole words do not. Two smoothed multinomials are counted, one of
trusted texts (the target) and one of all texts (the raw corpus), and a text's verdict is the mean over its n-grams of
ln(target / raw): the sum of log-likelihood ratios, normalised by length. Texts at or above ``threshold`` are kept
unless a base rule fails; the threshold decides every document alike.

The trusted texts are all documents labelled good; the raw counts and the verdicts take all documents. The ids of the
trusted grow with the corpus, so they meet the texts by a shuffle; rows without doc_id are never trusted and stay out
of it. The bucket table is one array literal of fixed size; each document's n-grams
are looked up and summed within its row, so no row of the corpus moves for its verdict.

Edge cases: null, empty and blank texts have no words, fail the base rules and have ratio 0; without trusted texts
every ratio is 0; rows that repeat a doc_id each get a result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.llm.common import let

BUCKETS, PRIOR, THRESHOLD = 1 << 16, 4096.0, -1.0
GRAM, GAP = 3, 2
LEAST_WORDS, MOST_REPEATED = 50, 50
SYMBOLS = "[#*$%&|<>]"


def _words(text: Column) -> Column:
    """Words of a text in order, without a function for each of them: a split leaves nothing but empty ends besides."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), "")


def _covered(w: Column) -> Column:
    """Words inside windows of three words that the text has twice or more, the first occurrence included."""
    n = F.size(w)
    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def of_sorted(s: Column) -> Column:
        same = lambda k, d: F.coalesce(F.get(s, k)["h"] == F.get(s, k + d)["h"], F.lit(False))
        marked = F.array_compact(F.transform(s, lambda x, k: F.when(same(k, -1) | same(k, 1), x["i"])))
        return let(F.sort_array(marked), lambda p: F.aggregate(
            F.transform(p, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1), F.lit(2**30)) - i)), F.lit(0).cast("long"), lambda a, x: a + x,
        ))

    def checked(h: Column) -> Column:
        # Most texts repeat no window: then no window is sorted with its place.
        placed = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(F.sort_array(placed), of_sorted))

    return F.when(n < 3, F.lit(0).cast("long")).otherwise(let(hashes, checked))


def base_counts(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the words themselves."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return let(_words(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.regexp_replace(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _covered(w).alias("n_repeat_words"),
        w.alias("w"),
    ))


def _grams(x: Column, before: Column, buckets: int) -> tuple[Column, Column, Column]:
    """Buckets of a word: of the ``GRAM`` characters that begin it, of those that end it, and of the ``GAP`` on both sides of the gap after the word ``before``."""
    place = lambda *c: F.pmod(F.xxhash64(*c), F.lit(buckets)).cast("int")
    return place(F.left(x, F.lit(GRAM))), place(F.right(x, F.lit(GRAM)), F.lit(1)), place(F.right(before, F.lit(GAP)), F.left(x, F.lit(GAP)))


def bucket_ratios(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, ratio): ln of the smoothed share of the bucket among trusted texts over that among all texts."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("doc_text"))
    good = trusted.select(F.col(id_col).alias("doc_id"), F.lit(1).alias("good")).hint("shuffle_hash")
    flagged = texts.where("doc_id IS NOT NULL").join(good, "doc_id", "left").unionByName(texts.where("doc_id IS NULL").withColumn("good", F.lit(0)))
    pairs = let(_words(F.col("doc_text")), lambda w: F.arrays_zip(w.alias("x"), F.concat(F.array(F.lit(None).cast("string")), w).alias("before")))
    # Rows of (word, word before it): what follows is compiled, not run for each element of an array. The last has no word.
    one = flagged.select(F.coalesce("good", F.lit(0)).alias("good"), F.inline(pairs).alias("x", "before")).where("x IS NOT NULL")
    begins, ends, gap = _grams(F.col("x"), F.col("before"), buckets)
    # The first word of a text has no gap before it.
    grams = one.select("good", F.explode(F.array(begins, ends, F.when(F.col("before").isNotNull(), gap))).alias("bucket")).where("bucket IS NOT NULL")
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("good").alias("target"))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").fillna(0, ["raw", "target"])
    totals = every.agg(F.sum("raw").alias("all_raw"), F.sum("target").alias("all_target"))
    raw = (F.col("raw") + 1.0) / (F.col("all_raw") + float(buckets))
    # The target leans on the raw corpus by PRIOR grams, so a bucket about which it says little has a ratio near 0.
    target = (F.col("target") + PRIOR * raw) / (F.col("all_target") + PRIOR)
    ratio = F.when(F.col("all_target") == 0, 0.0).otherwise(F.ln(target / raw))
    return every.withColumn("one", F.lit(1)).join(F.broadcast(totals.withColumn("one", F.lit(1))), "one").select("bucket", ratio.alias("ratio"))


def trusted_ids(labels: DataFrame, id_col: str = "doc_id", quality_col: str = "quality") -> DataFrame:
    """The ids of all documents labelled good."""
    return labels.where(F.col(quality_col) == 1).select(id_col).distinct()


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the base counts, base_failed, ratio and kept, for every row."""
    found = bucket_ratios(docs, trusted_ids(labels, id_col), id_col, text_col, buckets).agg(F.array_sort(F.collect_list(F.struct("bucket", "ratio"))).alias("t")).first()["t"]
    # ``buckets`` numbers, whatever the corpus: folded into one array literal.
    table = F.from_json(F.lit("[" + ",".join(repr(x["ratio"]) for x in found) + "]"), "array<double>")
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def judged(t: Column) -> Column:

        def each(w: Column) -> Column:
            def of(x: Column, k: Column) -> Column:
                begins, ends, gap = _grams(x, F.get(w, k - 1), buckets)
                return F.get(t, begins) + F.get(t, ends) + F.when(k > 0, F.get(t, gap)).otherwise(0.0)

            return F.transform(w, of)

        total = lambda w: F.aggregate(each(w), F.lit(0.0), lambda s, x: s + x)
        mean = lambda w: F.when(F.size(w) > 0, total(w) / (3 * F.size(w) - 1)).otherwise(0.0)
        return let(base_counts(F.col(text_col)), lambda b: F.struct(*[b[c].alias(c) for c in base], mean(b["w"]).alias("ratio")))

    rows = docs.select(F.col(id_col).alias("doc_id"), let(table, judged).alias("r")).select("doc_id", "r.*")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return rows.withColumn("base_failed", failed).select("doc_id", *base, "base_failed", (~failed & (F.col("ratio") >= threshold)).alias("kept"), "ratio")
