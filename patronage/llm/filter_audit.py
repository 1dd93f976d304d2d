"""What each of several filters removes in every order in which they can be applied.

Each document fails some of the filters: a mask of one bit for each filter. Documents are counted by part and mask, and
what is left of the corpus is this table of cells, 2 ** filters rows for each part at most. A recursive common table
expression then walks the orders: from the empty prefix each level extends every prefix by each letter that it does not
have, joins the masks and carries the bits of the filters applied so far, so that a level says of each mask whether that
step keeps it, removes it or finds it gone. The walk is over masks, not over documents or parts, so it has the same
size whatever the corpus; the counts of the cells are joined to it by mask.

Copies are one filter more: a document fails it if a document with a smaller id has the same text, anywhere in the
table. Texts are told apart by two 64-bit hashes. The smallest id of each text is joined back by hashes *and* id, so
that the rows of a text with very many copies spread over the tasks; equal rows are counted before any shuffle.

Edge cases: a null text is an empty one, a null part the empty string; a null id is larger than all others and null ids
are equal; rows that repeat an id and its text do not fail for each other; of repeated label rows the largest value
counts, and labels without an id are left out; an empty table gives no row. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from patronage.llm.common import let, stash, text_marks, words

#: Filters at most: the walk has about e * n! * 2 ** n rows, 125,000 for six.
MOST_FILTERS = 6
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
METRICS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")

WALK = """
WITH RECURSIVE walk(filter_order, letter, bit, before, applied, mask) AS (
  SELECT '', '', 0, 0, 0, mask FROM {masks}
  UNION ALL
  SELECT concat(w.filter_order, f.letter), f.letter, f.bit, w.applied, w.applied | f.bit, m.mask
  FROM walk w JOIN {filters} f ON (w.applied & f.bit) = 0 JOIN {masks} m ON m.mask = w.mask
)
SELECT filter_order, length(filter_order) AS step, letter, mask, (mask & applied) = 0 AS kept, (mask & before) = 0 AND (mask & bit) <> 0 AS removed,
  (mask & before) <> 0 AND (mask & bit) <> 0 AS redundant, mask = bit AS unique_fails
FROM walk WHERE filter_order <> ''"""


def text_fails(text: Column) -> Column:
    """Whether a text fails each of four filters, as an array: few words, few distinct words, many capitals, symbols."""
    t = F.coalesce(text, F.lit(""))
    capitals = F.length(t) - F.length(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return let(words(text), lambda w: F.array(
        F.size(w) < LEAST_WORDS,
        100 * F.size(F.array_distinct(w)) < LEAST_DISTINCT * F.size(w),
        100 * capitals > MOST_CAPITALS * F.length(t),
        t.rlike("[#$%&*|]"),
    ))


def failing(docs: DataFrame, fails: Column, letters: str, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(doc_id, part, mask, rows): documents that are alike in these, with the bit of the last letter set for later copies of a text."""
    t1, t2 = text_marks(F.coalesce(text_col, F.lit("")))
    own = let(fails, lambda f: sum((F.coalesce(F.get(f, F.lit(k)), F.lit(False)).cast("int") * (1 << k) for k in range(len(letters) - 1)), F.lit(0)))
    marks = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), own.alias("own"), t1.alias("t1"), t2.alias("t2"))
    alike = stash(marks.groupBy(*marks.columns).agg(F.count("*").alias("rows")), "filter-marks")
    first = alike.groupBy(F.col("t1").alias("of1"), F.col("t2").alias("of2")).agg(F.min("doc_id").alias("first"))
    is_first = (F.col("t1") == F.col("of1")) & (F.col("t2") == F.col("of2")) & F.col("doc_id").eqNullSafe(F.col("first"))
    last = F.when(F.col("of1").isNull(), 1 << (len(letters) - 1)).otherwise(0)
    return alike.join(first, is_first, "left").select("doc_id", "part", F.col("own").bitwiseOR(last).alias("mask"), "rows")


def mask_cells(masked: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by what they fail, and how many of them are labelled so."""
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg((F.max("quality") == 1).alias("good"), (F.max("toxic") == 1).alias("toxic")).where("good OR toxic")
    unknown = masked.where("doc_id IS NULL").select("*", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    every = masked.where("doc_id IS NOT NULL").join(known, "doc_id", "left").unionByName(unknown)
    of = lambda c: F.coalesce(F.sum(F.when(F.col(c), F.col("rows"))), F.lit(0))
    return every.groupBy("part", "mask").agg(F.sum("rows").alias("n"), of("good").alias("good"), of("toxic").alias("toxic"))


def audit(cells: DataFrame, letters: str) -> DataFrame:
    """One row for each part, order of the filters and step, with ``METRICS`` and shapley: the letter's removals over all orders."""
    if not 1 <= len(letters) <= MOST_FILTERS or len(set(letters)) < len(letters):
        raise ValueError(f"1 to {MOST_FILTERS} filters with letters of their own")
    spark = cells.sparkSession
    cells = stash(cells, "filter-cells")
    filters = spark.createDataFrame([(x, 1 << k) for k, x in enumerate(letters)], "letter string, bit int")
    walk = stash(spark.sql(WALK, masks=cells.select("mask").distinct(), filters=filters), "filter-walk")
    counted = lambda flag, n: F.sum(F.when(F.col(flag), F.col(n)).otherwise(0))
    sums = [counted(m, "n").alias(m) for m in METRICS[:4]] + [counted("removed", n).alias(f"{n}_lost") for n in ("good", "toxic")]
    # The walk has as many rows as filters and masks make, whatever the corpus.
    steps = cells.join(F.broadcast(walk), "mask").groupBy("part", "filter_order", "step", "letter").agg(*sums)
    # A prefix stands for all orders that begin with it.
    orders_of = F.factorial(F.lit(len(letters)) - F.col("step"))
    steps = steps.withColumn("shapley", F.sum(F.col("removed") * orders_of).over(W.partitionBy("part", "letter")))
    whole = walk.where(F.col("step") == len(letters)).select("filter_order").distinct()
    each = whole.select("filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step")).select("*", F.expr("left(filter_order, step)").alias("prefix"))
    prefixes = steps.withColumnRenamed("filter_order", "prefix").drop("step")
    return prefixes.join(F.broadcast(each), "prefix").select("part", "filter_order", "step", *METRICS, "shapley")


def filter_audit(docs: DataFrame, labels: DataFrame, letters: str = "ABCDE", fails: Column | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """The audit of row filters (``fails``, an array of booleans in the order of the letters; ``text_fails`` by default) and, under the last letter, of copies."""
    found = failing(docs, text_fails(F.col(text_col)) if fails is None else fails, letters, id_col, text_col, part_col)
    return audit(mask_cells(found, labels, id_col), letters)
