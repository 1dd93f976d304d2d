"""Line dedup over windows of three consecutive lines.

Lines are split at ``\\n``; a line without a word is never part of a window and is kept, so windows are runs of
``window`` neighbouring lines that have words. Windows that occur more than once, in one document or in several, keep
their first occurrence by (doc_id, place); each later occurrence covers its lines, and covered lines are removed.
Texts that share a doc_id are told apart by two 64-bit hashes, by which they come in order within that doc_id.
Windows are judged on the input, not on what is left.

A window travels as two 64-bit hashes and its place. Occurrences are counted with a combine before the shuffle, so a
window in very many documents costs one row for each task, and the join back to occurrences is of the kind that
adaptive execution splits.

Edge cases: null and empty texts have no lines with words and come back as the empty text; fewer than ``window``
lines with words lose nothing; rows that repeat a doc_id and its text are one document and stay alike; different texts
under one doc_id, null or not, are different documents; a null doc_id is last in the order. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.llm.common import let

WINDOW = 3
HAS_WORD = "[^\\x20\\x09-\\x0D]"


def _numbered_of(lines: Column) -> Column:
    """Of all lines, those with a word, each with its place."""
    return F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("at"), x.alias("line"))), lambda x: x["line"].rlike(HAS_WORD))


def _numbered(text: Column) -> Column:
    return _numbered_of(F.split(F.coalesce(text, F.lit("")), "\n"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, carried columns, n_lines (with words), n_removed and kept_text, the kept lines joined by ``\\n``."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("doc_text"), F.struct(*[F.col(c) for c in carry] or [F.lit(0)]).alias("carried"))
    texts = texts.withColumn("t1", F.xxhash64("doc_text")).withColumn("t2", F.xxhash64(F.lit(window), "doc_text"))
    def window_hashes(lines: Column) -> Column:
        def at(start: Column) -> Column:
            return let(F.array_join(F.slice(lines, start + 1, window), "\n"), lambda x: F.struct(start.alias("start"), F.xxhash64(x).alias("k1"), F.xxhash64(F.lit(window), x).alias("k2")))

        return F.when(F.size(lines) >= window, F.transform(F.sequence(F.lit(0), F.size(lines) - window), at))

    lines = texts.select("doc_id", "t1", "t2", let(F.transform(_numbered(F.col("doc_text")), lambda x: x["line"]), window_hashes).alias("w"))
    windows = lines.select("doc_id", "t1", "t2", F.explode("w").alias("w")).select("doc_id", "t1", "t2", "w.*")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t1", "t2", "start")
    repeated = windows.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min(order).alias("first")).where("n > 1").drop("n")
    later = windows.join(repeated, ["k1", "k2"]).where(order > F.col("first"))
    covered = later.groupBy("doc_id", "t1", "t2").agg(F.collect_set("start").alias("starts"))
    joined = texts.join(covered.withColumnRenamed("doc_id", "covered_id"), F.col("doc_id").eqNullSafe(F.col("covered_id")) & (texts["t1"] == covered["t1"]) & (texts["t2"] == covered["t2"]), "left")
    spans = F.transform(F.coalesce("starts", F.array().cast("array<int>")), lambda s: F.sequence(s, s + (window - 1)))

    def keep(all_lines: Column) -> Column:
        """The lines left, those with words counted by their place among such lines."""
        return let(F.struct(all_lines.alias("all"), _numbered_of(all_lines).alias("numbered"), F.array_distinct(F.flatten(spans)).alias("gone")), lambda v: let(
            F.array_except(F.sequence(F.lit(0), F.size(v["all"]) - 1), F.transform(v["gone"], lambda g: v["numbered"][g]["at"])),
            lambda places: F.struct(
                F.size(v["numbered"]).cast("long").alias("n_lines"),
                F.size(v["gone"]).cast("long").alias("n_removed"),
                F.array_join(F.transform(places, lambda i: v["all"][i]), "\n").alias("kept_text"),
            ),
        ))

    found = joined.select("doc_id", "carried", let(F.split(F.coalesce("doc_text", F.lit("")), "\n"), keep).alias("r"))
    return found.select("doc_id", *[F.col("carried")[c].alias(c) for c in carry], "r.*")
