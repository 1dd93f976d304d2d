"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input.

1. language  - documents whose language is rejected go (unknown, or far from every language's usual cross-entropy)
2. lines     - later occurrences of windows of three lines go; a document that had words and has none left goes
3. near      - of each group of near-duplicates (shingles of five words, similarity 0.8) the document with the smallest doc_id stays
4. benchmark - documents that hold a window of a benchmark item go
5. mix       - documents with how often the mix to target weights takes them

All stages but the last return the columns of ``documents``; n_chars follows the text. A row is a document of its own:
rows that repeat a doc_id with other texts, or have none, are told apart by their texts. Rows that repeat doc_id and text
are one document for stage 3, of which the first by the other columns stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patronage.llm.common import scratch, stash, text_marks
from patronage.llm.decontaminate import decontaminate
from patronage.llm.langid import identify
from patronage.llm.lines import line_dedup
from patronage.llm.mixing import mix_sources
from patronage.llm.simhash import near_groups

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return identify(docs, keep=list(COLUMNS)).where("accepted").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    has_word = "[^\\x20\\x09-\\x0D]"
    marked = docs.withColumn("no_text", F.col("text").isNull()).withColumn("no_word", ~F.coalesce(F.col("text").rlike(has_word), F.lit(False)))
    kept = line_dedup(marked, carry=("lang", "source", "n_chars", "no_text", "no_word"))
    left = kept.where(F.col("no_word") | F.col("kept_text").rlike(has_word))
    chars = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return left.select("doc_id", F.when(~F.col("no_text"), F.col("kept_text")).alias("text"), "lang", "source", chars.alias("n_chars"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    heads = stash(near_groups(docs).where("stays").select(F.col("doc_id").alias("head"), F.col("t1").alias("head_t1"), F.col("t2").alias("head_t2"), (F.col("copies") > 1).alias("again")), "heads")
    t1, t2 = text_marks(F.col("text"))
    same = F.col("doc_id").eqNullSafe(F.col("head")) & (t1 == F.col("head_t1")) & (t2 == F.col("head_t2"))
    stays = lambda which: docs.select(*COLUMNS).join(heads.where(which), same, "left_semi")
    if heads.where("again").isEmpty():
        return stays(F.lit(True))
    # Only rows that repeat a doc_id and its text are aggregated, within the tasks first.
    marks = [x.alias(k) for k, x in zip(("t1", "t2"), (t1, t2), strict=True)]
    first = stays(F.col("again")).groupBy("doc_id", *marks).agg(F.min(F.struct(*COLUMNS[1:])).alias("row")).select("doc_id", "row.*")
    return stays(~F.col("again")).unionByName(first)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate(docs, items, carry=("text", "lang", "source", "n_chars")).where("NOT contaminated").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = mix_sources(docs)
    keys = ("doc_id", "source", "t1", "t2")
    figures = ("size", "source_size", "target", "taken", "copies")
    taken = found.dropDuplicates(list(keys)).select(*[F.col(k).alias(f"of_{k}") for k in keys], *figures)
    t1, t2 = text_marks(F.col("text"))
    same = F.col("doc_id").eqNullSafe(F.col("of_doc_id")) & F.col("source").eqNullSafe(F.col("of_source")) & (t1 == F.col("of_t1")) & (t2 == F.col("of_t2"))
    return docs.select(*COLUMNS).join(taken, same, "left").select(*COLUMNS, *figures)


STAGES = [("language", language), ("lines", lines), ("near", near), ("benchmark", benchmark), ("mix", mix)]

#: The SimHash, the character models and the cube method have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
