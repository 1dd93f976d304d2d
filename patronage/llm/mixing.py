"""Mixing sources to target weights by the cube method.

Sources, in code point order with null last, weigh ``weights`` in turn and share the words of all documents; a target
stops at ``most`` times its source's words, and what is over is shared again by weight among the rest until none is
above (a water level over the sources, which rises by sums over them until no more are filled). A source's rate is
target / words. Every document is taken floor(rate) times, and once more if the cube method picks it, with the fraction
as its inclusion probability.

The cube method keeps two totals while it makes the probabilities whole: the number of documents and their words. Its
flight moves three undecided documents along the one direction that changes neither total until one of them is
decided. Flights run in blocks of hashed documents, so a source of any size is many small groups;
the two that a block leaves undecided form new blocks, until one block is left for each source. Its flight stops at
``LANDING`` documents, and of all ways to take or leave these the one that fits the words best, then the number of
documents, is the landing. Draws come from hashes of doc_ids and ``seed``: reruns agree.

Rows with the same doc_id, source and text are one document of several rows for the cube method: what it is taken goes
to its rows as evenly as whole numbers let it, so however many rows are alike, they never crowd a block.

Edge cases: null, empty and blank texts have size 0 and take nothing; a source without words has target 0; rows that
repeat a doc_id with other texts, or have none, are documents of their own; an empty table gives no rows. Other columns
are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from patronage.llm.common import stash, text_marks, words

WEIGHTS, MOST, BLOCK, SEED = (1, 2, 3), 3, 4000, 11
LANDING = 14
#: Rows that one array stands for when alike rows are told apart again.
RUN = 10_000
#: Sources up to this number are broadcast; beyond it Spark joins them by a shuffle.
BROADCAST_SOURCES = 100_000


def _numbered(totals: DataFrame) -> DataFrame:
    """Sources with their number by code point, null last, from 1; ranked within ranges, so by many tasks."""
    spark = totals.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = stash(totals.repartitionByRange(ranges, F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last()).withColumn("range_no", F.spark_partition_id()), "ranges")
    within = placed.withColumn("place", F.row_number().over(W.partitionBy("range_no").orderBy(F.col("source").asc_nulls_last())))
    below, before = {}, 0
    for row in placed.groupBy("range_no").agg(F.count("*").alias("n")).orderBy("range_no").collect():  # a row for each range
        below[row["range_no"]], before = before, before + row["n"]
    first = F.create_map(*[F.lit(x).cast("long") for kv in below.items() for x in kv])[F.col("range_no").cast("long")] if below else F.lit(0)
    return within.withColumn("source_no", (F.col("place") + first).cast("int")).drop("range_no", "place")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_no, source_size, target) from rows of (source, size); one row for each source."""
    numbered = _numbered(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.col("source_no") - 1, F.lit(len(weights))) + 1)
    capped = stash(numbered.withColumn("weight", weight).withColumn("cap", most * F.col("source_size")), "sources")
    total = capped.agg(F.sum("source_size")).first()[0] or 0
    # Sources that the level fills stop at their cap; the rest of all words is the level of the others. It only rises.
    level = 0.0
    while True:
        open_ = F.col("cap") > level * F.col("weight") if level else F.lit(True)
        row = capped.agg(F.sum(F.when(open_, F.col("weight"))).alias("w"), F.sum(F.when(~open_, F.col("cap"))).alias("c")).first()
        new = (total - (row["c"] or 0)) / row["w"] if row["w"] else level
        if new <= level:
            break
        level = new
    return capped.select("source", "source_no", "source_size", F.least(F.col("cap").cast("double"), F.lit(float(level)) * F.col("weight")).alias("target"))


def flight(pi: np.ndarray, size: np.ndarray, draws: np.ndarray, land: bool) -> np.ndarray:
    """Probabilities after the flight over one block: whole but for two of them at most, or all whole after landing."""
    pi = pi.astype(float).tolist()
    x = size.astype(float).tolist()
    draws = draws.tolist()
    todo = [k for k, p in enumerate(pi) if 0.0 < p < 1.0]
    todo.reverse()
    eps, live, at = 1e-9, [], 0
    while True:
        while len(live) < 3 and todo:
            live.append(todo.pop())
        if len(live) < 3 or land and len(live) + len(todo) <= LANDING:
            break
        a, b, c = live
        u = (x[b] - x[c], x[c] - x[a], x[a] - x[b])
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = min((1 - pi[k]) / d if d > 0 else -pi[k] / d for k, d in zip(live, u, strict=True) if d)
        down = min(pi[k] / d if d > 0 else (pi[k] - 1) / d for k, d in zip(live, u, strict=True) if d)
        step = up if draws[at] * (up + down) < down else -down
        at += 1
        for k, d in zip(live, u, strict=True):
            p = pi[k] + step * d
            pi[k] = 0.0 if p < eps else 1.0 if p > 1 - eps else p
        live = [k for k in live if 0.0 < pi[k] < 1.0]
    live += todo
    if land and live:
        ways = (np.arange(1 << len(live))[:, None] >> np.arange(len(live))) & 1
        of, shares = np.array([x[k] for k in live]), np.array([pi[k] for k in live])
        miss = np.abs(ways @ of - shares @ of) + 0.01 * of.mean() * np.abs(ways.sum(axis=1) - shares.sum())
        for k, s in zip(live, ways[np.argmin(miss)].tolist(), strict=True):
            pi[k] = float(s)
    return np.array(pi)


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: float = MOST, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """doc_id, size (words), source_size, target, taken (words, repeats counted) and copies (times taken); also source, t1 and t2 (``text_marks``)."""
    t1, t2 = text_marks(F.col(text_col))
    each = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("s"), t1.alias("t1"), t2.alias("t2"), F.size(words(F.col(text_col))).cast("long").alias("size"))
    sizes = stash(each.groupBy("doc_id", "s", "t1", "t2", "size").agg(F.count("*").alias("rows")), "sizes")
    targets = stash(source_targets(sizes.select(F.col("s").alias("source"), (F.col("size") * F.col("rows")).alias("size")), weights, most), "targets")
    few = targets.count() <= BROADCAST_SOURCES
    if few:
        targets = F.broadcast(targets)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = sizes.join(targets, F.col("s").eqNullSafe(F.col("source"))).withColumn("rate", rate * F.col("rows")).select(
        "doc_id", "source", "t1", "t2", "rows", "size", "source_no", "source_size", "target", F.floor("rate").cast("long").alias("base"), (F.col("rate") - F.floor("rate")).alias("pi"), F.xxhash64("doc_id", "t1", "t2", F.lit(seed)).alias("h")
    )
    fields, kinds = rows.columns, ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)

    def fly(land: bool):
        def one(key: tuple, t: pa.Table) -> pa.Table:
            order = np.lexsort((np.asarray(t["size"]), np.asarray(t["h"])))
            t = t.take(pa.array(order)).select(fields)
            rng = np.random.default_rng([seed, int(land), *(abs(k.as_py()) for k in key)])
            pi = flight(np.asarray(t["pi"]), np.asarray(t["size"]), rng.random(len(order) + 1), land)
            return t.set_column(t.schema.get_field_index("pi"), "pi", pa.array(pi))

        return one

    whole = (F.col("pi") <= 0) | (F.col("pi") >= 1)
    done, left = rows.where(whole), rows.where(~whole)
    for level in itertools.count():
        counts = left.groupBy("source_no").agg(F.count("*").alias("n"))
        largest = counts.agg(F.max("n")).first()[0]
        if largest is None:
            break
        blocks = F.ceil(F.col("n") / block)
        dealt = left.join(F.broadcast(counts) if few else counts, "source_no")
        dealt = dealt.withColumn("block", F.pmod(F.xxhash64("h", F.lit(level)), blocks).cast("int")).drop("n")
        # Dealt by block as well: a shuffle by source alone would leave a large source to one task.
        dealt = dealt.repartition("source_no", "block")
        flown = stash(dealt.groupBy("source_no", "block").applyInArrow(fly(largest <= block), kinds), "flown")
        done, left = done.unionByName(flown.where(whole)), flown.where(~whole)
    whole_copies = F.col("base") + F.col("pi").cast("long")
    # Alike rows come back in runs, so that no array is as long as their number.
    run = F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(RUN)))
    within = F.explode(F.sequence(F.col("from") + 1, F.least(F.col("from") + RUN, F.col("rows"))))
    one = done.withColumn("times", whole_copies).withColumn("from", run).withColumn("no", within)
    copies = F.floor(F.col("times") / F.col("rows")) + (F.col("no") <= F.col("times") % F.col("rows")).cast("long")
    return one.withColumn("copies", copies).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source", "t1", "t2")
