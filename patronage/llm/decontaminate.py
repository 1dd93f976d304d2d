"""Benchmark decontamination with Aho-Corasick automata over benchmark windows.

Texts are normalised alike: A-Z become a-z, and words are runs of digits, letters and code points from U+0080 on.
A window is ``window`` consecutive words of an item, or the whole item if it has fewer. All windows of a block form
one automaton over the normalised text; it reads each document once, and the end of every match is mapped back to
the words it covers, so a document word is hit if any occurrence of any window covers it. The runs of hit words are
given as word places and as offsets (code points) in the original text.

The pairs of a window and an item that has it are spread over blocks of about ``block_pairs``; each block is one
automaton and one reading of the documents, so a benchmark of any size, and a window in any number of items, stays
within the memory of a task. One block is the rule.

Edge cases: null, empty and wordless documents have no words and no hits; wordless items have no window; repeated
items each count by their item_id; an item without item_id marks words but is not listed; rows that repeat a doc_id each get a result. An empty benchmark leaves every
document clean. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patronage.llm.common import stash, text_bytes

WINDOW, BLOCK_PAIRS = 10, 200_000
#: Bytes of UTF-8: A-Z lowered, digits, a-z and all bytes of code points beyond ASCII kept, the rest blank.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, hits array<struct<first:int,last:int,start:long,stop:long>>"


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Different pairs (pattern, item) of a window's text and the id, as a string, of an item that has it."""
    low = F.translate(F.coalesce(text_col, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.filter(F.split(low, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), lambda w: w != "")
    each = benchmark.select(F.col(id_col).cast("string").alias("item"), found.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    return each.select("item", F.explode(starts).alias("at"), "w").select("item", F.array_join(F.slice("w", F.col("at"), window), " ").alias("pattern")).distinct()


def _spans(ends: list[int], sizes: list[int], word_ends: np.ndarray, n_words: int) -> np.ndarray:
    """Which words the matches cover, from where each ends in the text and how many words it has."""
    last = np.searchsorted(word_ends, np.asarray(ends))
    first = last - np.asarray(sizes) + 1
    step = np.zeros(n_words + 1, np.int64)
    np.add.at(step, first, 1)
    np.add.at(step, last + 1, -1)
    return np.cumsum(step[:n_words]) > 0


#: Of a run of hit words: the first and the last word's place, and where it begins and ends in the original text.
SPAN = ("first", "last", "start", "stop")


def _original(raw: np.ndarray, plain: bytes, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points before the first words and up to the end of the last words; normalising moves no byte."""
    solid = np.frombuffer(plain, np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([0], solid.view(np.int8), [0]))))
    points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return points[edge[::2][first]], points[edge[1::2][last]]


def _scan(docs: DataFrame, patterns: list) -> DataFrame:
    """One reading of the documents (doc_id, carried columns, doc_text) with one automaton."""
    keep = docs.columns[:-1]
    shared = docs.sparkSession.sparkContext.broadcast([(r["pattern"], r["item"]) for r in patterns])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, items = ahocorasick.Automaton(), {}
        for pattern, item in shared.value:
            items.setdefault(pattern, []).append(item)
        for pattern in items:
            automaton.add_word(f" {pattern.encode().decode('latin-1')} ", (pattern, pattern.count(" ") + 1))
        if items:
            automaton.make_automaton()
        for batch in batches:
            data, offs = text_bytes(batch.column(len(keep)))
            out = {k: [] for k in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "hits")}
            for k in range(batch.num_rows):
                raw = data[offs[k] : offs[k + 1]]
                plain = raw.tobytes().translate(PLAIN)
                found = plain.split()
                ends, sizes, of, hits, n_hit = [], [], set(), [], 0
                if items and found:
                    for end, (which, size) in automaton.iter(f" {b' '.join(found).decode('latin-1')} "):
                        ends.append(end)
                        sizes.append(size)
                        of.update(items[which])
                if ends:
                    word_ends = np.cumsum([len(w) + 1 for w in found])
                    hit = _spans(ends, sizes, word_ends, len(found))
                    n_hit = int(hit.sum())
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
                    first, last = edge[::2], edge[1::2] - 1
                    start, stop = _original(raw, plain, first, last)
                    hits = [dict(zip(SPAN, x, strict=True)) for x in zip(first.tolist(), last.tolist(), start.tolist(), stop.tolist(), strict=True)]
                names = sorted(x for x in of if x is not None)
                for c, v in zip(out, (len(found), n_hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), n_hit > 0, names, hits), strict=True):
                    out[c].append(v)
            span = pa.list_(pa.struct([(x, pa.int32() if x in SPAN[:2] else pa.int64()) for x in SPAN]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.string()), span)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True))], [*keep, *out])

    schema = T.StructType([*docs.select(*keep).schema.fields, *T.StructType.fromDDL(RESULT).fields])
    return docs.mapInArrow(each, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, block_pairs: int = BLOCK_PAIRS, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, carried columns, n_words, n_hit, n_items, items_sha256, contaminated; also items and hits (``SPAN`` of each run of hit words)."""
    texts = docs.select(F.col(id_col).alias("doc_id"), *carry, F.col(text_col).alias("doc_text"))
    known = stash(benchmark_windows(benchmark, window=window), "windows")
    blocks = max(1, -(-known.count() // block_pairs))
    if blocks == 1:
        return _scan(texts, known.collect())
    # A reading for each block; what they find is united for each row.
    texts = texts.withColumn("row", F.monotonically_increasing_id())
    texts = stash(texts, "texts")
    keyed, out = texts.select(F.col("row").alias("doc_id"), "doc_text"), None
    for b in range(blocks):
        of = known.where(F.pmod(F.xxhash64("pattern", "item"), F.lit(blocks)) == b).collect()
        one = _scan(keyed, of)
        out = one if out is None else out.unionByName(one)
    # Runs of different blocks that meet are one run; each row has a list of a few runs for each block.
    runs = F.array_sort(F.flatten(F.collect_list("hits")))
    whole = out.groupBy(F.col("doc_id").alias("row")).agg(F.max("n_words").alias("n_words"), runs.alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def add(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        meets = (F.size(done) > 0) & (x["first"] <= last["last"] + 1)
        joined = F.struct(last["first"].alias("first"), F.greatest(last["last"], x["last"]).alias("last"), last["start"].alias("start"), F.greatest(last["stop"], x["stop"]).alias("stop"))
        return F.when(meets, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(x)))

    whole = whole.withColumn("hits", F.aggregate("runs", F.array().cast("array<struct<first:int,last:int,start:long,stop:long>>"), add))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"] + 1)
    result = whole.select("row", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "items", "hits")
    return texts.select("doc_id", *carry, "row").join(result, "row").drop("row")
