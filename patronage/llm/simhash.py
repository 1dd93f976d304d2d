"""SimHash near-duplicates by multi-index hashing.

Each text gets a 64-bit SimHash over shingles of words. Two fingerprints within ``distance`` bits have, of their
``distance // radius`` segments, one in which they differ by ``radius`` bits at most; with the default of two 32-bit
segments and distance 3 the radius is 1. So every distinct fingerprint is entered once under each of its segments,
looks up the Hamming ball around each of its segments (the segment and its neighbours with one bit more; a neighbour
with one bit less finds it from its own side), and complete distances are verified within the join. Links then make components, named by their smallest doc_id.

Copies meet as one fingerprint before any lookup. Where very many distinct fingerprints share a segment (a large
group of near copies), lookups in that segment go on by a second level: the other half is cut again, and the lookup
key is the segment with a quarter of which one bit may differ, so a crowded entry does not become all pairs.

``near_groups`` is the same search at a similarity of shingle sets instead of a number of bits. One 64-bit fingerprint
with a few bits' distance misses most pairs at 0.8, so it takes ``SEGMENTS`` segments of 32 bits, and in each the ball
over the ``UNSURE`` bits whose votes were closest to even, which are those that an edit flips. Texts whose balls meet
are compared by their complete sets of 5-word shingles. First each is compared with the next one under the key in the
order of complete fingerprints and with the one that a hash names first; what that links is one group. Then all texts
under a key that are not of one group are compared, in blocks of at most ``BLOCK`` by ``BLOCK`` of one key for a task.
There a bitmap of each set bounds what two sets can share from above, so only pairs that may be alike leave the block,
and none that is alike is left out: no pair of texts whose balls meet goes unchecked. What the balls miss, they miss;
the recall is measured in the README.

Edge cases: a null, empty or blank text has fingerprint zero and links like any other; fewer words than a shingle
make one shingle of them all; rows that repeat a doc_id each get a result and all their fingerprints count as that
document's; a null doc_id never names a component unless its component has no other; an empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from patronage.llm.common import WindowHasher, WordHasher, mix, stash, text_bytes, text_marks
from patronage.llm.links import components

SHINGLE, SEED, DISTANCE = 3, 42, 3
HALF_MASK, QUARTER_MASK = (1 << 32) - 1, (1 << 16) - 1
#: From this many distinct fingerprints under one 32-bit segment on, its lookups use the second level.
CROWDED = 64
#: Of ``near_groups``: similarity and words of the shingles that decide; segments, unsure bits and words of the shingles that search.
SIMILARITY, NEAR_SHINGLE, SEGMENTS, UNSURE, SEARCH_SHINGLE = 0.8, 5, 16, 3, 3
#: Bits of the bitmap of a set of shingles, and texts of one key that are compared with each other in one group of rows.
BITMAP, BLOCK = 1024, 2048
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _fingerprint(data: bytes, shingle: int, seed: int) -> int:
    """The SimHash as a signed 64-bit integer."""
    found = data.translate(LOWER).split()
    if not found:
        return 0
    text = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(found) > shingle:
        starts, ends = starts[: 1 - shingle], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), 1 << 14):
        pairs = zip(starts[at : at + (1 << 14)].tolist(), ends[at : at + (1 << 14)].tolist(), strict=True)
        hashes = np.array([digest(text[a:b], seed) for a, b in pairs], np.uint64)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    bits = (2 * ones > len(starts)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id and its fingerprint as a signed long, for every row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_bytes(batch.column(1))
            out = [_fingerprint(data[offs[k] : offs[k + 1]].tobytes(), shingle, seed) for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("doc_text")).mapInArrow(each, f"doc_id {dict(docs.dtypes)[id_col]}, fp long")


def _half(fp: Column, segment: int) -> Column:
    return F.shiftrightunsigned(fp, 32 * segment).bitwiseAND(F.lit(HALF_MASK))


def _ball(value: Column, bits: int) -> Column:
    """The value and all values that differ from it in one of ``bits`` bits."""
    return F.array(value, *[value.bitwiseXOR(F.lit(1 << k)) for k in range(bits)])


def _half_ball(value: Column, bits: int) -> Column:
    """The value and all values with one more bit: of two values one bit apart, one has the other in its half."""
    more = [F.when(value.bitwiseAND(F.lit(1 << k)) == 0, value.bitwiseOR(F.lit(1 << k))) for k in range(bits)]
    return F.array_compact(F.array(value, *more))


def near_pairs(distinct: DataFrame, distance: int = DISTANCE, crowded: int = CROWDED) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints (column fp) that differ in at most ``distance`` <= 3 bits."""
    if not 0 <= distance <= 3:
        raise ValueError("two segments with radius 1 cover distances up to 3")
    halves = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(s).alias("seg"), _half(F.col("fp"), s).alias("key"), _half(F.col("fp"), 1 - s).alias("rest")) for s in (0, 1)])).alias("h")).select("fp", "h.*")
    table = stash(halves.join(halves.groupBy("seg", "key").agg((F.count("*") >= crowded).alias("many")), ["seg", "key"]), "segments")
    probes = table.select(F.col("fp").alias("other"), "seg", F.explode(_half_ball(F.col("key"), 32)).alias("key"), F.col("rest").alias("other_rest"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= distance
    plain = probes.join(table.where(~F.col("many")), ["seg", "key"]).where(near & (F.col("other") != F.col("fp")))
    # In a crowded entry the halves left differ by at most 3 bits, so one of their quarters differs by one at most.
    quarters = lambda rest: F.array(*[F.struct(F.lit(q).alias("quarter"), F.shiftrightunsigned(rest, 16 * q).bitwiseAND(F.lit(QUARTER_MASK)).alias("sub")) for q in (0, 1)])
    full = table.where("many")
    entries = full.select("fp", "seg", "key", F.explode(quarters(F.col("rest"))).alias("q")).select("fp", "seg", "key", "q.*")
    known = full.select("seg", "key").distinct()
    lookups = probes.join(known, ["seg", "key"]).select("other", "seg", "key", F.explode(quarters(F.col("other_rest"))).alias("q")).select("other", "seg", "key", "q.quarter", F.explode(_ball(F.col("q.sub"), 16)).alias("sub"))
    dense = lookups.join(entries, ["seg", "key", "quarter", "sub"]).where(near & (F.col("other") != F.col("fp")))
    both = plain.select("fp", "other").unionByName(dense.select("fp", "other"))
    return both.select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b")).distinct()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links)."""
    marks = stash(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    classes = stash(marks.groupBy("fp").agg(F.min("doc_id").alias("low")), "classes")
    linked = components(near_pairs(classes.select("fp"), distance))
    named = classes.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    member = named.select("fp", "component").join(lowest, "component").select("fp", "component_id")
    return marks.join(member, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _shingle_set(words: np.ndarray, windows: WindowHasher, shingle: int) -> np.ndarray:
    """Distinct hashes of a text's shingles; of all its words if they are fewer."""
    if not len(words):
        return np.zeros(0, np.uint64)
    length = min(shingle, len(words))
    return np.unique(windows.at(windows.sums(words), np.arange(len(words) - length + 1), length))


def _votes(hashes: np.ndarray, lanes: int) -> np.ndarray:
    """For each bit of ``lanes`` 64-bit fingerprints, votes for 1 less votes for 0."""
    ones = np.zeros((lanes, 64), np.int64)
    salts = mix(np.arange(1, lanes + 1, dtype=np.uint64))[:, None]
    for at in range(0, len(hashes), 1 << 12):
        lane = mix(hashes[None, at : at + (1 << 12)] ^ salts)
        ones += np.unpackbits(lane.astype("<u8").view(np.uint8).reshape(lanes, -1, 8), axis=2, bitorder="little").sum(axis=1, dtype=np.int32)
    return (2 * ones - len(hashes)).ravel()


def _segments(votes: np.ndarray, unsure: int) -> tuple[np.ndarray, np.ndarray]:
    """32-bit segments of a fingerprint, and the masks of the least sure bits of each."""
    by = votes.reshape(-1, 32)
    value = ((by > 0).astype(np.int64) << np.arange(32)).sum(axis=1)
    return value, np.int64(1) << np.argsort(np.abs(by), axis=1, kind="stable")[:, :unsure]


def _search_rows(docs: DataFrame, segments: int, unsure: int, shingle: int) -> DataFrame:
    """doc_id, t1, t2 of each row with two hashes of its lower-cased words, its segments and their unsure bits."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, windows = WordHasher(), WindowHasher()
        for batch in batches:
            data, offs = text_bytes(batch.column(3))
            marks, value, mask = np.zeros((batch.num_rows, 2), np.uint64), [], []
            for k in range(batch.num_rows):
                low = data[offs[k] : offs[k + 1]].tobytes().translate(LOWER)
                h = xxhash.xxh3_128_intdigest(b" ".join(low.split()))
                marks[k] = h >> 64, h & ((1 << 64) - 1)
                words = hasher(np.frombuffer(low, np.uint8))
                v, m = _segments(_votes(_shingle_set(words, windows, shingle), -(-segments // 2)), unsure)
                value.append(v[:segments].tolist())
                mask.append(m[:segments].ravel().tolist())
            longs = [pa.array(np.ascontiguousarray(marks[:, c]).view(np.int64)) for c in (0, 1)]
            arrays = [pa.array(x, pa.list_(pa.int64())) for x in (value, mask)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *longs, *arrays], ["doc_id", "t1", "t2", "n1", "n2", "segments", "masks"])

    return docs.mapInArrow(each, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, t1 long, t2 long, n1 long, n2 long, segments array<long>, masks array<long>")


def _probes(classes: DataFrame, segments: int, unsure: int) -> DataFrame:
    """(key, cid): each class under all keys of its segments' balls; a key holds the segment's number above its bits."""
    chosen = (np.arange(1 << unsure)[:, None] >> np.arange(unsure)) & 1

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                value = np.asarray(part.column(1).flatten()).reshape(-1, segments, 1)
                mask = np.asarray(part.column(2).flatten()).reshape(-1, segments, unsure)
                # The masks of a segment are different bits, so a sum of some of them is their union.
                keys = (value ^ (mask @ chosen.T)) | (np.arange(segments, dtype=np.int64) << 32)[:, None]
                cid = np.repeat(np.asarray(part.column(0)), segments << unsure)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(cid)], ["key", "cid"])

    return classes.select("cid", "segments", "masks").mapInArrow(each, "key long, cid long")


def _shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(cid, shingles, bits) from rows of (cid, doc_text); 32 bits of each hash tell the shingles of two texts apart, and
    ``bits`` is a bitmap with a bit for each of them."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, windows = WordHasher(), WindowHasher()
        for batch in batches:
            data, offs = text_bytes(batch.column(1))
            sets, bits = [], np.zeros((batch.num_rows, BITMAP), np.uint8)
            for k in range(batch.num_rows):
                low = data[offs[k] : offs[k + 1]].tobytes().translate(LOWER)
                sets.append((_shingle_set(hasher(np.frombuffer(low, np.uint8)), windows, shingle) >> np.uint64(32)).astype(np.uint32))
                bits[k, sets[-1] % BITMAP] = 1
            ends = pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32))
            flat = np.concatenate([*sets, np.zeros(0, np.uint32)]).view(np.int32)
            packed = np.packbits(bits, axis=1, bitorder="little").view("<i8")
            arrays = [pa.ListArray.from_arrays(ends, pa.array(flat)), pa.array(packed.tolist(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["cid", "shingles", "bits"])

    return texts.mapInArrow(each, "cid long, shingles array<int>, bits array<long>")


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of pairs (a, b) of classes those whose sets of shingles are as similar as asked."""
    left, right = sets.select(F.col("cid").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("cid").alias("b"), F.col("shingles").alias("y"))
    m, n, both = F.size("x"), F.size("y"), F.size(F.array_intersect("x", "y"))
    # Sets whose sizes differ too much cannot be alike, and are not compared.
    alike = F.when(F.least(m, n) >= similarity * F.greatest(m, n), both >= similarity * (m + n - both)).otherwise(False)
    return pairs.join(left, "a").join(right, "b").where(alike).select("a", "b")


def _pairs(rows: DataFrame) -> DataFrame:
    """Different pairs (a, b), a < b, of cid with one and with two."""
    both = rows.select("cid", F.col("one").alias("other")).unionByName(rows.select("cid", F.col("two").alias("other"))).where("other <> cid")
    return both.select(F.least("cid", "other").alias("a"), F.greatest("cid", "other").alias("b")).distinct()


def _may_be_alike(rows: dict[str, np.ndarray], similarity: float) -> np.ndarray:
    """Pairs (a, b), a < b, of rows of one run that can be alike: of other labels, and by size and bitmap."""
    same = np.all([rows[c][1:] == rows[c][:-1] for c in ("key", "i", "j")], axis=0)
    starts = np.flatnonzero(np.concatenate(([True], ~same)))
    ends = np.repeat(np.append(starts[1:], len(rows["key"])), np.diff(np.append(starts, len(rows["key"]))))
    at, found, apart = np.arange(len(ends)), [], 0
    while True:
        apart += 1
        at = at[at + apart < ends[at]]
        if not len(at):
            break
        to = at + apart
        m, n = rows["n"][at], rows["n"][to]
        may = (rows["label"][at] != rows["label"][to]) & ((rows["own"][at] != rows["own"][to]) | (rows["i"][at] == rows["j"][at])) & (np.minimum(m, n) >= similarity * np.maximum(m, n))
        a, b = at[may], to[may]
        x, y = rows["bits"][a], rows["bits"][b]
        # A bit that only one of two sets has stands for at least one shingle that the other lacks.
        both = np.minimum(m[may] - np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64), n[may] - np.bitwise_count(y & ~x).sum(axis=1, dtype=np.int64))
        keep = both >= similarity * (m[may] + n[may] - both)
        found.append(np.sort(np.stack([rows["cid"][a[keep]], rows["cid"][b[keep]]], axis=1), axis=1))
    return np.unique(np.concatenate([*found, np.zeros((0, 2), np.int64)]), axis=0)


def _unlinked_pairs(labelled: DataFrame, sets: DataFrame, similarity: float, block: int) -> DataFrame:
    """Different pairs (a, b) of classes under one key but of other labels that their bitmaps do not rule out.

    The classes of a key are dealt to blocks; each two blocks make one run of rows, so that a task holds 2 * ``block``
    rows of a key at most, and a crowded key is spread over many runs.
    """
    several = labelled.groupBy("key").agg(F.count("*").alias("m"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    rows = labelled.join(several.select("key", F.ceil(F.col("m") / block).alias("blocks")), "key").withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")))
    rows = rows.join(sets.select("cid", F.size("shingles").cast("long").alias("n"), "bits"), "cid").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    names = ["key", "i", "j", "own", "cid", "label", "n"]
    rows = rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).select(*names, "bits")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            new = {c: np.asarray(batch.column(k)) for k, c in enumerate(names)} | {"bits": np.asarray(batch.column(7).flatten()).view(np.uint64).reshape(batch.num_rows, -1)}
            left = new if left is None else {c: np.concatenate([left[c], new[c]]) for c in new}
            # The last run may go on in the next batch.
            cut = np.flatnonzero(np.any([left[c][1:] != left[c][:-1] for c in ("key", "i", "j")], axis=0))
            if len(cut):
                done = cut[-1] + 1
                pairs = _may_be_alike({c: v[:done] for c, v in left.items()}, similarity)
                left = {c: v[done:] for c, v in left.items()}
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])
        if left is not None:
            pairs = _may_be_alike(left, similarity)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(each, "a long, b long").distinct()


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, shingle: int = NEAR_SHINGLE, segments: int = SEGMENTS, unsure: int = UNSURE, search_shingle: int = SEARCH_SHINGLE, block: int = BLOCK
) -> DataFrame:
    """Near-duplicates by the similarity of their sets of shingles; one row for each different (doc_id, text).

    doc_id, t1 and t2 (``text_marks`` of the text), copies (rows that are the same), group_id (the doc_id that stays of
    its group) and stays: whether this is the first of its group, by doc_id, null last, then by the text's marks. Texts
    of the same lower-cased words are one group, and so are texts without words. A null doc_id is a document like any
    other; different texts under one doc_id are different documents.
    """
    t1, t2 = text_marks(F.col(text_col))
    texts = docs.select(F.col(id_col).alias("doc_id"), t1.alias("t1"), t2.alias("t2"), F.col(text_col).alias("doc_text"))
    found = _search_rows(texts, segments, unsure, search_shingle)
    one = [F.first(c).alias(c) for c in ("segments", "masks")]
    marks = stash(found.groupBy("doc_id", "t1", "t2", "n1", "n2").agg(F.count("*").alias("copies"), *one), "marks")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t1", "t2")
    # Numbers in the order of fingerprints, so that neighbours by number are alike.
    named = marks.groupBy("n1", "n2").agg(F.min(order).alias("head"), *one).orderBy("segments", "n1", "n2")
    classes = stash(named.withColumn("cid", F.monotonically_increasing_id()), "classes")
    of_key = W.partitionBy("key")
    shared = F.coalesce(F.lead("cid").over(of_key.orderBy("cid")), F.lag("cid").over(of_key.orderBy("cid"))).isNotNull()
    crowd = stash(_probes(classes, segments, unsure).withColumn("shared", shared).where("shared").drop("shared"), "crowd")
    neighbours = F.lead("cid").over(of_key.orderBy("cid")), F.min(F.struct(F.xxhash64("cid").alias("h"), "cid")).over(of_key)["cid"]
    pairs = stash(_pairs(crowd.select("cid", neighbours[0].alias("one"), neighbours[1].alias("two"))), "pairs")
    met = crowd.select("cid").distinct().join(classes, "cid").select("cid", F.col("head.doc_id").alias("of_id"), F.col("head.t1").alias("of_t1"), F.col("head.t2").alias("of_t2"))
    same = F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("t1") == F.col("of_t1")) & (F.col("t2") == F.col("of_t2"))
    sets = _shingle_sets(texts.join(stash(met, "met"), same).select("cid", "doc_text"), shingle)
    sets = stash(sets.groupBy("cid").agg(F.first("shingles").alias("shingles"), F.first("bits").alias("bits")), "sets")
    alike = stash(_alike(pairs, sets, similarity), "alike")
    linked = components(alike).withColumnRenamed("node", "cid")
    labelled = crowd.join(linked, "cid", "left").select("key", "cid", F.coalesce("component", "cid").alias("label"))
    rest = stash(_unlinked_pairs(labelled, sets, similarity, block).join(pairs, ["a", "b"], "left_anti"), "rest")
    more = stash(_alike(rest, sets, similarity), "alike")
    linked = components(alike.unionByName(more)).withColumnRenamed("node", "cid")
    grouped = classes.select("n1", "n2", "cid", "head").join(linked, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    heads = grouped.groupBy("component").agg(F.min("head").alias("first"))
    member = stash(grouped.join(heads, "component").select("n1", "n2", "first"), "member")
    return marks.join(member, ["n1", "n2"]).select("doc_id", "t1", "t2", "copies", F.col("first.doc_id").alias("group_id"), (order == F.col("first")).alias("stays"))
