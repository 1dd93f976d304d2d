"""Substring dedup with difference-cover anchors.

A window is ``window`` consecutive words. Two equal windows start anywhere in their texts, but some shift below
``period`` moves both starts onto positions whose remainder modulo the period is in the cover, because every
difference of remainders is a difference of two cover elements. So it is enough to hash shorter runs of
``window - period + 1`` words (anchors) at cover positions: any shared window holds an anchor that both texts hash.

1. Anchors of every text, packed in arrays by (group of documents, hash bucket); a bucket finds those that two
   documents share. Groups send each anchor once, so a passage in very many texts costs a value per group.
2. Each shared anchor is extended to the windows that hold it. Their hashes, 64 bits and 32 of another hash, meet in
   buckets again, which send back the smallest doc_id of each window that two documents share.
3. A text loses every word covered by a window that a smaller doc_id has.

Edge cases: null and empty texts have no words; texts below ``window`` words lose nothing; a null doc_id is last in
the order, so it may lose words but takes none; rows that repeat a doc_id count as one document, and each gets a
result; different texts under one doc_id, or without one, take no words from each other; equal texts keep the words of
the smallest doc_id only; doc_ids are integers. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.llm.common import WindowHasher, WordHasher, text_bytes, text_parts

WINDOW = 50
#: A perfect difference set: each non-zero remainder modulo 31 is one difference of two elements.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
LAST = (1 << 63) - 1

#: Groups and buckets beyond this number share shuffle partitions.
MOST_PARTITIONS = 50_000
CHECK_MULTIPLIER = 0xC2B2AE3D27D4EB4F

CELL = "bucket int, part int, keys array<long>, check array<int>, low array<long>, high array<long>"
FOUND = "part int, keys array<long>, check array<int>, first array<long>"


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Places where a row differs from the one before in any column."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def _order(keys: np.ndarray, check: np.ndarray) -> np.ndarray:
    """Places in the order of (key, check); anchors have no check, and are sorted by one column."""
    return np.lexsort((check, keys)) if len(check) and check.any() else np.argsort(keys, kind="stable")


def _cells(part: int, keys: np.ndarray, check: np.ndarray, ids: np.ndarray, buckets: int) -> pa.Table:
    """One row for each hash bucket that has keys, with their smallest id; the largest, by place, only where it differs."""
    order = _order(keys, check)
    keys, check, ids = keys[order], check[order], ids[order]
    head = _heads(keys, check)
    low, high = (np.minimum.reduceat(ids, head), np.maximum.reduceat(ids, head)) if len(head) else (ids, ids)
    keys, check = keys[head], check[head]
    bucket = ((keys >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    bucket, keys, check, low, high = bucket[order], keys[order], check[order], low[order], high[order]
    head = _heads(bucket)
    ends = np.concatenate((head, [len(keys)]))
    offs = pa.array(ends.astype(np.int32))
    many = low != high
    places = np.concatenate(([0], np.cumsum(many)))[ends]
    pairs = np.stack((np.flatnonzero(many) - np.repeat(head, np.diff(ends))[many], high[many]), 1).ravel()
    # Checks are kept only where there are any: an anchor's would all be 0.
    checked = bool(check.any())
    return pa.table({
        "bucket": pa.array(bucket[head], pa.int32()),
        "part": pa.array(np.full(len(head), part, np.int32)),
        "keys": pa.ListArray.from_arrays(offs, pa.array(keys.view(np.int64))),
        "check": pa.ListArray.from_arrays(offs if checked else pa.array(np.zeros(len(ends), np.int32)), pa.array(check if checked else check[:0], pa.int32())),
        "low": pa.ListArray.from_arrays(offs, pa.array(low)),
        "high": pa.ListArray.from_arrays(pa.array((places * 2).astype(np.int32)), pa.array(pairs.astype(np.int64))),
    })


def _flat(column: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([np.asarray(c.flatten()) for c in column.chunks] or [np.zeros(0, np.int64)]).astype(np.int64, copy=False)


def _lengths(column: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([np.diff(np.asarray(c.offsets)) for c in column.chunks] or [np.zeros(0, np.int64)]).astype(np.int64)


def _checks(table: pa.Table, lengths: np.ndarray) -> np.ndarray:
    """The check of each key, 0 for those of rows without."""
    out, given = np.zeros(int(lengths.sum()), np.int32), _lengths(table["check"])
    if given.any():
        out[np.repeat(given > 0, lengths)] = _flat(table["check"])
    return out


def _shared(cells: pa.Table) -> pa.Table:
    """Of one bucket: for each group, its keys that two documents share, with the smallest document."""
    lengths, keys, low = _lengths(cells["keys"]), _flat(cells["keys"]), _flat(cells["low"])
    check = _checks(cells, lengths)
    part = np.repeat(np.asarray(cells["part"]), lengths)
    high, pairs = low.copy(), _flat(cells["high"])
    base = np.repeat(np.cumsum(lengths) - lengths, _lengths(cells["high"]) // 2)
    high[base + pairs[::2]] = pairs[1::2]
    order = _order(keys, check)
    keys, check, part, low, high = keys[order], check[order], part[order], low[order], high[order]
    head = _heads(keys, check)
    first = np.minimum.reduceat(low, head)
    size = np.diff(np.concatenate((head, [len(keys)])))
    shared = np.repeat(first < np.maximum.reduceat(high, head), size)
    keys, check, part, first = keys[shared], check[shared], part[shared], np.repeat(first, size)[shared]
    order = np.argsort(part, kind="stable")
    keys, check, part, first = keys[order], check[order], part[order], first[order]
    head = _heads(part)
    offs, none = pa.array(np.concatenate((head, [len(keys)])).astype(np.int32)), pa.array(np.zeros(len(head) + 1, np.int32))
    checks = pa.ListArray.from_arrays(*(offs, pa.array(check, pa.int32())) if check.any() else (none, pa.array([], pa.int32())))
    return pa.table({"part": pa.array(part[head], pa.int32()), "keys": pa.ListArray.from_arrays(offs, pa.array(keys)), "check": checks, "first": pa.ListArray.from_arrays(offs, pa.array(first))})


def _texts(docs: pa.Table):
    """(row, order of its id, bytes) of each text, chunk by chunk."""
    row = 0
    for batch in docs.select(["doc_order", "doc_text"]).to_batches():
        data, offs = text_bytes(batch.column(1))
        ids = np.asarray(batch.column(0))
        for k in range(len(ids)):
            yield row, int(ids[k]), data[offs[k] : offs[k + 1]]
            row += 1


def _member(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key in sorted_keys, -1 where it is absent."""
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


def _returned(found: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, check, first = _flat(found["keys"]).view(np.uint64), _checks(found, _lengths(found["keys"])), _flat(found["first"])
    order = _order(keys, check)
    return keys[order], check[order], first[order]


def _spread(starts: np.ndarray, back: int, ahead: int, n: int) -> np.ndarray:
    """True at every place below n from ``back`` before to ``ahead`` after a start (both included)."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, np.maximum(starts - back, 0), 1)
    np.add.at(step, np.minimum(starts + ahead + 1, n), -1)
    return np.cumsum(step[:n]) > 0


def _anchor_places(n_words: int, anchor: int, period: int, cover: tuple[int, ...]) -> np.ndarray:
    at = (np.arange(0, max(n_words, 0), period)[:, None] + np.asarray(cover)).ravel()
    return at[at + anchor <= n_words]


def _joined(blocks: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(blocks) if blocks else np.zeros(0, kind)


def _check_at(hasher: WindowHasher, hashes: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """32 bits of another hash of the windows that begin at ``starts``."""
    return (hasher.at(hasher.sums(hashes), starts, window) >> np.uint64(33)).astype(np.int32) if len(starts) else np.zeros(0, np.int32)


def anchor_cells(docs: pa.Table, window: int, period: int, cover: tuple[int, ...], buckets: int) -> pa.Table:
    hasher, windows, anchor = WordHasher(), WindowHasher(), window - period + 1
    keys, ids = [], []
    for _, doc, data in _texts(docs):
        hashes = hasher(data)
        if len(hashes) < window:
            continue
        k = np.unique(windows.at(windows.sums(hashes), _anchor_places(len(hashes), anchor, period, cover), anchor))
        keys.append(k)
        ids.append(np.full(len(k), doc))
    keys = _joined(keys, np.uint64)
    return _cells(docs["part"][0].as_py(), keys, np.zeros(len(keys), np.int32), _joined(ids, np.int64), buckets)


def window_cells(docs: pa.Table, found: pa.Table, window: int, period: int, cover: tuple[int, ...], buckets: int) -> pa.Table:
    hasher, windows, other, anchor = WordHasher(), WindowHasher(), WindowHasher(CHECK_MULTIPLIER), window - period + 1
    known, _, _ = _returned(found)
    keys, checks, ids = [], [], []
    for _, doc, data in _texts(docs) if len(known) else ():
        hashes = hasher(data)
        if len(hashes) < window:
            continue
        sums, at = windows.sums(hashes), _anchor_places(len(hashes), anchor, period, cover)
        at = at[_member(known, windows.at(sums, at, anchor)) >= 0]
        if not len(at):
            continue
        starts = np.flatnonzero(_spread(at, period - 1, 0, len(hashes) - window + 1))
        keys.append(windows.at(sums, starts, window))
        checks.append(_check_at(other, hashes, starts, window))
        ids.append(np.full(len(starts), doc))
    part = docs["part"][0].as_py() if len(docs) else 0
    return _cells(part, _joined(keys, np.uint64), _joined(checks, np.int32), _joined(ids, np.int64), buckets)


def _owners(known: np.ndarray, check: np.ndarray, first: np.ndarray, keys: np.ndarray, own_check) -> np.ndarray:
    """The smallest document of each key that is known with its check, LAST for others; ``own_check(places)`` gives checks."""
    out = np.full(len(keys), LAST)
    at = _member(known, keys)
    left = np.flatnonzero(at >= 0)
    at = at[left]
    checks = own_check(left)
    # Different windows of the same key lie side by side.
    while len(left):
        same = check[at] == checks
        out[left[same]] = first[at[same]]
        more = ~same & (at + 1 < len(known))
        more[more] = known[at[more] + 1] == known[at[more]]
        left, at, checks = left[more], at[more] + 1, checks[more]
    return out


def kept_texts(docs: pa.Table, found: pa.Table, window: int, with_text: bool) -> pa.Table:
    hasher, windows, other = WordHasher(), WindowHasher(), WindowHasher(CHECK_MULTIPLIER)
    known, check, first = _returned(found)
    n_words, n_removed, digests, texts = [], [], [], []
    for _, doc, data in _texts(docs):
        hashes = hasher(data)
        n = len(hashes)
        gone = np.zeros(n, bool)
        if n >= window and len(known):
            starts = np.arange(n - window + 1)
            keys = windows.at(windows.sums(hashes), starts, window)
            starts = starts[_owners(known, check, first, keys, lambda at: _check_at(other, hashes, at, window)) < doc]  # noqa: B023
            if len(starts):
                gone = _spread(starts, 0, window - 1, n)
        kept = data.tobytes().split()
        if gone.any():
            kept = [w for w, g in zip(kept, gone.tolist(), strict=True) if not g]
        text = b" ".join(kept)
        n_words.append(n)
        n_removed.append(int(gone.sum()))
        digests.append(hashlib.sha256(text).hexdigest())
        if with_text:
            texts.append(text.decode())
    out = {"doc_id": docs["doc_id"], "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
    return pa.table(out | ({"kept_text": pa.array(texts, pa.string())} if with_text else {}))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (kept words joined by one space) and, if asked for, kept_text."""
    differences = {(a - b) % period for a in cover for b in cover}
    if len(differences) != period or not 0 < period < window:
        raise ValueError("cover must give every difference modulo period, and period be below window")
    parts = text_parts(docs, text_col)
    partitions = min(parts, MOST_PARTITIONS)
    grouped = docs.select(
        # By id and text: rows without an id, or of one id, spread as others do. Which group a row is in changes no result.
        F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(parts)).cast("int").alias("part"),
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc_order"),
        F.col(text_col).alias("doc_text"),
    ).repartition(partitions, "part")

    def shared(cells: DataFrame) -> DataFrame:
        return cells.repartition(partitions, "bucket").groupBy("bucket").applyInArrow(_shared, FOUND).repartition(partitions, "part")

    def extend(docs: pa.Table, found: pa.Table) -> pa.Table:
        return window_cells(docs, found, window, period, cover, parts)

    def finish(docs: pa.Table, found: pa.Table) -> pa.Table:
        return kept_texts(docs, found, window, with_text)

    anchors = shared(grouped.groupBy("part").applyInArrow(lambda t: anchor_cells(t, window, period, cover, parts), CELL))
    cells = grouped.groupBy("part").cogroup(anchors.groupBy("part")).applyInArrow(extend, CELL)
    result = f"doc_id {dict(docs.dtypes)[id_col]}, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    return grouped.groupBy("part").cogroup(shared(cells).groupBy("part")).applyInArrow(finish, result)
