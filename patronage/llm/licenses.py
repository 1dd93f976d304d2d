"""License scan: ordered signature rules behind a keyword gate, overlapping detections resolved by priority.

A text is lower-cased in A-Z and cut into words of letters, digits and characters beyond ASCII; its words joined by one
space are what the rules of ``license_rules`` are written for. The gate is one intersection of the text's words with
the rules' keywords: most texts hold too few of them for any rule and are counted only. For the others each rule that
the gate lets through gives all its matches in the whole text.

Detections are ranked by the kind of their rule (tag, address, notice with a version, version, sentence of a body,
notice, name, general statement), then the longer, the earlier, and the order of the rules. Going down the ranks, a
detection is suppressed if its span lies within the span of one that stays, or holds it. Base detections (the fixed
phrases) are never suppressed, whatever lies around them.

Edge cases: null, empty and blank texts have no words and no detection; texts are scanned whole, in steps of one row;
rows that repeat a doc_id each get a result. Other columns are ignored unless they are carried.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patronage.llm.common import text_bytes
from patronage.llm.decontaminate import PLAIN
from patronage.llm.fill_middle import Units
from patronage.llm.license_rules import KINDS, SURE, Rule, rules

#: One detection: first and last word from 0, place in the text in code points (stop is exclusive).
DETECTION = "rule string, label string, kind string, first int, last int, start long, stop long, sure double, base boolean"
FIELDS = tuple(x.split()[0] for x in DETECTION.split(", "))
RESULT = f"n_words long, detections array<struct<{', '.join(x.replace(' ', ': ', 1) for x in DETECTION.split(', '))}>>"


class Scanner:
    """Rules by keyword, and what they find in one text."""

    def __init__(self, ordered: tuple[Rule, ...]) -> None:
        self.rules = ordered
        self.keys = frozenset().union(*[group for r in ordered for group in r.needs])
        self.by_key: dict[bytes, list[int]] = {}
        for k, r in enumerate(ordered):
            for word in r.needs[0]:
                self.by_key.setdefault(word, []).append(k)

    def candidates(self, present: frozenset) -> list[int]:
        """Rules of which every group of keywords is present, in their order."""
        some = {k for word in present for k in self.by_key.get(word, ())}
        return sorted(k for k in some if all(not present.isdisjoint(group) for group in self.rules[k].needs))

    def matches(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(first word, last word, rule) of every match."""
        present = self.keys.intersection(words)
        which = self.candidates(present) if present else []
        if not which:
            return []
        joined, found = b" %s " % b" ".join(words), []
        for k in which:
            found += [(m.start(), m.end(), k) for m in self.rules[k].pattern.finditer(joined)]
        if not found:
            return []
        begins = np.cumsum([1, *map(len, words)][: len(words)]) + np.arange(len(words))
        at = np.array([x[:2] for x in found])
        first, last = np.searchsorted(begins, at[:, 0]), np.searchsorted(begins, at[:, 1], "right") - 1
        return list(zip(first.tolist(), last.tolist(), [x[2] for x in found], strict=True))

    def resolve(self, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """The detections that stay, by place."""
        rank = lambda d: (self.rules[d[2]].kind, d[0] - d[1], d[0], d[2])
        longest = max((d[1] - d[0] for d in found), default=0)
        kept, stays = [], []
        for d in sorted(found, key=rank):
            first, last, rule = d
            # Whatever holds this span or lies within it begins at most the longest span before it.
            near = kept[bisect_left(kept, (first - longest, -1)) : bisect_left(kept, (last + 1, -1))]
            nested = any((a <= first and last <= b) or (first <= a and b <= last) for a, b in near)
            if nested and not self.rules[rule].base:
                continue
            insort(kept, (first, last))
            stays.append(d)
        return sorted(stays)


def _detections(scanner: Scanner, raw: np.ndarray, plain: bytes, words: list[bytes]) -> list[dict]:
    stays = scanner.resolve(scanner.matches(words))
    if not stays:
        return []
    solid = np.frombuffer(plain, np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([0], solid.view(np.int8), [0]))))
    first, last, which = (np.array(x) for x in zip(*stays, strict=True))
    units = Units(raw)
    start, stop = units.count(edge[::2][first]), units.count(edge[1::2][last])
    out = []
    for a, b, k, s, e in zip(first.tolist(), last.tolist(), which.tolist(), start.tolist(), stop.tolist(), strict=True):
        r = scanner.rules[k]
        out.append(dict(zip(FIELDS, (r.name, r.label, KINDS[r.kind], a, b, s, e, SURE[r.kind], r.base), strict=True)))
    return out


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ordered: tuple[Rule, ...] | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, carried columns, n_words and detections (``DETECTION`` of each that stays, by place), for every row."""
    texts = docs.select(F.col(id_col).alias("doc_id"), *carry, F.col(text_col).alias("doc_text"))
    keep = texts.columns[:-1]
    schema = T.StructType([*texts.select(*keep).schema.fields, *T.StructType.fromDDL(RESULT).fields])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(ordered or rules())
        kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
        one = pa.struct([(f, kinds[t]) for f, t in (x.split() for x in DETECTION.split(", "))])
        for batch in batches:
            data, offs = text_bytes(batch.column(len(keep)))
            n_words, detections = [], []
            for k in range(batch.num_rows):
                raw = data[offs[k] : offs[k + 1]]
                plain = raw.tobytes().translate(PLAIN)
                words = plain.split()
                n_words.append(len(words))
                detections.append(_detections(scanner, raw, plain, words))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n_words, pa.int64()), pa.array(detections, pa.list_(one))], schema.names)

    return texts.mapInArrow(each, schema)


def names(detections: Column) -> Column:
    """The distinct labels of detections, sorted and joined by commas."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(detections, lambda d: d["label"]))), ",")


def sureness(detections: Column) -> Column:
    """How sure it is that a text names a license: 1 less the chance that all labels are wrong, each by its surest detection."""
    by_label = F.array_distinct(F.transform(detections, lambda d: F.struct(d["label"].alias("label"), d["sure"].alias("sure"))))
    best = F.filter(by_label, lambda x: ~F.exists(by_label, lambda y: (y["label"] == x["label"]) & (y["sure"] > x["sure"])))
    return 1 - F.aggregate(best, F.lit(1.0), lambda p, x: p * (1 - x["sure"]))
