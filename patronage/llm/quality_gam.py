"""Quality classifier: a generalised additive model with pairwise interactions.

Each text gives a few figures; each figure is cut into bins. The model is an intercept, one lookup table for each
figure and one for each chosen pair of figures. Tables are learned by cyclic boosting: round after round, every
figure in turn gets a shallow tree of one figure (three cuts at most) fitted to what the model still misses, and its
leaves are added to the table at a low rate. Then the pairs that explain most of the rest are boosted alike, with
trees that cut one figure and, on each side, the other. Scoring is a bin search and additions for all rows at once.

The classifier learns from at most ``train_rows`` labelled documents, chosen by hash (a documented bound of the
training set, by rows however often an id repeats); it scores all documents.

Edge cases: null, empty and blank texts have all figures 0 and are scored like any other; without labelled rows every
score is 0.5; labels that are null are no labels; a doc_id labelled twice counts by its larger label; rows that
repeat a doc_id each get a score. Other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.llm.common import WindowHasher, WordHasher, text_bytes

TRAIN_ROWS, SEED = 8000, 3
BINS, ROUNDS, PAIR_ROUNDS, PAIRS, RATE, RIDGE = 32, 60, 30, 6, 0.15, 5.0
FIGURES = (
    "log_words", "word_bytes", "upper", "symbols", "exclaim", "digits", "distinct", "top_word",
    "windows", "lines_repeated", "line_words", "stops", "blank", "other_marks", "beyond_ascii", "entropy",
)


def _figures(data: np.ndarray, hasher: WordHasher, windows: WindowHasher) -> list[float]:
    """FIGURES of one text from its bytes; 0 throughout for a text without words."""
    words = hasher(data)
    n = len(words)
    if not n:
        return [0.0] * len(FIGURES)
    count = np.bincount(data, minlength=256)
    size = len(data)
    upper, lower = count[65:91].sum(), count[97:123].sum()
    symbols = count[[35, 36, 37, 38, 42, 60, 62, 124]].sum()
    _, each = np.unique(words, return_counts=True)
    if n >= 3:
        runs = windows.at(windows.sums(words), np.arange(n - 2), 3)
        fresh = len(np.unique(runs)) / len(runs)
    else:
        fresh = 1.0
    lines = [x for x in data.tobytes().split(b"\n") if x.strip()]
    share = count[count > 0] / size
    marks = count[33:48].sum() + count[58:65].sum() + count[91:97].sum() + count[123:127].sum()
    return [
        np.log1p(n), (size - count[[32, 9, 10, 11, 12, 13]].sum()) / n, upper / max(1, upper + lower), symbols / size, (count[33] + count[63]) / n, count[48:58].sum() / size, len(each) / n, each.max() / n,
        fresh, 1 - len(set(lines)) / len(lines), n / len(lines), (count[46] + count[44]) / n, count[32] / size, (marks - symbols) / n, count[128:].sum() / size, float(-(share * np.log(share)).sum()),
    ]


def figures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its figures as an array, for every row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, windows = WordHasher(), WindowHasher()
        for batch in batches:
            data, offs = text_bytes(batch.column(1))
            out = [_figures(data[offs[k] : offs[k + 1]], hasher, windows) for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("doc_text")).mapInArrow(each, f"doc_id {dict(docs.dtypes)[id_col]}, x array<double>")


def _cuts(gain_of, n: int, most: int) -> list[int]:
    """Up to ``most`` places that cut n bins for the largest gain, greedily."""
    found: list[int] = []
    while len(found) < most:
        edges = [0, *sorted(found), n]
        best = max(((gain_of(a, k) + gain_of(k, b) - gain_of(a, b), k) for a, b in itertools.pairwise(edges) for k in range(a + 1, b)), default=(0, 0))
        if best[0] <= 1e-9:
            break
        found.append(best[1])
    return sorted(found)


def _tree(g: np.ndarray, h: np.ndarray, most: int) -> np.ndarray:
    """Leaf value of each bin, from sums of gradients and curvatures by bin."""
    cg, ch = np.concatenate(([0], np.cumsum(g))), np.concatenate(([0], np.cumsum(h)))
    gain = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + RIDGE)
    edges = [0, *_cuts(gain, len(g), most), len(g)]
    out = np.zeros(len(g))
    for a, b in itertools.pairwise(edges):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + RIDGE)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, leaf values by bin) of the best tree that cuts the rows once and then each side's columns once."""
    cg, ch = np.cumsum(g, axis=0), np.cumsum(h, axis=0)

    def sides(sg: np.ndarray, sh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of sums, the best column cut and its gain."""
        left_g, left_h = np.cumsum(sg, axis=1)[:, :-1], np.cumsum(sh, axis=1)[:, :-1]
        all_g, all_h = sg.sum(axis=1)[:, None], sh.sum(axis=1)[:, None]
        gain = left_g**2 / (left_h + RIDGE) + (all_g - left_g) ** 2 / (all_h - left_h + RIDGE)
        at = gain.argmax(axis=1)
        return gain[np.arange(len(gain)), at], at + 1

    if min(g.shape) < 2:
        return 0.0, np.zeros_like(g)
    low, low_at = sides(cg[:-1], ch[:-1])
    high, high_at = sides(cg[-1] - cg[:-1], ch[-1] - ch[:-1])
    k = int((low + high).argmax())
    out = np.zeros_like(g)
    for rows, at in ((slice(0, k + 1), low_at[k]), (slice(k + 1, None), high_at[k])):
        for cols in (slice(0, at), slice(at, None)):
            out[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + RIDGE)
    return float(low[k] + high[k] - g.sum() ** 2 / (h.sum() + RIDGE)), out


@dataclass
class Gam:
    """Bin edges and lookup tables; scores whole matrices."""

    edges: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)], 1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        if not self.edges:
            return np.full(len(x), self.base)
        b, out = self.bins(x), np.full(len(x), self.base)
        for k, table in enumerate(self.tables):
            out += table[b[:, k]]
        for (i, j), table in self.pairs.items():
            out += table[b[:, i], b[:, j]]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """Cyclic boosting of the figures' tables, then of the best pairs' tables."""
    model = Gam()
    if not len(y):
        return model
    model.base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    model.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    b = model.bins(x)
    f = np.full(len(y), model.base)

    def missed() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for k, table in enumerate(model.tables):
            g, h = missed()
            step = RATE * _tree(np.bincount(b[:, k], g, len(table)), np.bincount(b[:, k], h, len(table)), 3)
            table += step
            f += step[b[:, k]]

    def sums(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        shape = len(model.tables[i]), len(model.tables[j])
        cell, (g, h) = b[:, i] * shape[1] + b[:, j], missed()
        return np.bincount(cell, g, shape[0] * shape[1]).reshape(shape), np.bincount(cell, h, shape[0] * shape[1]).reshape(shape)

    gains = sorted(((_pair_tree(*sums(i, j))[0], i, j) for i, j in itertools.combinations(range(x.shape[1]), 2)), reverse=True)
    for gain, i, j in gains[:PAIRS]:
        if gain > 0:
            model.pairs[i, j] = np.zeros((len(model.tables[i]), len(model.tables[j])))
    for _ in range(PAIR_ROUNDS):
        for (i, j), table in model.pairs.items():
            step = RATE * _pair_tree(*sums(i, j))[1]
            table += step
            f += step[b[:, i], b[:, j]]
    return model


def learnable(id_col: str = "doc_id") -> Column:
    """Rows that may be learned from: those whose crc32 of the id as text leaves a remainder other than 1 by 3."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) != 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows: int = TRAIN_ROWS, seed: int = SEED) -> Gam:
    """The model from at most ``train_rows`` labelled documents."""
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).cast("int").alias("y"))
    sample = known.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(train_rows)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("doc_text")).join(F.broadcast(sample), "doc_id")
    # The limit holds for rows too, should one of the ids repeat; a null id has no label.
    rows = figures(texts, "doc_id", "doc_text").join(F.broadcast(sample), "doc_id").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id", "x").limit(train_rows).collect()
    return fit(np.array([r["x"] for r in rows]).reshape(-1, len(FIGURES)), np.array([r["y"] for r in rows], float))


def score(docs: DataFrame, model: Gam, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from a score of 0.5 on), for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, windows, gam = WordHasher(), WindowHasher(), shared.value
        for batch in batches:
            data, offs = text_bytes(batch.column(1))
            x = np.array([_figures(data[offs[k] : offs[k + 1]], hasher, windows) for k in range(batch.num_rows)]).reshape(-1, len(FIGURES))
            p = gam.scores(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("doc_text")).mapInArrow(each, f"doc_id {dict(docs.dtypes)[id_col]}, score double, predicted int")
