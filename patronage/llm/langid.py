"""Language identification by interpolated Kneser-Ney character models.

Each language gets a character model of orders 1 to ``ORDER`` over normalised text: letters in lower case, everything
else one space. Counts are Spark aggregations over a sample of labelled texts, drawn for each language so that about
``per_language`` documents, ``LANGUAGE_CHARS`` characters and its part of ``ALL_CHARS`` are expected (a documented bound
of the classifier's training set, which bounds the tables whatever the number of languages). Kneser-Ney takes raw counts at the
highest order and continuation counts below it; the discounted share of each gram and the weight left to the next
lower order of each context are held in sorted arrays of 64-bit gram hashes, so a lookup is a binary search.

A text's language is the one with the lowest cross-entropy for each character. The score is that language's share
when cross-entropies are weighed by the number of characters, at most ``SURE``. Rejection is calibrated: a tenth of
the sample is held back from the counts, and a text is rejected if its cross-entropy is beyond what ``QUANTILE`` of
the held-back texts of that language have, by a margin that shrinks with the text's length.

Edge cases: null, empty and letterless texts are ``und`` with score 0 and rejected; rows that repeat a doc_id each
get a result; without any labelled text every document is ``und``; whole texts are scored, in steps of bounded size that
hand on their last characters, so that no step shows in the score. A letter is a code point of a letter category, in
any plane. Other columns pass through ``identify`` untouched.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patronage.llm.common import mix, stash, text_bytes

ORDER, PER_LANGUAGE, SEED = 4, 1500, 7
SURE, QUANTILE, SLACK, SHORT = 40, 0.999, 0.5, 8.0
LANGUAGE_CHARS, ALL_CHARS = 5_000_000, 100_000_000
#: Characters of one numpy step.
STEP = 1 << 20
#: Languages up to this number are broadcast when the sample is drawn; beyond it they are joined by a shuffle.
BROADCAST_LANGUAGES = 10_000
SALT = 0x9E3779B97F4A7C15


@functools.cache
def _folded() -> np.ndarray:
    """Each code point's lower case, or 0 if it is no letter."""
    low = ((c, chr(c)) for c in range(0x110000))
    return np.array([(ord(x.lower()) if len(x.lower()) == 1 else c) if x.isalpha() else 0 for c, x in low], np.uint32)


def _steps(text: str | None, most: int = STEP) -> Iterator[np.ndarray]:
    """A text's letters in lower case, each run of other characters one 0, with ``ORDER - 1`` characters before.

    Each step begins with the characters before it, zeros at the start; the last step ends with a 0. A text without
    letters has no step.
    """
    before, open_end = np.zeros(ORDER - 1, np.uint64), False
    for at in range(0, len(text or ""), most):
        cps = _folded()[np.frombuffer(text[at : at + most].encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.uint64)
        cps = cps[(cps != 0) | (np.concatenate(([int(open_end)], cps[:-1])) != 0)]
        if len(cps):
            step = np.concatenate((before, cps))
            before, open_end = step[1 - ORDER :], cps[-1] != 0
            yield step
    if open_end:
        yield np.concatenate((before, np.zeros(1, np.uint64)))


def _tails(steps: list[np.ndarray]) -> np.ndarray:
    """One row for each character after the first ``ORDER - 1`` of each step: it and the characters before it."""
    return np.concatenate([np.lib.stride_tricks.sliding_window_view(x, ORDER) for x in steps])


def _hash_rows(chars: np.ndarray) -> np.ndarray:
    h = np.full(len(chars), chars.shape[1], np.uint64)
    for k in range(chars.shape[1]):
        h = mix((h + chars[:, k] + np.uint64(1)) * np.uint64(SALT))
    return h


def _hashes(tails: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each character's gram of order n, of the gram's context and of the gram without its first character."""
    none = np.zeros(len(tails), np.uint64)
    return _hash_rows(tails[:, ORDER - n :]), _hash_rows(tails[:, ORDER - n : -1]) if n > 1 else none, _hash_rows(tails[:, ORDER - n + 1 :]) if n > 1 else none


def _runs(lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` characters each, one row at least."""
    start = total = 0
    for k, n in enumerate(lengths):
        if k > start and total + n > most:
            yield start, k
            start, total = k, 0
        total += n
    if lengths:
        yield start, len(lengths)


COUNTS = "lang string, n int, gram long, context long, suffix long, c long"


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct grams of all orders with their counts, for each language and run of texts."""
    for batch in batches:
        text, lang = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        by: dict[str, list[np.ndarray]] = {}
        for t, name in zip(text, lang, strict=True):
            by.setdefault(name, []).extend(_steps(t))
        for name, steps in by.items():
            for a, b in _runs([len(x) for x in steps], STEP):
                tails = _tails(steps[a:b])
                for n in range(1, ORDER + 1):
                    whole, context, suffix = _hashes(tails, n)
                    gram, first, count = np.unique(whole, return_index=True, return_counts=True)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([name] * len(gram)), pa.array(np.full(len(gram), n, np.int32)), pa.array(gram.view(np.int64)),
                        pa.array(context[first].view(np.int64)), pa.array(suffix[first].view(np.int64)), pa.array(count.astype(np.int64)),
                    ], ["lang", "n", "gram", "context", "suffix", "c"])


class Model:
    """Sorted hash arrays of all languages; scores characters."""

    def __init__(self, grams: pd.DataFrame, langs: list[str]) -> None:
        self.langs, self.share, self.rest, self.floor = langs, {}, {}, {}
        for k, name in enumerate(langs):
            own = grams[grams["lang"] == name]
            for n in range(1, ORDER + 1):
                t = own[own["n"] == n]
                value = t["v"].to_numpy(float)
                once, twice = (value == 1).sum(), (value == 2).sum()
                cut = once / (once + 2 * twice) if once + twice else 0.5
                contexts, where = np.unique(t["context"].to_numpy().view(np.uint64), return_inverse=True)
                total, kinds = np.bincount(where, value), np.bincount(where)
                gram = t["gram"].to_numpy().view(np.uint64)
                order = np.argsort(gram)
                self.share[k, n] = (gram[order], (np.maximum(value - cut, 0) / total[where])[order] if len(t) else value)
                self.rest[k, n] = (contexts, cut * kinds / np.maximum(total, 1))
            self.floor[k] = 1.0 / (2 * len(self.share[k, 1][0]) + 2)

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray, absent: float) -> np.ndarray:
        known, value = table
        if not len(known):
            return np.full(len(keys), absent)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[at] == keys, value[at], absent)

    def surprise(self, grams: list[np.ndarray], contexts: list[np.ndarray]) -> np.ndarray:
        """-ln p of each gram in each language; grams[n - 1] and contexts[n - 1] hold the hashes of order n."""
        out = np.empty((len(self.langs), len(grams[0])), np.float32)
        for k in range(len(self.langs)):
            p = np.full(len(grams[0]), self.floor[k])
            for n in range(1, ORDER + 1):
                p = self._find(self.share[k, n], grams[n - 1], 0.0) + self._find(self.rest[k, n], contexts[n - 1], 1.0) * p
            out[k] = -np.log(p)
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy of each text in each language, characters); NaN without letters."""
        total, count = np.zeros((len(self.langs), len(texts))), np.zeros(len(texts), np.int64)
        run, held = [], 0

        def add() -> None:
            tails, sizes = _tails([x for _, x in run]), np.array([len(x) - ORDER + 1 for _, x in run])
            # Each different gram of the run is looked up once.
            _, place, codes = np.unique(_hash_rows(tails), return_index=True, return_inverse=True)
            found = [_hashes(tails[place], n) for n in range(1, ORDER + 1)]
            bits = self.surprise([x[0] for x in found], [x[1] for x in found])
            heads, rows = np.cumsum(sizes) - sizes, np.array([k for k, _ in run])
            for lang in range(len(self.langs)):
                np.add.at(total[lang], rows, np.add.reduceat(bits[lang][codes], heads, dtype=float))
            np.add.at(count, rows, sizes)

        for k, t in enumerate(texts):
            for step in _steps(t):
                if run and held + len(step) > STEP:
                    add()
                    run, held = [], 0
                run.append((k, step))
                held += len(step)
        if run:
            add()
        return np.where(count > 0, total / np.maximum(count, 1), np.nan), count


def _limit(n: np.ndarray, base: np.ndarray) -> np.ndarray:
    return base * (1 + SLACK) + SHORT / np.sqrt(np.maximum(n, 1))


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int = PER_LANGUAGE, seed: int = SEED) -> tuple[Model, dict[str, float]]:
    """(model, highest usual cross-entropy of each language) from labelled documents."""
    known = labelled.where(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("doc_text"), F.col(lang_col).cast("string").alias("doc_lang"), F.xxhash64(F.col(id_col), F.lit(seed)).alias("h"))
    draw = F.shiftrightunsigned("h", 11) / float(1 << 53)
    sizes = stash(known.groupBy("doc_lang").agg(F.count("*").alias("n"), F.sum(F.length("doc_text")).alias("chars"), F.min(draw).alias("least")), "langs")
    languages = sizes.count()
    chars = min(LANGUAGE_CHARS, ALL_CHARS // max(1, languages))
    sizes = sizes.select("doc_lang", "least", F.greatest(F.col("n") / per_language, F.coalesce("chars", F.lit(0)) / chars).alias("times"))
    if languages <= BROADCAST_LANGUAGES:
        sizes = F.broadcast(sizes)
    # The document drawn first stays whatever its length: a language of few long documents is learned from one of them.
    first = draw == F.col("least")
    sample = stash(known.join(sizes, "doc_lang").where((draw * F.col("times") < 1) | first).select("doc_text", "doc_lang", "h", first.alias("first")), "langsample")
    held = (F.pmod(F.xxhash64("h"), F.lit(10)) == 0) & ~F.col("first")
    raw = stash(sample.where(~held).select("doc_text", "doc_lang").mapInArrow(_count_grams, COUNTS).groupBy("lang", "n", "gram").agg(F.min("context").alias("context"), F.min("suffix").alias("suffix"), F.sum("c").alias("c")), "grams")
    continued = raw.where("n > 1").groupBy("lang", (F.col("n") - 1).alias("n"), F.col("suffix").alias("gram")).agg(F.count("*").alias("v"))
    top = raw.where(F.col("n") == ORDER).select("lang", "n", "gram", "context", F.col("c").alias("v"))
    low = raw.where(F.col("n") < ORDER).join(continued, ["lang", "n", "gram"]).select("lang", "n", "gram", "context", "v")
    grams = top.unionByName(low).toArrow().to_pandas()
    langs = sorted(grams["lang"].unique())
    model, usual = Model(grams, langs), {}
    if langs:
        check = sample.where(held).select(F.col("doc_lang").alias("lang"), "doc_text")
        entropy = _scored(check, model, {}, "doc_text", ["lang"]).where((F.col("lang") == F.col("lang_pred")) & (F.col("chars") >= 100))
        usual = {r["lang"]: r["q"] for r in entropy.groupBy("lang").agg(F.percentile("entropy", QUANTILE).alias("q")).collect()}
    return model, usual


SCORES = (("lang_pred", T.StringType(), pa.string()), ("score", T.DoubleType(), pa.float64()), ("entropy", T.DoubleType(), pa.float64()), ("chars", T.LongType(), pa.int64()), ("accepted", T.BooleanType(), pa.bool_()))


def _scored(docs: DataFrame, model: Model, usual: dict[str, float], text_col: str, keep: list[str]) -> DataFrame:
    """The kept columns and SCORES of every row."""
    shared = docs.sparkSession.sparkContext.broadcast((model, usual))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, limits = shared.value
        base = np.array([limits.get(name, np.inf) for name in own.langs])
        for batch in batches:
            place = batch.num_columns - 1
            _, offs = text_bytes(batch.column(place))
            for a, b in _runs(np.diff(offs).tolist(), STEP):
                rows = batch.slice(a, b - a)
                texts = rows.column(place).to_pylist()
                if own.langs:
                    ce, n = own.entropies(texts)
                    some = n > 0
                    best = np.argmin(np.where(some, ce, 0), axis=0)
                    low = ce[best, np.arange(len(best))]
                    share = 1 / np.exp(np.clip((low - ce) * np.minimum(n, SURE), -700, 0)).sum(axis=0)
                    good = some & (low <= _limit(n, base[best]))
                else:
                    n, some = np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
                    best, low, share, good = n, n * np.nan, n * 0.0, some
                pred = [own.langs[k] if ok else "und" for k, ok in zip(best.tolist(), some.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns[:place], pa.array(pred), pa.array(np.where(some, share, 0.0)), pa.array(np.where(some, low, np.nan), mask=~some), pa.array(n), pa.array(good)], [*keep, *(x[0] for x in SCORES)]
                )

    schema = T.StructType([*docs.select(*keep).schema.fields, *(T.StructField(a, b) for a, b, _ in SCORES)])
    return docs.select(*keep, F.col(text_col).alias("text_to_score")).mapInArrow(each, schema)


def training_rows(id_col: str = "doc_id") -> Column:
    """Rows that may be learned from: those whose crc32 of the id as text leaves a remainder other than 2 by 4."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) != 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: list[str] | None = None, per_language: int = PER_LANGUAGE) -> DataFrame:
    """The kept columns (doc_id unless told) with lang_pred, score, entropy, chars and accepted, for every row."""
    model, usual = train(docs.where(training_rows(id_col)), text_col, lang_col, id_col, per_language)
    return _scored(docs, model, usual, text_col, keep or [id_col])
