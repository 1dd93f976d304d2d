"""Fill-in-middle: prefix, middle and suffix of each text in the order that a code model is trained on.

A text has n code points; the middle lies between two cuts that a digest of its doc_id fixes, so reruns agree. Places
of code points in the UTF-8 bytes are found eight bytes at a time: the bytes of many texts are viewed as uint64 words,
the bytes that end a code point are marked in each word by shifts and masks, ``bitwise_count`` counts the marks of a
word, a search in the running counts finds the word that holds a wanted mark, and the mark is then resolved within its
word by a multiplication that sums bytes. No text is decoded and no byte is looked at alone.

Texts are worked on in steps of about ``STEP_BYTES`` bytes; a longer text is a step of its own.

Edge cases: null and empty texts, texts that hold a marker and a share of all others stay plain (prefix_chars and
middle_chars are null); any part may be empty; a null doc_id counts as an empty one; rows that repeat a doc_id get the
same cuts of their own texts. Other columns are ignored unless they are carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patronage.llm.common import STEP_BYTES, text_bytes

#: The three markers, which must be of one length and begin with a character that no other place of them has.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN_FROM, SPM_BELOW = 90, 20
RESULT = "n long, form string, prefix_chars long, middle_chars long, output string"

LOW = np.uint64(0x0101010101010101)


def unit_ends(data: np.ndarray) -> np.ndarray:
    """uint64 words, little-endian, whose byte k is 1 where that byte of ``data`` (whole texts in UTF-8) ends a code point."""
    words = np.zeros(len(data) // 8 + 1, np.uint64)
    words.view(np.uint8)[: len(data)] = data
    # A byte continues a code point if its two top bits are 10; the padding starts a code point each byte.
    starts = ~((words >> np.uint64(7)) & ~(words >> np.uint64(6))) & LOW
    # A byte ends a code point if the next one starts one: each mark moves down by a byte.
    ends = starts >> np.uint64(8)
    ends[:-1] |= (starts[1:] & np.uint64(1)) << np.uint64(56)
    used = len(data) - 8 * (len(words) - 1)
    ends[-1] &= (np.uint64(1) << np.uint64(8 * used)) - np.uint64(1)
    return ends


class Units:
    """Counts and places of the code points of many texts that lie one after the other."""

    def __init__(self, data: np.ndarray) -> None:
        self.ends = unit_ends(data)
        self.before = np.zeros(len(self.ends) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.ends), out=self.before[1:])

    def count(self, places: np.ndarray) -> np.ndarray:
        """How many code points end before each byte place."""
        word, at = places >> 3, (places & 7).astype(np.uint64)
        below = (np.uint64(1) << (np.uint64(8) * at)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.ends[word] & below)

    def place(self, nth: np.ndarray) -> np.ndarray:
        """The byte place after the nth code point, from 1; 0 for 0."""
        word = np.maximum(np.searchsorted(self.before, nth, "left") - 1, 0)
        rank = (nth - self.before[word]).astype(np.uint64)
        # Byte k of the product is the number of marks in bytes 0 to k: none is above 8, so bytes do not carry.
        sums = self.ends[word] * LOW
        # A byte that is at least rank keeps its top bit when rank is taken off; those below it come before the mark.
        reached = (((sums | (LOW << np.uint64(7))) - rank * LOW) >> np.uint64(7)) & LOW
        at = np.uint64(8) - np.bitwise_count(reached).astype(np.uint64)
        return np.where(nth > 0, 8 * word + at.astype(np.int64) + 1, 0)


def cut_words(id_col: Column) -> Column:
    """Four unsigned numbers of 32 bits from the digest of an id."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)])


def _arranged(data: np.ndarray, offs: np.ndarray, h: np.ndarray) -> list[list]:
    """Columns of ``RESULT`` of the texts in ``data``."""
    units = Units(data)
    done = units.count(offs)
    n = np.diff(done)
    a, b = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
    first, last = np.minimum(a, b), np.maximum(a, b)
    # A cut before the first code point of a text is after the last of the text before it.
    cut, end = units.place(done[:-1] + first), units.place(done[:-1] + last)
    plain, spm = (n == 0) | (h[:, 2] % 100 >= PLAIN_FROM), h[:, 3] % 100 < SPM_BELOW
    form, prefix, middle, output = [], [], [], []
    raw = data.tobytes()
    for k in range(len(n)):
        text = raw[offs[k] : offs[k + 1]]
        if plain[k] or PREFIX in text or SUFFIX in text or MIDDLE in text:
            form.append("plain")
            prefix.append(None)
            middle.append(None)
            output.append(text)
            continue
        p, m, s = raw[offs[k] : cut[k]], raw[cut[k] : end[k]], raw[end[k] : offs[k + 1]]
        form.append("spm" if spm[k] else "psm")
        prefix.append(int(first[k]))
        middle.append(int(last[k] - first[k]))
        output.append(b"".join((SUFFIX, s, PREFIX, p, MIDDLE, m) if spm[k] else (PREFIX, p, SUFFIX, s, MIDDLE, m)))
    return [n, form, prefix, middle, output]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, carried columns, n (code points), form (plain, psm or spm), prefix_chars, middle_chars and output, for every row."""
    texts = docs.select(F.col(id_col).alias("doc_id"), *carry, cut_words(F.col(id_col)).alias("cut_numbers"), F.col(text_col).alias("doc_text"))
    keep = texts.columns[:-2]
    schema = T.StructType([*texts.select(*keep).schema.fields, *T.StructType.fromDDL(RESULT).fields])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_bytes(batch.column(len(keep) + 1))
            h = batch.column(len(keep)).flatten().to_numpy().reshape(-1, 4)
            at = 0
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(offs, offs[at] + STEP_BYTES, "right")) - 1)
                made = _arranged(data[offs[at] : offs[stop]], offs[at : stop + 1] - offs[at], h[at:stop])
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
                made = [pa.array(v, t) for v, t in zip(made, kinds, strict=True)]
                part = batch.slice(at, stop - at)
                yield pa.RecordBatch.from_arrays([*part.columns[:-2], *made[:-1], made[-1].cast(pa.string())], schema.names)
                at = stop

    return texts.mapInArrow(each, schema)


def restored(output: Column, form: Column) -> Column:
    """The text from an output and its form alone. A text that is not plain holds no marker, so its output holds three."""
    parts = F.split(output, "<[PSM]>")
    first, second, third = (F.get(parts, F.lit(k)) for k in (1, 2, 3))
    return F.when(form == "psm", F.concat(first, third, second)).when(form == "spm", F.concat(second, third, first)).otherwise(output)
