"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step works on; bounds a Python worker's memory whatever the batch.
STEP_BYTES = 1 << 20
#: Longest text, in bytes of UTF-8, that one group of documents holds on average.
PART_BYTES = 6 << 20

SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
MULTIPLIER, WORD_MULTIPLIER = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def work_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (``spark.checkpoint.dir``); a temporary one on a local master where none is set."""
    top = spark.conf.get("spark.checkpoint.dir", "")
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = tempfile.mkdtemp(prefix="spark-work-")
        spark.conf.set("spark.checkpoint.dir", top)
    return top.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def drop() -> None:
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended already: the folder is the cluster's to clear
            pass

    atexit.register(drop)
    return path


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts the lineage and outlives executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; none of a null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def text_marks(text: Column) -> tuple[Column, Column]:
    """Two hashes that tell a text from others."""
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def text_parts(docs: DataFrame, text_col: str) -> int:
    """How many groups of about PART_BYTES the texts make."""
    total = docs.agg(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0
    return max(1, -(-total // PART_BYTES))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets) of a string column without copies; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**k and its inverse modulo 2**64, k below n."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(max(n, 1), b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class WordHasher:
    """Hashes of all white-space separated words of one text, in numpy steps of bounded size."""

    def __init__(self) -> None:
        self.space = np.zeros(256, bool)
        self.space[list(SPACES)] = True
        self.codes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(MULTIPLIER))
        self.up, self.down = powers(MULTIPLIER, STEP_BYTES)

    def _step(self, data: np.ndarray) -> np.ndarray:
        solid = ~self.space[data]
        edge = np.flatnonzero(np.diff(np.concatenate(([0], solid.view(np.int8), [0]))))
        start, end = edge[::2], edge[1::2]
        if len(data) > len(self.up):
            self.up, self.down = powers(MULTIPLIER, len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.codes[data] * self.up[: len(data)], out=sums[1:])
        return mix((sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def __call__(self, data: np.ndarray) -> np.ndarray:
        if len(data) <= STEP_BYTES:
            return self._step(data)
        out, at = [], 0
        while at < len(data):
            stop = min(at + STEP_BYTES, len(data))
            if stop < len(data):  # cut at white space; a longer word makes a longer step
                gaps = np.flatnonzero(self.space[data[at:stop]])
                if len(gaps):
                    stop = at + int(gaps[-1]) + 1
                else:
                    rest = np.flatnonzero(self.space[data[stop:]])
                    stop = stop + int(rest[0]) + 1 if len(rest) else len(data)
            out.append(self._step(data[at:stop]))
            at = stop
        return np.concatenate(out)


class WindowHasher:
    """Hashes of runs of consecutive words from the words' hashes; another multiplier gives independent hashes."""

    def __init__(self, multiplier: int = WORD_MULTIPLIER) -> None:
        self.multiplier = multiplier
        self.up, self.down = powers(multiplier, 1 << 16)

    def sums(self, word_hashes: np.ndarray) -> np.ndarray:
        n = len(word_hashes)
        if n > len(self.up):
            self.up, self.down = powers(self.multiplier, 2 * n)
        out = np.zeros(n + 1, np.uint64)
        np.cumsum(word_hashes * self.up[:n], out=out[1:])
        return out

    def at(self, sums: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
        return mix((sums[starts + length] - sums[starts]) * self.down[starts])


def let(value: Column, then) -> Column:
    """``then`` of a value that is computed once, however often lambdas inside ``then`` use it."""
    return F.element_at(F.transform(F.array(value), then), 1)
