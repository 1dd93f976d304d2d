"""Exact quantiles of any number of rows, for many columns or for many groups at once.

Two readings of the values. The first gives the number of rows and, from mergeable sketches, a bracket around each
wanted quantile that is sure to hold it. The second counts in each task what lies below each bracket and the different
values within it, some thousandths of all rows, and sends only these counts. The value at a rank is then found among
the counts of one bracket; where brackets are large they are dealt to ranges first, so that a task ranks within one
range alone. Quantiles are interpolated between neighbours, as SQL's ``quantile_cont`` does; nulls and NaN are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from patronage.sources.landing import work_path

#: Size of the sketches; half the width of a bracket as a share of all rows; rows up to which a bracket is everything.
ACCURACY, MARGIN, WHOLE_ROWS = 10_000, 1e-3, 5_000
#: Values in brackets beyond which they are dealt to ranges, and how many ranges.
RANGE_ROWS, RANGES = 1_000_000, 256
COUNTS = "target int, value double, n long"


@dataclass(frozen=True)
class Target:
    """A wanted quantile of a series: the ranks that it lies between, and the bracket that holds both."""

    series: int
    at: float
    low: float
    high: float

    @property
    def ranks(self) -> tuple[int, int]:
        return int(np.floor(self.at)), int(np.ceil(self.at))


def _sketch(c: Column, shares: tuple[float, ...]) -> Column:
    cuts = [min(max(s + d, 0.0), 1.0) for s in shares for d in (-MARGIN, MARGIN)]
    return F.struct(F.count(c).alias("n"), F.percentile_approx(c, F.array(*[F.lit(x) for x in cuts]), ACCURACY).alias("cuts"))


def _targets(series: int, sketch, shares: tuple[float, ...]) -> list[Target]:
    n, out = sketch["n"], []
    for k, s in enumerate(shares if n else ()):
        low, high = sketch["cuts"][2 * k : 2 * k + 2]
        low = -np.inf if n <= WHOLE_ROWS or s <= MARGIN else low
        high = np.inf if n <= WHOLE_ROWS or s >= 1 - MARGIN else high
        out.append(Target(series, s * (n - 1), low, high))
    return out


def _counts(rows: DataFrame, targets: list[Target], series_of: Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray]]]) -> DataFrame:
    """(target, value, n): rows of each value within each bracket, and under a null value those below it."""
    by_series: dict[int, list[int]] = {}
    for j, t in enumerate(targets):
        by_series.setdefault(t.series, []).append(j)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below = np.zeros(len(targets), np.int64)
        for batch in batches:
            which, values, counts = [], [], []
            for series, v in series_of(batch):
                v = v[~np.isnan(v)]
                for j in by_series.get(series, ()):
                    low, high = targets[j].low, targets[j].high
                    below[j] += int((v < low).sum())
                    u, c = np.unique(v[(v >= low) & (v <= high)], return_counts=True)
                    which.append(np.full(len(u), j, np.int32))
                    values.append(u)
                    counts.append(c.astype(np.int64))
            if which:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (which, values, counts)], ["target", "value", "n"])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(targets), dtype=np.int32)), pa.nulls(len(targets), pa.float64()), pa.array(below)], ["target", "value", "n"])

    return rows.mapInArrow(each, COUNTS).groupBy("target", "value").agg(F.sum("n").alias("n"))


def _at_ranks(counts: DataFrame, targets: list[Target], large: bool) -> dict[int, tuple[float, float]]:
    """For each target the values at its two ranks."""
    spark = counts.sparkSession
    ranks = spark.createDataFrame([(j, *t.ranks) for j, t in enumerate(targets)], "target int, first long, second long")
    keys, before = ["target"], F.lit(0)
    if large:
        path = work_path(spark, "ranges")
        counts.repartitionByRange(RANGES, "target", F.col("value").asc_nulls_first()).withColumn("part", F.spark_partition_id()).write.parquet(path)
        counts = spark.read.parquet(path)
        sizes = counts.groupBy("target", "part").agg(F.sum("n").alias("size"))
        # One row for each range and target.
        start = sizes.select("target", "part", "size", (F.sum("size").over(W.partitionBy("target").orderBy("part")) - F.col("size")).alias("start")).join(F.broadcast(ranks), "target")
        holds = lambda r: (F.col("start") <= F.col(r)) & (F.col(r) < F.col("start") + F.col("size"))
        chosen = start.where(holds("first") | holds("second")).select("target", "part", "start")
        counts, keys, before = counts.join(F.broadcast(chosen), ["target", "part"]), ["target", "part"], F.col("start")
    up_to = before + F.sum("n").over(W.partitionBy(*keys).orderBy(F.col("value").asc_nulls_first()))
    seen = counts.withColumn("up_to", up_to).join(F.broadcast(ranks), "target").where("value IS NOT NULL")
    value = lambda r: F.min(F.when((F.col("up_to") > F.col(r)) & (F.col("up_to") - F.col("n") <= F.col(r)), F.col("value"))).alias(r)
    return {x["target"]: (x["first"], x["second"]) for x in seen.groupBy("target").agg(value("first"), value("second")).collect()}


def _solve(rows: DataFrame, targets: list[Target], sizes: dict[int, int], series_of) -> list[float]:
    held = sum(sizes[t.series] if sizes[t.series] <= WHOLE_ROWS else 2 * MARGIN * sizes[t.series] for t in targets)
    found = _at_ranks(_counts(rows, targets, series_of), targets, held > RANGE_ROWS) if targets else {}
    out = []
    for j, t in enumerate(targets):
        low, high = found.get(j, (None, None))
        if low is None or high is None:
            raise RuntimeError("the rows changed between two readings")
        out.append(low + (t.at - t.ranks[0]) * (high - low))
    return out


def quantiles(df: DataFrame, columns: list[Column], shares: tuple[float, ...]) -> list[list[float]]:
    """For each column its exact quantiles at ``shares``; zeros where a column has no value."""
    names = [f"c{k}" for k in range(len(columns))]
    rows = df.select(*[F.nanvl(c.cast("double"), F.lit(None).cast("double")).alias(n) for c, n in zip(columns, names, strict=True)])
    one = rows.agg(*[_sketch(F.col(n), shares).alias(n) for n in names]).first()
    targets = [t for k, n in enumerate(names) for t in _targets(k, one[n], shares)]

    def series_of(batch: pa.RecordBatch):
        for k in range(batch.num_columns):
            yield k, batch.column(k).to_numpy(zero_copy_only=False)

    found = iter(_solve(rows, targets, {k: one[n]["n"] for k, n in enumerate(names)}, series_of))
    return [[next(found) for _ in shares] if one[n]["n"] else [0.0] * len(shares) for n in names]


def quantiles_by(df: DataFrame, by: str, value: Column, shares: tuple[float, ...]) -> dict[str | None, list[float]]:
    """Exact quantiles of a value within each group of a string column; the driver holds a bracket for each group, so groups are to be few, their rows may be many."""
    rows = df.select(F.col(by).cast("string").alias("g"), F.nanvl(value.cast("double"), F.lit(None).cast("double")).alias("v")).where("v IS NOT NULL")
    sketches = sorted(rows.groupBy("g").agg(_sketch(F.col("v"), shares).alias("s")).collect(), key=lambda r: (r["g"] is not None, r["g"] or ""))
    place = {r["g"]: k for k, r in enumerate(sketches)}
    targets = [t for k, r in enumerate(sketches) for t in _targets(k, r["s"], shares)]

    def series_of(batch: pa.RecordBatch):
        coded = batch.column(0).dictionary_encode()
        codes = coded.indices.fill_null(-1).to_numpy()
        v = batch.column(1).to_numpy(zero_copy_only=False)
        for c in np.unique(codes):
            yield place[coded.dictionary[int(c)].as_py() if c >= 0 else None], v[codes == c]

    found = iter(_solve(rows, targets, {k: r["s"]["n"] for k, r in enumerate(sketches)}, series_of))
    return {r["g"]: [next(found) for _ in shares] for r in sketches}
