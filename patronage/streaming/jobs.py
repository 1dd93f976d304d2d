"""Streaming forms of the event jobs. Sources are files, sinks Parquet; a run takes what is there and ends."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LATE = "1 hour"


def event_stream(spark: SparkSession, path: str, schema, per_trigger: int = 1000) -> DataFrame:
    """Events as they land in a folder; ``ts`` becomes the event time (STR-1)."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def drain(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run the stream over what is there and read its output; the checkpoint stands for the high-water mark."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def drain_each(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> None:
    """Run the stream and hand every micro-batch to ``each``."""
    stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def volumes(stream: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = LATE) -> DataFrame:
    """Events of each type in tumbling or sliding windows (STR-2, STR-3); windows close once they are ``late`` behind."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return stream.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), "event_type", "n")


def session_windows(stream: DataFrame, gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    """Sessions by session windows; the length is that of the events, one minute at least (STR-5)."""
    g = stream.withWatermark("ts", late).groupBy("entity", F.session_window("ts", gap)).agg(F.min("ts").alias("session_start"), F.max("ts").alias("session_end"), F.count("*").alias("events"))
    minutes = (F.unix_micros("session_end") - F.unix_micros("session_start")) / 6e7
    return g.select("entity", "session_start", "session_end", "events", F.greatest(F.lit(1.0), minutes).alias("minutes"))


def without_repeats(stream: DataFrame, keys: list[str], late: str = LATE) -> DataFrame:
    """Events whose keys were not seen within the watermark (EVT-10 on streams)."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def surges(counts: DataFrame, history: DataFrame, factor: float = 1.5) -> DataFrame:
    """Windows whose count is ``factor`` times the expectation of their type, with magnitude and severity (STR-4).

    ``history`` (event_type, expected) is one row for each type, so the join is with a small static table.
    """
    m = F.col("n") / F.col("expected")
    severity = F.when(m >= 3, "critical").when(m >= 2, "high").otherwise("medium")
    return counts.join(F.broadcast(history), "event_type").where(m >= factor).select("window_start", "event_type", "n", "expected", m.alias("magnitude"), severity.alias("severity"))


def latest_by_key(target: str, keys: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that upserts into a Parquet table of versions: each batch adds a folder, readers take the last (STR-6).

    The last is that of the largest ``order``, whichever batch it came in; of equal ones the later batch's. ``compact``
    keeps the number of folders small.
    """

    def each(batch: DataFrame, no: int) -> None:
        top = batch.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in batch.columns if c not in keys]), order).alias("r")).select(*keys, "r.*")
        top.withColumn("batch_no", F.lit(no)).write.mode("overwrite").parquet(f"{target}/batch={no}")

    return each


def _last(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, "batch_no")).alias("r")).select(*keys, "r.*")


def read_latest(spark: SparkSession, target: str, keys: list[str], order: str) -> DataFrame:
    """The last version of every key."""
    return _last(spark.read.parquet(target).drop("batch"), keys, order).drop("batch_no")


def compact(spark: SparkSession, target: str, into: str, keys: list[str], order: str) -> None:
    """Write the last versions of all batches so far as one folder of a new table, which later batches go on from."""
    _last(spark.read.parquet(target).drop("batch"), keys, order).write.mode("overwrite").parquet(f"{into}/batch=-1")
