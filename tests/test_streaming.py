"""Streams of more than one batch: stale upserts, late rows, compaction."""

from datetime import datetime

from patronage.streaming import jobs

SCHEMA = "entity long, event_id long, event_type string, ts timestamp"


def batches(spark, path, *parts):
    """Each part as one file, read one file for each micro-batch in the order of their times."""
    import os
    import time

    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/{k}")
        for name in os.listdir(f"{path}/{k}"):
            os.utime(f"{path}/{k}/{name}", (time.time() - 100 + 10 * k,) * 2)
    return jobs.event_stream(spark, f"{path}/*", spark.read.parquet(f"{path}/0").schema, per_trigger=1)


def test_a_stale_event_of_a_later_batch_does_not_win(spark, tmp_path):
    at = datetime(2024, 1, 1)
    stream = batches(spark, str(tmp_path / "in"), [(1, 9, "new", at), (2, 4, "old", at)], [(1, 3, "stale", at), (2, 5, "newer", at), (3, 1, "first", at)])
    out = str(tmp_path / "out")
    jobs.drain_each(stream.select("entity", "event_id", "event_type"), jobs.latest_by_key(out, ["entity"], "event_id"), str(tmp_path / "state"), "append")
    want = {(1, 9, "new"), (2, 5, "newer"), (3, 1, "first")}
    assert {tuple(r) for r in jobs.read_latest(spark, out, ["entity"], "event_id").collect()} == want
    jobs.compact(spark, out, str(tmp_path / "small"), ["entity"], "event_id")
    assert {tuple(r) for r in jobs.read_latest(spark, str(tmp_path / "small"), ["entity"], "event_id").collect()} == want


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    """The window of 1 o'clock has closed when its second row comes; a batch's watermark holds from the second batch after it."""
    day = lambda h, m=0: datetime(2024, 1, 1, h, m)
    stream = batches(spark, str(tmp_path / "in"), [(1, 1, "a", day(1)), (1, 2, "a", day(6))], [(1, 3, "a", day(6, 30))], [(1, 4, "a", day(1, 5))], [(1, 5, "a", day(9))])
    got = jobs.drain(jobs.volumes(stream), str(tmp_path / "out"), str(tmp_path / "state")).collect()
    assert sorted((r.window_start.hour, r.n) for r in got) == [(1, 1), (6, 2)]
