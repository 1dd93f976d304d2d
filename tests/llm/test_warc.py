import hashlib
import time

import numpy as np
from patronage.llm.common import scratch
from patronage.llm.warc import candidates, read_warc, reachable, warc_round_trip, with_records, write_warc


def test_round_trip_with_magic_in_payloads(spark):
    trap = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    long = "é" * 700
    rows = [(1, "u", trap), (2, "u v\n", trap * 30), (3, None, long), (4, "u", long), (5, "u", None), (6, "u", ""), (7, "u", "x" * 999), (8, "u", "x" * 999), (9, "u", "x\r\n\r\n"), (10, "u", long)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, kind string")
    got = {r.page_id: r for r in warc_round_trip(df).collect()}
    assert sorted(got) == [r[0] for r in rows]
    for i, _, h in rows:
        raw = (h or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (got[i].record_type, got[i].refers_to) == (("revisit", 10) if i in (3, 4) else ("response", None))


def test_many_records_in_a_file(spark):
    df = spark.range(300).selectExpr("id AS page_id", "'u' AS url", "repeat('WARC/1.1\r\n', int(id % 5)) AS html").coalesce(1)
    path = scratch(spark, "warc-test")
    write_warc(with_records(df), path, rolls=((0, 130), (30, 20)))
    assert read_warc(spark, path).count() == 300
    sizes = [r.length for r in spark.read.format('binaryFile').option('pathGlobFilter', 'part-*').load(path).select('length').collect()]
    assert len(sizes) == 2 + 6  # 180 records below 30 bytes, 120 from there on


def test_chain_rejects_what_it_does_not_reach():
    for rows, want in (([(0, 10), (10, 30), (12, 20), (20, 30), (30, 50)], {0, 10, 30}), ([(5, 9)], set()), ([(0, 7)], {0}), ([], set())):
        at, after = (np.array([r[k] for r in rows], np.int64) for k in (0, 1))
        assert set(at[reachable(at, after)].tolist()) == want
    chain = np.arange(0, 5001)
    assert reachable(chain[:-1], chain[1:]).all()


def test_headers_in_payloads_cost_no_more():
    fake = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n"
    began = time.time()
    for raw in (fake * 40_000, (fake + b"\r\n") * 40_000, b"WARC/1.1\r\n" * 200_000 + b"\r\n\r\n"):
        at, _, after = candidates(raw)
        reachable(at, after)
    assert time.time() - began < 10


def test_rows_that_repeat_a_page(spark):
    long, other = "y" * 1500, "z" * 1500
    rows = [(5, long), (5, long), (3, long), (7, other), (7, long + "!"), (None, long), (None, None), (8, "short"), (8, "short")]
    df = spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id long, url string, html string")
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc_round_trip(df).collect()), key=str)
    want = [(5, 1500, "response", None)] * 2 + [(3, 1500, "revisit", 5), (7, 1500, "response", None), (7, 1501, "response", None), (None, 1500, "revisit", 5), (None, 0, "response", None)] + [(8, 5, "response", None)] * 2
    assert got == sorted(want, key=str)


def test_large_pages_have_archives_of_their_own(spark):
    rows = [(k, "u", f"{k}" * n) for k, n in ((1, 10), (2, 1 << 20), (3, (1 << 20) + 5), (4, 1 << 17), (5, 3))]
    got = warc_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.payload_bytes) for r in got) == [(i, len(h)) for i, _, h in rows]


def test_ids_of_any_characters(spark):
    """A missing id and an empty one differ; line breaks, brackets and signs of ids come back as they were."""
    long = "w" * 1200
    ids = ["", None, "a b", "x\r\nContent-Length: 3\r\n\r\n", "<urn:page:1>", "1+1%2B", "é漢/?", " "]
    df = spark.createDataFrame([(i, "u", f"{k}" * 40) for k, i in enumerate(ids)] + [("z\n", "u", long), ("", "u", long)], "page_id string, url string, html string")
    got = [(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc_round_trip(df).collect()]
    want = [(i, 40, "response", None) for i in ids] + [("z\n", 1200, "response", None), ("", 1200, "revisit", "z\n")]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_empty_table(spark):
    assert warc_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
