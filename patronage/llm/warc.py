"""WARC archives: writing pages with revisit records, and reading with boundary-chain verification.

Writing: a page's payload is its html in UTF-8. Of pages with equal payloads of at least ``least`` bytes, the one with
the largest page_id is the response and the others are revisit records that refer to it; smaller payloads are always
responses. Spark's text writer makes the archives: a row is a record, and the line separator is the record's end.
Archives are rolled by number of records for each class of payload size (``ROLLS``), so that none passes 64 MB, headers
of up to a kilobyte included, but one that holds a single larger record. Ids are percent-encoded in the headers.

Reading: each task looks for record starts in its archives and gives every candidate its successor, which is where its
header says the next record begins. A candidate may be text inside a payload. Pointer jumping from the start of the
file doubles the hops of every candidate in a round and keeps the candidates that the chain from the start reaches;
all others are rejected, and only what is left is hashed. A chain never leaves its file and a file is read by one task,
so nothing is shuffled for it. Bytes after the last whole record of a cut-off archive are left out.

Edge cases: a null html is an empty payload; a null url leaves its header out; a null page_id gives a record without
id, an empty one has an id, and ids may hold any characters; rows are records of their own also where they repeat a page_id and payload: those with the largest page_id of their
payload are responses alike, the others revisit it; an empty table gives an empty folder and no records. Other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import unquote_plus

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patronage.llm.common import scratch, stash

LEAST = 1000
#: Payload bytes from which on a class of records begins, and how many of them an archive holds.
ROLLS = ((0, 1000), (1 << 16, 63), (1 << 20, 1))
#: Groups of equal payloads up to this number are broadcast; beyond it they are joined by a shuffle.
BROADCAST_GROUPS = 500_000
DATE = "2024-01-01T00:00:00Z"
END = "\r\n\r\n"
RECORDS = "page_id string, kind string, refers string, digest_said string, payload_bytes long, payload_digest string"


def with_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type and refers_to of each page."""
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("payload"))
    base = base.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1(F.col("payload").cast("binary")))
    rank = F.struct(F.col("page_id").isNotNull().alias("some"), "page_id")
    groups = stash(base.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.max(rank)["page_id"].alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n"), "payloads")
    if groups.count() <= BROADCAST_GROUPS:
        groups = F.broadcast(groups)
    joined = base.join(groups, "payload_digest", "left")
    revisit = (F.col("payload_bytes") >= least) & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select("page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first_id")).alias("refers_to"))


def write_warc(records: DataFrame, path: str, rolls: tuple[tuple[int, int], ...] = ROLLS) -> None:
    """Write the records of ``with_records`` as uncompressed WARC/1.1 files, one class of sizes after the other."""
    revisit = F.col("record_type") == "revisit"
    name = lambda c: F.coalesce(F.concat(F.lit("<urn:page:"), F.url_encode(F.col(c).cast("string")), F.lit(">")), F.lit("<urn:none>"))
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), "record_type"),
        F.concat(F.lit("WARC-Record-ID: "), name("page_id")),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", "[\\x00-\\x20]", "%20")),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), "payload_digest"),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), name("refers_to"))),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes")).cast("string")),
    )
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    for (low, per_file), (high, _) in zip(rolls, [*rolls[1:], (None, 0)], strict=True):
        own = records.where((F.col("payload_bytes") >= low) & (F.lit(True) if high is None else F.col("payload_bytes") < high))
        own.select(F.concat(head, F.lit(END), body).alias("value")).write.mode("append").option("lineSep", END).option("maxRecordsPerFile", per_file).text(path)


MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
LENGTH = re.compile(rb"\nContent-Length:[ \t]*([0-9]{1,18})[ \t]*\r\n", re.IGNORECASE)
FIELD = re.compile(rb"^([A-Za-z-]+):[ \t]*([^\r\n]*)\r?$", re.MULTILINE)


def candidates(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, start of the payload, start of the successor) of every place of an archive that looks like a record.

    The marks are found in one reading each and matched by binary search, so payloads full of headers cost no more.
    """
    starts = np.array([m.start() for m in MAGIC.finditer(raw)], np.int64)
    found = [(m.start(), int(m[1])) for m in LENGTH.finditer(raw)]
    at, length = (np.array([x[k] for x in found], np.int64) for k in (0, 1))
    ends = np.array([m.start() for m in re.finditer(rb"\r\n\r\n", raw)], np.int64)
    if not len(starts) or not len(ends) or not len(at):
        return (np.zeros(0, np.int64),) * 3
    stop, own = np.searchsorted(ends, starts), np.searchsorted(at, starts)
    ok = (stop < len(ends)) & (own < len(at))
    starts, stop, own = starts[ok], ends[stop[ok]], own[ok]
    body = stop + 4
    after = body + length[own] + 4
    # The header must say how long the record is, and the record must end where it says.
    ok = (at[own] < stop) & (after <= len(raw)) & (after > body)
    starts, body, after = starts[ok], body[ok], after[ok]
    whole = np.array([raw[e - 4 : e] == b"\r\n\r\n" for e in after.tolist()], bool)
    return starts[whole], body[whole], after[whole]


def reachable(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Which candidates, in order of their start, the chain from the start of the file reaches, by pointer jumping."""
    n = len(at)
    if not n:
        return np.zeros(0, bool)
    place = np.searchsorted(at, after)
    known = (place < n) & (at[np.minimum(place, n - 1)] == after)
    jump = np.append(np.where(known, place, n), n)  # n: beyond the last
    hit = np.append(at == 0, False)
    while True:
        # hit: within 2**k records of the start; jump: where 2**k records on begins.
        new = hit.copy()
        new[jump[hit]] = True
        new[n] = False
        jump = jump[jump]
        if (new == hit).all():
            return hit[:n]
        hit = new


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of whole archives."""
    names = [x.split()[0] for x in RECORDS.split(", ")]
    kinds = [pa.int64() if x.endswith(" long") else pa.string() for x in RECORDS.split(", ")]
    for batch in batches:
        for content in batch.column(0):
            raw, rows = content.as_buffer().to_pybytes(), []
            at, body, after = candidates(raw)
            kept = reachable(at, after)
            for start, b, e in zip(at[kept].tolist(), body[kept].tolist(), after[kept].tolist(), strict=True):
                field = {k.lower(): v for k, v in FIELD.findall(raw[start : b - 2])}
                text = lambda k: field.get(k, b"").decode("utf-8", "replace")  # noqa: B023, E731
                own = lambda k: next((unquote_plus(m[1]) for m in [re.fullmatch(r"<urn:page:(.*)>", text(k))] if m), None)
                payload = memoryview(raw)[b : e - 4]
                rows.append((own(b"warc-record-id"), text(b"warc-type"), own(b"warc-refers-to"), text(b"warc-payload-digest").removeprefix("sha1:"), len(payload), hashlib.sha1(payload).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(names), kinds, strict=True)], names)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the archives' records; ids as strings.

    A revisit record has the size of the response it refers to; a response's digest is that of the payload read.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    whole = stash(files.mapInArrow(_records, RECORDS), "records")
    response = whole.where("kind <> 'revisit'").select("page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), F.lit(None).cast("string").alias("refers_to"))
    sizes = response.select(F.col("page_id").alias("refers"), F.col("payload_digest").alias("digest_said"), F.col("payload_bytes").alias("size")).distinct()
    revisit = whole.where("kind = 'revisit'").join(sizes, ["refers", "digest_said"], "left").select("page_id", F.col("size").alias("payload_bytes"), F.col("digest_said").alias("payload_digest"), F.col("kind").alias("record_type"), F.col("refers").alias("refers_to"))
    return response.unionByName(revisit)


def warc_round_trip(pages: DataFrame, path: str | None = None, least: int = LEAST) -> DataFrame:
    """Write the pages' archives to ``path`` (a scratch folder unless told) and read them back."""
    spark, kind = pages.sparkSession, dict(pages.dtypes)["page_id"]
    path = path or scratch(spark, "warc")
    write_warc(with_records(pages, least=least), path)
    back = read_warc(spark, path)
    return back.withColumn("page_id", F.col("page_id").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind))
