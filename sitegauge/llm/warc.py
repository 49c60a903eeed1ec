"""WARC archives with revisit resolution.

Captures (id, address, payload) become WARC/1.1 records. Narrow header rows are grouped by payload digest; of the captures
with one payload the one with the smallest id stays a ``response``, the others become ``revisit`` records without payload that
refer to it. Archives are written as gzip files by Spark's own writer, with fresh headers (record id, date, lengths, digest).
Reading parses the records by their lengths; :func:`resolve` joins revisits back to the payload of their response.

Scale: payloads are hashed twice, for the staged (digest, id) rows and for the records. Only the former are shuffled, and
pre-aggregated per task, so a payload that a third of all captures share costs one row per task. Payloads stay where they were scanned unless there are too many revisits for a broadcast, which Spark
decides by the size of the staged table. Files hold at most ``RECORDS_PER_FILE`` records, which bounds a reader's memory.

Defined cases: a null payload is an empty one; payloads shorter than ``min_bytes`` are all responses; null ids rank last, and
captures that share the smallest id of a payload (repeated rows) are all responses; a null address has no header; line
breaks in an address are percent-encoded; an empty table gives an empty archive; columns other than the three are not kept.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_dir, stage

RECORDS_PER_FILE = 5000
BREAK = "\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(value: Column) -> Column:
    """Base32 SHA-1: 15 hex digits are 12 digits of base 32, which ``conv`` writes as 0-9A-V without leading zeros."""
    hexed = F.sha1(value)
    digits = [F.lpad(F.conv(F.substring(hexed, start, length), 16, 32), length * 4 // 5, "0") for start, length in ((1, 15), (16, 15), (31, 10))]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def captures(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Id, address, payload text, its size in bytes and its digest."""
    rows = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(payload, F.lit("")).alias("payload"))
    return rows.withColumns({"payload_bytes": F.octet_length("payload").cast("bigint"), "payload_digest": base32_sha1(F.col("payload").cast("binary"))})


def revisits(rows: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(digest, id, id of the response) of all captures but the first of each payload.

    The headers are staged: both sides of the join read them, and its filter on the digest would hash payloads once per use of the hash.
    """
    headers = stage(rows.where(F.col("payload_bytes") >= min_bytes).select("payload_digest", "page_id"), "warc_headers")
    first = headers.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = headers.join(first, "payload_digest").where("refers_to is not null and (page_id is null or page_id > refers_to)")
    return again.select("payload_digest", "page_id", "refers_to").distinct()


def record_id(page_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws(":", page_id.cast("string"), digest))
    return F.concat(F.lit("<urn:uuid:"), *[x for i, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
                                           for x in ([F.lit("-")] if i else []) + [F.substring(h, a, n)]], F.lit(">"))


def record_text(date: str) -> Column:
    """One record (without its closing blank lines) from the columns of :func:`deduplicated`."""
    revisit = F.col("refers_to").isNotNull()
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    head = F.concat(
        F.lit(f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{BREAK}Content-Length: "),
        F.col("payload_bytes").cast("string"), F.lit(BREAK * 2),
    )
    address = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(BREAK))
    optional = lambda name, value: F.coalesce(line(name, value), F.lit(""))
    length = F.octet_length(head) + F.octet_length(body)
    return F.concat(
        F.lit(f"WARC/1.1{BREAK}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit(BREAK),
        line("WARC-Record-ID", record_id(F.col("page_id"), F.col("payload_digest"))), F.lit(f"WARC-Date: {date}{BREAK}"),
        optional("WARC-Target-URI", address), optional("X-Page-Id", F.col("page_id")),
        F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest"), F.lit(BREAK),
        F.when(revisit, F.concat(
            F.lit(f"WARC-Profile: {PROFILE}{BREAK}"), line("WARC-Refers-To", record_id(F.col("refers_to"), F.col("payload_digest"))),
            line("X-Refers-To-Page-Id", F.col("refers_to")),
        )).otherwise(F.lit("")),
        F.lit(f"Content-Type: application/http; msgtype=response{BREAK}"), line("Content-Length", length), F.lit(BREAK), head, body,
    )


def deduplicated(rows: DataFrame, min_bytes: int = 0) -> DataFrame:
    """The captures with ``refers_to`` (null for responses)."""
    again = stage(revisits(rows, min_bytes), "warc_revisits")
    again = again.select(F.col("payload_digest").alias("d"), F.col("page_id").alias("i"), "refers_to")
    return rows.join(again, (F.col("payload_digest") == F.col("d")) & F.col("page_id").eqNullSafe(F.col("i")), "left").drop("d", "i")


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", **names: str) -> None:
    """Write the captures of ``pages`` as deduplicated archives below ``path``."""
    rows = deduplicated(captures(pages, **names), min_bytes)
    rows.select(record_text(date).alias("value")).write.option("lineSep", BREAK * 2).option("compression", "gzip").option(
        "maxRecordsPerFile", RECORDS_PER_FILE
    ).text(path)


RECORD = T.StructType([
    T.StructField("record_type", T.StringType()), T.StructField("record_id", T.StringType()), T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()), T.StructField("payload_digest", T.StringType()), T.StructField("refers_to", T.LongType()),
    T.StructField("stored_bytes", T.LongType()), T.StructField("stored_digest", T.StringType()), T.StructField("payload", T.BinaryType()),
])


def parse_records(data: bytes, payloads: bool) -> Iterator[tuple]:
    """Records of one uncompressed archive, in the order of :data:`RECORD`."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split(BREAK)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}: {lines[0][:40]!r}")
        head = dict(line.split(": ", 1) for line in lines[1:])
        start = end + 4
        at = start + int(head["Content-Length"])
        body = data.index(b"\r\n\r\n", start, at) + 4
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"record of {head['WARC-Record-ID']} has a wrong length")
        payload = data[body:at]
        at += 4
        stored = head["WARC-Type"] == "response"
        number = lambda name: int(head[name]) if name in head else None
        yield (
            head["WARC-Type"], head["WARC-Record-ID"], number("X-Page-Id"), head.get("WARC-Target-URI"),
            head["WARC-Payload-Digest"].removeprefix("sha1:"), number("X-Refers-To-Page-Id"), len(payload) if stored else None,
            base64.b32encode(hashlib.sha1(payload).digest()).decode() if stored else None, payload if stored and payloads else None,
        )


def read_archive(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records below ``path``; sizes and digests of stored payloads are taken anew."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    types = [pa.string()] * 2 + [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = list(parse_records(zlib.decompress(content.as_py(), 31), payloads))
                cells = [pa.array([r[i] for r in rows], type=kind) for i, kind in enumerate(types)]
                yield pa.RecordBatch.from_arrays(cells, names=RECORD.fieldNames())

    return files.mapInArrow(run, RECORD)


def resolve(records: DataFrame) -> DataFrame:
    """Records with ``payload_bytes`` and, where read, ``payload`` of the response with their digest."""
    originals = records.where("record_type = 'response'").groupBy("payload_digest").agg(
        F.min_by("stored_bytes", "record_id").alias("payload_bytes"), F.min_by("payload", "record_id").alias("original"),
    )
    own = records.where("record_type = 'response'").withColumn("payload_bytes", F.col("stored_bytes"))
    again = records.where("record_type = 'revisit'").join(originals, "payload_digest", "left")
    again = again.withColumn("payload", F.col("original")).select(*own.columns)
    return own.unionByName(again)


def archive_of(pages: DataFrame, min_bytes: int = 0, **names: str) -> DataFrame:
    """Write the archives to the shared folder, read them back and resolve the revisits."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/sitegauge/{uuid.uuid4().hex}/warc"
    write_archive(pages, path, min_bytes, **names)
    return resolve(read_archive(spark, path, payloads=False))
