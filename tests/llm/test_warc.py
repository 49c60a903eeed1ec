"""Archives: exact round trip, revisits, record form."""

import base64
import gzip
import hashlib
from glob import glob

from pyspark.sql import functions as F

from sitegauge.llm import warc as W

SCHEMA = "page_id bigint, url string, html string"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


ROWS = [
    (5, "http://a/", "same"), (3, "http://b/\r\nX: y", "same"), (9, None, "same"), (None, "u", "same"), (3, "http://c/", "same"),
    (1, "u", None), (2, "u", ""), (7, "u", "line\r\n\r\nWARC/1.1\r\n\r\nend\r\n\r\n"), (8, "u", "é日😀\x00" + "z" * 100_000), (None, None, "lonely"),
]


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "'x' as payload", "1 as refers_to").repartition(3)
    W.write_archive(pages, f"{tmp_path}/w")
    got = W.resolve(W.read_archive(spark, f"{tmp_path}/w")).collect()
    assert len(got) == len(ROWS)
    first = {}
    for page, _, html in ROWS:
        first[html or ""] = min((x for x in (first.get(html or ""), page) if x is not None), default=None)
    key = lambda r: repr(r)
    want = sorted(((p, None if u is None else u.replace("\r", "%0D").replace("\n", "%0A"), (h or "").encode(), digest(h),
                    "response" if p == first[h or ""] else "revisit", None if p == first[h or ""] else first[h or ""], len((h or "").encode())) for p, u, h in ROWS), key=key)
    have = sorted(((r["page_id"], r["url"], bytes(r["payload"]), r["payload_digest"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got), key=key)
    assert have == want
    assert all(r["stored_digest"] in (None, r["payload_digest"]) for r in got)
    records = b"".join(gzip.open(f).read() for f in glob(f"{tmp_path}/w/*.gz"))
    assert records.count(b"WARC-Type: revisit") == 4 and records.count(W.PROFILE.encode()) == 4


def test_short_payloads_are_not_revisits(spark, tmp_path):
    W.write_archive(spark.createDataFrame(ROWS, SCHEMA), f"{tmp_path}/w", min_bytes=5)
    got = W.read_archive(spark, f"{tmp_path}/w").collect()
    assert {r["record_type"] for r in got} == {"response"}


def test_empty(spark):
    assert W.archive_of(spark.createDataFrame([], SCHEMA)).count() == 0


def test_base32(spark):
    texts = ["", "é日😀\x00", *(f"payload {i}" for i in range(3000))]  # some digests with leading zeros in a part
    got = spark.createDataFrame([(x,) for x in texts], "x string").select("x", W.base32_sha1(F.col("x").cast("binary")).alias("d")).collect()
    assert all(r["d"] == digest(r["x"]) for r in got) and len(got) == len(texts)


def test_joins_and_filters_do_not_hash(spark):
    rows = W.captures(spark.createDataFrame(ROWS, SCHEMA).repartition(3))
    for df in (W.revisits(rows), W.deduplicated(rows)):
        nodes = [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "sha1" in x]
        assert not [x[:60] for x in nodes if "Filter" in x or "Join" in x]
