"""Captures in three formats: round trips, byte ranges, odd records."""

import glob
import re

import pytest
from fixtures import frame
from sitegauge.sources import archives as A

ROWS = [
    {"page_id": 1, "url": "https://a.example/?q=1", "html": "<p>one</p>\r\n\r\ntwo\n"}, {"page_id": 2, "url": None, "html": ""}, {"page_id": None, "url": "u", "html": None},
    {"page_id": -4, "url": "https://\u00e9.example/", "html": "\u00e9\u65e5\U0001f600 " * 2000}, {"page_id": 5, "url": "v", "html": "Content-Length: 3\r\n\r\nWARC/1.0\r\n"},
    {"page_id": 5, "url": "v", "html": "twice"}, {"page_id": 5, "url": "v", "html": "twice"},
]
KEY = lambda df: sorted((repr((r["page_id"], r["url"], r["html"])) for r in df.collect()))


@pytest.mark.parametrize("fmt, compressed", [("parquet", False), ("json", False), ("json", True), ("warc", False), ("warc", True)])
def test_round_trip(spark, tmp_path, fmt, compressed):
    pages = frame(spark, ROWS, A.PAGES).selectExpr("*", "1 as head", "'x' as value").repartition(2)
    A.write_pages(pages, f"{tmp_path}/p", fmt, compressed)
    assert KEY(A.read_pages(spark, f"{tmp_path}/p", fmt)) == KEY(pages)
    A.write_pages(pages.limit(0), f"{tmp_path}/e", fmt)
    assert A.read_pages(spark, f"{tmp_path}/e", fmt).count() == 0


def test_archives_are_read_in_byte_ranges(spark, tmp_path):
    rows = [{"page_id": i, "url": f"u{i}", "html": f"<p>{i}</p>" * (i % 90)} for i in range(700)]
    pages = frame(spark, rows, A.PAGES)
    A.write_pages(pages.coalesce(1), f"{tmp_path}/p", "warc")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1777")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        read = A.read_pages(spark, f"{tmp_path}/p", "warc")
        assert read.rdd.getNumPartitions() > 50 and KEY(read) == KEY(pages)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_valid_records_and_others(spark, tmp_path):
    A.write_pages(frame(spark, ROWS[:4], A.PAGES).coalesce(1), f"{tmp_path}/p", "warc")
    data = b"".join(open(p, "rb").read() for p in glob.glob(f"{tmp_path}/p/*.txt"))
    at = 0
    while at < len(data):  # each record ends where its length says, and the next begins there
        head = data.index(b"\r\n\r\n", at)
        assert data[at:at + 10] == b"WARC/1.1\r\n"
        at = head + 4 + int(re.search(rb"Content-Length: (\d+)", data[at:head])[1])
        assert data[at:at + 4] == b"\r\n\r\n"
        at += 4
    own = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 2\r\n\r\nhi\r\n\r\nWARC/1.1\r\nwarc-type: response\r\nWARC-Target-URI: r\r\nContent-Length: 33\r\n\r\nHTTP/1.1 200 OK\r\nA: b\r\n\r\n<p>x</p>\r\n\r\nWARC/1.1\r\nWARC-Type: resource\r\nContent-Length: 99\r\n\r\ncut"
    (tmp_path / "own.warc").write_bytes(own)
    got = sorted((r["url"] or "", r["html"].strip(), r["error"] or "") for r in A.read_warc(spark, str(tmp_path / "own.warc")).collect())
    assert got == [("", "cut", "body shorter than stated"), ("r", "<p>x</p>", "")]


def test_unknown_format(spark):
    with pytest.raises(ValueError):
        A.read_pages(spark, "x", "csv")
