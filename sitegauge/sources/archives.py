"""A1: captured pages as files of three kinds: Parquet, JSON lines and WARC archives.

All three are read by Spark's own readers, so they come from any store that Spark reaches, with only the wanted columns. A WARC
archive that is not compressed is read in byte ranges: the record mark is the line separator of the text reader, so a
record belongs to the range its mark starts in. A compressed archive is one range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = ("parquet", "json", "warc")
# Record mark, line end and the header names in use.
MARK = "WARC/1.1\r\n"
END = "\r\n"
HEADERS = {"url": "WARC-Target-URI", "fetched_at": "WARC-Date", "page_id": "WARC-Page-ID"}
PAGES = "page_id bigint, url string, html string"


def _size(text: Column) -> Column:
    return F.octet_length(text)


def warc_record(page_id: Column, url: Column, html: Column, fetched_at: Column) -> Column:
    """One resource record without the blank lines behind it. Line ends in an address are taken out; null addresses and ids have no header."""
    line = lambda name, value: F.when(value.isNull(), "").otherwise(F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), "[\r\n]", ""), F.lit(END)))
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit(MARK), F.lit(f"WARC-Type: resource{END}"),
        F.lit("WARC-Record-ID: <urn:uuid:"), F.regexp_replace(F.md5(F.concat_ws("|", page_id, url)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(f">{END}"),
        line(HEADERS["fetched_at"], F.date_format(F.coalesce(fetched_at, F.timestamp_seconds(F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        line(HEADERS["url"], url), line(HEADERS["page_id"], page_id), F.when(html.isNull(), f"X-Body: none{END}").otherwise(""),
        F.lit(f"Content-Type: text/html; charset=utf-8{END}Content-Length: "), _size(body).cast("string"), F.lit(END + END), body,
    )


def write_pages(pages: DataFrame, path: str, fmt: str, compressed: bool = False) -> None:
    """Write page_id, url and html (and fetched_at, where there is one) as ``fmt``; ``compressed`` text files are read whole, others in ranges."""
    if fmt not in FORMATS:
        raise ValueError(f"one of {', '.join(FORMATS)}, not {fmt}")
    if fmt != "warc":
        out = pages.select("page_id", "url", "html").write.mode("errorifexists").option("ignoreNullFields", "false").format(fmt)
        (out.option("compression", "gzip") if compressed and fmt == "json" else out).save(path)
        return
    at = F.col("fetched_at") if "fetched_at" in pages.columns else F.lit(None).cast("timestamp")
    records = pages.select(warc_record(F.col("page_id"), F.col("url"), F.col("html"), at).alias("value"))
    records.write.mode("errorifexists").option("lineSep", END + END).option("compression", "gzip" if compressed else "none").text(path)


def _header(head: Column, name: str) -> Column:
    value = F.regexp_extract(head, rf"(?im)^{name}:[ \t]*(.*?)[ \t]*\r?$", 1)
    return F.when(value != "", value)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, html, fetched_at, error) of the resource and response records of archives.

    ``error`` tells a record whose body is shorter than its stated length: cut short, or with the record mark inside. Records of
    other types are left out. A response's own header lines are no part of its html.
    """
    rows = spark.read.option("lineSep", MARK).text(path).where("value != ''")
    gap = F.locate(END + END, F.col("value"))
    cut = rows.select(F.when(gap > 0, F.substring("value", F.lit(1), gap)).otherwise(F.col("value")).alias("head"), F.col("value").substr(gap + 4, F.length("value")).alias("rest"))
    size = _header(F.col("head"), "Content-Length").cast("int")
    kind = F.lower(_header(F.col("head"), "WARC-Type"))
    body = cut.where(kind.isin("resource", "response")).select(
        "head", kind.alias("kind"), size.alias("size"), F.col("rest").cast("binary").substr(F.lit(1), size).alias("bytes"))
    text = F.decode("bytes", "UTF-8")
    inner = F.locate(END + END, text)
    html = F.when((F.col("kind") == "response") & (inner > 0), text.substr(inner + 4, F.length(text))).otherwise(text)
    return body.select(
        _header(F.col("head"), HEADERS["page_id"]).try_cast("bigint").alias("page_id"), _header(F.col("head"), HEADERS["url"]).alias("url"),
        F.when(~F.contains("head", F.lit("X-Body: none")), html).alias("html"), F.to_timestamp(_header(F.col("head"), HEADERS["fetched_at"])).alias("fetched_at"),
        F.when(F.octet_length("bytes") < F.col("size"), "body shorter than stated").alias("error"),
    )


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | T.StructType = PAGES) -> DataFrame:
    """Captured pages of one of :data:`FORMATS`; columns that nobody asks for are not read (Parquet) or not parsed (JSON)."""
    if fmt == "warc":
        return read_warc(spark, path).select("page_id", "url", "html")
    if fmt not in FORMATS:
        raise ValueError(f"one of {', '.join(FORMATS)}, not {fmt}")
    return spark.read.schema(schema).format(fmt).load(path)
