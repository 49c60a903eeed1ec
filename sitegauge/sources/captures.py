"""Inputs of the engine (A1-A5, A9, A10): captured requests as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import small_table

from ..functions import headers as H
from ..functions import urls as U

PAGES = (
    "site_id string, page_id bigint, url string, final_url string, status int, headers map<string,string>, "
    "html string, response_ms int, redirect_hops int, depth int, source string, ord bigint, is_primary boolean"
)
FETCH_LOG = (
    "site_id string, req_url string, final_url string, method string, user_agent string, redirect_mode string, "
    "status int, headers map<string,string>, body string, response_ms int, redirect_hops int, fetched_at timestamp"
)
TLS_CERTS = "host string, subject string, valid_to timestamp"
LAB_VITALS = (
    "url string, strategy string, fcp double, lcp double, inp double, cls double, ttfb double, speed_index double, "
    "tbt double, tti double, performance_score int, tap_targets_pass boolean, lcp_element_found boolean, "
    "lcp_lazy_loaded_pass boolean, modern_image_pass boolean, optimized_image_pass boolean, unused_js_bytes double, "
    "unused_css_bytes double, third_party_blocking double"
)
RENDERED = "url string, html string"
SITES = "site_id string, brand_name string, website_url string, business_email string"

# Addresses every site is asked for.
WELL_KNOWN = (
    ("robots", "/robots.txt"), ("sitemap", "/sitemap.xml"), ("ai_sitemap", "/ai-sitemap.xml"), ("ai_txt", "/ai.txt"),
    ("llms", "/llms.txt"), ("feed", "/feed"), ("feed", "/rss"), ("feed", "/atom.xml"),
    ("homepage", "/"), ("contact page", "/contact/"), ("contact page", "/contact-us/"), ("about page", "/about/"),
    ("about page", "/about-us/"), ("location page", "/locations/"),
    ("policy", "/policies/privacy-policy"), ("policy", "/policies/refund-policy"),
    ("policy", "/policies/shipping-policy"), ("policy", "/policies/terms-of-service"), ("policy", "/contact-us"),
    ("policy", "/privacy-policy"), ("policy", "/terms-of-service"),
)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return small_table(spark, [], schema)


def request_error(brand: Column, url: Column, email: Column) -> Column:
    """A2: reason a request is refused, NULL when it is fine."""
    return (
        F.when(brand.isNull() | ~F.length(brand).between(2, 120), "brand name must have 2 to 120 characters")
        .when(url.isNull() | ~F.length(url).between(4, 300), "website address must have 4 to 300 characters")
        .when(
            email.isNull() | ~email.rlike(r"^[A-Za-z0-9_'+.-]*[A-Za-z0-9_+-]@([A-Za-z0-9][A-Za-z0-9-]*\.)+[A-Za-z]{2,}$"),
            "business e-mail is not valid",
        )
    )


def validate_sites(sites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A2: accepted requests with a full address, and refused ones with the reason."""
    marked = sites.withColumn("reason", request_error(F.col("brand_name"), F.col("website_url"), F.col("business_email")))
    good = marked.where(F.col("reason").isNull()).drop("reason")
    return good.withColumn("website_url", U.normalize_url(F.col("website_url"))), marked.where(F.col("reason").isNotNull())


def page_rows(captures: DataFrame, headers: str = "headers", body: str = "html") -> DataFrame:
    """A3: only page responses. Bodies are read whole; A5's download limits have no place in a capture."""
    return captures.where(H.is_html_response(F.col(headers), F.col(body)))


def one_per_url(rows: DataFrame, keys: tuple[str, ...] = ("req_url",)) -> DataFrame:
    """Latest answer per address, so that the lookups below stay one-to-one.

    Unknown times rank first; of equal times the answer with the larger content hash counts, so repeated runs agree.
    """
    moment = F.coalesce("fetched_at", F.timestamp_seconds(F.lit(0)))
    return one_row(rows, keys, moment)


def content_hash(rows: DataFrame, columns: Sequence[str]) -> Column:
    """Hash of some columns; maps count as their sorted entries, values with maps inside as their JSON."""

    def plain(f: T.StructField) -> Column:
        if isinstance(f.dataType, T.MapType):
            return F.array_sort(F.map_entries(f.name))
        return F.to_json(f.name) if "map<" in f.dataType.simpleString() else F.col(f.name)

    return F.xxhash64(*[plain(f) for f in rows.schema if f.name in columns])


def one_row(rows: DataFrame, keys: Sequence[str], moment: Column | None = None) -> DataFrame:
    """One whole row per key: the latest, then the one with the largest content hash. No mix of several rows, no chance."""
    others = [c for c in rows.columns if c not in keys]
    order = F.struct(moment if moment is not None else F.lit(0), content_hash(rows, others))
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("_r")).select(*keys, "_r.*")


def certificate_ok(certs: DataFrame, as_of: Column) -> DataFrame:
    """A10: one row per host with a verdict."""
    good = F.col("subject").isNotNull() & (F.col("valid_to") > as_of)
    return certs.groupBy("host").agg(F.coalesce(F.bool_or(good), F.lit(False)).alias("certificate_ok"))
