"""Whole audits over the captured pages; lookups come from a fetch log derived from the same pages.

They have no SQL twin: trees with reopened elements cannot be rebuilt in SQL. The tests check them
on hand-made pages.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import scoring as S
from ..operators.classify import classify_pages
from ..plans import answer_engine, eeat, facts as FACTS, image, indexability, on_page, structured_data, technical, trust
from ..plans.audit import sitemap_addresses
from ..plans.rules import definitions, describe
from ..session import stage
from ..sources import captures as C
from .common import HOST_SQL, parsed_pages, site_pages

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
AS_OF = datetime(2026, 1, 15)


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


def _described(spark, rows, audit, module):
    return S.category_summary(describe(rows, definitions(spark, audit, module.DEFS)), ("site_id", "page_id", "audit", "category"))


def _inputs(spark, d):
    """Sites, pages and a fetch log: every page answers at its own address, plus robots and sitemap per host."""
    pages = site_pages(spark, d)
    hosts = pages.groupBy("site_id").agg(F.min_by("url", "page_id").alias("website_url"))
    sites = hosts.select("site_id", F.concat(F.lit("Brand "), "site_id").alias("brand_name"), "website_url", F.concat(F.lit("info@"), "site_id").alias("business_email"))
    headers = lambda kind: F.create_map(F.lit("content-type"), F.lit(kind), F.lit("cache-control"), F.lit("max-age=60"))
    blank = lambda kind: F.lit(None).cast(kind)
    row = lambda df, url, body, kind, status: df.select(
        "site_id", url.alias("req_url"), url.alias("final_url"), F.lit("GET").alias("method"), blank("string").alias("user_agent"), F.lit("follow").alias("redirect_mode"),
        status.alias("status"), headers(kind).alias("headers"), body.alias("body"), F.lit(80).alias("response_ms"), F.lit(0).alias("redirect_hops"), F.timestamp_seconds(F.lit(0)).alias("fetched_at"))
    origin = U.origin(F.col("website_url"))
    log = row(pages, F.col("url"), F.col("html"), "text/html", F.when(F.col("page_id") % 9 == 0, 404).otherwise(200)).unionByName(
        row(hosts, F.concat(origin, F.lit("/robots.txt")), F.lit("User-agent: *\nDisallow: /search\nSitemap: /sitemap.xml"), "text/plain", F.lit(200)))
    return {"sites": sites, "pages": pages.withColumn("response_ms", (F.length("html") % 1500).cast("int")), "fetch_log": log}


def _facts(spark, d):
    """Parsed once and written to the shared folder, as in the public call."""
    return FACTS.build(spark, _inputs(spark, d), staged=True)


@register("audit_on_page")
def audit_on_page(spark, d):
    return _described(spark, on_page.audit(parsed_pages(spark, d)), S.ON_PAGE, on_page)


@register("audit_image")
def audit_image(spark, d):
    return _described(spark, image.audit(parsed_pages(spark, d)), S.IMAGE, image)


@register("audit_structured_data")
def audit_structured_data(spark, d):
    return _described(spark, structured_data.audit(parsed_pages(spark, d)), S.STRUCTURED, structured_data)


@register("audit_indexability")
def audit_indexability(spark, d):
    f = _facts(spark, d)
    rows = indexability.audit(f.home, f.index, f.answers.select("req_url", "status"), f.manual, sitemap_addresses(f))
    return _described(spark, rows, S.INDEX, indexability)


@register("audit_eeat")
def audit_eeat(spark, d):
    pages = stage(parsed_pages(spark, d), "page_features")
    return _described(spark, eeat.audit(pages.where("is_primary"), eeat.target_facts(pages)), S.EXPERTISE, eeat)


@register("audit_trust")
def audit_trust(spark, d):
    pages = stage(parsed_pages(spark, d), "page_features")
    sites = _inputs(spark, d)["sites"]
    rows = trust.audit(pages.where("is_primary"), sites, trust.target_texts(pages), F.lit(AS_OF).cast("timestamp"))
    return _described(spark, rows, S.TRUST, trust)


@register("audit_technical")
def audit_technical(spark, d):
    rule_list = technical.rules()
    rows = technical.audit(_facts(spark, d), F.lit(AS_OF).cast("timestamp"))
    defs = definitions(spark, S.TECHNICAL, technical.definitions_of(rule_list), technical.CATEGORY_ORDER)
    return S.technical_scores(describe(rows, defs))


@register("audit_answer_engine")
def audit_answer_engine(spark, d):
    f = _facts(spark, d)
    rows = answer_engine.audit(f, sitemap_addresses(f))
    return S.answer_engine_scores(describe(rows, definitions(spark, S.ANSWER, answer_engine.DEFS, answer_engine.CATEGORY_ORDER)))


@register("page_classification")
def page_classification(spark, d):
    return classify_pages(parsed_pages(spark, d))


@register("site_validation", f"""WITH s AS (SELECT {HOST_SQL} AS h, url, page_id FROM pages), q AS (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'x' ELSE h END AS brand, CASE WHEN page_id % 5 = 0 THEN 'abc' ELSE h END AS site, CASE WHEN page_id % 3 = 0 THEN 'nobody' ELSE 'info@' || h END AS mail FROM s)
SELECT page_id, CASE WHEN length(brand) NOT BETWEEN 2 AND 120 THEN 'brand' WHEN length(site) NOT BETWEEN 4 AND 300 THEN 'website' WHEN mail = 'nobody' THEN 'business' ELSE 'ok' END AS verdict, CASE WHEN site LIKE 'http%' THEN site ELSE 'https://' || site END AS full_url FROM q""")
def site_validation(spark, d):
    """A2 + U1 over requests derived from the pages' hosts."""
    c = F.col
    k = c("page_id")
    rows = site_pages(spark, d).select(
        k, F.when(k % 7 == 0, "x").otherwise(c("site_id")).alias("brand"), F.when(k % 5 == 0, "abc").otherwise(c("site_id")).alias("site"),
        F.when(k % 3 == 0, "nobody").otherwise(F.concat(F.lit("info@"), "site_id")).alias("mail"))
    error = C.request_error(c("brand"), c("site"), c("mail"))
    return rows.select("page_id", F.coalesce(F.split(error, " ")[0], F.lit("ok")).alias("verdict"), U.normalize_url(c("site")).alias("full_url"))
