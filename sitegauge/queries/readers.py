"""Readers of headers, text files and page elements over values with known answers, one row per part."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dom as D
from ..functions import headers as H
from ..functions import robots as R
from ..functions import text as T
from ..functions import urls as U
from ..operators import scoring as S
from ..operators.parse import parse_pages
from ..operators.sitemaps import feed_average_words
from ..operators.structured import with_nodes
from ..plans import answer_engine as A
from ..sources.captures import certificate_ok
from .checks import _site_pages
from .common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str):
    def add(fn):
        QUERIES[name], ORACLES[name] = fn, sql
        return fn
    return add


def _keys(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"))


def _text(*pieces: tuple[str, str, str]):
    """Text put together from (condition on k, text where it holds, text where not); § stands for k."""
    return F.replace(F.concat(*[F.when(F.expr(c), F.lit(y)).otherwise(F.lit(n)) for c, y, n in pieces]), F.lit("§"), F.col("k").cast("string"))


def _name_value(name: str, *pieces: tuple[str, str, str]):
    return [F.lit(name), _text(*pieces)]


@register("header_readers", """SELECT k, CASE WHEN k % 2 = 0 THEN 1000 + k ELSE 0 END AS hsts, CASE k % 3 WHEN 0 THEN -1 WHEN 1 THEN k END AS snippet,
 CASE WHEN k % 5 = 0 THEN 'none' ELSE '' END AS image_preview, CASE WHEN k % 7 = 0 THEN 0 ELSE CAST(10 * k AS DOUBLE) END AS length,
 k % 11 < 2 AS page_cache, k % 11 = 1 OR k % 11 = 2 AS asset_cache, k % 13 = 0 AS type_ok, k % 13 = 1 AS script_type_ok,
 CASE WHEN k % 17 = 0 THEN 'cf-cache-status: HIT' WHEN k % 19 = 0 THEN 'server: cloudflare' ELSE '' END AS edge,
 CASE WHEN k % 23 = 0 THEN 'https://a.example/' || k ELSE '' END AS canonical, CASE WHEN k % 23 < 2 THEN 'https://a.example/' || k ELSE '' END AS canonical_lenient,
 k % 13 = 0 OR k % 29 = 0 AS html FROM (SELECT p_partkey AS k FROM part)""")
def header_readers(spark, d):
    """Response headers."""
    headers = F.create_map(
        *_name_value("strict-transport-security", ("k % 2 = 0", "max-age=", "includeSubDomains")),
        *_name_value("content-length", ("k % 7 = 0", "many", "§0")),
        *_name_value("cache-control", ("k % 11 = 0", "no-cache", ""), ("k % 11 = 1", "public, max-age=60", ""), ("k % 11 = 2", "max-age=86400", "")),
        *_name_value("content-type", ("k % 13 = 0", "text/html; charset=utf-8", ""), ("k % 13 = 1", "application/javascript", "")),
        *_name_value("cf-cache-status", ("k % 17 = 0", "HIT", "")), *_name_value("server", ("k % 19 = 0", "cloudflare", "nginx")),
        *_name_value("link", ("k % 23 = 0", '<https://a.example/§>; rel="canonical"', ""), ("k % 23 = 1", "<https://a.example/§> ; rel=canonical", "")),
    )
    headers = F.map_zip_with(
        headers, F.create_map(F.lit("strict-transport-security"), F.when(F.expr("k % 2 = 0"), (F.col("k") + 1000).cast("string")).otherwise("")),
        lambda key, a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    directives = _text(("k % 3 = 0", "index, max-snippet:-1", ""), ("k % 3 = 1", "max-snippet: §, index", ""), ("k % 5 = 0", ", max-image-preview:NONE", ""))
    body = _text(("k % 29 = 0", " \n<!doctype html><p>x", "plain"))
    rows = _keys(spark, d).select("k", headers.alias("h"), directives.alias("directives"), body.alias("body"))
    h = F.col("h")
    return rows.select(
        "k", H.hsts_max_age(h).alias("hsts"), H.max_snippet(F.col("directives")).alias("snippet"), F.coalesce(H.max_image_preview(F.col("directives")), F.lit("")).alias("image_preview"),
        H.content_length(h).alias("length"), H.cache_policy_ok(F.lit("html"), h).alias("page_cache"), H.cache_policy_ok(F.lit("js"), h).alias("asset_cache"),
        H.content_type_ok(F.lit("html"), h).alias("type_ok"), H.content_type_ok(F.lit("js"), h).alias("script_type_ok"), H.edge_signal(h).alias("edge"),
        H.link_canonical(h, strict_quotes=True).alias("canonical"), H.link_canonical(h).alias("canonical_lenient"), H.is_html_response(h, F.col("body")).alias("html"))


@register("file_readers", """SELECT k, CAST(2 + k % 3 AS INT) AS llms_sections, k % 5 > 0 AS lastmod_ok, CASE WHEN k % 7 = 0 THEN 0 ELSE CAST(floor((3 + 3 + k % 4) / 2.0 + 0.5) AS INT) END AS feed_words,
 k % 11 = 0 OR k % 13 = 0 AS challenge, k % 11 > 0 AND k % 17 = 0 AND k % 13 > 0 AS passes_firewall, k % 2 = 0 OR k % 13 = 0 OR k % 17 = 0 AS markup FROM (SELECT p_partkey AS k FROM part)""")
def file_readers(spark, d):
    """Llms.txt, sitemap dates, feeds and challenge pages."""
    llms = _text(("true", "# Acme\nsee https://a.example/§\n", ""), ("k % 3 > 0", "## About\n", ""), ("k % 3 = 2", "https://a.example/more", ""))
    entry = "<url><loc>https://a.example/§</loc>"
    sitemap = _text(("true", f"<urlset>{entry}<lastmod>2024-01-01</lastmod></url>{entry}", ""), ("k % 5 > 0", "<lastmod>2024-01-02</lastmod>", ""), ("true", "</url></urlset>", ""))
    feed = _text(
        ("k % 7 = 0", "<rss></rss>", "<rss><item><description>one two <b>three</b></description></item><item><description>one two three"),
        ("k % 7 > 0 and k % 4 > 0", " four", ""), ("k % 7 > 0 and k % 4 > 1", " five", ""), ("k % 7 > 0 and k % 4 > 2", " six", ""), ("k % 7 > 0", "</description></item></rss>", ""))
    page = _text(("k % 2 = 0", "<html>", ""), ("k % 13 = 0", "solve the captcha", ""), ("k % 17 = 0", " " + "x" * 6000, ""))
    page = F.when(F.expr("k % 13 = 0 and k % 17 = 0"), F.substring(page, 1, 900)).otherwise(page)
    status = F.expr("CASE WHEN k % 11 = 0 THEN 503 ELSE 200 END")
    rows = _keys(spark, d).select("k", llms.alias("llms"), sitemap.alias("sitemap"), feed.alias("feed"), page.alias("page"), status.alias("status"))
    c = F.col
    return rows.select(
        "k", T.llms_sections(c("llms")).alias("llms_sections"), R.lastmod_complete(c("sitemap")).alias("lastmod_ok"), feed_average_words(c("feed")).alias("feed_words"),
        H.is_challenge(c("status"), c("page")).alias("challenge"), H.passes_firewall(c("status"), c("page")).alias("passes_firewall"), H.has_markup(c("page")).alias("markup"))


@register("element_readers", """SELECT k, CASE WHEN k % 2 = 0 THEN 'About ' || k ELSE '' END AS description, CASE WHEN k % 3 = 0 THEN 'https://s' || k || '.example/c' ELSE '' END AS canonical,
 CAST(CASE k % 4 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 2 ELSE 0 END AS INT) AS jumps, CAST(2 + (k % 5 = 0)::INT AS INT) AS images, CAST(1 + (k % 5 = 0)::INT AS INT) AS with_alt,
 CAST((k % 5 = 0)::INT AS INT) AS sized, CAST(1 AS INT) AS modern, CASE WHEN k % 7 = 0 THEN 'html js css image image' ELSE 'html css image image' END || CASE WHEN k % 5 = 0 THEN ' image' ELSE '' END AS kinds,
 CASE WHEN k % 11 = 0 THEN 3 ELSE 0 END AS hidden_words, CASE WHEN k % 13 = 0 THEN 'x.example' ELSE 's' || k || '.example' END AS domain,
 CASE WHEN k % 2 = 0 THEN '/a.webp /b.webp' ELSE '' END AS srcset FROM (SELECT p_partkey AS k FROM part)""")
def element_readers(spark, d):
    """Selectors over parsed pages."""
    pages = _site_pages(spark, d, [
        ("k % 2 = 0", '<meta name="description" content=" About § ">', '<meta name="keywords" content="x">'), ("k % 3 = 0", '<link rel="canonical" href="/c">', ""),
        ("k % 7 = 0", '<script src="/a.js"></script>', ""), ("true", '<link rel="stylesheet" href="/a.css">', ""),
    ], [
        ("k % 4 = 0", "<h1>a</h1><h3>b</h3>", ""), ("k % 4 = 1", "<h1>a</h1><h2>b</h2><h1>c</h1>", ""), ("k % 4 = 2", "<h1>a</h1><h3>b</h3><h2>c</h2><h5>d</h5>", ""),
        ("true", '<img src="/a.webp" alt="x"><img src="/b.png">', ""), ("k % 5 = 0", '<img src="/c.png" alt="y" width="1" height="2">', ""),
        ("k % 11 = 0", '<p style="display:none">three hidden words</p>', ""), ("k % 13 = 0", '<a href="https://x.example/">x</a>', ""),
    ], "'https://s' || k || '.example/'")
    c = F.col
    rows = parse_pages(pages)
    stats = D.image_stats()
    first_link = F.get("anchors", 0)["abs"]
    kinds = F.array_join(F.transform(F.array_sort(F.transform(D.assets(c("url")), lambda a: F.struct(
        F.array_position(F.array(F.lit("html"), F.lit("js"), F.lit("css"), F.lit("image")), a["kind"]).alias("o"), a["kind"].alias("kind")))), lambda a: a["kind"]), " ")
    srcset = F.when(F.expr("k % 2 = 0"), F.lit("/a.webp 1x, /b.webp  2x, ")).otherwise(F.lit(None).cast("string"))
    return rows.select(
        "k", T.trim_blank(D.meta_first("description")).alias("description"), F.coalesce(D.canonical_combined(F.lit("")), F.lit("")).alias("canonical"),
        F.size(D.level_jumps(c("headings"))).alias("jumps"), stats["total"].alias("images"), stats["alt"].alias("with_alt"), stats["sized"].alias("sized"),
        stats["modern"].alias("modern"), kinds.alias("kinds"), D.hidden_words().alias("hidden_words"),
        U.domain_from_url(F.coalesce(first_link, c("url"))).alias("domain"), F.array_join(U.srcset_urls(srcset), " ").alias("srcset"))


@register("certificates", """SELECT 's' || (k % 50) AS host, bool_or(k % 3 > 0 AND k % 7 < 4) AS certificate_ok FROM (SELECT p_partkey AS k FROM part) GROUP BY ALL""")
def certificates(spark, d):
    """A10: hosts with several certificates, some without a subject, some out of date."""
    c = F.col
    rows = _keys(spark, d).select(
        F.concat(F.lit("s"), c("k") % 50).alias("host"), F.when(c("k") % 3 > 0, "CN=x").alias("subject"),
        F.when(c("k") % 7 < 4, F.lit("2027-01-01")).otherwise("2025-01-01").cast("timestamp").alias("valid_to"))
    return certificate_ok(rows, F.lit("2026-01-15").cast("timestamp"))


@register("page_types", """SELECT k, CAST(CASE k % 5 WHEN 2 THEN 5 WHEN 3 THEN 0 ELSE 10 END AS INT) AS alternatives, k % 3 < 2 AS use_case, CAST(CASE k % 7 WHEN 0 THEN 10 WHEN 1 THEN 6 ELSE 0 END AS INT) AS trust,
 k % 11 > 1 AS crawlable, CASE k % 13 WHEN 0 THEN 'html' WHEN 1 THEN 'js' WHEN 2 THEN 'image' WHEN 3 THEN 'xml' ELSE 'other' END AS kind,
 CASE WHEN k % 101 >= 85 THEN 'High AI citation probability' WHEN k % 101 >= 70 THEN 'Good AI visibility' WHEN k % 101 >= 55 THEN 'Needs improvement' WHEN k % 101 >= 40 THEN 'Poor AI visibility'
   ELSE 'Critical GEO issues' END AS grade_text, k % 17 = 0 OR k % 17 = 1 AS speakable FROM (SELECT p_partkey AS k FROM part)""")
def page_types(spark, d):
    """C7, C8, U10, U11, X4 and the real form of check 74."""
    c = F.col
    pick = lambda by, *texts: F.element_at(F.array(*[F.lit(t) for t in texts]), F.least(c("k") % by + 1, F.lit(len(texts))).cast("int"))
    first = F.concat(F.lit("https://a.example"), pick(5, "/compare/x", "/acme-vs-other", "/blog/comparetools", "/about", "/about"))
    second = F.concat(F.lit("https://a.example"), pick(3, "/use-cases/retail", "/loans-for-travel", "/x"))
    page_text = pick(5, "plain", "plain", "plain", "plain", "switch from us")
    policy = pick(7, "privacy policy, refund policy, shipping and contact us", "terms and refund", "privacy", "nothing")
    link = pick(11, "https://a.example/a.PDF", "https://a.example/b.webp?x", "https://a.example/c")
    content = pick(13, "text/html; charset=utf-8", "application/javascript", "image/png", "application/xml", "application/octet-stream")
    blocks = F.array(pick(17, '{"@type":"SpeakableSpecification"}', '{"@type":"Article","speakable":{"x":1}}', '{"@type":"Article"}'))
    rows = with_nodes(_keys(spark, d).withColumn("jsonld", blocks))
    return rows.select(
        "k", A.alternatives_score(F.array(first), F.array(page_text)).alias("alternatives"), A.is_use_case(second, U.path_words(second)).alias("use_case"),
        A.trust_score(A.trust_types(policy)).alias("trust"), U.is_crawlable(link).alias("crawlable"), U.content_kind(content).alias("kind"),
        S.grade_description((c("k") % 101).cast("int")).alias("grade_text"), A.speakable_found().alias("speakable"))


@register("answer_sections", """SELECT k, CAST(n AS INT) AS section, CASE n WHEN 0 THEN 'First ' || k ELSE 'Second' END AS title, CAST(CASE n WHEN 0 THEN 2 + CASE WHEN k % 2 = 0 THEN 45 ELSE 0 END ELSE 3 END AS INT) AS words,
 n = 0 AND k % 2 = 0 AND k % 3 = 0 AS answer_like FROM (SELECT p_partkey AS k, unnest([0, 1]) AS n FROM part)""")
def answer_sections(spark, d):
    """Sections below second-level headings."""
    words = " ".join(f"w{i}" for i in range(45))
    pages = _site_pages(spark, d, [], [
        ("true", "<h1>Top</h1><p>before</p><h2>First §</h2>", ""), ("k % 3 = 0", "<p>it helps</p>", "<p>it did</p>"), ("k % 2 = 0", f"<p>{words}</p>", ""),
        ("true", "<h2>Second</h2><p>three more words</p>", ""),
    ], "'https://s' || k || '.example/'")
    return parse_pages(pages).select("k", F.posexplode(D.answer_sections()).alias("section", "s")).select("k", "section", "s.title", "s.words", "s.answer_like")
