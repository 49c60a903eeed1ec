"""Page and site queries over the captured HTML of ``pages``."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import dom as D
from ..functions import robots as RB
from ..functions import text as T
from ..functions import urls as U
from ..functions.numbers import half_up, rate
from ..operators import links as L
from ..operators import ranking as R
from ..operators import scoring as S
from ..operators import sitemaps as SM
from ..operators.selection import kth_value, upper_median
from ..plans.technical import duplicate_rates
from ..session import LEAST_BUCKETS, shared_dir, stage, stage_by
from ..sources import archives
from ..streaming import health as SH
from .common import HOST_SQL, parsed_pages, site_pages, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


_UNESCAPE = "replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"
_FACTS = rf"""facts AS (SELECT page_id, url, {HOST_SQL} AS site_id, {_UNESCAPE.format("trim(regexp_extract(html, '<title>(.*?)</title>', 1, 's'))")} AS title,
  {_UNESCAPE.format("trim(regexp_replace(regexp_extract(html, '<h1>(.*?)</h1>', 1, 's'), '\\s+', ' ', 'g'))")} AS h1, len(regexp_extract_all(html, '<h1>')) AS n_h1,
  len(regexp_extract_all(html, '<a href="/')) AS n_links, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang FROM pages)"""


@register("page_features", f"WITH {_FACTS} SELECT page_id, title, CAST(length(title) AS INT) AS title_length, h1, CAST(n_h1 AS INT) AS n_h1, CAST(n_links AS INT) AS n_links, lang FROM facts")
def page_features(spark, d):
    """H1-H5: parse job against tag patterns."""
    c = F.col
    return parsed_pages(spark, d).select(
        "page_id", T.trim_blank(c("title")).alias("title"), T.utf16_length(T.trim_blank(c("title"))).alias("title_length"),
        T.collapse(D.first_h1()).alias("h1"), F.size(F.filter(D.visible_headings(), lambda h: h["tag"] == "h1")).alias("n_h1"),
        F.size(D.internal_links(U.bare_host(c("url")))).alias("n_links"),
        D.attr(D.first(D.tagged(c("nodes"), "html")), "lang").alias("lang"),
    )


def _health_facts(spark, d):
    c = F.col
    return parsed_pages(spark, d).select(
        "site_id", "page_id", T.trim_blank(c("title")).alias("title"), F.lit("").alias("description"),
        T.utf16_length(T.collapse(D.first_h1())).alias("h1_length"), F.size(F.filter(c("headings"), lambda h: h["tag"] == "h1")).alias("n_h1"),
        (F.size(D.level_jumps(D.visible_headings())) == 0).alias("hierarchy_ok"), F.size(D.internal_links(U.bare_host(c("url")))).alias("n_links"),
    )


_HEALTH_SQL = f"""WITH {_FACTS},
dup AS (SELECT site_id, title, count(*) AS n FROM facts GROUP BY ALL), dups AS (SELECT site_id, sum(CASE WHEN n > 1 AND title <> '' THEN n ELSE 0 END) / sum(n) AS dup FROM dup GROUP BY ALL),
s AS (SELECT site_id, count(*) AS n_pages, count(*) FILTER (title <> '') / count(*) AS t, count(*) FILTER (length(title) BETWEEN 30 AND 60) / count(*) AS tl, count(*) FILTER (n_h1 >= 1) / count(*) AS u, count(*) FILTER (n_h1 = 1) / count(*) AS o,
  count(*) FILTER (n_h1 = 1 AND length(h1) BETWEEN 10 AND 90) / count(*) AS hl, bool_and(n_links >= 3) AS links FROM facts GROUP BY ALL),
k AS (SELECT site_id, n_pages, t >= 0.95 AS c16, tl >= 0.8 AS c17, dup <= 0.1 AS c22, u >= 0.7 OR o >= 0.6 AS c24, hl >= 0.6 AS c25, true AS c26, links AS c96 FROM s JOIN dups USING (site_id)),
p AS (SELECT *, CAST(floor((c16::INT * 8 + c17::INT * 5 + c24::INT * 7 + c25::INT * 4 + c26::INT * 5 + c96::INT * 4) / 33 * 100 + 0.5) AS INT) AS page_score, c22::INT * 100 AS domain_score FROM k)
SELECT site_id, CAST(n_pages AS INT) AS n_pages, page_score, domain_score, CAST(floor(page_score * 0.7::DOUBLE + domain_score * 0.3::DOUBLE + 0.5) AS INT) AS score,
 CASE WHEN floor(page_score * 0.7::DOUBLE + domain_score * 0.3::DOUBLE + 0.5) >= 85 THEN 'A' WHEN floor(page_score * 0.7::DOUBLE + domain_score * 0.3::DOUBLE + 0.5) >= 70 THEN 'B' WHEN floor(page_score * 0.7::DOUBLE + domain_score * 0.3::DOUBLE + 0.5) >= 55 THEN 'C'
   WHEN floor(page_score * 0.7::DOUBLE + domain_score * 0.3::DOUBLE + 0.5) >= 40 THEN 'D' ELSE 'F' END AS grade FROM p"""


@register("site_health", _HEALTH_SQL)
def site_health(spark, d):
    """Flagship: scan, parse, aggregate, join, long check rows, score and grade per host."""
    facts = stage(_health_facts(spark, d), "health_facts")  # parsed once, read by two aggregates
    totals = facts.groupBy("site_id").agg(*(F.count_if(mark).alias(name) for name, mark in SH.marks().items()))
    titles = facts.where("title != ''").groupBy("site_id", "title").agg(F.count("*").alias("n")).where("n > 1")
    return SH.scores(totals, titles.groupBy("site_id").agg(F.sum("n").alias("repeated")))


@register("stream_site_health", _HEALTH_SQL)
def stream_site_health(spark, d):
    """2.13: the same health from batches that repeat pages, replace earlier captures and bring old ones late."""
    facts = stage(_health_facts(spark, d).withColumn("captured_at", F.timestamp_seconds(F.lit(1000))), "health_facts")
    old = facts.withColumns({"captured_at": F.timestamp_seconds(F.lit(10)), "title": F.lit("old title"), "n_links": F.lit(0), "n_h1": F.lit(0)})
    part = F.pmod("page_id", F.lit(3))
    out = f"{shared_dir(spark)}/sitegauge/health-{uuid.uuid4().hex}"
    batches = (old.where(part != 0), facts.where(part == 1).union(facts.where(part == 1)), facts.where(part != 2).union(old.where(part == 1)), facts.where(part == 2).union(old))
    for epoch, batch in enumerate(batches):
        SH.update(batch, epoch, out)
        SH.update(batch, epoch, out)  # a replayed batch
    return SH.current(spark, out)


@register("duplicate_titles", f"""WITH {_FACTS}, g AS (SELECT site_id, title, count(*) AS n FROM facts GROUP BY ALL)
SELECT site_id, round(sum(CASE WHEN n > 1 AND title <> '' THEN n ELSE 0 END) / sum(n), 9) AS rate FROM g GROUP BY ALL""")
def duplicate_titles(spark, d):
    """AG4."""
    return duplicate_rates(_health_facts(spark, d)).select("site_id", F.round("duplicate_titles", 9).alias("rate"))


_LINKS = rf"""raw AS (SELECT page_id, {HOST_SQL} AS site_id, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) AS scheme, unnest(regexp_extract_all(html, '<a href="(/[^"]*)"', 1)) AS href,
  generate_subscripts(regexp_extract_all(html, '<a href="(/[^"]*)"', 1), 1) AS pos FROM pages),
links AS (SELECT page_id, site_id, pos, scheme || '://' || site_id || replace(replace(replace(replace(url_encode(href), '%2F', '/'), '%2C', ','), '%21', '!'), '%3A', ':') AS url FROM raw)"""


@register("site_links", f"WITH {_LINKS} SELECT site_id, count(*) AS n_links, count(DISTINCT url) AS n_targets, min(url) AS first_target, max(url) AS last_target FROM links GROUP BY ALL")
def site_links(spark, d):
    """H5 + U3: resolved internal links per site."""
    rows = L.link_rows(parsed_pages(spark, d)).where("internal")
    return rows.groupBy("site_id").agg(F.count(F.lit(1)).alias("n_links"), F.countDistinct("url").alias("n_targets"), F.min("url").alias("first_target"), F.max("url").alias("last_target"))


@register("broken_links", f"""WITH {_LINKS}, log AS (SELECT DISTINCT url, CASE WHEN length(url) % 7 = 0 THEN 404 ELSE 200 END AS status FROM links WHERE length(url) % 5 <> 0),
f AS (SELECT DISTINCT site_id, url FROM links)
SELECT site_id, CAST(count(*) AS BIGINT) AS n_links, CAST(count(*) FILTER (coalesce(status, 599) >= 400) AS BIGINT) AS broken, coalesce(bool_and(coalesce(status, 599) < 400), true) AS all_live FROM f LEFT JOIN log USING (url) GROUP BY ALL""")
def broken_links(spark, d):
    """G1: all internal links per site against a fetch log derived from the link targets."""
    links = stage_by(L.link_rows(parsed_pages(spark, d)).where("internal").select("site_id", F.col("url").alias("req_url")).distinct(), "internal_links", "req_url", LEAST_BUCKETS)
    log = stage_by(links.select("req_url").distinct().where(F.length("req_url") % 5 != 0).withColumn(
        "status", F.when(F.length("req_url") % 7 == 0, 404).otherwise(200)), "fetch_log", "req_url", LEAST_BUCKETS)
    live = F.coalesce("status", F.lit(599)) < 400
    return L.answer(links, log).groupBy("site_id").agg(
        F.count(F.lit(1)).alias("n_links"), F.count_if(~live).alias("broken"), F.bool_and(live).alias("all_live"))


@register("orphan_pages", f"""WITH p AS (SELECT page_id, {HOST_SQL} AS site_id, regexp_replace(url, '[?#].*$', '') AS u FROM pages), h AS (SELECT site_id, min(page_id) AS home FROM p GROUP BY ALL),
l AS (SELECT DISTINCT a.site_id, b.u FROM p a JOIN p b ON b.page_id = a.page_id + 3 AND b.site_id = a.site_id)
SELECT p.page_id, p.site_id FROM p JOIN h USING (site_id) WHERE page_id <> home AND NOT EXISTS (SELECT 1 FROM l WHERE l.site_id = p.site_id AND l.u = p.u)""")
def orphan_pages(spark, d):
    """Every page links to the page three ids on, where that is on its site."""
    pages = L.assign_order(site_pages(spark, d).withColumn("final_url", F.regexp_replace("url", r"[?#].*$", "")))
    linking = pages.select("site_id", (F.col("page_id") + 3).alias("page_id"))
    links = pages.join(linking, ["site_id", "page_id"]).select("site_id", F.col("final_url").alias("url"), F.lit(True).alias("internal"))
    return L.orphan_pages(pages, links).select("page_id", "site_id")


@register("url_variants", f"""WITH p AS (SELECT page_id, url, regexp_replace(url, '[?#].*$', '') AS u, {HOST_SQL} AS h FROM pages), log AS (SELECT DISTINCT u AS req_url, 200 AS status FROM p),
v AS (SELECT page_id, u, CASE WHEN u LIKE '%/' THEN u[1:-2] ELSE u || '/' END AS slash, replace(u, 'https:', 'http:') AS http, CASE WHEN h LIKE 'www.%' THEN replace(u, '//www.', '//') ELSE replace(u, '//', '//www.') END AS www FROM p)
SELECT page_id, a.status AS slash_status, b.status AS http_status, c.status AS www_status FROM v LEFT JOIN log a ON a.req_url = slash LEFT JOIN log b ON b.req_url = http LEFT JOIN log c ON c.req_url = www""")
def url_variants(spark, d):
    """Three address variants of every page through one lookup."""
    pages = table(spark, d, "pages").select("page_id", F.regexp_replace("url", r"[?#].*$", "").alias("u"))
    log = pages.select(F.col("u").alias("req_url")).distinct().withColumn("status", F.lit(200))
    u = F.col("u")
    wanted = L.wanted_rows(pages, {"slash": U.toggle_slash(u), "http": U.with_http(u), "www": U.toggle_www(u)}, "page_id")
    roles = L.by_role(L.answer(wanted, log), ["slash", "http", "www"], ["status"], "page_id")
    return roles.select("page_id", *[F.col(r)["status"].alias(f"{r}_status") for r in ("slash", "http", "www")])


@register("canonical_chains", """WITH e AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 11 = 0 THEN p_partkey WHEN p_partkey % 7 = 0 THEN p_partkey + 1 WHEN p_partkey % 7 = 1 THEN p_partkey - 1 ELSE p_partkey // 2 END AS n FROM part),
a AS (SELECT e.k, e.n AS c0, b.n AS c1, c.n AS c2, dd.n AS c3 FROM e LEFT JOIN e b ON b.k = e.n LEFT JOIN e c ON c.k = b.n LEFT JOIN e dd ON dd.k = c.n)
SELECT k AS site_id, CAST(CASE WHEN c1 IS NULL OR c1 = c0 THEN 0 WHEN c2 IS NULL OR c2 = c1 THEN 1 WHEN c2 = c0 THEN 3 WHEN c3 IS NULL OR c3 = c2 THEN 2 ELSE 3 END AS INT) AS hops,
 coalesce(c1 <> c0 AND c2 <> c1 AND c2 = c0, false) AS loop FROM a""")
def canonical_chains(spark, d):
    """Canonical edges derived from part keys, with self-references and two-cycles."""
    k = F.col("p_partkey")
    target = F.when(k % 11 == 0, k).when(k % 7 == 0, k + 1).when(k % 7 == 1, k - 1).otherwise(F.floor(k / 2))
    edges = table(spark, d, "part").select(k, F.concat(F.lit("u"), target).alias("canonical"))
    facts = edges.select(F.concat(F.lit("u"), k).alias("req_url"), F.col("canonical").alias("canonical_tag"))
    return L.canonical_chain(edges.select(k.alias("site_id"), "canonical"), facts)


@register("agent_comparison", """WITH w AS (SELECT doc_id, CAST(n_chars AS BIGINT) AS n FROM documents), r AS (SELECT doc_id, n % 3 <> 0 AS has_bot, n // 2 + n % 5 AS bot, n AS plain FROM w)
SELECT doc_id, CASE WHEN has_bot THEN bot END AS bot_chars, plain AS plain_chars, CASE WHEN has_bot AND plain > 0 THEN round(bot / plain, 9) END AS ratio FROM r""")
def agent_comparison(spark, d):
    """Answers to two agents side by side."""
    docs = table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("bigint").alias("n"))
    fields = ("req_url", "user_agent", "chars", "headers", "fetched_at")
    row = lambda agent, chars: docs.select(
        F.col("doc_id").cast("string").alias("req_url"), F.lit(agent).alias("user_agent"), chars.alias("chars"),
        F.create_map().cast("map<string,string>").alias("headers"), F.timestamp_seconds(F.lit(0)).alias("fetched_at"), "n").select(*fields, "n")
    log = row("plain", F.col("n")).unionByName(row("bot", F.floor(F.col("n") / 2).cast("bigint") + F.col("n") % 5).where(F.col("n") % 3 != 0)).drop("n")
    wide = L.agents_side_by_side(log, ["bot", "plain"], ["chars"])
    bot, plain = F.col("agent_0")["chars"], F.col("agent_1")["chars"]
    return wide.select(F.col("req_url").cast("bigint").alias("doc_id"), bot.alias("bot_chars"), plain.alias("plain_chars"), F.round(F.when(plain > 0, bot / plain), 9).alias("ratio"))


def _robots(spark, d):
    n = F.count(F.lit(1))
    sites = site_pages(spark, d).groupBy("site_id").agg(n.alias("n"))
    text = F.concat(
        F.lit("User-agent: GPTBot\nUser-agent: ClaudeBot\nDisallow: "), F.when(F.col("n") % 2 == 0, "/").otherwise("/private"),
        F.lit("\n\nuser-agent : *\nDisallow: "), F.when(F.col("n") % 5 == 0, "/").otherwise("/search"),
        F.when(F.col("n") % 3 == 0, F.lit("\n\nUser-agent: Grok\nDisallow: /\nAllow: /")).otherwise(""),
        F.lit("\nSitemap: https://"), "site_id", F.lit("/sitemap.xml"),
    )
    return sites.select("site_id", text.alias("robots"), F.concat(F.lit("https://"), "site_id").alias("origin"))


@register("robots_rules", f"""WITH s AS (SELECT {HOST_SQL} AS site_id, count(*) AS n FROM pages GROUP BY ALL)
SELECT site_id, n % 5 <> 0 AS gpt, n % 2 <> 0 AND n % 5 <> 0 AS claude, n % 3 <> 0 AND n % 5 <> 0 AS grok, n % 5 <> 0 AS other, n % 5 <> 0 AS search_blocked, 'https://' || site_id || '/sitemap.xml' AS sitemap, n % 3 = 0 AS names_grok FROM s""")
def robots_rules(spark, d):
    """R1-R3, R9 over robots texts (a group starts at every agent line) derived from each host's page count."""
    r = F.col("robots")
    allows = lambda bot: RB.allows(r, F.lit(bot))
    return _robots(spark, d).select(
        "site_id", allows("GPTBot").alias("gpt"), allows("ClaudeBot").alias("claude"), allows("Grok").alias("grok"), allows("OAI-SearchBot").alias("other"),
        RB.blocks_search(r).alias("search_blocked"), F.get(RB.sitemap_lines(r), 0).alias("sitemap"), (RB.group_for(r, F.lit("grok")) != "").alias("names_grok"))


@register("sitemap_urls", rf"""WITH p AS (SELECT {HOST_SQL} AS site_id, regexp_replace(regexp_replace(url, '^http:', 'https:'), '#.*$', '') AS url FROM pages), u AS (SELECT DISTINCT site_id, url FROM p), q AS (SELECT *, bool_or(url NOT LIKE '%?%') OVER (PARTITION BY site_id) AS any_plain FROM u)
SELECT site_id, count(*) AS n_urls, min(url) AS first_url, max(url) AS last_url FROM q WHERE NOT any_plain OR url NOT LIKE '%?%' GROUP BY ALL""")
def sitemap_urls(spark, d):
    """Sitemap files built from each host's pages, half of them behind an index."""
    pages = site_pages(spark, d).select("site_id", "page_id", F.regexp_replace("url", "^http:", "https:").alias("url"))
    entry = F.concat(F.lit("<url><loc>"), F.regexp_replace("url", "&", "&"), F.lit("</loc></url>"))
    part = F.col("page_id") % 4
    body = F.concat(F.lit("<urlset>"), F.array_join(F.array_sort(F.collect_list(entry)), ""), F.lit("</urlset>"))
    leaves = pages.groupBy("site_id", part.alias("part")).agg(body.alias("body")).withColumn(
        "req_url", F.concat(F.lit("https://"), "site_id", F.lit("/map-"), "part", F.lit(".xml")))
    index = leaves.groupBy("site_id").agg(F.concat(F.lit("<sitemapindex>"), F.array_join(F.transform(
        F.array_sort(F.collect_list("req_url")), lambda u: F.concat(F.lit("<sitemap><loc><![CDATA["), u, F.lit("]]></loc></sitemap>"))), ""), F.lit("</sitemapindex>")).alias("body")).withColumn(
        "req_url", F.concat(F.lit("https://"), "site_id", F.lit("/sitemap.xml")))
    log = leaves.select("req_url", "body").unionByName(index.select("req_url", "body")).withColumn("final_url", F.col("req_url")).withColumn(
        "status", F.lit(200)).withColumn("headers", F.create_map().cast("map<string,string>"))
    sites = _robots(spark, d)
    urls = SM.site_urls(SM.expand(sites, log, 20), sites)
    return urls.groupBy("site_id").agg(F.count(F.lit(1)).alias("n_urls"), F.min("url").alias("first_url"), F.max("url").alias("last_url"))


@register("site_extremes", """SELECT l_suppkey AS site_id, max(l_quantity) AS largest, max(l_quantity) - min(l_quantity) AS spread, bool_and(l_discount < 0.1) AS every_ok, bool_or(l_tax > 0.07) AS some_high,
 round(count(*) FILTER (l_discount < 0.05) / count(*), 9) AS rate, CAST(floor(count(*) FILTER (l_discount < 0.05) / count(*) * 100 + 0.5) AS INT) AS percent FROM lineitem GROUP BY ALL""")
def site_extremes(spark, d):
    """AG1, AG2, AG5."""
    c = F.col
    good = F.count_if(c("l_discount") < 0.05)
    return table(spark, d, "lineitem").groupBy(c("l_suppkey").alias("site_id")).agg(
        F.max("l_quantity").alias("largest"), (F.max("l_quantity") - F.min("l_quantity")).alias("spread"),
        F.bool_and(c("l_discount") < 0.1).alias("every_ok"), F.bool_or(c("l_tax") > 0.07).alias("some_high"),
        F.round(rate(good, F.count(F.lit(1))), 9).alias("rate"), half_up(rate(good, F.count(F.lit(1))) * 100).alias("percent"))


_HOT = "CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE l_suppkey END"


@register("site_medians", f"""SELECT site_id, count(*) AS n, list_sort(list(v))[count(*) // 2 + 1] AS median, list_sort(list(v))[count(*) * 9 // 10 + 1] AS ninth FROM (
 SELECT {_HOT} AS site_id, CASE WHEN l_linenumber = 7 THEN -l_extendedprice WHEN l_linenumber = 6 THEN l_quantity ELSE l_extendedprice END AS v FROM lineitem) GROUP BY ALL""")
def site_medians(spark, d):
    """AG5: upper median and ninth decile per site, one site with a third of all rows."""
    value = F.expr("CASE WHEN l_linenumber = 7 THEN -l_extendedprice WHEN l_linenumber = 6 THEN l_quantity ELSE l_extendedprice END")
    rows = table(spark, d, "lineitem").select(F.expr(_HOT).alias("site_id"), value.alias("v"))
    ninth = kth_value(rows, ["site_id"], "v", lambda n: F.floor(n * 9 / 10), "ninth")
    return ninth.join(upper_median(rows, ["site_id"], "v"), "site_id")


@register("capture_formats", "SELECT f.fmt, page_id, url, md5(html) AS html_md5, length(html) AS n_chars FROM pages CROSS JOIN (VALUES ('parquet'), ('json'), ('warc')) f(fmt)")
def capture_formats(spark, d):
    """A1: all pages written and read back as Parquet, JSON lines and WARC archives."""
    pages = table(spark, d, "pages")
    out = f"{shared_dir(spark)}/sitegauge/captures-{uuid.uuid4().hex}"
    read = []
    for fmt in archives.FORMATS:
        archives.write_pages(pages, f"{out}/{fmt}", fmt, compressed=fmt == "json")
        read.append(archives.read_pages(spark, f"{out}/{fmt}", fmt).select(
            F.lit(fmt).alias("fmt"), "page_id", "url", F.md5(F.encode("html", "UTF-8")).alias("html_md5"), F.length("html").cast("bigint").alias("n_chars")))
    return read[0].union(read[1]).union(read[2])


@register("source_medians", "SELECT source, count(*) AS n, list_sort(list(CAST(length(text) AS DOUBLE)))[count(*) // 2 + 1] AS median FROM documents WHERE text IS NOT NULL GROUP BY ALL")
def source_medians(spark, d):
    """AG5 over texts: upper median of the lengths per source; one source holds a third of the rows."""
    rows = table(spark, d, "documents").select("source", F.length("text").alias("n_points"))
    return kth_value(rows, ["source"], "n_points", lambda n: F.floor(n / 2), "median")
