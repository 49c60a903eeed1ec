"""Technical audit: 237 published checks from shared predicates.

A predicate that the report lists under several ids is written once, with all the ids, categories,
names, weights and severities it is published as. Page facts are narrow columns; sites are one
``groupBy`` of counts and logical aggregates over them, which combine before the shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dom as D
from ..functions import headers as H
from ..functions import jsonld as J
from ..functions import patterns as P
from ..functions import robots as R
from ..functions import text as T
from ..functions import urls as U
from ..functions.numbers import half_up, percent, rate
from ..operators.links import answer, asset_rows, by_role, canonical_chain, link_rows, wanted_rows
from ..operators.scoring import TECHNICAL
from ..sources.captures import certificate_ok, one_per_url, one_row
from .facts import Facts, script_flags
from .rules import CheckDef, Verdict, check_rows

# Checks scored for the whole domain; all others are page checks.
DOMAIN_IDS = frozenset((
    3, 4, 7, 10, 11, 12, 13, 14, 15, 22, 23, 35, 37, 38, 45, 56, 59, 67, 68, 69, 70, 80, 81, 83, 91, 98, 99, 106, 114,
    115, 116, 117, 118, 119, 120, 121, 122, 123, 125, 126, 127, 128, 129, 130, 131, 132, 133, 134, 135, 136, 137, 138,
    139, 140, 141, 142,
))
# Report order of the categories.
CATEGORY_ORDER = (
    "HTTP & Server Health", "Security & HTTPS", "Robots.txt & Sitemap", "Meta Tags", "Heading Structure",
    "Canonicalization", "Crawl & Redirect Control", "Indexability & Crawlability", "URL Structure", "Core Web Vitals",
    "LCP (Largest Contentful Paint)", "INP & Interactivity", "CLS (Cumulative Layout Shift)",
    "FCP (First Contentful Paint)", "TTFB & Server Response", "PageSpeed Scores", "Mobile Optimization", "Image SEO",
    "Security & Trust Pages", "Performance", "Performance & Caching", "Asset Optimisation", "Rendering & DOM",
    "Schema Markup", "Social Metadata", "External Link Trust", "Internal Linking", "Semantic HTML", "Accessibility",
    "International SEO", "Content Basics", "Trust Signals", "Security & Spam", "AI Crawl Readiness",
    "AI Accessibility & Discoverability",
)
# Agents whose answers are compared, anchor texts that say nothing, probe.
AI_AGENTS = (
    "GPTBot/1.2; +https://openai.com/gptbot", "PerplexityBot/1.0; +https://perplexity.ai/perplexitybot",
    "Google-Extended",
)
GENERIC_ANCHORS = ("click here", "read more", "here", "learn more", "link", "this")
SOFT_404_PROBE = "/__audit-soft-404-test"


@dataclass(frozen=True)
class Rule:
    """One predicate and the checks it is published as."""

    passed: Column
    checks: tuple[tuple[int, str, str, float, str], ...]
    evidence: dict[str, Column] = field(default_factory=dict)


def page_columns(pages: DataFrame) -> DataFrame:
    """Per-page facts, narrow."""
    c = F.col
    url, html, body = c("final_url"), c("html"), c("body_text")
    path = c("path")
    robots = D.meta_robots_first()
    header_robots = F.lower(H.header(c("headers"), "x-robots-tag"))
    shown = D.visible_headings()
    shown_h1 = F.filter(shown, lambda h: h["tag"] == "h1")
    canonical = D.link_first("canonical")
    blocks = c("blocks")
    types = c("types")
    typed = lambda pattern: J.any_type(types, pattern)
    article_path = P.test(path, "blog|article")
    internal = D.internal_links(c("site_host"))
    third = D.third_party_scripts(c("site_host"))
    preloads = D.links_rel("preload")
    image_preloads = F.filter(preloads, lambda e: D.attr_or(e, "as") == "image")
    context_ok = lambda b: F.coalesce(F.contains(J.string_of(J.get(b, "@context")), F.lit("schema.org")), F.lit(True))
    reviews = lambda e: P.test(F.concat_ws("\n", D.attr(e, "class"), D.attr(e, "id")), "review|testimonial", "")
    inline = D.inline_script_text()
    first = pages.select(
        "*", U.path(url).alias("path"), U.bare_host(url).alias("site_host"),
        J.top_blocks().alias("blocks"), J.deep_types().alias("types"),
        D.image_stats().alias("img"), D.label_stats().alias("labels"),
    )
    return first.select(
        "site_id", "ord", "is_primary", "img", "labels", "dom_nodes", "visible_words",
        url.alias("url"), (c("status") == 200).alias("status_ok"),
        (~F.contains(F.concat(header_robots, F.lit(" "), robots), F.lit("noindex"))).alias("allows_index"),
        F.contains(robots, F.lit("noindex")).alias("meta_noindex"),
        (~(F.contains(robots, F.lit("nosnippet")) | F.contains(robots, F.lit("max-snippet:0")))).alias("snippet_ok"),
        T.trim_blank(c("title")).alias("title"),
        T.trim_blank(D.meta_first("description")).alias("description"),
        F.contains(F.lower(D.meta_first("viewport")), F.lit("width=device-width")).alias("viewport_ok"),
        F.size(shown_h1).alias("n_h1"),
        F.when(F.size(shown_h1) == 1, T.utf16_length(T.collapse(F.get(shown_h1, 0)["text"]))).otherwise(0).alias("h1_length"),
        (F.size(D.level_jumps(shown)) == 0).alias("hierarchy_ok"),
        (T.text_or_empty(D.attr(canonical, "href")) != "").alias("has_canonical"),
        U.same_path(D.canonical_tag(), url).alias("self_canonical"),
        T.word_count(body).alias("words"),
        D.hidden_words().alias("hidden_words"),
        P.test(html, "infinite|load more|IntersectionObserver").alias("infinite"),
        P.test(html, "cookie|consent").alias("consent_words"),
        (~F.contains(path, F.lit("_"))).alias("no_underscore"),
        (T.utf16_length(url) <= 75).alias("short_url"),
        (path == F.lower(path)).alias("lower_path"),
        path.endswith("/").alias("slash_end"),
        F.coalesce(c("depth") <= 3, F.lit(True)).alias("shallow"),
        D.head_blocking().alias("n_blocking"),
        (F.size(image_preloads) > 0).alias("preloads_image"),
        F.transform(image_preloads, lambda e: e["abs"]).alias("image_preloads"),
        F.size(preloads).alias("n_preload"),
        F.size(D.links_rel("preconnect")).alias("n_preconnect"),
        F.size(blocks).alias("n_blocks"),
        J.error_count(blank_is_error=False).alias("n_errors"),
        F.forall(blocks, context_ok).alias("contexts_ok"),
        typed("Organization").alias("t_org"), typed("WebSite").alias("t_website"),
        typed("BreadcrumbList").alias("t_breadcrumb"),
        (~article_path | typed("Article|BlogPosting")).alias("article_typed"),
        ((D.tag_count("details") + D.class_lines("faq") == 0) | typed("FAQPage")).alias("faq_typed"),
        (~P.test(F.concat_ws(" ", path, T.trim_blank(D.first_h1())), "how-to|how to") | typed("HowTo")).alias("how_to_typed"),
        (~P.test(path, "service")
         | typed("LocalBusiness|ProfessionalService|MedicalBusiness|MedicalClinic|Physician|Dentist")).alias("service_typed"),
        (~P.test(path, "author|team") | typed("Person")).alias("person_typed"),
        (~P.test(path, "product|pricing") | typed("Product")).alias("product_typed"),
        (P.test(html, r'"sameAs"\s*:\s*\[', "") & (P.count(html, "https?://", "") >= 4)).alias("same_as"),
        F.contains(html, F.lit("SearchAction")).alias("search_action"),
        (~P.test(html, r'"price"\s*:', "") | P.test(body, r"\$|₹|€|£|\bprice\b")).alias("price_ok"),
        (T.trim_blank(D.meta_first("og:title", "property")) != "").alias("og_title"),
        (T.trim_blank(D.meta_first("og:description", "property")) != "").alias("og_description"),
        F.size(internal).alias("n_internal"),
        D.n(internal, lambda a: F.lower(T.trim_blank(a["text"])).isin(*GENERIC_ANCHORS)).alias("n_generic"),
        D.n(internal, lambda a: F.contains(a["abs"], F.lit("?")) & U.has_tracking_param(a["abs"])).alias("n_tracking"),
        D.n(internal, lambda a: U.is_search_url(a["abs"])).alias("n_search"),
        (D.tag_total("article", "section", "main", "aside", "header", "footer") >= 3).alias("semantic"),
        _every_table_captioned().alias("captions_ok"),
        F.forall(D.tagged(c("nodes"), "time"), lambda e: D.has_text_attr(e, "datetime")).alias("times_ok"),
        D.any_of(c("nodes"), lambda e: (e["tag"] == "html") & D.has_text_attr(e, "lang")).alias("has_lang"),
        (T.word_count(body) >= F.when(article_path, 800).otherwise(300)).alias("deep_enough"),
        (~article_path | P.test(html, "datePublished", "")
         | D.any_of(c("nodes"), lambda e: (e["tag"] == "time") & D.has(e, "datetime"))).alias("published_ok"),
        (~article_path | P.test(html, "dateModified|last-modified")
         | c("headers").getItem("last-modified").isNotNull()).alias("modified_ok"),
        (~article_path | P.test(html, "author|byline")).alias("author_ok"),
        D.any_of(c("anchors"), lambda a: P.test(D.attr(a, "href"), "/author/|/team/", "")).alias("bio_link"),
        (F.size(D.outbound_links(c("site_host"))) >= 2).alias("outbound_ok"),
        (D.any_of(D.every_element(), reviews) | (P.count(
            body, r"\b(review|reviews|testimonial|testimonials|rating|ratings|stars?|customer stories)\b") >= 2)
         ).alias("reviews"),
        D.is_empty_shell().alias("is_shell"),
        D.folded_words().alias("folded_words"),
        D.hidden_keyword_blocks().alias("n_hidden_spam"),
        F.size(third).alias("n_third"),
        F.size(F.filter(third, lambda deferred: deferred)).alias("n_third_deferred"),
        D.ad_slots_reserved().alias("ads_reserved"),
        _head_style().alias("critical_css"),
        *[flag.alias(name) for name, flag in script_flags(inline).items()],
    )


def _every_table_captioned() -> Column:
    captions = D.tagged(F.col("nodes"), "caption")
    return F.forall(
        D.tagged(F.col("nodes"), "table"), lambda t: F.exists(captions, lambda x: D.contains_element(t, x))
    )


def _head_style() -> Column:
    return D.any_of(
        F.col("nodes"),
        lambda e: (e["tag"] == "style") & D.inside(e, "head") & (T.trim_blank(T.text_or_empty(e["text"])) != ""),
    )


def home_columns(home: DataFrame) -> DataFrame:
    """Facts of the home page only."""
    c = F.col
    url, html, headers = c("final_url"), c("html"), c("headers")
    images = c("images")
    first_image = F.get(images, 0)
    src = F.coalesce(D.attr(first_image, "src"), D.attr(first_image, "data-src"), F.lit(""))
    viewport = F.lower(D.meta_first("viewport"))
    candidate = (F.size(images) > 0) | (D.tag_count("h1") > 0) | D.any_of(
        c("nodes"), lambda e: (e["tag"] == "video") & (D.inside(e, "main") | D.has(e, "poster"))
    )
    alternates = D.n(c("link_tags"), lambda e: (D.attr_or(e, "rel") == "alternate") & D.has(e, "hreflang"))
    twitter = lambda name: D.meta_first(f"twitter:{name}") != ""
    validators = lambda name: H.header(headers, name) != ""
    link_canonical = P.find(H.header(headers, "link"), r"<([^>]+)>;\s*rel=\"?canonical\"?")
    return home.select(
        "site_id", c("url").alias("home_url"), url.alias("landed_url"), "response_ms", "redirect_hops", "headers",
        c("status").alias("home_status"),
        T.word_count(c("body_text")).alias("home_words"),
        F.xxhash64("html").alias("home_hash"),
        F.octet_length(html).alias("home_bytes"),
        c("http_refs"), viewport.alias("viewport"),
        D.head_blocking().alias("home_blocking"),
        D.hidden_words().alias("home_hidden"),
        D.canonical_tag().alias("canonical"),
        link_canonical.alias("link_canonical"),
        (F.size(D.links_rel("next")) + F.size(D.links_rel("prev"))).alias("n_next_prev"),
        F.size(images).alias("home_images"),
        D.n(images, lambda e: ~(D.has_text_attr(e, "width") & D.has_text_attr(e, "height"))).alias("home_unsized"),
        src.alias("first_src"),
        F.when(src != "", F.when(D.attr(first_image, "src").isNotNull(), first_image["abs"]).otherwise(
            D.resolve_reference(url, src))).otherwise("").alias("first_url"),
        F.coalesce(F.lower(D.attr(first_image, "loading")) == "lazy", F.lit(False)).alias("first_lazy"),
        candidate.alias("lcp_candidate"),
        (~P.test(html, "@font-face") | P.test(html, r"font-display\s*:\s*swap")).alias("fonts_swap"),
        P.test(html, "cookie").alias("cookie_words"),
        P.test(html, D.INTERSTITIAL).alias("interstitial"),
        ((F.size(F.filter("scripts", lambda s: D.attr_or(s, "type") == "application/ld+json")) > 0)
         | ~P.test(html, r"googletagmanager|GTM-|dataLayer\.push|schema\.org[\s\S]{0,120}dataLayer")).alias("server_schema"),
        D.footer_link("privacy").isNotNull().alias("footer_privacy"),
        D.footer_link("terms|conditions").isNotNull().alias("footer_terms"),
        D.plain_link("contact")["abs"].alias("contact_url"),
        D.plain_link("about")["abs"].alias("about_url"),
        alternates.alias("n_hreflang"),
        (P.test(html, "/(en|hi|fr|es|de|ar)/") | (alternates > 0)).alias("multilingual"),
        D.resolve_reference(url, D.meta_first("og:image", "property")).alias("og_image"),
        (D.meta_first("og:image", "property") != "").alias("has_og_image"),
        (twitter("card") & twitter("title") & twitter("description")).alias("twitter_ok"),
        (validators("etag") | validators("last-modified")).alias("has_validator"),
        H.edge_signal(headers).alias("edge"),
        H.header(headers, "content-encoding").alias("encoding"),
        H.hsts_max_age(headers).alias("hsts"),
        D.api_urls(U.origin(url)).alias("api_urls"),
        P.find_all(html, r"https?://[^\"'\s]+/[a-f0-9-]{8,}\.txt").alias("key_files"),
    )


_EVERY = (
    "status_ok", "allows_index", "snippet_ok", "has_canonical", "no_underscore", "short_url", "lower_path", "shallow",
    "contexts_ok", "article_typed", "faq_typed", "how_to_typed", "service_typed", "person_typed", "product_typed",
    "price_ok", "og_title", "og_description", "semantic", "captions_ok", "times_ok", "has_lang", "deep_enough",
    "published_ok", "modified_ok", "author_ok", "outbound_ok", "ads_reserved", "critical_css",
)
_SOME = (
    "same_as", "search_action", "t_website", "bio_link", "reviews", "preloads_image", "history_trap", "exit_trap",
    "yields", "injects", "infinite", "is_shell",
)


def site_columns(pages: DataFrame) -> DataFrame:
    """AG1-AG5: one row per site from the page facts."""
    c = F.col
    share = lambda condition: F.count_if(condition) / F.count(F.lit(1))
    total = lambda column: F.coalesce(F.sum(column), F.lit(0))
    image = lambda part, whole, empty: rate(total(c("img")[part]), total(c("img")[whole]), empty)
    described = c("description") != ""
    return pages.groupBy("site_id").agg(
        F.count(F.lit(1)).cast("int").alias("n_pages"),
        *[F.coalesce(F.bool_and(name), F.lit(True)).alias(f"every_{name}") for name in _EVERY],
        *[F.coalesce(F.bool_or(name), F.lit(False)).alias(f"some_{name}") for name in _SOME],
        share(c("title") != "").alias("title_rate"),
        share(T.utf16_length(c("title")).between(30, 60)).alias("title_length_rate"),
        share(described).alias("description_rate"),
        rate(F.count_if(described & T.utf16_length(c("description")).between(120, 160)), F.count_if(described)).alias(
            "description_length_rate"),
        share(c("viewport_ok")).alias("viewport_rate"),
        share(c("n_h1") >= 1).alias("h1_rate"),
        share(c("n_h1") == 1).alias("single_h1_rate"),
        share(c("h1_length").between(10, 90)).alias("h1_length_rate"),
        share(c("hierarchy_ok")).alias("hierarchy_rate"),
        share(c("self_canonical")).alias("self_canonical_rate"),
        share(c("visible_words") >= 150).alias("ssr_rate"),
        F.bool_and(~c("meta_noindex")).alias("no_meta_noindex"),
        F.bool_and(~c("meta_noindex") & c("has_canonical")).alias("indexable_canonical"),
        F.bool_and(c("words") >= 50).alias("enough_words"),
        F.bool_and((c("words") > 80) | ~c("consent_words")).alias("no_consent_wall"),
        F.bool_and(c("hidden_words") < 100).alias("little_hidden"),
        F.bool_and(c("n_blocking") == 0).alias("no_blocking"),
        F.bool_and(c("n_blocks") > 0).alias("all_jsonld"),
        total("n_errors").alias("n_errors"),
        F.bool_and(c("is_primary") | c("t_breadcrumb")).alias("interior_breadcrumbs"),
        F.bool_or(c("is_primary") & c("t_org")).alias("home_org"),
        F.bool_and(c("n_internal") >= 3).alias("internal_ok"),
        total("n_generic").alias("n_generic"), total("n_tracking").alias("n_tracking"), total("n_search").alias("n_search"),
        (F.bool_and("slash_end") | ~F.bool_or("slash_end")).alias("slash_consistent"),
        F.bool_and(c("img")["sized"] == c("img")["total"]).alias("all_sized"),
        F.bool_and(rate(c("img")["modern"], c("img")["total"], 1.0) >= 0.7).alias("modern_pages"),
        image("alt", "shown", 1.0).alias("alt_rate"), image("sized", "total", 1.0).alias("sized_rate"),
        image("modern", "total", 1.0).alias("modern_rate"), image("generic", "total", 0.0).alias("generic_rate"),
        image("charts_detailed", "charts", 1.0).alias("chart_rate"), image("below_lazy", "below", 1.0).alias("lazy_rate"),
        rate(total(c("labels")["labelled"]), total(c("labels")["total"]), 1.0).alias("label_rate"),
        F.max("dom_nodes").alias("max_nodes"),
        total("folded_words").alias("folded_words"), total("n_hidden_spam").alias("n_hidden_spam"),
        total("n_third").alias("n_third"), total("n_third_deferred").alias("n_third_deferred"),
        total("n_preconnect").alias("n_preconnect"), total("n_preload").alias("n_preload"),
    )


def duplicate_rates(pages: DataFrame) -> DataFrame:
    """AG4: pages that share their title or description with another page of the site.

    Two-level counting: per value first, then per site. No site is ever windowed as a whole.
    """
    values = pages.select(
        "site_id",
        F.explode(F.array(
            F.struct(F.lit("title").alias("what"), F.col("title").alias("value")),
            F.struct(F.lit("description").alias("what"), F.col("description").alias("value")),
        )).alias("v"),
    ).select("site_id", "v.*")
    per_value = values.groupBy("site_id", "what", "value").agg(F.count(F.lit(1)).alias("n"))
    filled = F.col("value") != ""
    repeated = lambda what: F.coalesce(F.sum(F.when((F.col("what") == what) & filled & (F.col("n") > 1), F.col("n"))), F.lit(0))
    return per_value.groupBy("site_id").agg(
        rate(repeated("title"), F.sum(F.when(F.col("what") == "title", F.col("n")))).alias("duplicate_titles"),
        rate(
            repeated("description"),
            F.coalesce(F.sum(F.when((F.col("what") == "description") & filled, F.col("n"))), F.lit(0)),
        ).alias("duplicate_descriptions"),
    )


def asset_columns(pages: DataFrame, answers: DataFrame, first_urls: DataFrame) -> DataFrame:
    """All assets with their answers, folded per site."""
    c = F.col
    known = asset_rows(pages).where(c("kind").isin(*U.TEXT_KINDS) | (c("kind") != "other")).join(
        answers.select(
            c("req_url").alias("url"), "status", "headers", "history_trap", "exit_trap", "yields", "injects"
        ), "url",
    ).join(first_urls, "site_id", "left")
    groups = {"text": c("kind").isin(*U.TEXT_KINDS), "header": c("kind") != "other", "script": c("kind") == "js"}
    of = groups.__getitem__
    size = H.content_length(c("headers"))
    head_sum = lambda condition: F.coalesce(F.sum(F.when(of("header") & condition, size)), F.lit(0.0))
    own = U.same_site(c("url"), c("landed_url"))
    some = lambda name: F.coalesce(F.bool_or(of("script") & c(name)), F.lit(False)).alias(f"asset_{name}")
    return known.groupBy("site_id").agg(
        F.count_if(of("text")).alias("n_text"),
        F.count_if(of("text") & P.test(H.header(c("headers"), "content-encoding"), "gzip|br|deflate")).alias("n_compressed"),
        F.count_if(of("header")).alias("n_header"),
        F.count_if(of("header") & H.cache_policy_ok(c("kind"), c("headers"))).alias("n_cached"),
        F.count_if(of("header") & (c("headers").getItem("etag").isNotNull() | c("headers").getItem("last-modified").isNotNull())
                   ).alias("n_validated"),
        F.count_if(of("header") & H.content_type_ok(c("kind"), c("headers"))).alias("n_typed"),
        F.min_by(F.when(of("header"), F.when(H.edge_signal(c("headers")) != "", H.edge_signal(c("headers")))),
                 F.when(of("header") & (H.edge_signal(c("headers")) != ""), c("place"))).alias("asset_edge"),
        head_sum(c("kind") == "js").alias("js_bytes"), head_sum(c("kind") == "css").alias("css_bytes"),
        head_sum(F.lit(True)).alias("asset_bytes"),
        F.count_if(of("header") & (c("kind") == "font")).alias("n_fonts"),
        F.count_if(of("header") & (c("kind") == "font") & own).alias("n_own_fonts"),
        F.coalesce(F.max(F.when(of("header") & (c("url") == c("first_url")), size)), F.lit(0.0)).alias("lcp_bytes"),
        some("history_trap"), some("exit_trap"), some("yields"), some("injects"),
    )


def link_columns(pages: DataFrame, answers: DataFrame) -> DataFrame:
    """G1: all distinct internal and external links with what they answered."""
    links = link_rows(pages).where(F.col("internal") | F.col("url").startswith("http"))
    rows = links.select("site_id", "url", F.when(F.col("internal"), "internal").otherwise("external").alias("side")).distinct()
    known = rows.join(answers.select(F.col("req_url").alias("url"), "status"), "url", "left")
    inside = F.col("side") == "internal"
    live = F.coalesce("status", F.lit(599)) < 400
    return known.groupBy("site_id").agg(
        F.coalesce(F.bool_and(F.when(inside, live)), F.lit(True)).alias("internal_live"),
        F.count_if(~inside).alias("n_external"),
        F.count_if(~inside & live).alias("n_external_live"),
    )


def subdomain_columns(pages: DataFrame, home: DataFrame, certs: DataFrame) -> DataFrame:
    """H17 + A10: linked subdomains and whether each has a valid certificate."""
    own = home.select("site_id", U.bare_host(F.col("url")).alias("own_host"))
    rows = (
        pages.join(own, "site_id")
        .select("site_id", F.explode(D.subdomain_hosts(F.col("own_host"))).alias("host"))
    )
    return rows.select("site_id", "host").distinct().join(certs, "host", "left").groupBy("site_id").agg(
        F.bool_and(F.coalesce("certificate_ok", F.lit(False))).alias("subdomains_ok")
    )


def agent_columns(home: DataFrame, parsed_log: DataFrame) -> DataFrame:
    """What AI agents got for the home page, against the ordinary answer."""
    seen = one_per_url(
        parsed_log.where(F.col("user_agent").isin(*AI_AGENTS)).select(
            F.col("url").alias("landed_url"), "user_agent", "status", T.word_count(F.col("body_text")).alias("words"),
            F.coalesce("fetched_at", F.timestamp_seconds(F.lit(0))).alias("fetched_at"),
            F.lit(None).cast("map<string,string>").alias("headers"),
        ),
        ("landed_url", "user_agent"),
    )
    pairs = home.select("site_id", "landed_url", "home_words").join(seen, "landed_url")
    need = F.greatest(F.lit(50), half_up(F.col("home_words") * 0.5))
    return pairs.groupBy("site_id").agg(
        F.count(F.lit(1)).cast("int").alias("n_agents"),
        F.bool_and((F.col("status") < 400) & (F.col("words") >= need)).alias("agents_ok"),
        F.min(F.when(F.col("home_words") > 0, F.col("words") / F.col("home_words")).otherwise(1.0)).alias("agent_ratio"),
    )


def list_columns(home: DataFrame, answers: DataFrame) -> DataFrame:
    """Public interfaces and key files of the home page with their answers."""
    rows = home.select(
        "site_id",
        F.explode(F.concat(
            F.transform("api_urls", lambda u: F.struct(F.lit("api").alias("kind"), u.alias("req_url"))),
            F.transform("key_candidates", lambda u: F.struct(F.lit("key").alias("kind"), u.alias("req_url"))),
        )).alias("w"),
    ).select("site_id", "w.*")
    known = rows.join(answers.select("req_url", "status", "headers"), "req_url", "left")
    cors = H.header(F.col("headers"), "access-control-allow-origin") != ""
    return known.groupBy("site_id").agg(
        F.coalesce(F.bool_or((F.col("kind") == "api") & cors), F.lit(False)).alias("any_cors"),
        F.coalesce(F.bool_or((F.col("kind") == "key") & (F.col("status") == 200)), F.lit(False)).alias("key_found"),
    )


_ANSWER = (
    "status", "content_type", "landed", "body_hash", "robots_text", "llms_words", "llms_sections", "feed_words",
    "lastmod_ok", "headers",
)


def wide_columns(facts: Facts, as_of: Column) -> DataFrame:
    """Everything the rules look at, one row per site."""
    c = F.col
    pages = facts.keep(page_columns(facts.pages), "technical_pages")
    home = home_columns(facts.home)
    certs = certificate_ok(facts.certs, as_of)
    origin = U.origin(c("home_url"))
    first = wanted_rows(home, {"robots": F.concat(origin, F.lit("/robots.txt"))})
    robots = answer(first, facts.answers).select("site_id", c("robots_text").alias("robots"), c("status").alias("robots_status"),
                                                 c("content_type").alias("robots_type"))
    home = home.join(robots, "site_id", "left").withColumn("robots", F.coalesce("robots", F.lit("")))
    declared = F.get(R.sitemap_lines(c("robots")), 0)
    home = home.withColumn(
        "key_candidates", R.index_key_candidates(origin, c("robots"), F.array_join("key_files", "\n"))
    )
    home = facts.keep(home, "technical_home")
    roles = {
        "sitemap": F.coalesce(declared, F.concat(origin, F.lit("/sitemap.xml"))),
        "ai_sitemap": F.concat(origin, F.lit("/ai-sitemap.xml")), "ai_txt": F.concat(origin, F.lit("/ai.txt")),
        "llms": F.concat(origin, F.lit("/llms.txt")), "feed0": F.concat(origin, F.lit("/feed")),
        "feed1": F.concat(origin, F.lit("/rss")), "feed2": F.concat(origin, F.lit("/atom.xml")),
        "probe": F.concat(origin, F.lit(SOFT_404_PROBE)), "www": U.with_www(c("home_url")),
        "slash": U.toggle_slash(c("home_url")), "og": F.when(c("has_og_image"), c("og_image")),
    }
    looked_up = by_role(answer(wanted_rows(home, roles), facts.answers), list(roles), _ANSWER)
    manual_roles = {"slash_raw": U.toggle_slash(c("home_url")), "case_raw": U.upper_path(c("landed_url"))}
    manual = by_role(answer(wanted_rows(home, manual_roles), facts.manual), list(manual_roles), ["status"])
    page_roles = {"about": c("about_url"), "contact": c("contact_url"), "target": c("canonical")}
    body = T.collapse(c("body_text"))
    linked_facts = facts.parsed_log.where(c("user_agent").isNull() & (c("redirect_mode") == "follow")).select(
        c("url").alias("req_url"), "headers", "metas", "body_text"
    ).unionByName(facts.pages.select(c("url").alias("req_url"), "headers", "metas", "body_text")).select(
        "req_url", T.word_count(c("body_text")).alias("words"),
        (T.visible_phone(body) & P.test(body, r"\b(street|road|avenue|lane|floor|city|india|usa|uk)\b")).alias("nap"),
        (~F.contains(F.concat(F.lower(H.header(c("headers"), "x-robots-tag")), D.meta_robots_first()), F.lit("noindex"))
         ).alias("allows_index"),
    )
    linked_facts = one_row(linked_facts, ("req_url",))
    linked = by_role(
        answer(wanted_rows(home, page_roles), linked_facts), list(page_roles), ["words", "nap", "allows_index"]
    )
    preloaded = (
        pages.where("preloads_image").select("site_id", F.explode("image_preloads").alias("first_url"))
        .groupBy("site_id", "first_url").agg(F.lit(True).alias("lcp_preloaded"))
    )
    chains = canonical_chain(home.select("site_id", "canonical"), facts.index)
    vitals = _vitals(home, facts.vitals)
    out = home.join(facts.keep(site_columns(pages), "technical_sites"), "site_id")
    for at, side in enumerate((
        duplicate_rates(pages),
        asset_columns(facts.pages, facts.answers, home.select("site_id", "first_url", "landed_url")),
        link_columns(facts.pages, facts.answers), looked_up, manual, linked,
        subdomain_columns(facts.pages, facts.home, certs), agent_columns(home, facts.parsed_log),
        list_columns(home, facts.answers), chains, vitals,
    )):
        out = out.join(facts.keep(side, f"technical_side_{at}"), "site_id", "left")
    host_certs = certs.select(c("host").alias("cert_host"), "certificate_ok")
    return out.join(preloaded, ["site_id", "first_url"], "left").withColumn("cert_host", U.host(c("home_url"))).join(
        host_certs, "cert_host", "left"
    )


def _vitals(home: DataFrame, lab: DataFrame) -> DataFrame:
    """Measurements of the home page per strategy."""
    names = [n for n in lab.columns if n not in ("url", "strategy")]
    packed = lab.groupBy(F.col("url").alias("landed_url")).agg(
        *[
            F.first(F.when(F.col("strategy") == s, F.struct(*names)), ignorenulls=True).alias(s)
            for s in ("field", "mobile", "desktop")
        ]
    )
    return home.select("site_id", "landed_url").join(packed, "landed_url").drop("landed_url")


# Categories, in the short form the rules below use.
_HTTP, _SECURITY, _ROBOTS, _META = "HTTP & Server Health", "Security & HTTPS", "Robots.txt & Sitemap", "Meta Tags"
_HEADING, _CANON, _CRAWL = "Heading Structure", "Canonicalization", "Crawl & Redirect Control"
_INDEX, _URL, _CWV = "Indexability & Crawlability", "URL Structure", "Core Web Vitals"
_LCP, _INP, _CLS = "LCP (Largest Contentful Paint)", "INP & Interactivity", "CLS (Cumulative Layout Shift)"
_FCP, _TTFB, _PSI = "FCP (First Contentful Paint)", "TTFB & Server Response", "PageSpeed Scores"
_MOBILE, _IMAGE, _PAGES, _PERF = "Mobile Optimization", "Image SEO", "Security & Trust Pages", "Performance"
_CACHE, _ASSET, _DOM, _SCHEMA = "Performance & Caching", "Asset Optimisation", "Rendering & DOM", "Schema Markup"
_SOCIAL, _EXTERNAL, _INTERNAL = "Social Metadata", "External Link Trust", "Internal Linking"
_SEMANTIC, _ACCESS, _LANG = "Semantic HTML", "Accessibility", "International SEO"
_CONTENT, _TRUST, _SPAM, _AI = "Content Basics", "Trust Signals", "Security & Spam", "AI Crawl Readiness"
_AI_MORE = "AI Accessibility & Discoverability"


def rules() -> list[Rule]:
    """All predicates with what they are published as (ids, labels, weights and limits are fixed values)."""
    c = F.col
    every, some = (lambda n: c(f"every_{n}")), (lambda n: c(f"some_{n}"))
    status = lambda role: c(role)["status"]
    zero = lambda column: F.coalesce(c(column), F.lit(0))
    none_or = lambda part, whole, least: (zero(whole) == 0) | (percent(zero(part), zero(whole)) >= least)
    https = U.scheme(c("home_url")) == "https"
    ms = c("response_ms")
    lcp = F.coalesce(c("field")["lcp"], c("mobile")["lcp"])
    inp = F.coalesce(c("field")["inp"], c("mobile")["inp"])
    cls = F.coalesce(c("field")["cls"], c("mobile")["cls"])
    ttfb = F.coalesce(c("field")["ttfb"], c("mobile")["ttfb"], ms)
    psi = lambda name: c("mobile")[name]
    under = lambda value, limit: F.coalesce(value, ms.cast("double")) < limit
    device_width = F.contains(c("viewport"), F.lit("width=device-width"))
    no_blocking = c("home_blocking") == 0
    mobile_ok = F.coalesce(psi("performance_score") >= 60, (ms < 2500) & device_width)
    tap_ok = F.coalesce(psi("tap_targets_pass"), device_width)
    certified = https & F.coalesce(c("certificate_ok"), F.lit(False))
    gzip = P.test(c("encoding"), "gzip|br")
    modern = c("modern_rate") >= 0.7
    optimized = F.coalesce(psi("optimized_image_pass"), modern)
    not_lazy = F.coalesce(psi("lcp_lazy_loaded_pass"), ~c("first_lazy"))
    modern_lcp = F.when(
        c("first_src") != "",
        P.test(c("first_src"), r"\.(webp|avif)(?:[?#].*)?$") | F.coalesce(psi("modern_image_pass"), F.lit(False)),
    ).otherwise(F.coalesce(psi("modern_image_pass"), modern))
    lcp_preload = F.when(c("first_url") != "", F.coalesce(c("lcp_preloaded"), F.lit(False))).otherwise(some("preloads_image"))
    savings = lambda name, size: F.when(psi(name).isNotNull() & (zero(size) > 0), half_up(psi(name) / c(size) * 100))
    phases = sum((psi(n).isNotNull().cast("int") for n in ("ttfb", "fcp", "lcp")), F.lit(0))
    llms_ok = (
        (status("llms") == 200) & P.test(c("llms")["content_type"], "text|plain|markdown")
        & (c("llms")["llms_words"] >= 100) & (c("llms")["llms_sections"] >= 2)
    )
    feed_ok = lambda r: status(r).between(200, 299) & P.test(c(r)["content_type"], "xml|rss|atom|text")
    feed_words = F.coalesce(*[F.when(feed_ok(r), c(r)["feed_words"]) for r in ("feed0", "feed1", "feed2")])
    probe_gone = F.coalesce(status("probe"), F.lit(0)).isin(404, 410)
    edge = F.coalesce(F.when(c("edge") != "", c("edge")), c("asset_edge"), F.lit(""))
    traps = lambda name: some(name) | F.coalesce(c(f"asset_{name}"), F.lit(False))
    indexable_target = (c("canonical") == "") | F.coalesce(c("target")["allows_index"], F.lit(False))
    chain_ok = (zero("hops") <= 1) & ~F.coalesce(c("loop"), F.lit(False))
    slash_raw, case_raw = F.coalesce(status("slash_raw"), F.lit(0)), F.coalesce(status("case_raw"), F.lit(0))
    redirects_ok = slash_raw.isin(0, 301, 308) | case_raw.isin(0, 301, 308, 404)
    slash_differs = (status("slash") == 200) & (c("home_status") == 200) & (c("slash")["body_hash"] != c("home_hash"))
    search_ok = R.blocks_search(c("robots")) | (c("n_search") == 0)
    external_ok = (zero("n_external") == 0) | (rate(zero("n_external_live"), zero("n_external"), 1.0) >= 0.9)
    api_ok = (F.size("api_urls") == 0) | F.coalesce(c("any_cors"), F.lit(False))
    agents_ok = (zero("n_agents") > 0) & F.coalesce(c("agents_ok"), F.lit(False))
    agent_ratio = F.coalesce(c("agent_ratio"), F.lit(1.0))
    subdomains_ok = F.coalesce(c("subdomains_ok"), F.lit(True))
    no_jsonld_errors = c("n_errors") == 0
    validators = c("has_validator") | (zero("n_validated") > 0)
    types_ok = zero("n_typed") == zero("n_header")
    B, MA, MI, AD = "BLOCKER", "MAJOR", "MINOR", "ADVISORY"
    return [
        Rule(c("home_status") == 200, ((1, _HTTP, "Page returns HTTP 200", 10, B),), {"status": c("home_status")}),
        Rule(https, ((2, _HTTP, "HTTPS protocol enabled", 10, B),), {"url": c("home_url")}),
        Rule(certified, ((3, _HTTP, "SSL certificate valid and not expired", 8, B),), {"host": c("cert_host")}),
        Rule(c("hsts") >= 31536000, ((4, _HTTP, "HSTS header present", 4, MI),), {"max_age": c("hsts")}),
        Rule(gzip, ((5, _HTTP, "GZIP or Brotli compression enabled", 5, MA),
                    (72, _PERF, "GZIP or Brotli compression on responses", 5, MA),
                    (212, _CACHE, "GZIP/Brotli on HTML", 2.25, MI)), {"encoding": c("encoding")}),
        Rule(~F.contains(F.lower(H.header(c("headers"), "x-robots-tag")), F.lit("noindex")),
             ((6, _HTTP, "X-Robots-Tag header does NOT contain noindex", 7, B),)),
        Rule(F.coalesce((c("www")["landed"] != U.with_www(c("home_url"))) | (status("www") == 200), F.lit(True)),
             ((7, _HTTP, "WWW vs non-WWW redirects consistently", 5, MA),), {"landed": c("www")["landed"]}),
        Rule(~https | (c("http_refs") == 0), ((8, _HTTP, "No mixed content on HTTPS pages", 7, MA),
                                              (211, _SECURITY, "No Mixed Content", 2.25, MA)), {"references": c("http_refs")}),
        Rule(ms < 800, ((9, _HTTP, "TTFB < 800ms", 6, MA),), {"ms": ms}),
        Rule((c("robots_status") == 200) & P.test(c("robots_type"), "text|plain"),
             ((10, _ROBOTS, "robots.txt returns HTTP 200", 5, MA),), {"status": c("robots_status")}),
        Rule(P.test(c("robots"), "sitemap:"), ((11, _ROBOTS, "Sitemap declared in robots.txt", 5, MI),)),
        Rule((status("sitemap") == 200) & P.test(c("sitemap")["content_type"], "xml|text"),
             ((12, _ROBOTS, "sitemap.xml returns HTTP 200 with XML content", 7, MA),), {"status": status("sitemap")}),
        Rule(c("sitemap")["lastmod_ok"], ((13, _ROBOTS, "All sitemap URLs have lastmod element", 4, MI),)),
        Rule(every("allows_index"), ((14, _ROBOTS, "No noindex pages included in sitemap", 6, MA),
                                     (32, _INDEX, "Page is indexable", 8, MA),
                                     (206, _CRAWL, "No Noindex in Sitemap", 1.69, MA)), {"pages": c("n_pages")}),
        Rule(status("ai_sitemap") == 200, ((15, _ROBOTS, "Optional ai-sitemap.xml exists", 2, AD),)),
        Rule(c("title_rate") >= 0.95, ((16, _META, "Title tag exists and non-empty", 8, MA),), {"rate": c("title_rate")}),
        Rule(c("title_length_rate") >= 0.8, ((17, _META, "Title length 30-60 characters", 5, MA),),
             {"rate": c("title_length_rate")}),
        Rule(c("description_rate") >= 0.8, ((18, _META, "Meta description exists and non-empty", 7, MA),),
             {"rate": c("description_rate")}),
        Rule(c("description_length_rate") >= 0.75, ((19, _META, "Meta description length 120-160 characters", 4, MI),),
             {"rate": c("description_length_rate")}),
        Rule(c("viewport_rate") >= 0.95, ((20, _META, "Viewport meta tag present", 8, B),), {"rate": c("viewport_rate")}),
        Rule(c("no_meta_noindex"), ((21, _META, "No noindex in meta robots", 8, B),)),
        Rule(c("duplicate_titles") <= 0.1, ((22, _META, "Duplicate titles sitewide", 6, MA),), {"rate": c("duplicate_titles")}),
        Rule(c("duplicate_descriptions") <= 0.15, ((23, _META, "Duplicate meta descriptions sitewide", 5, MA),),
             {"rate": c("duplicate_descriptions")}),
        Rule((c("h1_rate") >= 0.7) | (c("single_h1_rate") >= 0.6), ((24, _HEADING, "Exactly 1 H1 per page", 7, MA),),
             {"rate": c("single_h1_rate")}),
        Rule(c("h1_length_rate") >= 0.6, ((25, _HEADING, "H1 length 10-90 characters", 4, MI),), {"rate": c("h1_length_rate")}),
        Rule(c("hierarchy_rate") >= 0.6, ((26, _HEADING, "Heading hierarchy never skips levels", 5, MA),),
             {"rate": c("hierarchy_rate")}),
        Rule(every("has_canonical"), ((27, _CANON, "Canonical tag exists on every page", 6, MA),)),
        Rule(c("self_canonical_rate") >= 0.9, ((28, _CANON, "Canonical URL is self-referencing", 7, B),
                                               (201, _CRAWL, "Self-Referencing Canonical", 2.82, B)),
             {"rate": c("self_canonical_rate")}),
        Rule(indexable_target, ((29, _CANON, "Canonical does not point to noindex page", 7, B),
                                (202, _CRAWL, "Canonical Not -> Noindex", 2.25, B)), {"canonical": c("canonical")}),
        Rule(~P.test(c("home_url"), "[?&]page=|/page/") | (c("n_next_prev") > 0),
             ((30, _CANON, "Paginated pages have rel next or prev", 4, AD),)),
        Rule(~F.coalesce(slash_differs, F.lit(False)), ((31, _CANON, "No duplicate content at slug and slug slash", 4, MI),),
             {"status": status("slash")}),
        Rule(every("snippet_ok"), ((33, _INDEX, "No nosnippet or max-snippet:0", 7, B),)),
        Rule(c("enough_words"), ((34, _INDEX, "JS content rendering check", 9, B),)),
        Rule(F.coalesce(c("internal_live"), F.lit(True)), ((35, _INDEX, "0 broken internal links", 7, MA),)),
        Rule(c("redirect_hops") <= 1, ((36, _INDEX, "Redirect chain <= 1 hop", 6, MA),), {"hops": c("redirect_hops")}),
        Rule(every("shallow"), ((37, _INDEX, "No important page at crawl depth > 3", 5, MA),
                                (99, _INTERNAL, "No page at crawl depth > 3", 5, MA))),
        Rule(F.lit(True), ((38, _INDEX, "0 orphan pages", 5, MA), (98, _INTERNAL, "0 orphan pages", 5, MA))),
        Rule(c("little_hidden"), ((39, _INDEX, "No content hidden in display:none > 100w", 7, MA),)),
        Rule(~some("infinite"), ((40, _INDEX, "No infinite scroll", 4, MI), (197, _CRAWL, "No Infinite Scroll", 2.25, MA))),
        Rule(c("no_consent_wall"), ((41, _INDEX, "No cookie wall blocking DOM content", 5, MA),
                                    (218, _DOM, "No Consent Wall Blocking DOM", 2.25, B))),
        Rule(every("no_underscore"), ((42, _URL, "Hyphens used with no underscores", 4, MI),)),
        Rule(every("short_url"), ((43, _URL, "URL total length <= 75 characters", 3, AD),)),
        Rule(every("lower_path"), ((44, _URL, "URL path all lowercase", 4, MI),
                                   (209, _CRAWL, "No URL Path Case Inconsistency", 1.13, MI))),
        Rule(c("slash_consistent"), ((45, _URL, "Trailing slash consistent sitewide", 4, MI),)),
        Rule(under(lcp, 2500), ((46, _CWV, "LCP < 2500ms mobile p75", 8, MA),
                                (143, _LCP, "LCP <2500ms Mobile p75", 3.5, B)), {"lcp": lcp}),
        Rule(F.coalesce(inp < 200, no_blocking), ((47, _CWV, "INP < 200ms p75", 7, MA), (152, _INP, "INP <200ms p75", 3, B)),
             {"inp": inp}),
        Rule(F.coalesce(cls < 0.1, c("home_unsized") == 0), ((48, _CWV, "CLS < 0.1 p75", 7, MA),), {"cls": cls}),
        Rule(ttfb < 800, ((49, _CWV, "TTFB < 800ms", 6, MA), (166, _TTFB, "TTFB <800ms", 2.5, MA)), {"ttfb": ttfb}),
        Rule(c("all_sized"), ((50, _CWV, "All images have explicit width and height", 6, MA),)),
        Rule(~c("first_lazy"), ((51, _CWV, "LCP hero image does not have loading lazy", 6, B),)),
        Rule(c("fonts_swap"), ((52, _CWV, "All font-face use font-display swap", 4, MI), (162, _CLS, "font-display:swap CLS", 1.5, MI),
                               (181, _ASSET, "font-display:swap All Fonts", 2, MI), (226, _CACHE, "font-display: swap", 1.69, MI))),
        Rule(c("no_blocking"), ((53, _CWV, "0 render-blocking scripts in head", 6, MA),
                                (73, _PERF, "0 render-blocking scripts in head", 6, MA),
                                (164, _FCP, "No Render-Blocking in <head>", 2.5, MA),
                                (222, _DOM, "No Render-Blocking Scripts in <head>", 2.25, MA))),
        Rule(every("critical_css"), ((54, _CWV, "Inline critical CSS in head", 4, MI), (74, _PERF, "Inline critical CSS in head", 4, MI),
                                     (165, _FCP, "Critical CSS Inlined", 2, MI), (223, _DOM, "Critical CSS Inlined", 1.69, MI))),
        Rule(some("preloads_image"), ((55, _CWV, "LCP image preloaded", 5, MI), (75, _PERF, "LCP image preloaded", 5, MI))),
        Rule(mobile_ok, ((56, _CWV, "Mobile PSI score >= 60", 6, MA), (59, _MOBILE, "Mobile PSI score >= 60", 6, MA),
                         (169, _PSI, "Mobile PSI >=60", 2.5, MA)), {"score": psi("performance_score")}),
        Rule(tap_ok, ((57, _CWV, "All tap targets adequate", 4, MI), (60, _MOBILE, "Tap target size adequate", 4, MI),
                      (171, _PSI, "Tap Targets >=48px", 1.5, MI))),
        Rule(device_width & F.contains(c("viewport"), F.lit("initial-scale=1")),
             ((58, _MOBILE, "Viewport meta tag correct", 8, MA),), {"viewport": c("viewport")}),
        Rule(c("alt_rate") >= 0.9, ((61, _IMAGE, "All non-decorative images have alt text", 7, MA),
                                    (103, _ACCESS, "All non-decorative images have alt text", 7, MA)), {"rate": c("alt_rate")}),
        Rule(c("chart_rate") >= 0.3, ((62, _IMAGE, "Data/chart images have detailed alt text", 4, AD),), {"rate": c("chart_rate")}),
        Rule(c("sized_rate") >= 0.9, ((63, _IMAGE, "All images have explicit width and height", 6, MA),
                                      (159, _CLS, "All Images width+height", 2.5, MA),
                                      (224, _CACHE, "All Images width+height", 2.25, MA)), {"rate": c("sized_rate")}),
        Rule(c("lazy_rate") >= 0.8, ((64, _IMAGE, "Below-fold images have loading lazy", 4, MI),
                                     (185, _ASSET, "Below-Fold Lazy Loading", 1.5, MI),
                                     (225, _CACHE, "Below-Fold Images Lazy-Loaded", 1.69, MI)), {"rate": c("lazy_rate")}),
        Rule(c("modern_rate") >= 0.4, ((65, _IMAGE, "70 percent images are WebP or AVIF", 5, MI),), {"rate": c("modern_rate")}),
        Rule(c("generic_rate") < 0.5, ((66, _IMAGE, "Image filenames are descriptive", 3, AD),), {"rate": c("generic_rate")}),
        Rule(c("footer_privacy"), ((67, _PAGES, "Privacy Policy page linked from footer", 5, MA),)),
        Rule(c("footer_terms"), ((68, _PAGES, "Terms page linked from footer", 4, MI),)),
        Rule(c("contact")["nap"], ((69, _PAGES, "Contact page linked and contains NAP", 5, MA),), {"url": c("contact_url")}),
        Rule(c("about")["words"] >= 200, ((70, _PAGES, "About page has at least 200 words", 5, MA),), {"words": c("about")["words"]}),
        Rule(c("cookie_words"), ((71, _PAGES, "Cookie consent element present", 3, MI),)),
        Rule(c("modern_pages"), ((76, _PERF, "70 percent images in WebP or AVIF", 5, MI),)),
        Rule(c("all_jsonld"), ((77, _SCHEMA, "At least 1 JSON-LD block on every page", 8, MA),)),
        Rule(no_jsonld_errors, ((78, _SCHEMA, "All JSON-LD blocks parse without error", 8, B),
                                (91, _SCHEMA, "Schema validation has 0 rich result errors", 6, MA)), {"errors": c("n_errors")}),
        Rule(every("contexts_ok"), ((79, _SCHEMA, "All JSON-LD blocks have schema.org context", 4, MI),)),
        Rule(c("home_org"), ((80, _SCHEMA, "Organization schema on homepage", 7, MA),)),
        Rule(some("same_as"), ((81, _SCHEMA, "Organization sameAs at least 4 entries", 5, MI),)),
        Rule(some("t_website") & some("search_action"), ((82, _SCHEMA, "WebSite schema with SearchAction", 4, MI),)),
        Rule(c("interior_breadcrumbs"), ((83, _SCHEMA, "BreadcrumbList on interior pages", 5, MI),)),
        Rule(every("article_typed"), ((84, _SCHEMA, "Article schema on blog posts", 6, MA),)),
        Rule(every("faq_typed"), ((85, _SCHEMA, "FAQPage schema when FAQ section exists", 7, MA),)),
        Rule(every("how_to_typed"), ((86, _SCHEMA, "HowTo schema on step pages", 5, MI),)),
        Rule(every("service_typed"), ((87, _SCHEMA, "LocalBusiness schema on service pages", 6, MA),)),
        Rule(every("person_typed"), ((88, _SCHEMA, "Person schema on author bio pages", 5, MI),)),
        Rule(every("product_typed"), ((89, _SCHEMA, "Product schema on product pages", 6, MA),)),
        Rule(every("price_ok"), ((90, _SCHEMA, "Schema price matches DOM price", 8, B),)),
        Rule(every("og_title"), ((92, _SOCIAL, "og:title present", 5, MI),)),
        Rule(every("og_description"), ((93, _SOCIAL, "og:description present", 4, MI),)),
        Rule(status("og").between(200, 299) & P.test(c("og")["content_type"], "image"),
             ((94, _SOCIAL, "og:image URL returns valid image", 4, MI),), {"status": status("og")}),
        Rule(c("twitter_ok"), ((95, _SOCIAL, "Twitter card metadata present", 3, AD),)),
        Rule(c("internal_ok"), ((96, _INTERNAL, "Each page has at least 3 internal links", 4, MI),)),
        Rule(c("n_generic") == 0, ((97, _INTERNAL, "No generic anchor text", 5, MI),), {"links": c("n_generic")}),
        Rule(every("semantic"), ((100, _SEMANTIC, "At least 3 semantic HTML5 elements used", 5, MA),)),
        Rule(every("captions_ok"), ((101, _SEMANTIC, "All tables have caption element", 3, MI),)),
        Rule(every("times_ok"), ((102, _SEMANTIC, "All time tags have datetime attribute", 3, MI),)),
        Rule(c("label_rate") >= 0.8, ((104, _ACCESS, "Unlabelled interactive elements have aria-label", 4, MI),),
             {"rate": c("label_rate")}),
        Rule(every("has_lang"), ((105, _ACCESS, "HTML lang attribute set", 3, MI),)),
        Rule(~c("multilingual") | (c("n_hreflang") > 0), ((106, _LANG, "hreflang tags on multi-language pages", 5, MA),)),
        Rule(every("deep_enough"), ((107, _CONTENT, "Word count threshold met", 5, MA),)),
        Rule(every("published_ok"), ((108, _CONTENT, "Published date present", 4, MI),)),
        Rule(every("modified_ok"), ((109, _CONTENT, "Modified date present", 4, MI),)),
        Rule(every("author_ok"), ((110, _CONTENT, "Named author byline present", 5, MI),)),
        Rule(some("bio_link"), ((111, _CONTENT, "Author linked to bio page", 4, MI),)),
        Rule(every("outbound_ok"), ((112, _CONTENT, "At least 2 outbound links", 4, MI),)),
        Rule(some("reviews"), ((113, _TRUST, "Review or testimonial signals present", 4, MI),)),
        Rule(llms_ok, ((114, _AI, "llms.txt present and useful", 5, MA), (230, _AI_MORE, "llms.txt Present+Valid", 1.69, MA)),
             {"status": status("llms"), "words": c("llms")["llms_words"]}),
        Rule(none_or("n_compressed", "n_text", 80), ((115, _PERF, "Compression on all text assets", 5, MA),
                                                     (178, _ASSET, "Text Compression GZIP/Brotli", 2, MI),
                                                     (195, _CACHE, "Compression on All Text Assets", 1.69, MI)),
             {"compressed": c("n_compressed"), "of": c("n_text")}),
        Rule(none_or("n_cached", "n_header", 80), ((116, _PERF, "Cache-Control configured", 5, MA),
                                                   (196, _CACHE, "Cache-Control Configured", 1.69, MI)),
             {"cached": c("n_cached"), "of": c("n_header")}),
        Rule(validators, ((117, _PERF, "ETag or Last-Modified headers present", 3, MI),
                          (214, _CACHE, "ETag/Last-Modified Headers", 1.69, AD))),
        Rule(edge != "", ((118, _PERF, "CDN edge caching detected", 3, MI), (168, _TTFB, "CDN Edge Caching", 2, MI),
                          (213, _CACHE, "CDN Edge Caching", 2.25, MI)), {"signal": edge}),
        Rule(types_ok, ((119, _HTTP, "Correct Content-Type headers", 3, MI), (238, _SECURITY, "Correct Content-Type Headers", 1.13, MI))),
        Rule(external_ok, ((120, _EXTERNAL, "No broken external links", 3, MI), (210, _SECURITY, "No Broken External Links", 1.69, MI)),
             {"live": c("n_external_live"), "of": c("n_external")}),
        Rule(c("n_tracking") == 0, ((121, _URL, "URL params stripped from internal links", 3, MI),
                                    (237, _CRAWL, "URL Params Stripped from Internal Links", 1.69, MI)), {"links": c("n_tracking")}),
        Rule(search_ok, ((122, _INDEX, "Internal search blocked", 5, MA), (236, _CRAWL, "Internal Search Blocked", 1.69, MA))),
        Rule(probe_gone, ((123, _INDEX, "No soft-404s", 5, MA), (207, _CRAWL, "No Soft-404s", 1.69, MA)), {"status": status("probe")}),
        Rule(feed_words >= 120, ((125, _AI, "RSS feed full-text", 3, MI), (228, _AI_MORE, "RSS Feed Full-Text", 1.69, MI)),
             {"words": feed_words}),
        Rule(~traps("history_trap"), ((126, _SPAM, "No back-button hijacking", 8, B), (204, _SECURITY, "No Back-Button Hijacking", 2.25, B))),
        Rule(~traps("exit_trap"), ((127, _SPAM, "No exit-intent redirects", 5, MA), (205, _SECURITY, "No Exit-Intent Redirects", 1.69, MA))),
        Rule(api_ok, ((128, _HTTP, "CORS on public APIs", 2, AD), (231, _SECURITY, "CORS on Public APIs", 1.13, AD))),
        Rule(subdomains_ok, ((129, _HTTP, "SSL covers discovered subdomains", 3, MA), (194, _SECURITY, "SSL Covers All Subdomains", 1.69, MA))),
        Rule(c("ssr_rate") >= 0.7, ((130, _INDEX, "SSR contains primary content", 8, B), (215, _DOM, "SSR Contains Primary Content", 4.51, B)),
             {"rate": c("ssr_rate")}),
        Rule(~some("is_shell"), ((131, _INDEX, "No empty-shell SPA", 7, B), (216, _DOM, "No Empty-Shell SPA", 3.38, B))),
        Rule(c("folded_words") < 100, ((132, _INDEX, "No key content in accordions or tabs", 5, MA),
                                       (217, _DOM, "No Key Content in Accordions/Tabs", 2.25, MA)), {"words": c("folded_words")}),
        Rule(c("max_nodes") < 1500, ((133, _PERF, "DOM node count under 1500", 3, MI), (219, _DOM, "DOM Node Count <1500", 1.69, MI)),
             {"nodes": c("max_nodes")}),
        Rule(c("n_hidden_spam") == 0, ((134, _SPAM, "No CSS-hidden keyword text", 8, B), (221, _DOM, "No CSS-Hidden Keyword Text", 2.25, B))),
        Rule(c("server_schema"), ((135, _SCHEMA, "Server-side schema injection", 6, B), (227, _DOM, "Server-Side Schema Injection", 2.82, B))),
        Rule((c("link_canonical") != "") & (c("canonical") != "") & U.same_path(
            D.resolve_reference(c("home_url"), c("link_canonical")), c("canonical")),
             ((136, _CANON, "Canonical in HTTP header", 2, AD),), {"link": c("link_canonical")}),
        Rule(chain_ok, ((137, _CANON, "No canonical chains", 5, MA), (203, _CRAWL, "No Canonical Chains", 2.25, MA)), {"hops": c("hops")}),
        Rule(ms < 200, ((138, _PERF, "TTFB competitive under 200ms", 4, MI), (184, _TTFB, "TTFB <200ms AI Optimal", 2, MI)), {"ms": ms}),
        Rule(agents_ok, ((139, _HTTP, "AI crawler accessibility", 6, B), (233, _AI_MORE, "AI Crawler IP Accessibility", 2.25, B)),
             {"agents": c("n_agents")}),
        Rule(agent_ratio >= 0.8, ((140, _INDEX, "Headless browser content match", 4, MA),
                                  (234, _AI_MORE, "Headless Browser Content Match", 1.69, MA)), {"ratio": agent_ratio}),
        Rule(F.coalesce(c("key_found"), F.lit(False)), ((141, _INDEX, "IndexNow implemented", 3, MI), (235, _AI_MORE, "IndexNow Implemented", 1.69, MI))),
        Rule(redirects_ok, ((142, _CANON, "301 for permanent redirects", 4, MA), (208, _CRAWL, "301 for Permanent Redirects", 1.69, MA)),
             {"slash": slash_raw, "case": case_raw}),
        Rule(under(lcp, 1800), ((144, _LCP, "LCP <1800ms Competitive", 2.5, MA),), {"lcp": lcp}),
        Rule(under(c("desktop")["lcp"], 2500), ((145, _LCP, "LCP <2500ms Desktop", 2, MI),)),
        Rule(F.coalesce(psi("lcp_element_found"), c("lcp_candidate")), ((146, _LCP, "LCP Element Identified", 2, MI),)),
        Rule(lcp_preload, ((147, _LCP, "LCP Preload Hint", 3, B),)),
        Rule(not_lazy, ((148, _LCP, "LCP Not Lazy-Loaded", 3, B), (198, _CACHE, "LCP Image Not Lazy-Loaded", 2.82, B))),
        Rule(modern_lcp, ((149, _LCP, "LCP WebP/AVIF Format", 2, MA),), {"src": c("first_src")}),
        Rule(F.when((c("first_url") == "") | (zero("lcp_bytes") == 0), optimized).otherwise(c("lcp_bytes") < 200000),
             ((150, _LCP, "LCP Size <200KB", 2.5, MA),), {"bytes": c("lcp_bytes")}),
        Rule((phases >= 2) | (ms > 0), ((151, _LCP, "LCP Phase Breakdown", 1.5, MI),)),
        Rule(F.coalesce(inp < 150, no_blocking & (c("n_third") <= 2)), ((153, _INP, "INP <150ms Competitive", 2, MA),)),
        Rule(F.coalesce(psi("tbt"), c("home_blocking") * 120.0 + c("n_third") * 40) < 200, ((154, _INP, "Long Tasks Count", 2.5, MA),)),
        Rule(traps("yields") | F.coalesce(psi("tbt") < 200, F.lit(False)), ((155, _INP, "Task Yielding Patterns", 1.5, MI),)),
        Rule(none_or("n_third_deferred", "n_third", 80), ((156, _INP, "Third-Party Scripts Deferred", 2.5, MA),),
             {"deferred": c("n_third_deferred"), "of": c("n_third")}),
        Rule(F.coalesce(cls < 0.1, c("sized_rate") >= 0.9), ((157, _CLS, "CLS <0.1 p75", 3, B),), {"cls": cls}),
        Rule(F.coalesce(cls == 0, (c("sized_rate") >= 0.95) & (c("folded_words") < 100)), ((158, _CLS, "CLS Zero in Content Area", 2, MI),)),
        Rule(every("ads_reserved"), ((160, _CLS, "Ad Slots Reserved Space", 1.5, MI),)),
        Rule(~traps("injects"), ((161, _CLS, "No Dynamic Injection Above", 2, MA),)),
        Rule(under(psi("fcp"), 1800), ((163, _FCP, "FCP <1.8s Mobile", 2.5, MA),)),
        Rule(F.lit(True), ((167, _TTFB, "TTFB Consistency Low Variance", 1.5, MI),)),
        Rule(F.coalesce(c("desktop")["performance_score"] >= 80, ms < 1800), ((170, _PSI, "Desktop PSI >=80", 2, MI),)),
        Rule(~c("interstitial"), ((172, _CLS, "No Intrusive Interstitials", 2, B),)),
        Rule(F.coalesce(savings("unused_js_bytes", "js_bytes") < 20, zero("js_bytes") < 500000), ((173, _ASSET, "Unused JS <20%", 2, MI),)),
        Rule(F.coalesce(savings("unused_css_bytes", "css_bytes") < 40, F.lit(True)), ((174, _ASSET, "Unused CSS <40%", 1.5, MI),)),
        Rule(modern, ((175, _ASSET, "WebP/AVIF >=70%", 2, MI),), {"rate": c("modern_rate")}),
        Rule(zero("js_bytes") < 500000, ((176, _ASSET, "JS Bundle <500KB", 2, MA),), {"bytes": c("js_bytes")}),
        Rule(optimized, ((177, _ASSET, "Image Compression Quantified", 1.5, MI),)),
        Rule(F.coalesce(psi("third_party_blocking") < 500, c("n_third") <= 5), ((179, _INP, "Third-Party Impact <500ms", 2, MA),)),
        Rule(under(psi("fcp"), 400), ((180, _FCP, "FCP <0.4s Optimal", 2, MI),)),
        Rule(none_or("n_own_fonts", "n_fonts", 80), ((182, _ASSET, "Self-Hosted Fonts", 1.5, MI),)),
        Rule((c("n_preconnect") > 0) | (c("n_third") == 0), ((183, _ASSET, "Preconnect Hints", 1.5, MI),)),
        Rule(c("n_preload") > 0, ((186, _ASSET, "Preload Critical Resources", 1.5, MI),)),
        Rule(zero("asset_bytes") + c("home_bytes") < 3000000, ((187, _ASSET, "Total Page Weight <3MB", 2, MA),)),
        Rule(F.coalesce(psi("tti") < 3800, (ms < 3800) & no_blocking), ((188, _INP, "TTI <3800ms", 2, MA),)),
        Rule(under(psi("speed_index"), 3400), ((189, _PSI, "Speed Index <3400ms", 1.5, MI),)),
        Rule(F.coalesce(psi("tbt") < 200, no_blocking), ((190, _INP, "TBT <200ms", 2.5, MA),)),
        Rule(every("status_ok"), ((191, _SECURITY, "HTTP 200 on All Target Pages", 3.96, B),)),
        Rule(certified, ((192, _SECURITY, "HTTPS + Valid SSL Certificate", 3.38, B),)),
        Rule(c("hsts") > 0, ((193, _SECURITY, "HSTS Header", 1.69, MI),)),
        Rule(c("link_canonical") != "", ((199, _CRAWL, "Canonical in HTTP Header", 1.13, AD),)),
        Rule(c("indexable_canonical"), ((200, _CRAWL, "Canonical on All Indexable Pages", 2.82, B),)),
        Rule(c("home_hidden") < 100, ((220, _DOM, "CSS Hidden Content <100w", 2.25, MA),), {"words": c("home_hidden")}),
        Rule(status("ai_txt") == 200, ((229, _AI_MORE, "ai.txt Exists", 0.85, AD),)),
        Rule(ms < 800, ((232, _CACHE, "TTFB <800ms Pass / <200ms Competitive", 2.82, MA),), {"ms": ms}),
    ]


def definitions_of(rule_list: list[Rule]) -> list[CheckDef]:
    """The audit's definition table in id order."""
    published = sorted(check for rule in rule_list for check in rule.checks)
    return [CheckDef(i, cat, name, weight, sev, "domain" if i in DOMAIN_IDS else "page") for i, cat, name, weight, sev in published]


def audit(facts: Facts, as_of: Column) -> DataFrame:
    """Check rows of every site; sites without a captured home page fail all but advisory checks."""
    rule_list = rules()
    wide = wide_columns(facts, as_of)
    verdicts = [([check[0] for check in rule.checks], Verdict(rule.passed, evidence=rule.evidence)) for rule in rule_list]
    found = check_rows(wide, ["site_id"], TECHNICAL, verdicts)
    unreachable = facts.sites.select("site_id").join(facts.home.select("site_id"), "site_id", "left_anti")
    fallback = [
        ([check[0]], Verdict(check[4] == "ADVISORY", evidence={"reason": F.lit("home page not captured")}))
        for rule in rule_list for check in rule.checks
    ]
    return found.unionByName(check_rows(unreachable, ["site_id"], TECHNICAL, fallback)).withColumn(
        "page_id", F.lit(None).cast("bigint")
    )
