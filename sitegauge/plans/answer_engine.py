"""Answer-engine audit: 61 checks on the pages of a site, its files and its bot answers."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dom as D
from ..functions import headers as H
from ..functions import jsonld as J
from ..functions import patterns as P
from ..functions import robots as R
from ..functions import text as T
from ..functions import urls as U
from ..functions.numbers import half_up, rate
from ..operators import phrases
from ..operators.links import answer, by_role, wanted_rows
from ..operators.parse import parse_pages
from ..operators.ranking import last_wins
from ..operators.scoring import ANSWER, ANSWER_CATEGORY_WEIGHTS
from ..sources.captures import WELL_KNOWN, one_per_url, one_row
from .facts import Facts
from .rules import CheckDef, Verdict, check_rows

# Id, category, name, severity, scope. The score weighs categories, not checks.
DEFS = [
    CheckDef(1, "AI Bot Access", "GPTBot allowed", 1, "BLOCKER", "domain"),
    CheckDef(2, "AI Bot Access", "ClaudeBot allowed", 1, "BLOCKER", "domain"),
    CheckDef(3, "AI Bot Access", "PerplexityBot allowed", 1, "BLOCKER", "domain"),
    CheckDef(4, "AI Bot Access", "Google-Extended allowed", 1, "BLOCKER", "domain"),
    CheckDef(5, "AI Bot Access", "OAI-SearchBot allowed", 1, "BLOCKER", "domain"),
    CheckDef(6, "AI Bot Access", "Grok allowed", 1, "BLOCKER", "domain"),
    CheckDef(7, "AI Bot Access", "DeepSeek allowed", 1, "BLOCKER", "domain"),
    CheckDef(8, "AI Discovery Files", "llms.txt Exists", 1, "MAJOR", "domain"),
    CheckDef(9, "AI Discovery Files", "llms.txt Plain Markdown", 1, "MAJOR", "domain"),
    CheckDef(10, "AI Readiness", "llms.txt word count", 1, "MAJOR", "domain"),
    CheckDef(11, "AI Readiness", "llms.txt content completeness", 1, "MAJOR", "domain"),
    CheckDef(12, "Entity & Trust Signals", "Organization sameAs depth", 1, "MAJOR", "domain"),
    CheckDef(13, "Entity & Trust Signals", "LinkedIn present in sameAs", 1, "MAJOR", "domain"),
    CheckDef(14, "Entity & Trust Signals", "Crunchbase or Wikidata present", 1, "MAJOR", "domain"),
    CheckDef(15, "Entity & Trust Signals", "NAP schema-DOM match", 1, "BLOCKER", "domain"),
    CheckDef(16, "Entity & Trust Signals", "Schema-DOM consistency", 1, "BLOCKER", "page"),
    CheckDef(17, "FAQ & Answer Optimization", "FAQ section exists", 1, "MAJOR", "page"),
    CheckDef(18, "FAQ & Answer Optimization", "FAQPage schema exists", 1, "MAJOR", "page"),
    CheckDef(19, "FAQ & Answer Optimization", "FAQ schema completeness", 1, "MAJOR", "page"),
    CheckDef(20, "FAQ & Answer Optimization", "BLUF detection", 1, "MAJOR", "page"),
    CheckDef(21, "FAQ & Answer Optimization", "Question-based content structure", 1, "MAJOR", "page"),
    CheckDef(22, "Content Authority", "Author byline quality", 1, "MINOR", "page"),
    CheckDef(23, "Content Authority", "Author bio quality", 1, "MINOR", "page"),
    CheckDef(24, "Content Authority", "Credentials/certifications", 1, "MINOR", "page"),
    CheckDef(25, "Content Authority", "First-hand experience language", 1, "MINOR", "page"),
    CheckDef(26, "Content Authority", "Last updated visible", 1, "MINOR", "page"),
    CheckDef(27, "Content Authority", "Outbound authority links", 1, "MINOR", "page"),
    CheckDef(28, "Local GEO Signals", "Local entity schema", 1, "MAJOR", "domain"),
    CheckDef(29, "Local GEO Signals", "geo.latitude", 1, "MAJOR", "domain"),
    CheckDef(30, "Local GEO Signals", "geo.longitude", 1, "MAJOR", "domain"),
    CheckDef(31, "Local GEO Signals", "areaServed", 1, "MAJOR", "domain"),
    CheckDef(32, "AI Crawlability", "JS-rendered content available in raw HTML", 1, "BLOCKER", "page"),
    CheckDef(33, "AI Crawlability", "Hidden content under threshold", 1, "MAJOR", "page"),
    CheckDef(34, "AI Crawlability", "Data point density", 1, "MAJOR", "page"),
    CheckDef(35, "Structured Data Integrity", "FAQ schema-DOM match", 1, "BLOCKER", "page"),
    CheckDef(36, "Structured Data Integrity", "Product schema-DOM match", 1, "BLOCKER", "page"),
    CheckDef(37, "Structured Data Integrity", "Schema consistency validation", 1, "BLOCKER", "page"),
    CheckDef(38, "Crawlability", "OAI-SearchBot allowed", 1, "BLOCKER", "domain"),
    CheckDef(39, "Crawlability", "ChatGPT-User allowed", 1, "BLOCKER", "domain"),
    CheckDef(40, "Crawlability", "GPTBot rules do not block OAI agents", 1, "MAJOR", "domain"),
    CheckDef(41, "Crawlability", "WAF not challenging OAI agents", 1, "BLOCKER", "domain"),
    CheckDef(42, "Technical Access", "No paywall on citable content", 1, "MAJOR", "page"),
    CheckDef(49, "Content Structure", "Alternatives page detection", 1, "MINOR", "domain"),
    CheckDef(50, "Content Structure", "Use-case page detection", 1, "MINOR", "domain"),
    CheckDef(52, "Content Quality", "Product schema completeness", 1, "MAJOR", "page"),
    CheckDef(54, "Content Quality", "Review diversity check", 1, "MINOR", "domain"),
    CheckDef(55, "Content Quality", "Merchant trust pages", 1, "MAJOR", "domain"),
    CheckDef(65, "Technical Access", "No nosnippet restrictions", 1, "BLOCKER", "page"),
    CheckDef(66, "Crawlability", "SSR for OAI-SearchBot", 1, "BLOCKER", "page"),
    CheckDef(67, "Gemini Crawlability", "Google-Extended allowed", 1, "BLOCKER", "domain"),
    CheckDef(68, "Gemini Crawlability", "WAF not blocking Google-Extended", 1, "BLOCKER", "domain"),
    CheckDef(69, "Gemini Crawlability", "IP range accessible", 1, "BLOCKER", "domain"),
    CheckDef(70, "Local & E-Commerce", "NAP matches GBP consistently", 1, "BLOCKER", "domain"),
    CheckDef(71, "Gemini Crawlability", "Cookie consent not blocking DOM", 1, "BLOCKER", "page"),
    CheckDef(72, "Schema & Technical", "Server-side schema injection", 1, "BLOCKER", "page"),
    CheckDef(73, "Robots & Bot Access", "GoogleOther allowed", 1, "MAJOR", "domain"),
    CheckDef(74, "Schema & Technical", "Speakable schema presence", 1, "MINOR", "page"),
    CheckDef(75, "Media & Visuals", "Stock photo detection", 1, "MINOR", "page"),
    CheckDef(76, "Media & Visuals", "OCR legibility", 1, "MINOR", "page"),
    CheckDef(77, "Schema & Technical", "VideoObject schema", 1, "MINOR", "page"),
    CheckDef(78, "Media & Visuals", "Transcript-HTML alignment", 1, "MAJOR", "page"),
]
CATEGORY_ORDER = tuple(name for name, _ in ANSWER_CATEGORY_WEIGHTS)
# Robots.txt bots per check, agents of the log.
BOTS = (
    (1, "GPTBot"), (2, "ClaudeBot"), (3, "PerplexityBot"), (4, "Google-Extended"), (5, "OAI-SearchBot"), (6, "Grok"),
    (7, "DeepSeek"), (38, "OAI-SearchBot"), (39, "ChatGPT-User"), (67, "Google-Extended"), (73, "GoogleOther"),
)
OAI_AGENT, GOOGLE_AGENT = "OAI-SearchBot/1.0", "Google-Extended"
BROWSER_AGENT = (
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/125.0 Safari/537.36"
)
# Trust-page types and the words that mark a candidate.
TRUST_TYPES = (
    ("Privacy/Terms", r"\b(policies privacy policy|policies terms of service|policies legal|privacy|privacy policy|terms|"
                      r"terms of service|terms and conditions|tnc|t and c|legal|disclaimer|cookie policy)\b"),
    ("Refund/Returns", r"\b(policies refund policy|policies return policy|policies cancellation policy|refund|"
                       r"refund policy|cancellation|cancellation policy|return|returns|return policy|money back)\b"),
    ("Shipping/Delivery", r"\b(policies shipping policy|policies delivery policy|shipping|shipping policy|delivery|"
                          r"delivery policy|fulfillment)\b"),
    ("Contact/Support", r"\b(pages contact|contact|contact us|support|help|helpdesk|grievance|reach us|get in touch)\b"),
)
TRUST_WORDS = (
    r"\b(privacy|terms?|tnc|legal|disclaimer|cookie|refund|returns?|cancellation|money back|shipping|delivery|"
    r"fulfillment|contact|support|helpdesk|grievance|reach|get in touch)\b"
)
# Address and text patterns of comparison and use-case pages.
ALTERNATIVE_URL = (
    r"/(?:alternatives?|alternative-to|vs|compare|comparison)(?:/|$)|/[^/?#]+-(?:alternative|alternatives)(?:/|$)|"
    r"/[^/?#]+-vs-[^/?#]+(?:/|$)|/best-[^/?#]+(?:/|$)|/[^/?#]+-alternatives?(?:/|$)"
)
ALTERNATIVE_TEXT = r"\b(vs|versus|alternative|alternatives|compare|comparison|instead of|switch from)\b"
ALTERNATIVE_BLOG = r"/(?:blog|articles?|resources?|posts?)/[^?#]*(?:\bvs\b|compare)"
USE_CASE_URL = (
    r"/(?:for-[^/?#]+|use-cases?|solutions?)(?:/|$)|/personal-loan-for-[^/?#]+|/(?:salaried|freelancers?|self-employed|"
    r"medical|travel|home-renovation|education|wedding|business|professionals?)(?:/|$)"
)
USE_CASE_TEXT = (
    r"\b(personal loan for (?:medical expenses?|travel|home renovation|education|wedding|business)|loans? for "
    r"(?:freelancers?|salaried professionals?|self-employed|medical|travel|home renovation|education|wedding|business)|"
    r"for (?:medical expenses?|travel|home renovation|freelancers?|salaried professionals?|self-employed))\b"
)
LOCAL_TYPE = (
    "LocalBusiness|MedicalBusiness|ProfessionalService|HealthAndBeautyBusiness|BeautySalon|MedicalClinic|Dermatology|"
    "Dentist|Physician"
)
_PHONE = r"(\+91[\s-]?)?[6-9]\d{9}|1800[\s-]?\d{3}[\s-]?\d{4}"
_ADDRESS = (
    r"\b(?:street|road|nagar|mumbai|delhi|bangalore|bengaluru|floor|building|plot|sector|phase)\b.{0,140}"
)


def alternatives_score(urls: Column, page_texts: Column) -> Column:
    """10 for a strong sign of a comparison page, 5 for a blog hint, else 0."""
    strong = F.exists(urls, lambda u: P.test(u, ALTERNATIVE_URL) | P.test(U.path_words(u), ALTERNATIVE_TEXT)) | F.exists(
        page_texts, lambda t: P.test(t, ALTERNATIVE_TEXT)
    )
    return F.when(strong, 10).when(F.exists(urls, lambda u: P.test(u, ALTERNATIVE_BLOG)), 5).otherwise(0)


def is_use_case(url: Column, words: Column) -> Column:
    return P.test(url, USE_CASE_URL) | P.test(words, USE_CASE_TEXT)


def trust_types(text: Column) -> Column:
    """Trust-page types a candidate text shows."""
    return F.filter(
        F.array(*[F.when(P.test(text, pattern), F.lit(name)) for name, pattern in TRUST_TYPES]), lambda t: t.isNotNull()
    )


def trust_text(url: Column, *parts: Column) -> Column:
    where = F.coalesce(F.try_url_decode(F.concat_ws(" ", U.path(url), F.concat(F.lit("?"), U.query(url)))), url)
    return F.regexp_replace(F.concat_ws(" ", F.when(U.is_url(url), where).otherwise(url), *parts), "[_-]+", " ")


def trust_score(types: Column) -> Column:
    """C8."""
    n = F.size(types)
    return F.when(n == len(TRUST_TYPES), 10).when(n >= 2, 6).otherwise(0)


def _source_name(source: Column, primary: Column) -> Column:
    return (
        F.when(primary | (source == "homepage"), "homepage").when(source == "sitemap", "sitemap page")
        .otherwise("internal page")
    )


def page_columns(pages: DataFrame) -> DataFrame:
    """Facts of one page; ``is_site`` tells crawled pages from the extra local ones."""
    c = F.col
    body = T.collapse(c("body_text"))
    site = U.bare_host(c("final_url"))
    every = D.every_element()
    faq = lambda e: (e["tag"] == "details") | F.contains(D.attr_or(e, "class"), F.lit("faq")) | F.contains(
        D.attr_or(e, "id"), F.lit("faq")
    )
    questions = F.filter(c("headings"), lambda h: h["tag"].isin("h2", "h3") & P.test(h["text"], T.QUESTION_WORDS))
    images = D.sourced_images()
    h12 = D.joined(F.filter(c("headings"), lambda h: h["tag"].isin("h1", "h2")), "")
    map_signals = D.map_signals()
    raw = c("body_text")
    footer = T.collapse(F.substring(raw, F.floor(F.length(raw) * 0.7).cast("int") + 1, F.length(raw)))
    contact = T.collapse(D.joined(F.filter(
        c("nodes"), lambda e: P.test(D.attr(e, "class"), "contact|address|phone|email|location|office", "")), ""))
    business = J.first(F.filter(J.objects(), lambda r: J.any_type(
        J.graph_types(r), "LocalBusiness|Organization|Store|Corporation", "i")))
    nap_text = F.concat_ws(" ", contact, footer, body)
    meta_text = F.array_join(F.transform(c("metas"), lambda m: D.attr_or(m, "content")), " ")
    site_name = D.attr(D.first(c("metas"), lambda m: D.attr(m, "property") == "og:site_name"), "content")
    first_text = lambda *keys: F.coalesce(
        *[F.when(T.trim_blank(J.scalar(c("business"), k)) != "", T.trim_blank(J.scalar(c("business"), k))) for k in keys], F.lit("")
    )
    parts = F.array(*[
        F.coalesce(J.scalar(J.get(c("business"), "address"), k), F.lit(""))
        for k in ("streetAddress", "addressLocality", "addressRegion", "postalCode")
    ])
    address = F.coalesce(J.string_of(J.get(c("business"), "address")), F.array_join(F.filter(parts, lambda p: p != ""), ", "))
    squeeze = lambda value: F.regexp_replace(F.lower(value), "[^a-z0-9]+", "")
    first = pages.select("*", business.alias("business"), nap_text.alias("nap_text"), meta_text.alias("meta_text"),
                         site_name.alias("site_name"))
    phone = F.coalesce(
        F.when(first_text("telephone", "phone") != "", first_text("telephone", "phone")),
        F.when(P.find(c("nap_text"), _PHONE, 0) != "", P.find(c("nap_text"), _PHONE, 0)), P.find(c("meta_text"), _PHONE, 0),
    )
    name = F.when(c("business").isNotNull(), first_text("name", "legalName")).otherwise(
        F.coalesce(c("site_name"), T.trim_blank(c("title")))
    )
    return first.select(
        "site_id", "ord", "is_site", "source", F.col("final_url").alias("url"), "ld",
        body.alias("body"),
        F.concat_ws(" ", c("final_url"), c("title"), h12).alias("search_text"),
        D.n(every, faq).alias("n_faq"), F.size(questions).alias("n_question_heads"),
        F.size(D.outbound_links(site)).alias("n_outbound"),
        D.hidden_words_aria().alias("hidden_words"),
        c("first_p"),
        D.any_of(c("anchors"), lambda a: P.test(D.attr(a, "href"), "/author/|/team/|/about", "")).alias("bio_link"),
        D.any_of(every, lambda e: D.has(e, "data-nosnippet")).alias("data_nosnippet"),
        F.size(images).alias("n_images"),
        D.n(images, lambda p: F.length(T.trim_blank(p["alt"])) > 10).alias("n_alt"),
        D.n(images, lambda p: P.test(p["src"], D.STOCK_HOSTS)).alias("n_stock"),
        D.video_count().alias("n_videos"),
        D.transcript_text().alias("transcript"),
        (F.size(D.local_nodes()) > 0).alias("md_entity"),
        D.local_property("latitude").alias("md_latitude"), D.local_property("longitude").alias("md_longitude"),
        D.local_property("areaServed", "serviceArea").alias("md_area"),
        D.local_property_text("telephone", "phone").alias("md_phone"), D.local_property_text("name").alias("md_name"),
        map_signals["embed"].alias("map_embed"), map_signals["latitude"].alias("map_latitude"),
        map_signals["longitude"].alias("map_longitude"),
        squeeze(F.coalesce(name, F.lit(""))).alias("nap_name"),
        squeeze(F.when(F.coalesce(address, F.lit("")) != "", address).otherwise(P.find(c("nap_text"), _ADDRESS, 0))).alias("nap_address"),
        F.substring(squeeze(F.coalesce(phone, F.lit(""))), -8, 8).alias("nap_phone"),
    )


def site_pages(facts: Facts) -> DataFrame:
    """All pages of each site and the likely local pages that answered."""
    need = [
        "final_url", "html", "title", "body_text", "ld", "first_p", "headings", "anchors", "images", "metas", "nodes",
        "link_tags", "scripts", "tag_counts", "class_text", "id_text",
    ]
    crawled = facts.pages.select(
        "site_id", "ord", F.lit(True).alias("is_site"), _source_name(F.col("source"), F.col("is_primary")).alias("source"), *need
    )
    origin = U.origin(F.col("url"))
    local = [(role, path) for role, path in WELL_KNOWN if role in ("homepage", "contact page", "about page", "location page")]
    wanted = facts.home.select("site_id", F.explode(F.array(*[
        F.struct(F.lit((1 << 60) + i).alias("ord"), F.lit(role).alias("source"), F.concat(origin, F.lit(path)).alias("url"))
        for i, (role, path) in enumerate(local)
    ])).alias("w")).select("site_id", "w.*")
    narrow = page_columns(crawled)
    blank = lambda kind: F.lit(None).cast(kind)
    answered = one_row(page_columns(facts.parsed_log.where(
        F.col("user_agent").isNull() & F.col("status").between(200, 299) & (T.trim_blank(F.col("html")) != "")
    ).select(blank(crawled.schema["site_id"].dataType).alias("site_id"), blank("bigint").alias("ord"), F.lit(False).alias("is_site"),
             blank("string").alias("source"), F.col("url").alias("final_url"), *[n for n in need if n != "final_url"])).drop("site_id", "ord", "is_site", "source"), ("url",))
    extra = wanted.join(answered, "url").withColumn("is_site", F.lit(False))
    return narrow.unionByName(extra.select(*narrow.columns))


_CLAIMS = "array<struct<phone:string,name:string>>"


def site_columns(rows: DataFrame, content: DataFrame, facts: Facts) -> DataFrame:
    """One row per site: flags, sums and first values of its pages; no text is gathered."""
    c = F.col
    site = c("is_site")
    total = lambda name: F.coalesce(F.sum(F.when(site, c(name))), F.lit(0)).alias(name)
    some = lambda condition, name: F.coalesce(F.bool_or(condition), F.lit(False)).alias(name)
    has_nap = (c("nap_name") != "") | (c("nap_address") != "") | (c("nap_phone") != "")
    keys = ("nap_name", "nap_address", "nap_phone")
    first_where = lambda condition, value: F.min_by(F.when(condition, value), F.when(condition, c("ord")))
    # a site's pages agree with its first one where that has no value or all values are one
    one_value = [F.min(F.when(c(k) != "", c(k))).eqNullSafe(F.max(F.when(c(k) != "", c(k)))).alias(f"one_{k}") for k in keys]
    folded = facts.keep(content.groupBy("site_id").agg(
        *[total(n) for n in (
            "n_faq", "n_question_heads", "n_outbound", "hidden_words", "n_images", "n_alt", "n_stock", "n_videos", "n_marks",
            "n_errors", "n_video_records", "n_same_as", "words", "data_points")],
        *[some(site & c(n), n) for n in (
            "bio_link", "data_nosnippet", "faq_typed", "linkedin", "authority", "has_faqs", "faq_sized", "has_products",
            "product_shown", "answer_words", "credentials", "first_hand", "alternative_text", "use_case_text", "has_transcript")],
        *[some(c(n), n) for n in (
            "md_entity", "md_latitude", "md_longitude", "md_area", "map_embed", "map_latitude", "map_longitude", "has_local",
            "has_orgs", "located", "ld_latitude", "ld_longitude", "ld_area", "area_words", "phone_words", "address_words",
            "claim_shown")],
        *[some(site & c(f"product_{key}"), f"product_{key}") for key in J.PRODUCT_FIELDS],
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(site, c("types")))))).alias("types"),
        first_where(site & c("first_p").isNotNull(), c("first_p")).alias("first_p"),
        first_where(site & c("rating").isNotNull(), c("rating")).alias("rating"),
        first_where(has_nap, F.struct(*keys)).alias("first_nap"), *one_value, F.count_if(has_nap).cast("int").alias("n_naps"),
        first_where(c("map_embed"), c("source")).alias("map_source"),
        first_where(c("md_entity") | c("map_embed"), c("source")).alias("entity_source"),
    ).select(
        "*", (c("phone_words") & c("address_words")).alias("nap"),
        (~c("has_local") & ~c("has_orgs") & ~c("md_entity")).alias("no_entity"),
    ), "answer_folded")
    elsewhere = facts.keep(shown_elsewhere(folded, content, rows, facts.keep), "answer_elsewhere")
    overlaps = facts.keep(overlap_columns(rows), "answer_overlaps")
    number = lambda key: F.coalesce(c("rating")[key], F.lit(0.0))
    agrees = [(c("first_nap")[k] == "") | c(f"one_{k}") for k in keys]
    fields = sum((c(f"product_{key}").cast("int") for key in J.PRODUCT_FIELDS), F.lit(0))
    return folded.join(elsewhere, "site_id", "left").join(overlaps, "site_id", "left").select(
        "site_id", "n_faq", "n_outbound", "hidden_words", "n_images", "n_alt", "n_stock", "n_videos", "bio_link",
        "data_nosnippet", "md_latitude", "md_longitude", "md_area", "md_entity", "map_embed", "map_latitude", "map_longitude",
        "map_source", "entity_source", "n_errors", "nap", "n_video_records", "faq_typed", "n_same_as", "linkedin", "authority",
        "has_local", "located", "ld_latitude", "ld_longitude", "ld_area", "area_words", "faq_sized", "credentials",
        "first_hand", "words", "data_points", "alternative_text", "use_case_text", "n_naps", "has_transcript",
        (c("n_marks") + c("n_question_heads")).alias("questions"),
        F.array_join("types", ", ").alias("type_list"), (F.size("types") > 0).alias("has_types"),
        (c("no_entity") | c("nap") | c("claim_shown") | F.coalesce("claim_elsewhere", F.lit(False))).alias("nap_matches"),
        (~c("has_faqs")).alias("no_faqs"),
        (~c("has_products") | c("product_shown") | F.coalesce("product_elsewhere", F.lit(False))).alias("products_shown"),
        F.when(c("has_products"), F.floor(fields * 100 / len(J.PRODUCT_FIELDS) + 0.5).cast("int")).otherwise(100).alias("product_percent"),
        ((number("ratingValue") == 5) & (number("reviewCount") >= 20)).alias("suspicious_rating"),
        (c("answer_words") | (T.utf16_length(c("first_p")) >= 80)).alias("answer_first"),
        ((c("n_naps") > 0) & agrees[0] & agrees[1] & agrees[2]).alias("nap_agrees"),
        F.coalesce("overlap", F.lit(0)).alias("overlap"),
    )


def shown_elsewhere(folded: DataFrame, content: DataFrame, rows: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Phones, names and products that their own pages do not show, looked up on all pages of the site.

    Only sites without a match on one page get here; their terms meet the pages in a positional index.
    """
    c = F.col
    open_sites = folded.select(
        "site_id", (~c("nap") & ~c("no_entity") & ~c("claim_shown")).alias("open_claim"),
        (c("has_products") & ~c("product_shown")).alias("open_product"),
    ).where("open_claim or open_product")
    wanted = content.select("site_id", "is_site", "claims", "product_names").join(open_sites, "site_id")
    claims = keep(wanted.where("open_claim").select("site_id", F.explode("claims").alias("claim")).select(
        "site_id", "claim.phone", "claim.name").distinct(), "open_claims")
    products = keep(wanted.where("open_product and is_site").select("site_id", F.explode("product_names").alias("phrase")).distinct(), "open_products")
    texts = rows.select("site_id", c("ord").alias("page"), c("is_site").alias("own"), F.lower("body").alias("text"))
    names = keep(phrases.shown(texts, claims.select("site_id", c("name").alias("phrase")).union(products), keep=keep), "shown_names")
    phones = phrases.shown_digits(
        rows.select("site_id", T.digits(c("body")).alias("digits")), claims.where("phone != ''").select("site_id", c("phone").alias("number")))
    told = claims.join(names.select("site_id", c("phrase").alias("name"), F.lit(True).alias("named")), ["site_id", "name"], "left").join(
        phones.select("site_id", c("number").alias("phone"), F.lit(True).alias("called")), ["site_id", "phone"], "left").groupBy("site_id").agg(
        F.bool_or(((c("phone") == "") | c("called").isNotNull()) & ((c("name") == "") | c("named").isNotNull())).alias("claim_elsewhere"))
    sold = products.join(names.where("on_site"), ["site_id", "phrase"], "left_semi").select("site_id", F.lit(True).alias("product_elsewhere")).distinct()
    return open_sites.select("site_id").join(told, "site_id", "left").join(sold, "site_id", "left").select(
        "site_id", F.coalesce("claim_elsewhere", F.lit(False)).alias("claim_elsewhere"), F.coalesce("product_elsewhere", F.lit(False)).alias("product_elsewhere"))


def overlap_columns(rows: DataFrame) -> DataFrame:
    """Share of the entities of a site's transcripts that its texts have too, in whole percent."""
    c = F.col
    pages = rows.where("is_site")
    ours = pages.where(F.trim("transcript") != "").select("site_id", F.explode(T.entity_set(c("transcript"))).alias("entity")).distinct()
    theirs = pages.join(ours.select("site_id").distinct(), "site_id", "left_semi").select(
        "site_id", F.explode(T.entity_set(c("body"))).alias("entity")).distinct().withColumn("shared", F.lit(1))
    return ours.join(theirs, ["site_id", "entity"], "left").groupBy("site_id").agg(
        half_up(rate(F.count("shared"), F.count(F.lit(1))) * 100).alias("overlap"))


def trust_candidates(facts: Facts, addresses: DataFrame) -> DataFrame:
    """S2 + H21: addresses, links of the last fifth of the home page, and policy pages; last wins per address."""
    html = F.col("html")
    tail = facts.home.select(
        "site_id", "url", F.substring(html, F.floor(F.length(html) * 0.8).cast("int") + 1, F.length(html)).alias("html")
    )
    footer = parse_pages(tail, base="url", keep_html=False).select("site_id", F.posexplode("anchors").alias("pos", "a")).where(
        F.coalesce(F.col("a.abs"), F.lit("")) != ""
    )
    origin = U.origin(F.col("url"))
    policy = wanted_rows(facts.home, {
        path: F.concat(origin, F.lit(path)) for role, path in WELL_KNOWN if role == "policy"
    }).join(facts.answers.where(F.col("status") == 200).select("req_url"), "req_url")
    all_rows = (
        addresses.select("site_id", "url", F.lit("").alias("anchor"), F.lit(0).alias("turn"), F.lit(0).alias("pos"))
        .unionByName(footer.select("site_id", F.col("a.abs").alias("url"), T.collapse(F.col("a.text")).alias("anchor"),
                                   F.lit(1).alias("turn"), "pos"))
        .unionByName(policy.select("site_id", F.col("req_url").alias("url"),
                                   F.regexp_replace("role", "[-/]", " ").alias("anchor"), F.lit(2).alias("turn"), F.lit(0).alias("pos")))
    )
    return last_wins(all_rows.withColumn("place", F.struct("turn", "pos")).drop("turn", "pos"), ["site_id", "url"], "place")


def trust_columns(facts: Facts, addresses: DataFrame) -> DataFrame:
    """Distinct trust-page types per site, from candidate texts and from the titles of likely ones."""
    candidates = trust_candidates(facts, addresses)
    text = trust_text(F.col("url"), F.col("anchor"))
    titles = facts.parsed_log.where(F.col("user_agent").isNull() & F.col("status").between(200, 299)).select(
        "url", F.concat_ws(" ", "title", D.first_h1()).alias("head"), F.lit(0).alias("turn")
    ).unionByName(facts.pages.select("url", F.concat_ws(" ", "title", D.first_h1()).alias("head"), F.lit(1).alias("turn"))).groupBy("url").agg(
        F.min_by("head", F.struct("turn", "head")).alias("head")
    )
    broad = candidates.where(P.test(text, TRUST_WORDS)).join(titles, "url")
    found = candidates.select("site_id", F.explode(trust_types(text)).alias("type")).unionByName(
        broad.select("site_id", F.explode(trust_types(trust_text(F.col("url"), F.col("anchor"), F.col("head")))).alias("type"))
    )
    return found.groupBy("site_id").agg(F.array_sort(F.collect_set("type")).alias("trust_types"))


def agent_columns(home: DataFrame, parsed_log: DataFrame) -> DataFrame:
    """What the two answer-engine agents and a browser got for the home page."""
    agents = {"oai": OAI_AGENT, "google": GOOGLE_AGENT, "browser": BROWSER_AGENT}
    rows = one_per_url(
        parsed_log.where(F.col("user_agent").isin(*agents.values())).select(
            F.col("url").alias("home_url"), "user_agent", "status", "headers",
            F.coalesce("fetched_at", F.timestamp_seconds(F.lit(0))).alias("fetched_at"),
            T.word_count(F.col("body_text")).alias("words"), H.has_markup(F.col("html")).alias("markup"),
            H.is_challenge(F.col("status"), F.col("html")).alias("challenged"),
            H.passes_firewall(F.col("status"), F.col("html")).alias("passes"),
        ),
        ("home_url", "user_agent"),
    )
    packed = F.struct("status", "words", "markup", "challenged", "passes", "headers")
    wide = rows.groupBy("home_url").agg(*[
        F.first(F.when(F.col("user_agent") == agent, packed), ignorenulls=True).alias(name) for name, agent in agents.items()
    ])
    return home.select("site_id", F.col("url").alias("home_url")).join(wide, "home_url").drop("home_url")


def rendered_columns(home: DataFrame, rendered: DataFrame | None) -> DataFrame:
    """Words and structured-data blocks of the rendered page, where one was captured."""
    if rendered is None:
        return home.select("site_id", F.lit(None).cast("int").alias("rendered_words"), F.lit(None).cast("int").alias("rendered_blocks"))
    facts = parse_pages(rendered.select("url", "html"), base="url", keep_html=False).groupBy("url").agg(
        F.first(T.word_count(F.col("body_text"))).alias("rendered_words"), F.first(F.size("jsonld")).alias("rendered_blocks")
    )
    return home.select("site_id", "url").join(facts, "url").drop("url")


def audit(facts: Facts, sitemap_urls: DataFrame) -> DataFrame:
    c = F.col
    home = facts.home.select(
        "site_id", "url", "html", T.word_count(c("body_text")).alias("home_words"), F.size("jsonld").alias("home_blocks")
    )
    origin = U.origin(c("url"))
    files = by_role(
        answer(wanted_rows(home, {
            "robots": F.concat(origin, F.lit("/robots.txt")), "llms": F.concat(origin, F.lit("/llms.txt")), "server": c("url"),
        }), facts.answers),
        ["robots", "llms", "server"],
        ["status", "robots_text", "llms_words", "llms_markdown", "llms_topics", "markup"],
    )
    pages = facts.pages.select("site_id", F.col("final_url").alias("url"))
    addresses = sitemap_urls.select("site_id", "url").unionByName(pages).distinct()
    words = U.path_words(c("url"))
    kinds = addresses.groupBy("site_id").agg(
        F.coalesce(F.bool_or(P.test(c("url"), f"(?:{ALTERNATIVE_URL})|(?:{ALTERNATIVE_BLOG})") | P.test(words, ALTERNATIVE_TEXT)),
                   F.lit(False)).alias("alternative_url"),
        F.coalesce(F.bool_or(is_use_case(c("url"), words)), F.lit(False)).alias("use_case_url"),
    )
    rows = facts.keep(site_pages(facts), "answer_pages")
    sites = facts.keep(site_columns(rows, facts.keep(content_columns(rows), "answer_content"), facts), "answer_sites")
    wide = facts.keep(home_columns(home), "answer_home").join(sites, "site_id")
    for at, side in enumerate((files, kinds, trust_columns(facts, addresses), agent_columns(home, facts.parsed_log),
                               rendered_columns(home, facts.rendered))):
        wide = wide.join(facts.keep(side, f"answer_side_{at}"), "site_id", "left")
    return check_rows(wide, ["site_id"], ANSWER, _verdicts()).withColumn("page_id", F.lit(None).cast("bigint"))


def home_columns(home: DataFrame) -> DataFrame:
    """Wordings of the home page's source."""
    word = lambda pattern: P.test(F.col("html"), pattern)
    return home.select(
        "site_id", "home_words", "home_blocks",
        word("author|byline|written by|reviewed by").alias("byline_words"),
        word("dateModified|last updated|updated on|last-modified").alias("updated_words"),
        word("nosnippet|max-snippet:0").alias("snippet_limits"),
        word("cookie consent|accept cookies|gdpr|before you continue").alias("consent_words"),
    )


def content_columns(rows: DataFrame) -> DataFrame:
    """Everything that follows from one page's text and structured data, as small columns.

    The heavy readers run here, before anything is shuffled, so the roll-up and the joins carry flags and counts.
    """
    c = F.col
    typed = lambda objects, pattern: F.filter(objects, lambda r: J.any_type(J.graph_types(r), pattern, "i"))
    first = rows.select(
        "*", J.objects().alias("objects"), T.digits(c("body")).alias("body_digits"), F.lower("body").alias("lower_body"),
        T.collapse(c("search_text")).alias("search"),
    )
    second = first.select(
        "*", typed(c("objects"), LOCAL_TYPE).alias("local"), typed(c("objects"), "Organization").alias("orgs"),
        typed(c("objects"), "Product").alias("products"), typed(c("objects"), "FAQPage").alias("faqs"),
        J.same_as_urls(typed(c("objects"), f"Organization|{LOCAL_TYPE}")).alias("same_as"),
        F.flatten(F.transform(J.top_blocks(), lambda b: J.graph_types(b))).alias("types"),
    )
    text = lambda record, key: F.coalesce(J.string_of(J.get(record, key)), F.lit(""))
    claim = lambda phone, name: F.struct(F.substring(T.digits(phone), -7, 7).alias("phone"), F.lower(name).alias("name"))
    own = F.when(c("md_entity"), F.array(claim(c("md_phone"), F.trim(c("md_name"))))).otherwise(F.array().cast(_CLAIMS))
    third = second.select(
        "*", J.objects_of(c("local")).alias("local_nested"), J.review_aggregate(c("products")).alias("rated"),
        F.array_distinct(F.concat(
            F.transform(F.concat("local", "orgs"), lambda r: claim(text(r, "telephone"), text(r, "name"))), own)).alias("claims"),
        F.array_distinct(F.transform("products", lambda r: F.lower(text(r, "name")))).alias("product_names"),
    )
    phone_like = lambda r: (
        J.string_of(J.get(r, "telephone")).isNotNull() | J.string_of(J.get(r, "phone")).isNotNull()
        | J.is_object(J.get(r, "contactPoint"))
    )
    located = lambda r: phone_like(r) & (J.is_object(J.get(r, "address")) | J.string_of(J.get(r, "address")).isNotNull())
    placed = lambda r: F.exists(
        F.array(*[J.get(r, k) for k in ("address", "addressLocality", "addressRegion", "areaServed", "serviceArea")]), J.truthy
    )
    property_of = lambda *names: F.exists("local_nested", lambda r: reduce(or_, [J.own_or_nested(r, name) for name in names]))
    sized = lambda r: F.coalesce(F.size(J.get(r, "mainEntity")["items"]) >= 2, F.lit(False))
    carries = lambda key: lambda r: J.truthy(J.get(r, key))
    body = c("body")
    test = lambda pattern: P.test(body, pattern)
    number = lambda key: J.number(c("rated"), key).alias(key)
    return third.select(
        "site_id", "ord", "is_site", "source", "n_faq", "n_question_heads", "n_outbound", "hidden_words", "n_images", "n_alt",
        "n_stock", "n_videos", "first_p", "bio_link", "data_nosnippet", "md_entity", "md_latitude", "md_longitude", "md_area",
        "map_embed", "map_latitude", "map_longitude", "nap_name", "nap_address", "nap_phone", "types", "claims", "product_names",
        P.count(body, r"\?", "").alias("n_marks"), J.error_count().alias("n_errors"),
        F.size(typed(c("objects"), "VideoObject")).alias("n_video_records"),
        J.any_type(c("types"), "FAQPage").alias("faq_typed"),
        F.size("same_as").alias("n_same_as"),
        F.exists("same_as", lambda u: P.test(u, r"linkedin\.com")).alias("linkedin"),
        F.exists("same_as", lambda u: P.test(u, r"crunchbase\.com|wikidata\.org")).alias("authority"),
        F.exists("claims", lambda k: F.contains(c("body_digits"), k["phone"]) & F.contains(c("lower_body"), k["name"])).alias("claim_shown"),
        (F.size("local") > 0).alias("has_local"), (F.size("orgs") > 0).alias("has_orgs"), F.exists("orgs", located).alias("located"),
        property_of("latitude").alias("ld_latitude"), property_of("longitude").alias("ld_longitude"),
        (property_of("areaServed", "serviceArea", "addressLocality", "addressRegion") | F.exists("orgs", placed)).alias("ld_area"),
        (T.visible_area_served(body) | T.visible_address(body)).alias("area_words"),
        T.visible_phone(body).alias("phone_words"), T.visible_address(body).alias("address_words"),
        (F.size("faqs") > 0).alias("has_faqs"), F.exists("faqs", sized).alias("faq_sized"),
        (F.size("products") > 0).alias("has_products"),
        F.exists("product_names", lambda n: F.contains(c("lower_body"), n)).alias("product_shown"),
        *[F.exists("products", carries(key)).alias(f"product_{key}") for key in J.PRODUCT_FIELDS],
        F.when(c("rated").isNotNull(), F.struct(number("ratingValue"), number("reviewCount"))).alias("rating"),
        test(r"\b(in short|bottom line|summary|answer:|tl;dr)\b").alias("answer_words"),
        test(r"\b(certified|credential|licensed|award|degree|accredited|partner)\b").alias("credentials"),
        test(r"\b(we tested|our experience|case study|results|client|customer|first-hand|hands-on)\b").alias("first_hand"),
        T.word_count(body).alias("words"), T.data_point_count(body).alias("data_points"),
        P.test(c("search"), ALTERNATIVE_TEXT).alias("alternative_text"), is_use_case(c("url"), c("search")).alias("use_case_text"),
        (F.trim("transcript") != "").alias("has_transcript"),
    )


def _verdicts() -> list[tuple[list[int], Verdict]]:
    c = F.col
    llms, server, oai, google = c("llms"), c("server"), c("oai"), c("google")
    ok = llms["status"].between(200, 299)
    robots = F.coalesce(c("robots")["robots_text"], F.lit(""))
    browser_words = F.coalesce(c("browser")["words"], c("home_words"))
    oai_words = F.coalesce(oai["words"], F.lit(0))
    oai_ratio = rate(oai_words, browser_words)
    restricted = c("snippet_limits") | P.test(H.header(oai["headers"], "x-robots-tag"), "nosnippet|max-snippet:0")
    alt_score = F.when(c("n_images") > 0, half_up(c("n_alt") / c("n_images") * 10)).otherwise(10)
    robots_ok = lambda bot: R.allows(robots, F.lit(bot))
    verdicts = [([i], Verdict(robots_ok(bot), evidence={"status": c("robots")["status"]})) for i, bot in BOTS]
    verdicts += [
        ([8], Verdict(ok, evidence={"status": llms["status"]})),
        ([9], Verdict(ok & llms["llms_markdown"])),
        ([10], Verdict(ok & (llms["llms_words"] >= 200), evidence={"words": llms["llms_words"]})),
        ([11], Verdict(ok & (llms["llms_topics"] >= 2), evidence={"topics": llms["llms_topics"]})),
        ([12], Verdict(c("n_same_as") >= 4, evidence={"links": c("n_same_as")})),
        ([13], Verdict(c("linkedin"))),
        ([14], Verdict(c("authority"))),
        ([15], Verdict(c("nap_matches"))),
        ([16], Verdict((c("n_errors") == 0) & c("has_types"), evidence={"errors": c("n_errors")})),
        ([17], Verdict((c("n_faq") > 0) | (c("questions") >= 3), evidence={"faq": c("n_faq"), "questions": c("questions")})),
        ([18], Verdict(c("faq_typed"), evidence={"types": c("type_list")})),
        ([19], Verdict(c("no_faqs") | c("faq_sized"))),
        ([20], Verdict(c("answer_first"))),
        ([21], Verdict(c("questions") >= 3, evidence={"questions": c("questions")})),
        ([22], Verdict(c("byline_words"))),
        ([23], Verdict(c("bio_link"))),
        ([24], Verdict(c("credentials"))),
        ([25], Verdict(c("first_hand"))),
        ([26], Verdict(c("updated_words"))),
        ([27], Verdict(c("n_outbound") >= 2, evidence={"links": c("n_outbound")})),
        ([28], Verdict(c("has_local") | c("md_entity") | c("located") | c("nap") | c("map_embed"),
                       evidence={"source": c("entity_source")})),
        ([29], Verdict(c("ld_latitude") | c("md_latitude") | c("map_latitude"), evidence={"map": c("map_source")})),
        ([30], Verdict(c("ld_longitude") | c("md_longitude") | c("map_longitude"), evidence={"map": c("map_source")})),
        ([31], Verdict(c("ld_area") | c("md_area") | c("area_words"))),
        ([32], Verdict(c("words") >= 100, evidence={"words": c("words")})),
        ([33], Verdict(c("hidden_words") < 100, evidence={"words": c("hidden_words")})),
        ([34], Verdict(c("data_points") >= 5, evidence={"points": c("data_points")})),
        ([35], Verdict(c("no_faqs") | (c("questions") >= 2))),
        ([36], Verdict(c("products_shown"))),
        ([37], Verdict(c("n_errors") == 0, evidence={"errors": c("n_errors")})),
        ([40], Verdict(robots_ok("OAI-SearchBot") & robots_ok("ChatGPT-User"),
                       evidence={"group": F.when(R.group_for(robots, F.lit("GPTBot")) != "", "GPTBot").otherwise("")})),
        ([41], Verdict((oai["status"] == 200) & oai["markup"] & ~oai["challenged"], evidence={"status": oai["status"]})),
        ([42], Verdict(oai_ratio >= 0.5, evidence={"ratio": F.round(oai_ratio, 2)})),
        ([49], Verdict(c("alternative_url") | c("alternative_text"))),
        ([50], Verdict(c("use_case_url") | c("use_case_text"))),
        ([52], Verdict(c("product_percent") >= 60, evidence={"percent": c("product_percent")})),
        ([54], Verdict(~c("suspicious_rating"))),
        ([55], Verdict(F.size(F.coalesce("trust_types", F.array().cast("array<string>"))) >= 2,
                       evidence={"types": F.array_join("trust_types", ", ")})),
        ([65], Verdict(~restricted & ~c("data_nosnippet"))),
        ([66], Verdict(rate(oai_words, c("rendered_words")) >= 0.6, skipped=c("rendered_words").isNull(),
                       evidence={"words": oai_words, "rendered": c("rendered_words")})),
        ([68], Verdict(google["passes"], evidence={"status": google["status"]})),
        ([69], Verdict((server["status"] == 200) & server["markup"], evidence={"status": server["status"]})),
        ([70], Verdict(c("nap_agrees"), evidence={"pages": c("n_naps")})),
        ([71], Verdict(c("home_words") > 200, evidence={"words": c("home_words"), "consent": c("consent_words")})),
        ([72], Verdict(c("home_blocks") >= c("rendered_blocks"), skipped=c("rendered_blocks").isNull())),
        ([74], Verdict(True)),
        ([75], Verdict(c("n_stock") <= 2, evidence={"stock": c("n_stock")})),
        ([76], Verdict(alt_score >= 5, evidence={"score": alt_score})),
        ([77], Verdict((c("n_videos") == 0) | (rate(c("n_video_records"), c("n_videos")) >= 0.3),
                       evidence={"videos": c("n_videos")})),
        ([78], Verdict(c("overlap") >= 40, skipped=(c("n_videos") == 0) | ~c("has_transcript"),
                       evidence={"overlap": c("overlap")})),
    ]
    return verdicts


def speakable_found() -> Column:
    """Real form of check 74: a speakable type or property somewhere."""
    return F.exists(
        J.objects(),
        lambda r: J.any_type(J.graph_types(r), "SpeakableSpecification", "i") | J.has_key(r, "speakable"),
    )
