"""Indexability audit: 26 checks on the home page and what its addresses answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dom as D
from ..functions import headers as H
from ..functions import patterns as P
from ..functions import text as T
from ..functions import urls as U
from ..operators.links import answer, by_role, wanted_rows
from ..operators.ranking import first_k
from ..operators.scoring import INDEX
from ..session import large, stage
from .rules import CheckDef, Verdict, check_rows

# Id, category, name, highest score, severity.
DEFS = [
    CheckDef(1, "Index Status", "No noindex Anywhere", 10, "Critical"),
    CheckDef(2, "Index Status", "Google Index Verified", 10, "Critical"),
    CheckDef(3, "Index Status", "Bing Index Verified", 10, "Critical"),
    CheckDef(4, "Index Status", "GSC Coverage Zero Errors", 8, "High"),
    CheckDef(5, "Index Status", "Canonical Not -> Noindex", 10, "Critical"),
    CheckDef(6, "Index Status", "No noindex in Sitemap", 8, "High"),
    CheckDef(7, "Canonicalization", "Self-Referencing Canonical", 10, "Critical"),
    CheckDef(8, "Canonicalization", "Canonical Absolute HTTPS", 8, "High"),
    CheckDef(9, "Canonicalization", "Canonical Target Returns 200", 10, "Critical"),
    CheckDef(10, "Canonicalization", "No Canonical Chains", 8, "High"),
    CheckDef(11, "Canonicalization", "No HTTP Header Canonical Conflict", 8, "High"),
    CheckDef(12, "Snippet Controls", "No nosnippet on Key Pages", 10, "Critical"),
    CheckDef(13, "Snippet Controls", "No max-snippet:0 / Low", 10, "Critical"),
    CheckDef(14, "Snippet Controls", "No data-nosnippet Key Content", 8, "High"),
    CheckDef(15, "Snippet Controls", "No max-image-preview:none", 4, "Low"),
    CheckDef(16, "URL & Redirect Management", "HTTP->HTTPS No Dual Serving", 10, "Critical"),
    CheckDef(17, "URL & Redirect Management", "WWW/Non-WWW Handled", 10, "Critical"),
    CheckDef(18, "URL & Redirect Management", "Parameter URL Managed", 8, "High"),
    CheckDef(19, "International & Pagination", "Pagination rel=next/prev", 4, "Low"),
    CheckDef(20, "International & Pagination", "Hreflang Correct", 8, "High"),
    CheckDef(21, "Access & Gating", "No Login/Paywall Gate", 10, "Critical"),
    CheckDef(22, "Access & Gating", "No Consent Wall Blocking", 10, "Critical"),
    CheckDef(23, "Access & Gating", "No Back-Button Hijack", 10, "Critical"),
    CheckDef(24, "Rendering & Content Access", "CSS Hidden <100 Words", 8, "High"),
    CheckDef(25, "Rendering & Content Access", "No Soft-404s", 8, "High"),
    CheckDef(26, "Rendering & Content Access", "No Infinite Scroll Dependency", 8, "High"),
]
# Invented addresses a site must not serve.
PROBES = ("/random-url-123456789-test/", "/nonexistent-page-seo-audit-test/")
SITEMAP_SAMPLE: int | None = None  # addresses looked up per site; None takes them all


def features(pages: DataFrame, compat: bool = False) -> DataFrame:
    """``compat`` leaves response headers out, as in the one-page report flow."""
    headers = (
        F.col("headers") if "headers" in pages.columns and not compat else F.create_map().cast("map<string,string>")
    )
    nodes = F.col("nodes")
    every = D.every_element()
    link_canonical = H.link_canonical(headers, strict_quotes=True)
    lower_rel = lambda e: F.lower(D.attr_or(e, "rel"))
    next_prev = F.filter(F.col("link_tags"), lambda e: lower_rel(e).isin("next", "prev"))
    page_links = D.any_of(D.hrefs(), lambda a: P.test(D.attr(a, "href"), "page=|/page/", ""))
    alternates = F.filter(F.col("link_tags"), lambda e: (lower_rel(e) == "alternate") & D.has(e, "hreflang"))
    codes = F.filter(F.transform(alternates, lambda e: F.lower(D.attr_or(e, "hreflang"))), lambda v: v != "")
    gate_form = lambda e: ((e["tag"] == "input") & (D.attr_or(e, "type") == "password")) | (
        (e["tag"] == "form") & P.test(D.attr(e, "action"), "login|signin")
    )
    overlay = lambda e: P.test(D.attr(e, "class"), "cookie|consent|gdpr") | P.test(D.attr(e, "id"), "cookie|consent")
    body = T.collapse(F.col("body_text"))
    html = F.col("html")
    return pages.select(
        "site_id", "page_id", "url", "parse_error",
        P.test(html, r"history\.(?:pushState|replaceState)|onpopstate").alias("hijack"),
        P.test(html, r"setInterval\s*\([^)]*history\.|while\s*\([^)]*\)\s*\{[^}]*history\.").alias("looped"),
        P.test(html, r"infinite[-_\s]?scroll|IntersectionObserver|loadMore|load-more").alias("infinite"),
        F.concat(
            D.meta_robots_joined("robots", "googlebot", "bingbot"), F.lit(","), H.header(headers, "x-robots-tag")
        ).alias("directives"),
        F.coalesce(D.canonical_combined(link_canonical), F.lit("")).alias("canonical"),
        F.coalesce(D.canonical_combined(F.lit("")), F.lit("")).alias("canonical_html"),
        H.header(headers, "link").alias("link_header"),
        D.n(every, lambda e: D.has(e, "data-nosnippet") & (T.word_count(e["text"]) > 50)).alias("n_nosnippet"),
        (page_links | (F.size(next_prev) > 0)).alias("paginated"),
        page_links.alias("page_links"),
        D.any_of(next_prev, lambda e: D.attr_or(e, "href") != "").alias("next_prev"),
        F.size(alternates).alias("n_alternates"),
        F.size(codes).alias("n_codes"),
        D.n(alternates, lambda e: D.attr_or(e, "href") != "").alias("n_code_links"),
        D.n(codes, lambda v: (v != "x-default") & ~v.rlike("^[a-z]{2}(-[a-z]{2})?$")).alias("n_malformed"),
        D.n(nodes, gate_form).alias("n_gate_forms"),
        P.test(
            body, r"\b(login|sign in|subscribe|paywall|members only|create an account|restricted access)\b"
        ).alias("gate_words"),
        T.word_count(body).alias("words"),
        D.n(every, overlay).alias("n_overlays"),
        D.hidden_words_outside_regions().alias("hidden_words"),
    )


def audit(
    pages: DataFrame, facts: DataFrame, plain: DataFrame, manual: DataFrame, sitemap_urls: DataFrame,
    sample: int | None = SITEMAP_SAMPLE, compat: bool = False, index_status: DataFrame | None = None,
) -> DataFrame:
    """``facts``: page facts per address; ``plain`` / ``manual``: answers with and without redirects."""
    home = stage(features(pages, compat), "index_features")  # parsed once, read by four branches
    target = facts.select(
        F.col("req_url").alias("canonical"), F.col("status").alias("target_status"),
        F.col("noindex").alias("target_noindex"), F.col("canonical").alias("second_canonical"),
        F.lit(True).alias("target_found"),
    )
    origin = U.origin(F.col("url"))
    manual_roles = answer(
        wanted_rows(home, {"http": U.with_http(F.col("url")), "www": U.toggle_www(F.col("url"))}), manual
    )
    redirects = by_role(manual_roles, ["http", "www"], ["status", "location"])
    probes = by_role(
        answer(wanted_rows(home, {f"probe{i}": F.concat(origin, F.lit(p)) for i, p in enumerate(PROBES)}), plain),
        ["probe0", "probe1"], ["status"],
    )
    short = facts.select("req_url", "noindex", "canonical")
    sampled = first_k(sitemap_urls, ["site_id"], [F.col("place")], sample)
    first_hop = sampled.select("site_id", F.col("url").alias("req_url")).join(large(short), "req_url", "left")
    second = facts.select(F.col("req_url").alias("canonical"), F.col("noindex").alias("canonical_noindex"))
    onward = F.coalesce("canonical", F.lit("")) != ""
    blocked = (
        first_hop.where(onward).join(large(second), "canonical", "left").select("site_id", "noindex", "canonical_noindex")
        .unionByName(first_hop.where(~onward).select("site_id", "noindex", F.lit(None).cast("boolean").alias("canonical_noindex")))
        .groupBy("site_id")
        .agg(
            F.count_if(F.coalesce("noindex", F.lit(False)) | F.coalesce("canonical_noindex", F.lit(False)))
            .cast("int").alias("n_blocked"),
            F.count(F.lit(1)).cast("int").alias("n_sampled"),
        )
    )
    targets = home.where(F.col("canonical") != "").select("site_id", "page_id", "canonical").join(large(target), "canonical").drop("canonical")
    wide = (
        home.join(large(targets), ["site_id", "page_id"], "left")
        .join(large(redirects), "site_id", "left")
        .join(large(probes), "site_id", "left")
        .join(large(blocked), "site_id", "left")
    )
    if index_status is not None:
        wide = wide.join(index_status.select("site_id", "google_indexed", "bing_indexed", "coverage_errors"), "site_id", "left")
    c = F.col
    status = lambda name: F.coalesce(c(name), F.lit(None).cast("boolean")) if index_status is not None else F.lit(None).cast("boolean")
    engine = lambda name: Verdict(status(name), skipped=status(name).isNull())
    coverage = (c("coverage_errors") == 0) if index_status is not None else F.lit(None).cast("boolean")
    url, canonical = c("url"), c("canonical")
    redirect = lambda role: c(role)["status"].isin(301, 302, 307, 308)
    gone = lambda role: F.coalesce(c(role)["status"], F.lit(0)).isin(404, 410)
    snippet = H.max_snippet(c("directives"))
    traps = U.trap_params(url)
    hijack, looped, infinite = c("hijack"), c("looped"), c("infinite")
    www_back = U.comparable_url(F.coalesce(c("www")["location"], F.lit(""))) == U.comparable_url(url)
    second_canonical = F.coalesce(c("second_canonical"), F.lit(""))
    verdicts = [
        ([1], Verdict(~P.test(c("directives"), r"(^|,|\s)noindex(,|\s|$)"), evidence={"directives": c("directives")})),
        ([2], engine("google_indexed")),
        ([3], engine("bing_indexed")),
        ([4], Verdict(coverage, skipped=coverage.isNull())),
        ([5], Verdict(~F.coalesce(c("target_noindex"), F.lit(False)), evidence={"canonical": canonical})),
        ([6], Verdict(F.coalesce(c("n_blocked"), F.lit(0)) == 0,
                      evidence={"checked": c("n_sampled"), "blocked": c("n_blocked")})),
        ([7], Verdict((canonical != "") & (U.comparable_url(canonical) == U.comparable_url(url)),
                      evidence={"canonical": canonical, "url": url})),
        ([8], Verdict(P.test(canonical, "^https://"), evidence={"canonical": canonical})),
        ([9], Verdict(c("target_status") == 200, evidence={"status": c("target_status")})),
        ([10], Verdict((canonical == "") | (second_canonical == "")
                       | (U.comparable_url(second_canonical) == U.comparable_url(canonical)),
                       evidence={"second": second_canonical})),
        ([11], Verdict((c("link_header") == "") | (canonical == "")
                       | (U.comparable_url(canonical) == U.comparable_url(c("canonical_html"))),
                       evidence={"link": c("link_header")})),
        ([12], Verdict(~P.test(c("directives"), "nosnippet"), evidence={"directives": c("directives")})),
        ([13], Verdict(snippet.isNull() | (snippet == -1) | (snippet >= 50), evidence={"value": snippet})),
        ([14], Verdict(c("n_nosnippet") == 0, evidence={"elements": c("n_nosnippet")})),
        ([15], Verdict(H.max_image_preview(c("directives")) != "none",
                       evidence={"value": H.max_image_preview(c("directives"))})),
        ([16], Verdict((U.scheme(url) == "https") & redirect("http") & P.test(c("http")["location"], "^https:"),
                       evidence={"status": c("http")["status"], "location": c("http")["location"]})),
        ([17], Verdict(c("www")["status"].isNull() | redirect("www") | gone("www") | www_back,
                       evidence={"status": c("www")["status"], "location": c("www")["location"]})),
        ([18], Verdict((F.size(traps) == 0) | ((canonical != "") & (U.query(canonical) == "")),
                       evidence={"params": F.array_join(traps, ",")})),
        ([19], Verdict(c("next_prev") | (canonical != ""), skipped=~c("paginated"))),
        ([20], Verdict((c("n_code_links") == c("n_codes")) & (c("n_malformed") == 0), skipped=c("n_alternates") == 0,
                       evidence={"codes": c("n_codes"), "malformed": c("n_malformed")})),
        ([21], Verdict(~(c("gate_words") & (c("words") < 250)) & (c("n_gate_forms") == 0),
                       evidence={"words": c("words"), "forms": c("n_gate_forms")})),
        ([22], Verdict((c("n_overlays") == 0) | (c("words") >= 100),
                       evidence={"overlays": c("n_overlays"), "words": c("words")})),
        ([23], Verdict(~hijack | ~looped, evidence={"history": hijack, "loop": looped})),
        ([24], Verdict(c("hidden_words") < 100, evidence={"words": c("hidden_words")})),
        ([25], Verdict(gone("probe0") & gone("probe1"),
                       evidence={"status": c("probe0")["status"], "second": c("probe1")["status"]})),
        ([26], Verdict(~infinite | c("paginated"), evidence={"infinite": infinite, "paginated": c("paginated")})),
    ]
    return check_rows(wide, ["site_id", "page_id"], INDEX, verdicts)
