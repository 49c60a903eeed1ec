"""Image audit: 13 checks on one page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dom as D
from ..functions import jsonld as J
from ..functions import patterns as P
from ..functions import text as T
from ..functions import urls as U
from ..functions.numbers import fixed2, rate
from ..operators.scoring import IMAGE
from .rules import CheckDef, Verdict, check_rows

# Id, category, name, weight, severity.
DEFS = [
    CheckDef(1, "Alt Text", "Alt Text Non-Empty on All Images", 4.38, "Critical"),
    CheckDef(2, "Image Format & Performance", "WebP/AVIF >=70%", 3.26, "Medium"),
    CheckDef(3, "Image Format & Performance", "LCP Image Preloaded", 3.8, "Critical"),
    CheckDef(4, "Image Format & Performance", "<picture> with WebP+Fallback", 2.17, "Medium"),
    CheckDef(5, "Image Format & Performance", "Stable Image URLs", 2.17, "Medium"),
    CheckDef(6, "Image Format & Performance", "Native Lazy Loading (Not JS)", 3.26, "High"),
    CheckDef(7, "Image Format & Performance", "Responsive srcset+sizes", 2.17, "Medium"),
    CheckDef(8, "Image Format & Performance", "Descriptive File Names", 2.17, "Medium"),
    CheckDef(9, "Content & Accessibility", "OCR-HTML Data Parity", 3.8, "Critical"),
    CheckDef(10, "Content & Accessibility", "No Key Data as Image-Only", 3.8, "Critical"),
    CheckDef(11, "Content & Accessibility", "No Images Blocking Text", 2.72, "High"),
    CheckDef(12, "Schema & Markup", "SVG <title>+<desc>", 2.17, "Medium"),
    CheckDef(13, "Schema & Markup", "ImageObject Schema", 2.17, "Medium"),
]
_MODERN = r"\.(?:webp|avif)(?:[?#]|$)"


def features(pages: DataFrame) -> DataFrame:
    nodes = F.col("nodes")
    shown = D.content_images()
    pictures, sources = D.tagged(nodes, "picture"), D.tagged(nodes, "source")
    svgs = D.tagged(nodes, "svg")

    def with_fallback(picture):
        modern = lambda s: P.test(D.attr(s, "type"), "image/(?:webp|avif)") | P.test(D.attr(s, "srcset"), _MODERN)
        return F.exists(sources, lambda s: D.contains_element(picture, s) & modern(s)) & F.exists(
            F.col("images"), lambda i: D.contains_element(picture, i)
        )

    def described(svg):
        has = lambda tag: F.exists(nodes, lambda e: (e["tag"] == tag) & D.contains_element(svg, e))
        return has("title") & has("desc")

    scripted_lazy = lambda e: (
        D.has_text_attr(e, "data-src") | D.has_text_attr(e, "data-lazy-src")
        | P.test(D.attr(e, "class"), "lazyload|lazy-load")
    )
    data_alt = lambda e: P.test(D.attr(e, "alt"), r"[$%]|price|chart|table|data")
    urls = F.filter(F.transform(shown, D.image_source), lambda u: u != "")
    return pages.select(
        "site_id", "page_id", "parse_error",
        F.size(shown).alias("n_images"),
        urls.alias("urls"),
        D.n(shown, lambda e: T.trim_blank(D.attr_or(e, "alt")) == "").alias("n_missing_alt"),
        D.n(shown, lambda e: F.lower(D.attr_or(e, "loading")) == "lazy").alias("n_lazy"),
        D.n(shown, scripted_lazy).alias("n_scripted_lazy"),
        D.n(shown, lambda e: D.has_text_attr(e, "srcset") & D.has_text_attr(e, "sizes")).alias("n_responsive"),
        F.size(pictures).alias("n_pictures"),
        D.n(pictures, with_fallback).alias("n_fallback"),
        F.size(svgs).alias("n_svg"),
        D.n(svgs, lambda s: ~described(s)).alias("n_svg_bare"),
        D.any_of(F.col("images"), data_alt).alias("data_risk"),
        F.size(D.links_rel("preload", lambda e: F.lower(D.attr_or(e, "as")) == "image", case_free=True)).alias("n_preload"),
        F.size(J.of_type(J.records(), ["ImageObject"])).alias("n_image_objects"),
    )


def audit(pages: DataFrame) -> DataFrame:
    c = F.col
    n, n_urls = c("n_images"), F.size("urls")
    modern = F.size(F.filter("urls", lambda u: P.test(u, _MODERN)))
    unstable = F.size(F.filter("urls", U.has_cache_buster))
    vague = F.size(F.filter("urls", lambda u: ~U.is_descriptive_file(u)))
    verdicts = [
        ([1], Verdict(c("n_missing_alt") == 0, evidence={"images": n, "missing": c("n_missing_alt")})),
        ([2], Verdict(rate(modern, n_urls, 1.0) >= 0.7, evidence={"images": n_urls, "modern": modern})),
        ([3], Verdict(skipped=True, evidence={"reason": F.lit("needs rendering"), "preloaded": c("n_preload")})),
        ([4], Verdict(c("n_fallback") == c("n_pictures"), skipped=c("n_pictures") == 0,
                      evidence={"pictures": c("n_pictures"), "with_fallback": c("n_fallback")})),
        ([5], Verdict(unstable == 0, evidence={"unstable": unstable})),
        ([6], Verdict((c("n_scripted_lazy") == 0) & ((n <= 1) | (c("n_lazy") > 0)),
                      warning=(c("n_scripted_lazy") == 0) & (n > 1) & (c("n_lazy") == 0),
                      evidence={"lazy": c("n_lazy"), "scripted": c("n_scripted_lazy")})),
        ([7], Verdict(rate(c("n_responsive"), n, 1.0) >= 0.7,
                      evidence={"responsive": c("n_responsive"), "ratio": fixed2(rate(c("n_responsive"), n, 1.0))})),
        ([8], Verdict(vague == 0, evidence={"not_descriptive": vague})),
        ([9], Verdict(skipped=True, evidence={"reason": F.lit("needs text recognition")})),
        ([10], Verdict(False, skipped=~c("data_risk"), warning=c("data_risk"), evidence={"data_hint": c("data_risk")})),
        ([11], Verdict(skipped=True, evidence={"reason": F.lit("needs rendering")})),
        ([12], Verdict(c("n_svg_bare") == 0, skipped=c("n_svg") == 0,
                       evidence={"svg": c("n_svg"), "bare": c("n_svg_bare")})),
        ([13], Verdict(c("n_image_objects") > 0, skipped=n == 0, evidence={"records": c("n_image_objects")})),
    ]
    return check_rows(features(pages), ["site_id", "page_id"], IMAGE, verdicts)
