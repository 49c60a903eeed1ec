"""Response-header readers (N15, A3, A5). ``headers`` is a map with lower-case keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .text import text_or_empty, trim_blank


def header(headers: Column, name: str) -> Column:
    return F.coalesce(headers.getItem(name), F.lit(""))


def _number(text: Column) -> Column:
    return F.when(text != "", text).try_cast("bigint")


def hsts_max_age(headers: Column) -> Column:
    value = P.find(header(headers, "strict-transport-security"), r"max-age=(\d+)")
    return F.coalesce(_number(value), F.lit(0).cast("bigint"))


def max_snippet(directives: Column) -> Column:
    """NULL when the directive is absent."""
    return _number(P.find(directives, r"max-snippet\s*:\s*(-?\d+)"))


def max_image_preview(directives: Column) -> Column:
    return F.lower(P.find(directives, r"max-image-preview\s*:\s*([a-z]+)"))


def content_length(headers: Column) -> Column:
    value = header(headers, "content-length")
    return F.coalesce(F.when(value != "", value).try_cast("double"), F.lit(0.0))


def cache_policy_ok(kind: Column, headers: Column) -> Column:
    """Pages must be revalidated soon, every other asset needs a max-age."""
    value = F.lower(header(headers, "cache-control"))
    age = F.coalesce(_number(P.find(value, r"max-age=(\d+)")), F.lit(999999).cast("bigint"))
    page_ok = P.test(value, "no-cache|max-age=0|must-revalidate") | (age <= 3600)
    return (value != "") & F.when(kind == "html", page_ok).otherwise(P.test(value, r"max-age=\d+"))


# Acceptable content type per asset kind.
CONTENT_TYPES = {
    "html": r"text/html|application/xhtml\+xml",
    "css": "text/css",
    "js": "javascript|ecmascript|text/plain",
    "xml": "xml|text/plain",
    "json": "json|text/plain",
    "txt": "text/plain",
    "svg": r"image/svg\+xml|xml|text/plain",
    "image": "image/",
    "font": "font|woff|ttf|otf|octet-stream",
}


def content_type_ok(kind: Column, headers: Column) -> Column:
    value = header(headers, "content-type")
    out = F.lit(True)
    for name, pattern in CONTENT_TYPES.items():
        out = F.when(kind == name, P.test(value, pattern)).otherwise(out)
    return out


# Headers and server names that show an edge cache.
EDGE_HEADERS = (
    "cf-cache-status", "x-cache", "x-vercel-cache", "x-nextjs-cache", "x-served-by", "x-cache-hits", "age", "via",
)
EDGE_SERVERS = "cloudflare|akamai|fastly|cloudfront|vercel|netlify"


def edge_signal(headers: Column) -> Column:
    """First edge-cache header as ``name: value``, ``''`` when none."""
    named = [
        F.when(header(headers, name) != "", F.concat(F.lit(f"{name}: "), header(headers, name)))
        for name in EDGE_HEADERS
    ]
    server = header(headers, "server")
    return F.coalesce(*named, F.when(P.test(server, EDGE_SERVERS), F.concat(F.lit("server: "), server)), F.lit(""))


def link_canonical(headers: Column, strict_quotes: bool = False) -> Column:
    """Canonical of a ``Link`` header; the strict form insists on quotes around the relation."""
    quote = "[\"']" if strict_quotes else "[\"']?"
    gap = "" if strict_quotes else r"\s*"
    return P.find(header(headers, "link"), rf"<([^>]+)>{gap};\s*rel={quote}canonical{quote}")


def is_html_response(headers: Column, body: Column) -> Column:
    """A3: page gate by content type or by the first tag."""
    start = trim_blank(text_or_empty(body))
    return (
        P.test(header(headers, "content-type"), "html|xhtml")
        | start.startswith("<!doctype")
        | start.startswith("<html")
    )


def is_challenge(status: Column, body: Column) -> Column:
    """Answer-engine agent met a challenge page."""
    return F.when(status.isin(403, 503), True).otherwise(
        (status == 200)
        & (F.length(text_or_empty(body)) < 5000)
        & P.test(body, r"\b(captcha|challenge|blocked|cloudflare)\b")
    )


def passes_firewall(status: Column, body: Column) -> Column:
    """R10, large-page form."""
    size = F.length(text_or_empty(body))
    challenged = P.test(body, "captcha|challenge|blocked|access denied") & (size < 10000)
    return F.coalesce((status == 200) & (size > 5000) & ((size > 50000) | ~challenged), F.lit(False))


def has_markup(body: Column) -> Column:
    return P.test(body, r"<html[\s>]|<!doctype html|<body[\s>]|<main[\s>]|<article[\s>]") | (
        trim_blank(F.regexp_replace(text_or_empty(body), r"(?s)<[^>]*>", "")) != ""
    )
