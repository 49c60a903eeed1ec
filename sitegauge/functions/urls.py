"""URL scalars (U1-U15) as built-in string expressions.

URLs are taken apart with one anchored pattern instead of ``parse_url``: a malformed address gives
empty parts rather than an error, which is what every caller below expects.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .text import text_or_empty

_ABSOLUTE = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]*)(:\d*)?([^?#]*)(\?[^#]*)?(#[\s\S]*)?$"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(text_or_empty(url), _ABSOLUTE, group)


def normalize_url(value: Column) -> Column:
    """U1."""
    return F.when(value.startswith("http"), value).otherwise(F.concat(F.lit("https://"), value))


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def host(url: Column) -> Column:
    return F.lower(_part(url, 2))


def bare_host(url: Column) -> Column:
    """Host without a leading ``www.``."""
    return F.regexp_replace(host(url), r"^www\.", "")


def port(url: Column) -> Column:
    raw = _part(url, 3)
    default = ((scheme(url) == "http") & (raw == ":80")) | ((scheme(url) == "https") & (raw == ":443"))
    return F.when(default | (raw == ":"), "").otherwise(raw)


def path(url: Column) -> Column:
    raw = _part(url, 4)
    return F.when((raw == "") & (_part(url, 1) != ""), "/").otherwise(raw)


def query(url: Column) -> Column:
    """Query without the question mark."""
    return F.regexp_replace(_part(url, 5), r"^\?", "")


def origin(url: Column) -> Column:
    return F.when(is_url(url), F.concat(scheme(url), F.lit("://"), host(url), port(url))).otherwise("")


def is_url(url: Column) -> Column:
    return text_or_empty(url).rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#:\s]+")


def _sorted_query(raw: Column) -> Column:
    # array_sort with a comparator is stable, so equal keys keep their order
    def by_key(a: Column, b: Column) -> Column:
        left, right = F.split_part(a, F.lit("="), F.lit(1)), F.split_part(b, F.lit("="), F.lit(1))
        return F.when(left < right, -1).when(left > right, 1).otherwise(0)

    pairs = F.filter(F.split(raw, "&"), lambda p: p != "")
    return F.array_join(F.array_sort(pairs, by_key), "&")


def canonicalize(url: Column) -> Column:
    """Hash dropped, query sorted by key, malformed addresses empty."""
    q = _sorted_query(query(url))
    rebuilt = F.concat(origin(url), path(url), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))
    return F.when(is_url(url), rebuilt).otherwise("")


def comparable_url(url: Column) -> Column:
    """U8, first form: canonical address without a last slash."""
    return F.regexp_replace(F.when(is_url(url), canonicalize(url)).otherwise(text_or_empty(url)), "/$", "")


def comparable_page(url: Column) -> Column:
    """U8, second form: the query is dropped too."""
    bare = F.concat(origin(url), path(url))
    return F.regexp_replace(F.when(is_url(url), bare).otherwise(text_or_empty(url)), "/$", "")


def same_site(left: Column, right: Column) -> Column:
    """U4: hosts agree apart from ``www.``."""
    return is_url(left) & is_url(right) & (bare_host(left) == bare_host(right))


def root_domain(host_: Column) -> Column:
    """The last two labels."""
    labels = F.split(F.lower(F.regexp_replace(text_or_empty(host_), r"^www\.", "")), r"\.")
    return F.array_join(
        F.when(F.size(labels) > 2, F.slice(labels, -2, 2)).otherwise(labels), "."
    )


def domain_from_email(email: Column) -> Column:
    """U6."""
    return F.lower(F.split_part(text_or_empty(email), F.lit("@"), F.lit(2)))


def domain_from_url(value: Column) -> Column:
    """U7, with the textual fallback."""
    full = normalize_url(text_or_empty(value))
    cut = F.regexp_replace(F.regexp_replace(text_or_empty(value), "^https?://", ""), r"^www\.", "")
    return F.when(is_url(full), bare_host(full)).otherwise(F.lower(F.split_part(cut, F.lit("/"), F.lit(1))))


def same_path(left: Column, right: Column) -> Column:
    """Paths agree apart from a last slash; malformed addresses never do."""
    trimmed = [F.regexp_replace(path(u), "/$", "") for u in (left, right)]
    return is_url(left) & is_url(right) & (trimmed[0] == trimmed[1])


def is_crawlable(url: Column) -> Column:
    """U10, link form."""
    return ~P.test(url, r"\.(pdf|jpg|jpeg|png|gif|webp|avif|svg|zip|docx?|xlsx?|pptx?|mp4|mov)(\?|$)")


def is_media(url: Column) -> Column:
    """U10, sitemap form."""
    return P.test(
        url,
        r"\.(?:jpe?g|png|gif|webp|avif|svg|pdf|mp4|mov|avi|webm|mp3|wav|zip|rar|7z|docx?|xlsx?|pptx?)(?:[?#]|$)",
    )


# Fixed values: (kind, file-name pattern, content-type pattern), first match wins.
ASSET_KINDS = (
    ("html", None, "html"),
    ("css", r"\.css$", "css"),
    ("js", r"\.m?js$", "javascript|ecmascript|x-javascript"),
    ("json", r"\.json$", "json"),
    ("xml", r"\.xml$|sitemap|feed|atom|rss", "xml"),
    ("txt", r"\.txt$", "text/plain"),
    ("svg", r"\.svg$", "svg"),
    ("image", r"\.(png|jpe?g|gif|webp|avif|ico)$", "image/"),
    ("font", r"\.(woff2?|ttf|otf|eot)$", "font|woff|ttf|otf"),
)
TEXT_KINDS = ("css", "js", "json", "xml", "txt", "svg")


def _first_kind(value: Column, which: int) -> Column:
    out = F.lit("other")
    for entry in reversed(ASSET_KINDS):
        if entry[which]:
            out = F.when(P.test(value, entry[which]), entry[0]).otherwise(out)
    return out


def asset_kind(url: Column) -> Column:
    """U11 by file name."""
    return _first_kind(F.lower(F.regexp_extract(text_or_empty(url), r"^[^?#]*", 0)), 1)


def content_kind(content_type: Column) -> Column:
    """U11 by content type."""
    return _first_kind(content_type, 2)


def file_name(url: Column) -> Column:
    """Last non-empty path segment of an absolute or relative address."""
    only_path = F.regexp_replace(
        F.regexp_extract(text_or_empty(url), r"^[^?#]*", 0), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/]*", ""
    )
    parts = F.filter(F.split(only_path, "/"), lambda p: p != "")
    return F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))


def is_descriptive_file(url: Column) -> Column:
    """N8, strict form."""
    name = F.regexp_replace(file_name(url), r"(?i)\.[a-z0-9]+$", "")
    stock = P.test(name, r"^(image|img|photo|pic|screenshot|untitled|dsc|px|spacer|blank)[-_]?\d*$")
    return (F.length(name) >= 8) & ~stock & P.test(name, "[a-z]{3,}[-_][a-z0-9]{2,}")


def is_generic_file(url: Column) -> Column:
    """N8, generic form."""
    name = F.regexp_replace(file_name(url), r"(?i)\.[a-z0-9]+$", "")
    return P.test(name, r"^(img|image|photo|pic|screenshot)[-_]?\d+$")


def path_words(url: Column) -> Column:
    """Decoded path with separators as blanks."""
    decoded = F.coalesce(F.try_url_decode(path(url)), path(url))
    return F.regexp_replace(F.when(is_url(url), decoded).otherwise(text_or_empty(url)), "[-_]+", " ")


def query_keys(url: Column) -> Column:
    pairs = F.filter(F.split(query(url), "&"), lambda p: p != "")
    return F.transform(pairs, lambda p: F.split_part(p, F.lit("="), F.lit(1)))


# Query parameters looked for.
TRACKING_PARAMS = ("utm_source", "utm_medium", "utm_campaign", "gclid", "fbclid", "msclkid")
TRAP_PARAMS = ("sort", "filter", "color", "size", "page", "q", "s")


def _has_param(url: Column, names: tuple[str, ...]) -> Column:
    return F.arrays_overlap(query_keys(url), F.array(*[F.lit(n) for n in names]))


def has_tracking_param(url: Column) -> Column:
    """U13."""
    return is_url(url) & _has_param(url, TRACKING_PARAMS)


def trap_params(url: Column) -> Column:
    return F.array_intersect(F.array(*[F.lit(n) for n in TRAP_PARAMS]), query_keys(url))


def is_search_url(url: Column) -> Column:
    keys = query_keys(url)
    named = F.array_contains(keys, "q") & P.test(path(url), "search")
    return is_url(url) & (P.test(path(url), r"/search/?$") | F.array_contains(keys, "s") | named)


def has_cache_buster(url: Column) -> Column:
    return F.exists(
        query_keys(F.when(is_url(url), url).otherwise(F.concat(F.lit("https://x.invalid/"), text_or_empty(url)))),
        lambda k: P.test(k, "^(v|ver|version|cache|cachebuster|cb|t|time|timestamp|rand|random)$"),
    )


def toggle_www(url: Column) -> Column:
    """The same address on the other host variant."""
    other = F.when(host(url).startswith("www."), bare_host(url)).otherwise(F.concat(F.lit("www."), host(url)))
    q = _part(url, 5)
    return F.concat(scheme(url), F.lit("://"), other, port(url), path(url), q)


def with_www(url: Column) -> Column:
    """Scheme and ``www.`` host only."""
    return F.concat(scheme(url), F.lit("://www."), bare_host(url))


def toggle_slash(url: Column) -> Column:
    return F.when(url.endswith("/"), F.regexp_replace(url, "/$", "")).otherwise(F.concat(url, F.lit("/")))


def upper_path(url: Column) -> Column:
    return F.concat(origin(url), F.upper(path(url)))


def with_http(url: Column) -> Column:
    return F.regexp_replace(url, "(?i)^https:", "http:")


def srcset_urls(srcset: Column) -> Column:
    """Addresses of a ``srcset`` value, unresolved."""
    parts = F.transform(F.split(text_or_empty(srcset), ","), lambda p: F.trim(p))
    return F.filter(F.transform(parts, lambda p: F.split(p, f"{P.BLANK}+")[0]), lambda p: p != "")
