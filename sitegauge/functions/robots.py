"""Robots and sitemap text readers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .text import text_or_empty, trim_blank


def groups(robots: Column) -> Column:
    """Text blocks, each starting at a user-agent line."""
    blocks = F.split(text_or_empty(robots), r"\n(?=(?i:user-agent)[\t ]*:)")
    return F.filter(F.transform(blocks, trim_blank), lambda g: g != "")


def group_agents(group: Column) -> Column:
    names = P.find_all(group, r"^user-agent[\t ]*:[\t ]*(.+)$", 1, "im")
    return F.transform(names, lambda a: F.lower(trim_blank(a)))


def group_blocks_all(group: Column) -> Column:
    rules = P.find_all(group, r"^disallow[\t ]*:[\t ]*(.*)$", 1, "im")
    return F.array_contains(F.transform(rules, trim_blank), "/")


def allows(robots: Column, bot: Column) -> Column:
    """No group naming the bot or ``*`` has exactly ``Disallow: /``."""
    name = F.lower(bot)

    def blocked(group: Column) -> Column:
        agents = group_agents(group)
        named = F.array_contains(agents, "*") | F.exists(agents, lambda a: a == name)
        return named & group_blocks_all(group)

    return ~F.exists(groups(robots), blocked)


def group_for(robots: Column, bot: Column) -> Column:
    """R2: text of the first group that names the bot itself."""
    name = F.lower(bot)
    hits = F.filter(groups(robots), lambda g: F.exists(group_agents(g), lambda a: a == name))
    return F.coalesce(F.get(hits, 0), F.lit(""))


def sitemap_lines(robots: Column) -> Column:
    """Declared sitemap addresses in order."""
    return F.transform(P.find_all(robots, r"^sitemap:[\t ]*(.+)$", 1, "im"), trim_blank)


def blocks_search(robots: Column) -> Column:
    """R9."""
    return P.test(robots, r"^disallow:\s*(/search/?|/?\?s=|\*?\?s=)", "im")


def clean_xml(text: Column) -> Column:
    plain = F.regexp_replace(text_or_empty(text), r"^\x{feff}", "")
    return trim_blank(F.regexp_replace(plain, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"))


def sitemap_kind(xml: Column) -> Column:
    """``index``, ``urlset`` or ``invalid``."""
    text = clean_xml(xml)
    head = F.lower(F.substring(text, 1, 500))
    is_page = head.startswith("<!doctype html") | head.startswith("<html") | P.test(head, r"<body[\s>]")
    return (
        F.when((text == "") | is_page, "invalid")
        .when(P.test(text, r"<(?:[\w.-]+:)?urlset(?![\w])"), "urlset")
        .when(P.test(text, r"<(?:[\w.-]+:)?sitemapindex(?![\w])"), "index")
        .otherwise("invalid")
    )


def locations(xml: Column) -> Column:
    raw = P.find_all(xml, r"<(?:[\w.-]+:)?loc(?![\w])[^>]*>\s*(.*?)\s*</(?:[\w.-]+:)?loc>", 1, "is")
    return F.filter(F.transform(raw, clean_xml), lambda u: u != "")


def lastmod_complete(xml: Column) -> Column:
    """Every ``url`` element has a ``lastmod``."""
    entries = P.find_all(xml, r"<url(?![\w])[^>]*>(.*?)</url>", 1, "s")
    return F.forall(entries, lambda e: P.test(e, r"<lastmod(?![\w])", ""))


def feed_items(xml: Column) -> Column:
    return P.find_all(xml, r"<(item|entry)(?![\w])[^>]*>(.*?)</\1>", 2, "s")


def feed_item_words(item: Column) -> Column:
    """Words of the content-like children of one feed item."""
    from .text import word_count

    parts = P.find_all(
        item, r"<(content:encoded|encoded|content|summary|description)(?![\w:])[^>]*>(.*?)</\1>", 2, "s"
    )
    plain = F.regexp_replace(F.array_join(F.transform(parts, clean_xml), ""), r"(?s)<[^>]*>", "")
    return word_count(plain)


def index_key_candidates(origin: Column, robots: Column, html: Column) -> Column:
    """Key-file addresses from robots.txt and the page."""
    declared = trim_blank(P.find(robots, r"^key-location:\s*(.+)$", 1, "im"))
    slash = F.when(declared.startswith("/"), "").otherwise("/")
    absolute = F.when(declared.startswith("http"), declared).otherwise(F.concat(origin, slash, declared))
    first = F.when(declared != "", F.array(absolute)).otherwise(F.array().cast("array<string>"))
    explicit = P.find_all(html, r"https?://[^\"'\s]+/[a-f0-9-]{8,}\.txt")
    return F.array_distinct(F.concat(first, explicit))
