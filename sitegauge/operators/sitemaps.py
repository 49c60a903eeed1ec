"""Sitemap discovery and expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import robots as R
from ..functions import urls as U
from ..functions.dom import resolve_reference
from ..session import stage
from .ranking import first_k

# Addresses tried before the declared ones.
DEFAULT_FILES = ("/sitemap_index.xml", "/sitemap.xml", "/sitemap-index.xml", "/sitemap_index.xml.gz")


def candidates(sites: DataFrame) -> DataFrame:
    """Addresses to try per site, in order; ``sites`` has ``origin`` and ``robots``."""
    declared = F.transform(R.sitemap_lines(F.col("robots")), lambda u: resolve_reference(F.col("origin"), u))
    tried = F.array_distinct(
        F.concat(F.array(*[F.concat("origin", F.lit(p)) for p in DEFAULT_FILES]), declared)
    )
    return sites.select("site_id", F.posexplode(tried).alias("cand_ord", "url")).where(F.col("url") != "")


def sitemap_files(log: DataFrame) -> DataFrame:
    """Kind and locations of every captured file that answered."""
    ok = log.where(F.col("status").between(200, 299)).select(
        F.col("req_url").alias("url"),
        F.col("body").alias("xml"),
        F.coalesce("final_url", "req_url").alias("base"),
    )
    parsed = ok.select("url", "base", R.sitemap_kind(F.col("xml")).alias("kind"), R.locations(F.col("xml")).alias("locs"))
    return parsed.select(
        "url", "kind",
        F.filter(F.transform("locs", lambda u: resolve_reference(F.col("base"), u)), lambda u: u != "").alias("locs"),
    )


def expand(sites: DataFrame, log: DataFrame, max_files: int | None = None, max_depth: int | None = None) -> DataFrame:
    """Files visited per site in depth-first order; ``max_files`` and ``max_depth`` set a budget.

    Index recursion is a loop of joins, one per level. Without ``max_depth`` it goes on until a level is empty; each level is
    written once, and an index that names one of the files above it is not followed again. ``path`` is the visiting
    position, which also gives the file budget its order.
    """
    files = sitemap_files(log)
    level = candidates(sites).select(
        "site_id", "cand_ord", F.array("cand_ord").alias("path"), "url", F.array().cast("array<string>").alias("above")
    )
    visited, depth = None, 0
    while True:
        # a site never visits more than the budget, so later ones of one level need no lookup
        level = first_k(level, ["site_id"], [F.col("path")], max_files)
        found = level.join(files, "url", "left")
        if max_depth is None:
            found = stage(found, "sitemap_level")
        rows = found.drop("above")
        visited = rows if visited is None else visited.unionByName(rows)
        if depth == max_depth or (max_depth is None and found.where(F.col("kind") == "index").isEmpty()):
            return first_k(visited, ["site_id"], [F.col("path")], max_files)
        level = (
            found.where(F.col("kind") == "index")
            .select("site_id", "cand_ord", "path", F.array_append("above", F.col("url")).alias("above"), F.posexplode("locs").alias("pos", "child"))
            .where(~F.array_contains("above", F.col("child")))
            .select("site_id", "cand_ord", F.concat("path", F.array("pos")).alias("path"), F.col("child").alias("url"), "above")
        )
        depth += 1


def site_urls(visited: DataFrame, sites: DataFrame) -> DataFrame:
    """Page addresses of the first candidate that yields any, cleaned and de-duplicated."""
    rows = (
        visited.where(F.col("kind") == "urlset")
        .select("site_id", "cand_ord", "path", F.posexplode("locs").alias("pos", "loc"))
        .select("site_id", "cand_ord", F.struct("path", "pos").alias("place"), U.canonicalize(F.col("loc")).alias("url"))
        .where(F.col("url") != "")
    )
    winner = rows.groupBy("site_id").agg(F.min("cand_ord").alias("cand_ord"))
    distinct = (
        rows.join(winner, ["site_id", "cand_ord"])
        .where(~U.is_media(F.col("url")))
        .groupBy("site_id", "url")
        .agg(F.min("place").alias("place"))
        .withColumn("plain", U.query(F.col("url")) == "")
    )
    any_plain = distinct.groupBy("site_id").agg(F.bool_or("plain").alias("any_plain"))
    kept = distinct.join(any_plain, "site_id").where(F.col("plain") | ~F.col("any_plain"))
    own = sites.select("site_id", U.bare_host(F.col("origin")).alias("own_host"))
    return (
        kept.join(own, "site_id")
        .where(U.bare_host(F.col("url")) == F.col("own_host"))
        .select("site_id", "url", "place")
    )


def summary(visited: DataFrame, urls: DataFrame) -> DataFrame:
    """Found and failed files and number of addresses per site."""
    files = visited.groupBy("site_id").agg(
        F.count_if(F.col("kind").isin("index", "urlset")).cast("int").alias("sitemaps_found"),
        F.count_if(~F.coalesce(F.col("kind"), F.lit("")).isin("index", "urlset")).cast("int").alias("sitemaps_failed"),
    )
    totals = urls.groupBy("site_id").agg(F.count(F.lit(1)).cast("int").alias("total_urls"))
    return files.join(totals, "site_id", "left").withColumn("total_urls", F.coalesce("total_urls", F.lit(0)))


def feed_average_words(body, limit: int | None = None):
    """Rounded mean words of the feed items (of the first ``limit``), 0 without items."""
    items = R.feed_items(body)
    words = F.transform(items if limit is None else F.slice(items, 1, limit), R.feed_item_words)
    total = F.aggregate(words, F.lit(0), lambda acc, x: acc + x)
    return F.when(F.size(words) > 0, F.floor(total / F.size(words) + 0.5).cast("int")).otherwise(0)
