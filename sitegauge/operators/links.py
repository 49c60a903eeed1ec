"""Link and lookup joins.

What the audits ask the network for is a table of wanted addresses per site and role; the answers
are rows of the fetch log. Wanted rows of all roles go through one equi-join on the address, so the
log is shuffled once however many roles there are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dom as D
from ..functions import headers as H
from ..functions import text as T
from ..functions import urls as U
from ..session import large
from ..sources.captures import one_per_url, one_row


def assign_order(pages: DataFrame) -> DataFrame:
    """Crawl order and home page per site where the capture does not state them.

    The home page is found by a partial minimum, not by sorting a site.
    """
    depth = F.coalesce(F.col("depth"), F.lit(0)) if "depth" in pages.columns else F.lit(0)
    ordered = pages if "ord" in pages.columns else pages.withColumn(
        "ord", depth.cast("bigint") * F.lit(1 << 40) + F.col("page_id")
    )
    if "is_primary" in ordered.columns:
        return ordered
    home = ordered.groupBy("site_id").agg(F.min("ord").alias("_home"))
    return ordered.join(large(home), "site_id").withColumn("is_primary", F.col("ord") == F.col("_home")).drop("_home")


def link_rows(pages: DataFrame, base: str = "final_url") -> DataFrame:
    """H5 as rows: every resolved link with its position, text and whether it stays on the site."""
    site = U.bare_host(F.col(base))
    return (
        pages.select("site_id", "page_id", "ord", site.alias("site_host"), F.explode("anchors").alias("a"))
        .where(F.coalesce(F.col("a.abs"), F.lit("")) != "")
        .select(
            "site_id", "page_id",
            F.struct("ord", F.col("a.ord").alias("pos")).alias("place"),
            F.col("a.abs").alias("url"),
            F.lower(T.trim_blank(F.col("a.text"))).alias("text"),
            (F.col("a.host") == F.col("site_host")).alias("internal"),
        )
    )


def asset_rows(pages: DataFrame, base: str = "final_url") -> DataFrame:
    """H6: distinct assets per site with their first position."""
    return (
        pages.select("site_id", "ord", F.posexplode(D.assets(F.col(base))).alias("pos", "a"))
        .select("site_id", F.struct("ord", "pos").alias("place"), "a.url", "a.kind")
        .groupBy("site_id", "url")
        .agg(F.min("place").alias("place"), F.min_by("kind", "place").alias("kind"))
    )


def wanted_rows(sites: DataFrame, roles: Mapping[str, Column], key: str = "site_id") -> DataFrame:
    """One row per site and role with a non-empty address."""
    pairs = F.array(*[F.struct(F.lit(r).alias("role"), u.alias("req_url")) for r, u in roles.items()])
    return (
        sites.select(key, F.explode(pairs).alias("w"))
        .select(key, "w.role", "w.req_url")
        .where(F.coalesce(F.col("req_url"), F.lit("")) != "")
    )


def answer(wanted: DataFrame, facts: DataFrame, url: str = "req_url") -> DataFrame:
    """Wanted addresses with what is known about them; unknown ones keep NULLs."""
    return wanted.join(large(facts), url, "left")


def by_role(answered: DataFrame, roles: Sequence[str], columns: Sequence[str], key: str = "site_id") -> DataFrame:
    """Back to one row per site: a struct column per role."""
    packed = F.struct(*columns)
    return answered.groupBy(key).agg(
        *[F.first(F.when(F.col("role") == r, packed), ignorenulls=True).alias(r) for r in roles]
    )


def page_facts(parsed: DataFrame, url: str = "url") -> DataFrame:
    """Index-related facts of every parsed page, one row per address."""
    headers = F.col("headers") if "headers" in parsed.columns else F.create_map().cast("map<string,string>")
    robots_header = H.header(headers, "x-robots-tag")
    joined = F.concat(D.meta_robots_joined("robots", "googlebot", "bingbot"), F.lit(","), robots_header)
    first = F.concat(F.lower(robots_header), F.lit(" "), D.meta_robots_first())
    rows = parsed.select(
        F.col(url).alias("req_url"),
        F.col("status") if "status" in parsed.columns else F.lit(200).alias("status"),
        joined.alias("directives"),
        (~F.contains(first, F.lit("noindex"))).alias("allows_index"),
        joined.rlike(r"(?i)(^|,|\s)noindex(,|\s|$)").alias("noindex"),
        D.canonical_tag().alias("canonical_tag"),
        D.canonical_combined(H.link_canonical(headers, strict_quotes=True)).alias("canonical"),
        T.word_count(F.col("body_text")).alias("words"),
    )
    return one_row(rows, ("req_url",))


def canonical_chain(starts: DataFrame, facts: DataFrame, steps: int = 3, key: str = "site_id") -> DataFrame:
    """Hops along canonicals with loop detection in a bounded number of joins.

    ``starts`` has ``key`` and ``canonical``. A chain that has ended leaves the joins: its rows are set aside and
    united with the rest at the end, so no join has null keys.
    """
    edges = facts.select(F.col("req_url").alias("at"), F.col("canonical_tag").alias("next"))
    state = starts.select(
        key, F.when(F.col("canonical") != "", F.col("canonical")).alias("at"), F.lit(0).alias("hops"),
        F.array().cast("array<string>").alias("seen"), F.lit(False).alias("loop"),
    )
    ended = state.where(F.col("at").isNull()).select(key, "hops", "loop")
    state = state.where(F.col("at").isNotNull())
    for _ in range(steps):
        again = F.coalesce(F.array_contains("seen", F.col("at")), F.lit(False))
        looped = state.select(
            key, F.when(~again, F.col("at")).alias("at"),
            F.when(again, F.col("hops") + 1).otherwise(F.col("hops")).alias("hops"),
            F.when(F.col("at").isNotNull() & ~again, F.array_append("seen", F.col("at"))).otherwise(F.col("seen")).alias("seen"),
            (F.col("loop") | again).alias("loop"),
        )
        moved = F.coalesce(F.col("next"), F.lit(""))
        on = (moved != "") & (moved != F.col("at"))
        ended = ended.unionByName(looped.where(F.col("at").isNull()).select(key, "hops", "loop"))
        state = looped.where(F.col("at").isNotNull()).join(large(edges), "at", "left").select(
            key, F.when(on, F.col("next")).alias("at"),
            (F.col("hops") + F.when(on, 1).otherwise(0)).alias("hops"), "seen", "loop",
        )
        ended = ended.unionByName(state.where(F.col("at").isNull()).select(key, "hops", "loop"))
        state = state.where(F.col("at").isNotNull())
    return ended.unionByName(state.select(key, "hops", "loop"))


def orphan_pages(pages: DataFrame, links: DataFrame, url: str = "final_url") -> DataFrame:
    """Pages other than the home page that no internal link points to."""
    targets = links.where(F.col("internal")).select("site_id", U.canonicalize(F.col("url")).alias("key")).distinct()
    candidates = pages.where(~F.col("is_primary")).withColumn("key", U.canonicalize(F.col(url)))
    return candidates.join(large(targets), ["site_id", "key"], "left_anti").drop("key")


def agents_side_by_side(log: DataFrame, agents: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Answers to several user agents as columns of one row per address."""
    rows = one_per_url(log.where(F.col("user_agent").isin(*agents)), ("req_url", "user_agent"))
    packed = F.struct(*columns)
    return rows.groupBy("req_url").agg(
        *[F.first(F.when(F.col("user_agent") == a, packed), ignorenulls=True).alias(f"agent_{i}") for i, a in enumerate(agents)]
    )
