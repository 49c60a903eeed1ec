"""The public call: all audits over all sites of a capture."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import reports as REP
from ..operators import scoring as S
from ..operators import sitemaps
from ..operators.classify import classify_pages
from ..operators.links import answer, orphan_pages, link_rows, wanted_rows
from ..operators.recommend import classification_recommendation, recommend
from ..session import stage
from ..sources.captures import one_per_url, validate_sites
from . import answer_engine, eeat, facts as facts_module, image, indexability, on_page, structured_data, technical, trust
from .rules import definitions, describe

# The audits that judge every captured page.
PAGE_AUDITS = (S.STRUCTURED, S.ON_PAGE, S.IMAGE)


def check_definitions(spark: SparkSession) -> DataFrame:
    """All 448 published checks."""
    tables = [
        definitions(spark, S.TECHNICAL, technical.definitions_of(technical.rules()), technical.CATEGORY_ORDER),
        definitions(spark, S.ANSWER, answer_engine.DEFS, answer_engine.CATEGORY_ORDER),
    ] + [
        definitions(spark, name, module.DEFS)
        for name, module in (
            (S.INDEX, indexability), (S.STRUCTURED, structured_data), (S.ON_PAGE, on_page), (S.IMAGE, image),
            (S.EXPERTISE, eeat), (S.TRUST, trust),
        )
    ]
    return union_all(tables)


def sitemap_addresses(facts: facts_module.Facts, max_files: int | None = None) -> DataFrame:
    """R3-R6 for every site of the capture."""
    origin = U.origin(F.col("url"))
    home = facts.home.select("site_id", "url", origin.alias("origin"))
    robots = answer(wanted_rows(home, {"robots": F.concat("origin", F.lit("/robots.txt"))}), facts.answers)
    sites = home.join(robots.select("site_id", "robots_text"), "site_id", "left").select(
        "site_id", "origin", F.coalesce("robots_text", F.lit("")).alias("robots")
    )
    plain = facts.log.where(
        F.col("user_agent").isNull() & (F.coalesce("redirect_mode", F.lit("follow")) == "follow")
        & F.col("body").rlike(r"<(?:[\w.-]+:)?(urlset|sitemapindex)")
    ).select("req_url", "final_url", "status", "body", "fetched_at")
    plain = one_per_url(plain)
    return sitemaps.site_urls(sitemaps.expand(sites, plain, max_files), sites)


def check_results(facts: facts_module.Facts, as_of: Column, compat: bool = False) -> dict[str, DataFrame]:
    """Long check rows per audit. The audits stay separate plans: each is small enough to re-plan quickly."""
    addresses = sitemap_addresses(facts)
    default_log = facts.parsed_log.where(F.col("user_agent").isNull() & (F.col("redirect_mode") == "follow"))
    shared = ["url", "status", "body_text", "anchors", "images", "nodes", "headings", "tag_counts"]
    captured = facts.pages.select(*shared).unionByName(default_log.select(*shared))
    home = facts.home
    return {
        S.TECHNICAL: technical.audit(facts, as_of),
        S.ANSWER: answer_engine.audit(facts, addresses),
        S.INDEX: indexability.audit(
            home, facts.index, facts.answers.select("req_url", "status"), facts.manual, addresses, compat=compat
        ),
        S.STRUCTURED: structured_data.audit(facts.pages),
        S.ON_PAGE: on_page.audit(facts.pages),
        S.IMAGE: image.audit(facts.pages),
        S.EXPERTISE: eeat.audit(home, eeat.target_facts(captured)),
        S.TRUST: trust.audit(home, facts.sites, trust.target_texts(captured), as_of),
    }


def one_row_per_check(rows: DataFrame, home: DataFrame) -> DataFrame:
    """Page checks of a site as one row per check: the worst state of its pages, shown by the home page or the least page id.

    A failed page comes before a warned, a passed and a skipped one.
    """
    state = F.when(F.col("skipped"), 3).when(F.col("passed") & ~F.col("warning"), 2).when(F.col("warning"), 1).otherwise(0)
    first = home.select("site_id", F.col("page_id").alias("home_id")).dropDuplicates(["site_id"])
    place = F.struct(state, F.coalesce(F.col("page_id") != F.col("home_id"), F.lit(True)), "page_id")
    kept = [c for c in rows.columns if c not in ("site_id", "audit", "check_id")]
    return rows.join(first, "site_id", "left").groupBy("site_id", "audit", "check_id").agg(
        F.min_by(F.struct(*kept), place).alias("row")).select("site_id", "audit", "check_id", "row.*").select(rows.columns)


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def audit(
    spark: SparkSession, inputs: dict[str, DataFrame], as_of: datetime, staged: bool = True, compat: bool = False
) -> dict[str, DataFrame]:
    """Audit every site of ``inputs``.

    ``inputs`` needs ``sites`` and ``pages``; ``fetch_log``, ``tls_certs``, ``lab_vitals`` and
    ``rendered_pages`` are optional. ``as_of`` stands for "now", so a run can be repeated. With
    ``staged`` the parsed pages and the check rows are written once to the shared folder and read
    back, which keeps later reads narrow and survives lost executors.

    The page audits run on all captured pages: ``page_check_results`` has their rows, scores and categories count
    them all, and ``check_results`` and the reports show one row per site and check, of the worst page.
    """
    keep = (lambda df, name: stage(df, name)) if staged else (lambda df, name: df)
    moment = F.lit(as_of).cast("timestamp")
    sites, rejected = validate_sites(inputs["sites"])
    facts = facts_module.build(spark, {**inputs, "sites": sites}, staged)
    defs = check_definitions(spark)
    described = {
        name: keep(describe(rows, defs), f"check_results_{name}") for name, rows in check_results(facts, moment, compat).items()
    }
    page_checks = union_all([described[name] for name in PAGE_AUDITS])
    site_checks = [rows for name, rows in described.items() if name not in PAGE_AUDITS]
    every = union_all([*site_checks, page_checks])
    checks = union_all([*site_checks, keep(one_row_per_check(page_checks, facts.home), "page_checks_folded")])
    order = defs.select("audit", "category", "category_ord").distinct()
    categories = keep(S.category_summary(every).join(F.broadcast(order), ["audit", "category"]), "category_scores")
    scores = keep(S.with_missing_audits(S.audit_scores(every), sites), "audit_scores")
    home = facts.home
    classified = keep(
        classify_pages(home).join(home.select("page_id", "site_id"), "page_id").drop("page_id"), "classifications"
    )
    failed = checks.where((F.col("audit") == S.TECHNICAL) & ~F.col("passed"))
    advice = keep(recommend(failed).unionByName(classification_recommendation(classified)), "recommendations")
    tabs = REP.audit_tabs(categories, scores)
    report = REP.public_report(sites, scores, categories, checks, classified, advice)
    counts = S.opportunity_counts(checks.where(F.col("audit") == S.ANSWER))
    return {
        "rejected_sites": rejected,
        "page_features": facts.pages,
        "check_results": checks,
        "page_check_results": page_checks,
        "category_scores": categories,
        "audit_scores": scores,
        "classifications": classified,
        "recommendations": advice,
        "citation_details": REP.citation_details(checks.where(F.col("audit") == S.ANSWER), facts.pages.select("site_id", "url", "ord")),
        "audit_tabs": tabs,
        "orphans": orphan_pages(facts.pages, link_rows(facts.pages)).select("site_id", "page_id", "final_url"),
        "csv_rows": REP.csv_rows(scores, categories, sites, counts),
        "reports": report,
    }
