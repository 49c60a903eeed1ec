"""Report tables (P4-P10, AG12, AG17, AG18, A6-A7 projections)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import small_table

from ..functions.numbers import clamp_score
from . import scoring as S
from .ranking import first_k

# Categories behind the two citation views and the crawlability view.
CHAT_CITATION = ("Crawlability", "Technical Access", "Content Structure", "Content Quality")
GEMINI_CITATION = (
    "Gemini Crawlability", "Local & E-Commerce", "Schema & Technical", "Media & Visuals", "Robots & Bot Access",
    "AI Discovery Files",
)
CRAWLABILITY = ("Robots.txt & Sitemap", "Indexability & Crawlability", "Internal Linking", "AI Crawl Readiness")

# Advice per answer-engine check id.
CITATION_ADVICE = {
    38: "Allow OAI-SearchBot in robots.txt so ChatGPT search can crawl public pages.",
    39: "Allow ChatGPT-User in robots.txt for user-triggered browsing and citations.",
    40: "Separate GPTBot training rules from OAI-SearchBot and ChatGPT-User access rules.",
    41: "Allow OAI user agents through WAF, bot protection, and challenge pages.",
    42: "Make citable page content visible without login, interstitials, or paywalls.",
    49: "Create alternatives pages for high-intent comparison queries.",
    50: "Create use-case or industry pages that map the offer to specific buyer situations.",
    52: "Complete Product schema with name plus offers, reviews, or aggregate ratings where applicable.",
    54: "Show reviews from diverse sources or multiple trust platforms.",
    55: "Link merchant trust pages such as privacy, terms, refund, warranty, shipping, contact, and secure payment.",
    65: "Remove nosnippet, max-snippet:0, X-Robots-Tag restrictions, and data-nosnippet from citable content.",
    66: "Ensure OAI-SearchBot receives raw HTML content comparable to normal page content.",
    67: "Allow Google-Extended in robots.txt when Gemini citation visibility is desired.",
    68: "Allow Google-Extended through WAF, bot protection, and challenge rules.",
    69: "Review server/WAF IP allow rules; true Google IP verification needs manual network testing.",
    70: "Keep business name, address, and phone consistent across homepage, contact page, footer, and schema.",
    71: "Ensure cookie consent does not replace the crawlable raw HTML body.",
    72: "Render JSON-LD schema server-side instead of injecting it only after JavaScript.",
    73: "Allow GoogleOther in robots.txt for Google systems that support AI and search features.",
    74: "Add speakable schema only where the content is appropriate for voice-style extraction.",
    75: "Replace stock imagery with original images where trust and citation quality matter.",
    76: "Add meaningful alt text to images that communicate important page content.",
    77: "Add VideoObject schema for embedded videos on key pages.",
    78: "Publish crawlable transcript or caption text that aligns with the visible page content.",
    79: "Remove noindex directives from meta robots, X-Robots-Tag, and canonical targets for pages meant to rank.",
    80: "Use a self-referencing canonical on the indexable page.",
    81: "Use an absolute https canonical URL.",
    82: "Point canonical URLs directly to pages that return HTTP 200.",
    83: "Avoid canonical chains; point directly to the final canonical target.",
    84: "Keep HTTP Link canonical and HTML canonical consistent, or remove the header canonical.",
    85: "Do not canonicalize indexable pages to a noindexed target.",
    86: "Remove nosnippet directives from pages that should be eligible for rich extraction.",
    87: "Avoid max-snippet:0 or very low max-snippet values on key pages.",
    88: "Remove data-nosnippet from substantial key content.",
    89: "Allow image previews with max-image-preview:large or no restrictive directive.",
    90: "Redirect HTTP requests to HTTPS with a permanent redirect.",
    91: "Choose one canonical host variant and redirect the other consistently.",
    92: "Expose substantial content without login or paywall gates.",
    93: "Keep hidden text below spam-risk thresholds.",
    94: "Ensure cookie consent does not block crawlable page content.",
    95: "Remove scripts that manipulate browser history in ways that trap users.",
    96: "Provide crawlable pagination when using infinite-scroll style interfaces.",
    97: "Add valid hreflang alternates with x-default and self-reference for multilingual pages.",
    98: "Handle paginated pages with clear pagination links and canonicals.",
    99: "Return a real 404/410 for missing pages instead of a soft-404 200 response.",
    100: "Canonicalize parameter URLs to clean equivalents.",
    101: "Verify Google index coverage in Google Search Console.",
    102: "Verify Bing index coverage in Bing Webmaster Tools.",
    103: "Remove noindexed URLs from XML sitemaps.",
}
DEFAULT_ADVICE = "Review this failed citation-readiness signal on key pages."

# Check ids counted by each lead metric.
LEAD_METRICS = (
    ("AI Decision Coverage", "ai_decision_coverage", (77, 78, 79, 80, 81, 82, 85, 91, 107, 113, 114)),
    ("Brand Authority", "brand_authority", (67, 68, 69, 70, 80, 81, 92, 93, 94, 95, 110, 111, 113)),
    ("Entity Strength", "entity_strength", (77, 78, 79, 80, 81, 82, 87, 88, 89, 100, 105)),
    ("Search Readiness", "search_readiness",
     (1, 2, 5, 6, 9, 10, 11, 12, 16, 17, 18, 19, 20, 21, 24, 27, 28, 32, 35, 46, 49, 53, 56, 59, 72, 73, 96, 97, 107)),
)


def advice_table(spark: SparkSession) -> DataFrame:
    return small_table(spark, list(CITATION_ADVICE.items()), "check_id int, advice string")


def citation_details(checks: DataFrame, pages: DataFrame, key: str = "site_id", samples: int = 3) -> DataFrame:
    """Failed and skipped citation checks with advice, affected pages and sample addresses.

    Page totals and samples are gathered once per site, not once per check.
    """
    spark = checks.sparkSession
    wanted = checks.where(F.col("category").isin(*CHAT_CITATION, *GEMINI_CITATION)).where(
        F.col("skipped") | ~F.col("passed")
    )
    counts = pages.groupBy(key).agg(F.count(F.lit(1)).cast("int").alias("n_pages"))
    picked = first_k(pages.select(key, "url", "ord"), [key], [F.col("ord"), F.col("url")], samples)
    urls = picked.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "url"))), lambda s: s["url"]).alias("sample_urls")
    )
    return (
        wanted.join(F.broadcast(advice_table(spark)), "check_id", "left")
        .join(counts, key, "left")
        .join(urls, key, "left")
        .select(
            key, "check_id", "name", "category", "severity", "skipped",
            F.when(~F.col("skipped"), F.coalesce("advice", F.lit(DEFAULT_ADVICE))).alias("advice"),
            F.when(~F.col("skipped"), F.coalesce("n_pages", F.lit(0))).alias("affected_pages"),
            F.when(~F.col("skipped"), F.col("sample_urls")).alias("sample_urls"),
        )
    )


def failed_by_metric(checks: DataFrame, key: str = "site_id") -> DataFrame:
    """AG12: failed technical checks per lead metric (a check may count for several)."""
    rows = [(i, label, check_id) for i, (label, _, ids) in enumerate(LEAD_METRICS) for check_id in ids]
    mapping = small_table(checks.sparkSession, rows, "metric_ord int, metric string, check_id int")
    return (
        checks.join(F.broadcast(mapping), "check_id")
        .groupBy(key, "metric_ord", "metric")
        .agg(S.count_if(~F.col("passed")).alias("failed"))
    )


def lead_metrics(checks: DataFrame, scores: DataFrame, key: str = "site_id") -> DataFrame:
    """P10: failed counts with the score-dependent floor; ``scores`` are the caller's four columns."""
    long = scores.select(
        key,
        F.explode(
            F.array(*[
                F.struct(F.lit(i).alias("metric_ord"), F.lit(label).alias("metric"), F.col(column).alias("score"))
                for i, (label, column, _) in enumerate(LEAD_METRICS)
            ])
        ).alias("m"),
    ).select(key, "m.*")
    return (
        long.join(failed_by_metric(checks, key).drop("metric"), [key, "metric_ord"], "left")
        .withColumn("failed", F.coalesce("failed", F.lit(0)))
        .withColumn("opportunities", F.greatest(S.opportunity_floor(F.col("score")), F.col("failed")))
    )


def issue_summary(recommendations: DataFrame, scores: DataFrame, key: str = "site_id") -> DataFrame:
    """Opportunities by priority with their floors; ``scores`` has ``visibility_score``."""
    found = recommendations.groupBy(key).agg(
        *[
            S.count_if(F.col("priority") == f"{name} Priority").alias(f"n_{name.lower()}")
            for name in ("High", "Medium", "Low")
        ],
        F.count(F.lit(1)).cast("int").alias("n_found"),
    )
    score = F.col("visibility_score")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = scores.select(key, "visibility_score").join(found, key, "left").select(
        key,
        "visibility_score",
        F.greatest(S.opportunity_floor(score), zero("n_high")).alias("high"),
        F.greatest(F.when(score < 70, 2).otherwise(1), zero("n_medium")).alias("medium"),
        zero("n_low").alias("low"),
        zero("n_found").alias("n_found"),
    )
    visible = F.col("high") + F.col("medium") + F.col("low")
    return out.select(
        key, "visibility_score", "high", "medium", "low",
        F.greatest(F.lit(0), F.greatest(visible, F.col("n_found")) - 3).alias("additional"),
    )


def impact_of_index(index: Column, high: Column, medium: Column) -> Column:
    """Impact of the n-th opportunity of a report."""
    return F.when(index < high, "high").when(index < high + medium, "medium").otherwise("low")


# Audit tabs in display order, with the audit they read and how they pick categories.
TABS = (
    ("Technical Audit", S.TECHNICAL, "all"),
    ("Crawlability", S.TECHNICAL, "crawl"),
    ("Structured data", S.STRUCTURED, "all"),
    ("On-Page SEO", S.ON_PAGE, "all"),
    ("Image SEO", S.IMAGE, "all"),
    ("EEAT Audit", S.EXPERTISE, "all"),
    ("Trust Signal", S.TRUST, "all"),
    ("GEO / AEO Audit", S.ANSWER, "rest"),
    ("ChatGPT Citation", S.ANSWER, "chat"),
    ("Gemini Citation", S.ANSWER, "gemini"),
    ("Indexability", S.INDEX, "all"),
)


def _tab_filter(pick: str) -> Column:
    category = F.col("category")
    return {
        "all": F.lit(True),
        "crawl": category.isin(*CRAWLABILITY),
        "chat": category.isin(*CHAT_CITATION),
        "gemini": category.isin(*GEMINI_CITATION),
        "rest": ~category.isin(*CHAT_CITATION, *GEMINI_CITATION),
    }[pick]


def audit_tabs(categories: DataFrame, scores: DataFrame, key: str = "site_id") -> DataFrame:
    """One row per site and tab: score, issues, number of categories.

    A category row fans out to the (at most three) tabs it belongs to and is folded in one pass.
    """
    tabs = F.array(*[
        F.when(
            (F.col("audit") == audit) & _tab_filter(pick),
            F.struct(F.lit(i).alias("tab_ord"), F.lit(label).alias("tab"), F.lit(pick).alias("pick")),
        )
        for i, (label, audit, pick) in enumerate(TABS)
    ])
    rows = categories.withColumn("t", F.explode(F.filter(tabs, lambda t: t.isNotNull()))).select(
        key, "audit", "t.*", "total", "failed", "score", "status"
    )
    live = (F.col("total") > 0) & (F.col("status") != "Skipped")
    total = S.sum_if(live, F.col("total"))
    folded = rows.groupBy(key, "audit", "tab_ord", "tab", "pick").agg(
        F.sum("failed").cast("int").alias("issues"),
        F.count(F.lit(1)).cast("int").alias("n_categories"),
        F.when(total > 0, clamp_score(S.sum_if(live, F.col("score") * F.col("total")) / total)).alias("mean_score"),
    )
    stored = scores.select(key, "audit", F.col("score").alias("stored_score"))
    own = F.coalesce("stored_score", F.lit(0))
    return folded.join(stored, [key, "audit"], "left").select(
        key, "tab_ord", "tab", "audit",
        F.when(F.col("pick") == "all", own)
        .when(F.col("pick") == "rest", F.coalesce("mean_score", own))
        .otherwise(F.coalesce("mean_score", F.lit(0)))
        .cast("int")
        .alias("score"),
        "issues", "n_categories",
    )


def visibility_score(tabs: DataFrame, stored: DataFrame, key: str = "site_id") -> DataFrame:
    """AG18: stored overall score, else the mean of the ten audit tabs (Crawlability is not one)."""
    means = tabs.where(F.col("tab") != "Crawlability").groupBy(key).agg(
        clamp_score(F.sum("score") / 10).alias("mean_score")
    )
    return means.join(stored.select(key, "overall"), key, "left").select(
        key, F.coalesce(F.when(F.col("overall") != 0, F.col("overall")), F.col("mean_score")).cast("int").alias("score")
    )


def rollup_scores(categories: DataFrame, key: str = "site_id") -> DataFrame:
    """Site, audit and category levels in one rollup, with the share of passed checks."""
    return categories.rollup(key, "audit", "category").agg(
        F.grouping_id().cast("int").alias("level"),
        F.sum("total").cast("bigint").alias("total"),
        F.sum("passed").cast("bigint").alias("passed"),
        F.sum("failed").cast("bigint").alias("failed"),
    )


def rank_sites(scores: DataFrame, key: str = "site_id") -> DataFrame:
    """Position of each site per audit.

    Ranks come from the distinct score values (0..100), whose counts are tiny, joined back by
    broadcast; no task ever sorts all sites of an audit.
    """
    from pyspark.sql import Window as W

    counts = scores.groupBy("audit", "score").agg(F.count(F.lit(1)).alias("n"))
    better = W.partitionBy("audit").orderBy(F.col("score").desc()).rowsBetween(W.unboundedPreceding, -1)
    places = counts.select(
        "audit", "score",
        (F.coalesce(F.sum("n").over(better), F.lit(0)) + 1).cast("bigint").alias("rank"),
        F.sum("n").over(W.partitionBy("audit")).cast("bigint").alias("n_sites"),
    )
    position = F.when(F.col("n_sites") > 1, (F.col("rank") - 1) / (F.col("n_sites") - 1)).otherwise(0.0)
    return scores.join(F.broadcast(places), ["audit", "score"]).select(
        key, "audit", "score", "rank", position.alias("percent_rank")
    )


def prompts(sites: DataFrame) -> DataFrame:
    """Five prompts per site from brand, category, model and industry."""
    brand, category = F.col("brand_name"), F.lower("sub_industry")
    short = F.regexp_replace(category, r"(?i)\s+services$", "")
    texts = F.array(
        F.concat(brand, F.lit(" "), short, F.lit(" services")),
        F.concat(brand, F.lit(" "), category, F.lit(" reviews")),
        F.concat(F.lit("Is "), brand, F.lit(" a good "), short, F.lit(" provider")),
        F.concat(brand, F.lit(" "), F.lower("business_model")),
        F.concat(brand, F.lit(" "), F.lower("industry"), F.lit(" credibility")),
    )
    return sites.select("site_id", F.posexplode(texts).alias("prompt_ord", "prompt"))


def playground_questions(brand: Column, sub_industry: Column) -> Column:
    """Three questions for the public report."""
    vague = sub_industry.isNull() | sub_industry.isin("", "AI Visibility Preview", "Insufficient Evidence")
    category = F.when(vague, "your category").otherwise(F.lower(sub_industry))
    return F.array(
        F.concat(F.lit("What does "), brand, F.lit(" offer in "), category, F.lit("?")),
        F.concat(F.lit("Is "), brand, F.lit(" a trusted option for "), category, F.lit("?")),
        F.concat(F.lit("When should someone choose "), brand, F.lit("?")),
    )


def rating_description(label: Column, brand: Column) -> Column:
    # One sentence per rating.
    endings = {
        "Poor": " has limited visibility in AI-driven discovery and recommendation journeys.",
        "Below Average": " has early AI visibility signals, but several growth opportunities remain.",
        "Average": " has a workable AI visibility foundation with room to improve coverage and authority.",
        "Good": " is positioned well for AI discovery, with targeted opportunities to strengthen performance.",
        "Excellent": " shows strong readiness for AI-generated recommendations and decision-making queries.",
    }
    out = F.lit(None).cast("string")
    for name, ending in endings.items():
        out = F.when(label == name, F.concat(brand, F.lit(ending))).otherwise(out)
    return out


def public_report(
    sites: DataFrame, scores: DataFrame, categories: DataFrame, checks: DataFrame, classified: DataFrame,
    recommendations: DataFrame, key: str = "site_id",
) -> DataFrame:
    """P5: one nested row per site.

    Lists are bounded by the catalogue (448 checks, 82 categories, 12 recommendations per site), and
    each is folded to one row per site before the joins, so the joins are one-to-one.
    """
    per_audit_checks = checks.groupBy(key, "audit").agg(
        F.array_sort(
            F.collect_list(
                F.struct("check_id", "name", "category", "severity", "passed", "skipped", "warning", "evidence_text")
            )
        ).alias("checks")
    )
    per_audit = categories.groupBy(key, "audit").agg(
        F.sum("failed").cast("int").alias("issues_found"),
        F.array_sort(
            F.collect_list(
                F.struct("category_ord", "category", "total", "passed", "failed", "warnings", "skipped", "score", "status")
            )
        ).alias("categories"),
    )
    audits = (
        scores.join(per_audit, [key, "audit"], "left")
        .join(per_audit_checks, [key, "audit"], "left")
        .groupBy(key)
        .agg(
            F.max(F.when(F.col("audit") == S.TECHNICAL, F.col("score"))).alias("technical_score"),
            F.max(F.when(F.col("audit") == S.ANSWER, F.col("score"))).alias("answer_engine_score"),
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "audit", "score", "grade", "raw_score", "page_score", "domain_score",
                        F.coalesce(F.col("blocker_failed") & (F.col("score") < F.col("raw_score")), F.lit(False)).alias(
                            "blocker_cap_applied"
                        ),
                        F.coalesce("issues_found", F.lit(0)).alias("issues_found"),
                        "categories", "checks",
                    )
                )
            ).alias("audits"),
        )
    )
    advice = recommendations.groupBy(key).agg(
        F.array_sort(
            F.collect_list(F.struct("rank", "priority", "recommendation", "reason", "expected_impact"))
        ).alias("recommendations")
    )
    base = (
        sites.join(audits, key)
        .join(classified, key, "left")
        .withColumn("overall_score", S.overall_score(F.col("technical_score"), F.col("answer_engine_score")))
        .withColumn("visibility_score", F.col("overall_score"))
    )
    summary = issue_summary(recommendations, base.select(key, "visibility_score"), key).drop("visibility_score")
    counts = F.struct("high", "medium", "low", "additional")
    title = (("GEO / AEO Audit", "Increase GEO / AEO readiness"), ("Technical Audit", "Improve technical health"),
             ("AI Visibility", "Improve overall AI visibility"))
    label = S.rating_label(F.col("overall_score"))
    return (
        base.join(advice, key, "left")
        .join(summary, key, "left")
        .select(
            key, F.col("brand_name").alias("brand"), F.col("website_url").alias("url"), "overall_score",
            label.alias("rating_label"),
            rating_description(label, F.col("brand_name")).alias("rating_description"),
            S.visibility_level(F.col("overall_score")).alias("visibility_level"),
            S.risk_level(F.col("overall_score")).alias("risk_level"),
            S.sentiment(F.col("overall_score")).alias("sentiment"),
            F.struct("industry", "sub_industry", "business_model", "confidence").alias("classification"),
            F.array(*[
                F.struct(
                    F.lit(text).alias("title"), F.lit(category).alias("category"),
                    impact_of_index(F.lit(i), F.col("high"), F.col("medium")).alias("impact"),
                )
                for i, (category, text) in enumerate(title)
            ]).alias("opportunities"),
            counts.alias("opportunity_counts"),
            "audits", "recommendations",
            playground_questions(F.col("brand_name"), F.col("sub_industry")).alias("playground_questions"),
        )
    )


def csv_rows(scores: DataFrame, categories: DataFrame, sites: DataFrame, counts: DataFrame, key: str = "site_id") -> DataFrame:
    """The CSV report in long form: a metric block, then one block per main audit.

    ``block`` and ``ord`` give the line order of a site's file.
    """
    main = scores.where(F.col("audit").isin(S.TECHNICAL, S.ANSWER)).groupBy(key).agg(
        *[
            F.max(F.when(F.col("audit") == audit, F.col(column))).alias(f"{column}_{audit}")
            for audit in (S.TECHNICAL, S.ANSWER)
            for column in ("score", "grade")
        ]
    )
    issues = categories.where(F.col("audit") == S.TECHNICAL).groupBy(key).agg(F.sum("failed").alias("issues"))
    wide = sites.join(main, key).join(issues, key, "left").join(counts, key, "left")
    overall = S.overall_score(F.col(f"score_{S.TECHNICAL}"), F.col(f"score_{S.ANSWER}"))
    percent = lambda c: F.concat(c.cast("string"), F.lit("%"))
    found = sum((F.coalesce(F.col(c), F.lit(0)) for c in ("medium", "low")), F.coalesce(F.col("high"), F.lit(0)))
    lines = [
        ("Metric", F.lit("Value")),
        ("Brand", F.col("brand_name")),
        ("AI Visibility Score", percent(overall)),
        ("Rating", S.rating_label(overall)),
        ("Technical Score", percent(F.col(f"score_{S.TECHNICAL}"))),
        ("Technical Grade", F.col(f"grade_{S.TECHNICAL}")),
        ("Technical Issues Found", F.coalesce("issues", F.lit(0)).cast("string")),
        ("GEO / AEO Score", percent(F.col(f"score_{S.ANSWER}"))),
        ("GEO / AEO Grade", F.col(f"grade_{S.ANSWER}")),
        ("GEO / AEO Opportunities Found", found.cast("string")),
    ]
    empty = F.lit(None).cast("string")
    row = lambda i, a, b, c=empty, d=empty, e=empty: F.struct(
        F.lit(i).alias("ord") if isinstance(i, int) else i.alias("ord"), a.alias("c1"), b.alias("c2"), c.alias("c3"),
        d.alias("c4"), e.alias("c5"),
    )
    metric = wide.select(
        key, F.lit(0).alias("block"), F.explode(F.array(*[row(i, F.lit(n), v) for i, (n, v) in enumerate(lines)])).alias("r")
    )
    out = metric.select(key, "block", "r.*")
    for block, (audit, head) in enumerate(((S.TECHNICAL, "Technical Category"), (S.ANSWER, "GEO / AEO Category")), 1):
        titles = sites.select(
            key, F.lit(block).alias("block"), F.lit(-1).alias("ord"), F.lit(head).alias("c1"),
            F.lit("Total Checks").alias("c2"), F.lit("Issues Found").alias("c3"), F.lit("Category Score").alias("c4"),
            F.lit("Status").alias("c5"),
        )
        body = categories.where(F.col("audit") == audit).select(
            key, F.lit(block).alias("block"), F.col("category_ord").alias("ord"), F.col("category").alias("c1"),
            F.col("total").cast("string").alias("c2"), F.col("failed").cast("string").alias("c3"),
            percent(F.col("score")).alias("c4"), F.col("status").alias("c5"),
        )
        out = out.unionByName(titles).unionByName(body)
    return out
