"""Ranked recommendations from failed checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import small_table

from .ranking import first_k

# Fixed values: (failed check ids, advice, expected effect, set priority or None), in rule order.
RULES = (
    ((85,), "Implement FAQPage schema for visible FAQ sections",
     "Helps AI engines extract concise question-answer pairs from the page and use them in answer-style results.", None),
    ((80, 81), "Implement Organization schema with sameAs entity links",
     "Strengthens brand entity recognition by connecting the website to official social, directory, and profile URLs.",
     None),
    ((77, 78, 79, 91), "Fix JSON-LD schema coverage and validation errors",
     "Improves machine-readable context so AI systems can parse the brand, services, and page purpose with less "
     "ambiguity.", None),
    ((82,), "Add WebSite schema with SearchAction",
     "Gives crawlers a clearer site-level entity and search pattern, improving structured understanding of the domain.",
     None),
    ((87,), "Add LocalBusiness or ProfessionalService schema on service pages",
     "Clarifies location, service area, and service type for local and service-intent AI recommendations.", None),
    ((89,), "Add Product schema on product or pricing pages",
     "Makes product names, offers, and pricing easier for AI systems to interpret in commercial prompts.", None),
    ((114,), "Create an llms.txt file at the site root",
     "Provides AI crawlers with a concise map of important pages, brand context, and preferred content sources.",
     "Medium Priority"),
    ((107,), "Expand page content depth around the detected business category",
     "Gives AI systems more topical evidence to understand services, eligibility, benefits, and decision criteria.",
     None),
    ((96, 97, 35), "Optimize internal linking with descriptive anchors",
     "Improves crawl paths and helps AI systems connect service pages, category pages, proof pages, and conversion "
     "pages.", None),
    ((113,), "Add visible review or testimonial signals",
     "Adds trust evidence that AI systems can use when evaluating brand credibility and customer proof.", None),
    ((10, 11, 12, 13), "Fix robots.txt and sitemap discovery",
     "Helps search and AI crawlers discover priority URLs reliably and understand which pages should be indexed.", None),
    ((16, 17, 18, 19), "Rewrite title and meta description to match the page intent",
     "Improves the page summary signals that AI and search systems use to classify relevance.", None),
    ((24, 25, 26), "Correct heading structure on the page",
     "Makes the page hierarchy easier for crawlers and AI systems to parse into topics and subtopics.", None),
    ((27, 28, 29), "Fix canonical tags",
     "Reduces duplicate or conflicting URL signals so crawlers can consolidate authority to the correct page.", None),
    ((61, 62, 103), "Add descriptive alt text for meaningful images",
     "Exposes visual proof, charts, services, and product context to crawlers that cannot rely on image pixels alone.",
     None),
    ((46, 49, 53, 56, 59, 72, 73), "Improve mobile performance and render-blocking resources",
     "Improves crawl efficiency and user experience signals that can affect AI and search visibility.", None),
    ((67, 68, 69, 70), "Strengthen trust pages and contact information",
     "Improves credibility signals by making ownership, contact details, policies, and brand background easier to "
     "verify.", None),
)
PRIORITIES = ("High Priority", "Medium Priority", "Low Priority")
REPORT_LIMIT, FILL_TO = 12, 6


def rules_table(spark: SparkSession) -> DataFrame:
    rows = [
        (check_id, ordinal, advice, effect, fixed)
        for ordinal, (ids, advice, effect, fixed) in enumerate(RULES)
        for check_id in ids
    ]
    return small_table(spark, 
        rows, "check_id int, rule_ord int, recommendation string, expected_impact string, fixed_priority string"
    )


def severity_priority_rank(severity: Column) -> Column:
    return F.when(severity.isin("BLOCKER", "MAJOR"), 0).when(severity == "MINOR", 1).otherwise(2)


def _priority(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(p) for p in PRIORITIES]), (rank + 1).cast("int"))


def recommend(failed: DataFrame, key: str = "site_id") -> DataFrame:
    """P1 + P2: rule advice, then the heaviest uncovered failures up to six, ranked, at most twelve.

    ``failed`` holds failed technical checks: ``key, check_id, name, category, severity, weight,
    evidence_text``. A site has at most one row per check, so per-site lists stay small by
    definition; only failing checks are shuffled.
    """
    spark = failed.sparkSession
    hits = failed.join(F.broadcast(rules_table(spark)), "check_id")
    by_rule = hits.groupBy(key, "rule_ord").agg(
        F.min(severity_priority_rank(F.col("severity"))).alias("worst"),
        F.first("fixed_priority").alias("fixed_priority"),
        F.first("recommendation").alias("recommendation"),
        F.first("expected_impact").alias("expected_impact"),
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("check_id", "name", "evidence_text"))),
                lambda s: F.concat(s["name"], F.lit(": "), s["evidence_text"]),
            ),
            "; ",
        ).alias("reason"),
    )
    fixed_rank = F.array_position(F.array(*[F.lit(p) for p in PRIORITIES]), F.col("fixed_priority")) - 1
    advice = by_rule.select(
        key,
        F.coalesce(fixed_rank.cast("int"), F.col("worst")).alias("priority_rank"),
        F.col("rule_ord").alias("ord"),
        "recommendation", "reason", "expected_impact",
    )
    # a failure is covered when its name occurs in some reason of its site
    reasons = advice.groupBy(key).agg(
        F.concat_ws("\n", F.collect_list("reason")).alias("all_reasons"), F.count(F.lit(1)).alias("n_advice")
    )
    rest = (
        failed.join(reasons, key, "left")
        .where(F.col("severity") != "ADVISORY")
        .where(F.col("all_reasons").isNull() | ~F.contains(F.col("all_reasons"), F.col("name")))
    )
    ranked = first_k(rest, [key], [F.col("weight").desc(), F.col("check_id")], FILL_TO)
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy(key).orderBy(F.col("weight").desc(), F.col("check_id")))
    fill = (
        ranked.withColumn("place", place)
        .where(F.col("place") <= F.greatest(F.lit(0), F.lit(FILL_TO) - F.coalesce(F.col("n_advice"), F.lit(0))))
        .select(
            key,
            severity_priority_rank(F.col("severity")).alias("priority_rank"),
            (F.lit(len(RULES)) + F.col("place")).alias("ord"),
            F.concat(F.lit("Fix "), F.lower("name")).alias("recommendation"),
            F.concat(F.col("category"), F.lit(": "), F.col("evidence_text")).alias("reason"),
            F.concat(
                F.lit("Improves "), F.lower("category"), F.lit(' signals by resolving the failed "'), F.col("name"),
                F.lit('" audit check.'),
            ).alias("expected_impact"),
        )
    )
    order = W.partitionBy(key).orderBy("priority_rank", "ord")
    return (
        advice.unionByName(fill)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= REPORT_LIMIT)
        .select(
            key, "rank", _priority(F.col("priority_rank")).alias("priority"), "recommendation", "reason",
            "expected_impact",
        )
    )


def classification_recommendation(classified: DataFrame, key: str = "site_id", below: int = 55) -> DataFrame:
    """Advice for sites whose business cannot be told with confidence."""
    return classified.where(F.col("confidence") < below).select(
        key,
        F.lit(0).alias("rank"),
        F.lit("High Priority").alias("priority"),
        F.lit("Clarify homepage category and service positioning").alias("recommendation"),
        F.concat(
            F.lit("Business classification confidence is "), F.col("confidence").cast("string"),
            F.lit("%, which means the homepage evidence is not strong enough to classify industry, sub-industry, "
                  "and business model reliably."),
        ).alias("reason"),
        F.lit(
            "Improves how AI systems understand what the brand does before they decide whether to recommend it for "
            "category-specific prompts."
        ).alias("expected_impact"),
    )
