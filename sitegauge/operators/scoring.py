"""Scores, category summaries, grades and levels over long-form check rows (AG7-AG14, X1-X10).

A check row carries ``site_id, audit, check_id, category, name, weight, severity, scope, passed,
skipped, warning``. Every score below is one ``groupBy`` whose partial aggregates combine on the map
side, so a site with a third of all rows costs no more than its share of the scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import small_table

from ..functions.numbers import clamp_score, half_up, rate

TECHNICAL, ANSWER, INDEX = "technical", "answer_engine", "indexability"
STRUCTURED, ON_PAGE, IMAGE, EXPERTISE, TRUST = "structured_data", "on_page", "image", "eeat", "trust"
AUDITS = (TECHNICAL, ANSWER, INDEX, STRUCTURED, ON_PAGE, IMAGE, EXPERTISE, TRUST)


def count_if(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False))).cast("int")


def sum_if(condition: Column, value: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, value)), F.lit(0.0))


def earned(weight: Column, passed: Column, warning: Column, skipped: Column) -> Column:
    """Points of one row: full, half for a warning, none when failed or skipped."""
    return F.when(skipped, 0.0).when(passed, weight).when(warning, weight / 2).otherwise(0.0)


def grade(score: Column) -> Column:
    """X4."""
    return (
        F.when(score >= 85, "A").when(score >= 70, "B").when(score >= 55, "C").when(score >= 40, "D").otherwise("F")
    )


def grade_description(score: Column) -> Column:
    return (
        F.when(score >= 85, "High AI citation probability")
        .when(score >= 70, "Good AI visibility")
        .when(score >= 55, "Needs improvement")
        .when(score >= 40, "Poor AI visibility")
        .otherwise("Critical GEO issues")
    )


def overall_score(technical: Column, answer_engine: Column) -> Column:
    """X6."""
    return clamp_score(technical * 0.4 + answer_engine * 0.6)


def _ladder(score: Column, steps: Sequence[tuple[int, str]], last: str, inclusive: bool = False) -> Column:
    out = F.lit(last)
    for limit, label in reversed(steps):
        out = F.when(score <= limit if inclusive else score < limit, label).otherwise(out)
    return out


def visibility_level(score: Column) -> Column:
    """Upper bounds exclusive."""
    steps = [(25, "Critical"), (40, "Poor"), (55, "Below Average"), (70, "Average"), (85, "Strong")]
    return _ladder(score, steps, "Excellent")


def rating_label(score: Column) -> Column:
    """Upper bounds inclusive, unlike the level."""
    steps = [(40, "Poor"), (55, "Below Average"), (70, "Average"), (85, "Good")]
    return _ladder(score, steps, "Excellent", inclusive=True)


def risk_level(score: Column) -> Column:
    return _ladder(score, [(25, "Critical"), (45, "High"), (70, "Medium")], "Low")


def authority_strength(score: Column) -> Column:
    return _ladder(score, [(35, "Low"), (65, "Moderate"), (85, "Strong")], "Excellent")


def market_position(score: Column, category_visibility: Column, authority: Column) -> Column:
    return (
        F.when(
            (score >= 80) & (category_visibility >= 75) & (authority >= 75),
            "Strong AI-ready position within the detected category",
        )
        .when((score >= 65) & (category_visibility >= 60), "Established AI visibility within the detected category")
        .when(score >= 45, "Developing AI presence with clear optimization upside")
        .otherwise("Early-stage AI visibility with limited supporting evidence")
    )


def sentiment(score: Column) -> Column:
    return _ladder(score, [(40, "Negative"), (70, "Neutral")], "Positive")


def display_status(score: Column, skipped: Column) -> Column:
    return F.when(skipped, "Skipped").otherwise(
        _ladder(score, [(60, "Needs Attention"), (90, "Minor Attention")], "Passed")
    )


def opportunity_floor(score: Column) -> Column:
    """X8."""
    return F.when(score < 25, 4).when(score < 45, 3).when(score < 70, 2).when(score < 85, 1).otherwise(0)


def impact_of_severity(severity: Column) -> Column:
    """AG11: severity wordings of all audits to high / medium / low."""
    return (
        F.when(severity.rlike("(?i)blocker|critical|high|major"), "high")
        .when(severity.rlike("(?i)medium|minor"), "medium")
        .otherwise("low")
    )


def scope_scores(checks: DataFrame, key: str = "site_id") -> DataFrame:
    """AG7: weighted share of passed checks per scope, 0 for an empty scope."""
    return checks.groupBy(key, "scope").agg(
        half_up(rate(sum_if(F.col("passed"), F.col("weight")), F.sum("weight")) * 100).alias("score")
    )


def skip_aware_scores(checks: DataFrame, keys: Sequence[str] = ("site_id",), empty: int = 100) -> DataFrame:
    """AG8: skipped rows leave both sums; a warning earns half."""
    return checks.groupBy(*keys).agg(_skip_aware(F.lit(empty)).alias("score"))


def _skip_aware(empty: Column) -> Column:
    live = ~F.col("skipped")
    total = sum_if(live, F.col("weight"))
    points = sum_if(live, earned(F.col("weight"), F.col("passed"), F.col("warning"), F.col("skipped")))
    return F.when(total > 0, clamp_score(points / total * 100)).otherwise(empty)


def unweighted_scope_scores(checks: DataFrame, key: str = "site_id") -> DataFrame:
    """AG14: plain share of passed checks per scope, skipped ones left out, 100 when none remain."""
    live = ~F.col("skipped")
    share = clamp_score(rate(count_if(live & F.col("passed")), count_if(live), 1.0) * 100)
    return checks.groupBy(key, "scope").agg(share.alias("score"))


def category_status(
    audit: Column, total_live: Column, failed: Column, warnings: Column, skipped: Column, urgent: Column
) -> Column:
    """The status rule differs per audit and must not be unified."""
    by_count = F.when(failed == 0, "Passed").when(failed <= 2, "Minor Attention").otherwise("Needs Attention")
    strict = (
        F.when((failed == 0) & (warnings == 0), "Passed").when(failed == 0, "Minor Attention")
        .otherwise("Needs Attention")
    )
    return (
        F.when(audit.isin(TECHNICAL, ANSWER), by_count)
        .when(
            audit == ON_PAGE,
            F.when(total_live == 0, "Skipped").when(failed == 0, "Passed").when(failed <= 1, "Minor Attention")
            .otherwise("Needs Attention"),
        )
        .when(audit == STRUCTURED, strict)
        .when(
            audit == INDEX,
            F.when((total_live == 0) & (skipped > 0), "Skipped").when(failed == 0, "Passed")
            .when(urgent > 0, "Needs Attention").otherwise("Minor Attention"),
        )
        .otherwise(F.when(total_live == 0, "Skipped").otherwise(strict))
    )


def category_summary(checks: DataFrame, keys: Sequence[str] = ("site_id", "audit", "category")) -> DataFrame:
    """AG9: per category totals, score and status in one aggregation over all audits."""
    audit = F.col("audit")
    passed, warning, skipped = F.col("passed"), F.col("warning"), F.col("skipped")
    live = ~skipped
    soft = audit.isin(STRUCTURED, IMAGE, EXPERTISE, TRUST)
    failed_row = live & ~passed & ~(soft & warning)
    warned_row = (
        F.when(audit == TECHNICAL, ~passed & F.col("severity").isin("MINOR", "ADVISORY"))
        .when(audit == ANSWER, live & ~passed & (F.col("severity") == "MINOR"))
        .when(audit == INDEX, live & ~passed & (F.col("severity") == "Low"))
        .when(soft, live & warning)
        .otherwise(F.lit(False))
    )
    agg = checks.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("int").alias("n_all"),
        count_if(live).alias("n_live"),
        count_if(live & passed & ~(soft & warning)).alias("passed"),
        count_if(failed_row).alias("failed"),
        count_if(warned_row).alias("warnings"),
        count_if(skipped).alias("skipped"),
        count_if(failed_row & F.col("severity").isin("Critical", "High")).alias("n_urgent"),
        count_if(live & passed).alias("n_passed_live"),
        sum_if(live, F.col("weight")).alias("w_live"),
        sum_if(live, earned(F.col("weight"), passed, warning & (audit != ON_PAGE), skipped)).alias("w_points"),
    )
    weighted = clamp_score(rate(F.col("w_points"), F.col("w_live")) * 100)
    empty = F.when(F.col("audit").isin(TECHNICAL, INDEX), 0).otherwise(100)
    score = (
        F.when(
            F.col("audit") == ANSWER,
            F.when(F.col("n_live") > 0, clamp_score(F.col("n_passed_live") / F.col("n_live") * 100)).otherwise(100),
        )
        .when(F.col("w_live") > 0, weighted)
        .otherwise(empty)
    )
    status = category_status(
        F.col("audit"), F.col("n_live"), F.col("failed"), F.col("warnings"), F.col("skipped"), F.col("n_urgent")
    )
    return agg.select(
        *keys,
        F.when(F.col("audit") == ANSWER, F.col("n_live")).otherwise(F.col("n_all")).alias("total"),
        "passed", "failed", "warnings", "skipped",
        score.cast("int").alias("score"),
        status.alias("status"),
    )


# Category weights of the answer-engine score, in report order.
ANSWER_CATEGORY_WEIGHTS = (
    ("AI Bot Access", 20), ("AI Readiness", 5), ("Entity & Trust Signals", 20), ("FAQ & Answer Optimization", 15),
    ("Content Authority", 10), ("Local GEO Signals", 15), ("AI Crawlability", 5), ("Structured Data Integrity", 5),
    ("Crawlability", 7), ("Technical Access", 3), ("Content Structure", 2), ("Content Quality", 3),
    ("Gemini Crawlability", 6), ("Local & E-Commerce", 2), ("Schema & Technical", 3), ("Media & Visuals", 2),
    ("Robots & Bot Access", 2), ("AI Discovery Files", 5),
)


def category_weighted_mean(
    categories: DataFrame, weights: DataFrame, keys: Sequence[str] = ("site_id",)
) -> DataFrame:
    """AG10: mean of category scores by category weight; ``weights`` is a small fixed table."""
    joined = categories.join(F.broadcast(weights), "category", "left")
    w = F.coalesce(F.col("category_weight"), F.lit(0.0))
    total = F.sum(w)
    return joined.groupBy(*keys).agg(
        F.when(total > 0, clamp_score(F.sum(F.col("score") * w) / total)).otherwise(0).alias("score")
    )


def answer_weights(spark) -> DataFrame:
    return small_table(spark, 
        [(c, float(w)) for c, w in ANSWER_CATEGORY_WEIGHTS], "category string, category_weight double"
    )


def blocker_failed(severity: Column, passed: Column, skipped: Column) -> Column:
    return F.coalesce(F.bool_or((severity == "BLOCKER") & ~passed & ~skipped), F.lit(False))


def technical_scores(checks: DataFrame, key: str = "site_id") -> DataFrame:
    """Page and domain share 7:3, a failed blocker caps at 50."""
    def part(name: str) -> Column:
        inside = F.col("scope") == name
        return half_up(rate(sum_if(inside & F.col("passed"), F.col("weight")), sum_if(inside, F.col("weight"))) * 100)

    return (
        checks.groupBy(key)
        .agg(
            part("page").alias("page_score"),
            part("domain").alias("domain_score"),
            F.coalesce(F.bool_or((F.col("severity") == "BLOCKER") & ~F.col("passed")), F.lit(False)).alias(
                "blocker_failed"
            ),
        )
        .withColumn("raw_score", half_up(F.col("page_score") * 0.7 + F.col("domain_score") * 0.3))
        .withColumn("score", _capped())
        .withColumn("grade", grade(F.col("score")))
    )


def _capped() -> Column:
    return F.when(F.col("blocker_failed"), F.least(F.col("raw_score"), F.lit(50))).otherwise(F.col("raw_score"))


def answer_engine_scores(checks: DataFrame, key: str = "site_id") -> DataFrame:
    """Category-weighted mean with the same cap; scope scores are informative only."""
    categories = category_summary(checks.withColumn("audit", F.lit(ANSWER)), (key, "audit", "category"))
    raw = category_weighted_mean(categories, answer_weights(checks.sparkSession), (key,))
    live = ~F.col("skipped")

    def part(name: str) -> Column:
        inside = live & (F.col("scope") == name)
        return clamp_score(rate(count_if(inside & F.col("passed")), count_if(inside), 1.0) * 100)

    facts = checks.groupBy(key).agg(
        part("page").alias("page_score"),
        part("domain").alias("domain_score"),
        blocker_failed(F.col("severity"), F.col("passed"), F.col("skipped")).alias("blocker_failed"),
    )
    return (
        facts.join(raw.withColumnRenamed("score", "raw_score"), key)
        .withColumn("score", _capped())
        .withColumn("grade", grade(F.col("score")))
    )


def audit_scores(checks: DataFrame, key: str = "site_id") -> DataFrame:
    """One row per site and audit, by each audit's own rule."""
    columns = [key, "audit", "raw_score", "page_score", "domain_score", "score", "grade", "blocker_failed"]
    technical = technical_scores(checks.where(F.col("audit") == TECHNICAL), key).withColumn("audit", F.lit(TECHNICAL))
    answer = answer_engine_scores(checks.where(F.col("audit") == ANSWER), key).withColumn("audit", F.lit(ANSWER))
    others = (
        checks.where(~F.col("audit").isin(TECHNICAL, ANSWER))
        .groupBy(key, "audit")
        .agg(_skip_aware(F.when(F.first("audit") == INDEX, 0).otherwise(100)).alias("score"))
        .withColumn("raw_score", F.col("score"))
        .withColumn("page_score", F.lit(None).cast("int"))
        .withColumn("domain_score", F.lit(None).cast("int"))
        .withColumn("grade", grade(F.col("score")))
        .withColumn("blocker_failed", F.lit(False))
    )
    return technical.select(columns).unionByName(answer.select(columns)).unionByName(others.select(columns))


def opportunity_counts(checks: DataFrame, key: str = "site_id") -> DataFrame:
    """AG13."""
    failed = ~F.col("passed") & ~F.col("skipped")
    return checks.groupBy(key).agg(
        *[
            count_if(failed & (F.col("severity") == severity)).alias(name)
            for name, severity in (("high", "BLOCKER"), ("medium", "MAJOR"), ("low", "MINOR"))
        ]
    )


def impact_counts(checks: DataFrame, key: str = "site_id") -> DataFrame:
    """AG11: failed checks by impact over every audit."""
    failed = ~F.col("passed") & ~F.col("skipped")
    impact = impact_of_severity(F.col("severity"))
    return checks.groupBy(key).agg(*[count_if(failed & (impact == i)).alias(i) for i in ("high", "medium", "low")])


def checks_weighted_score(categories: DataFrame, keys: Sequence[str] = ("site_id",), fallback: Column | None = None) -> DataFrame:
    """AG11: category scores weighted by their number of checks, skipped categories left out."""
    live = (F.col("total") > 0) & (F.col("status") != "Skipped")
    total = sum_if(live, F.col("total"))
    mean = clamp_score(sum_if(live, F.col("score") * F.col("total")) / total)
    return categories.groupBy(*keys).agg(
        F.when(total > 0, mean).otherwise(clamp_score(fallback) if fallback is not None else 0).alias("score"),
        F.sum("failed").cast("int").alias("issues"),
    )


def with_missing_audits(scores: DataFrame, sites: DataFrame, key: str = "site_id") -> DataFrame:
    """Audits without a result get their fallback score and are marked."""
    names = small_table(scores.sparkSession, [(a,) for a in AUDITS], "audit string")
    wanted = sites.select(key).distinct().join(F.broadcast(names))
    zero = F.col("audit").isin(TECHNICAL, ANSWER, INDEX)
    return (
        wanted.join(scores, [key, "audit"], "left")
        .withColumn("available", F.col("score").isNotNull())
        .withColumn("score", F.coalesce(F.col("score"), F.when(zero, 0).otherwise(100)))
        .withColumn("grade", F.coalesce(F.col("grade"), grade(F.col("score"))))
        .withColumn(
            "blocker_failed",
            F.coalesce(F.col("blocker_failed"), F.col("audit").isin(TECHNICAL, ANSWER)),
        )
    )
