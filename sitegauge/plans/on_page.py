"""On-page audit: 13 checks on one page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dom as D
from ..functions import jsonld as J
from ..functions import patterns as P
from ..functions import text as T
from ..functions import urls as U
from ..functions.numbers import fixed2, rate
from ..operators.scoring import ON_PAGE
from .rules import CheckDef, Verdict, check_rows

# Id, category, name, weight, severity.
DEFS = [
    CheckDef(1, "Headings & Titles", "Heading Hierarchy No Skips", 3.26, "High"),
    CheckDef(2, "Content Signals & Clarity", "Entity Bolding Quality", 2.72, "Medium"),
    CheckDef(3, "Structured Markup & Lists", "HTML Tables for Comparisons", 3.26, "High"),
    CheckDef(4, "Structured Markup & Lists", "Table Captions", 2.17, "Medium"),
    CheckDef(5, "Structured Markup & Lists", "<blockquote>+<cite> for Quotes", 1.63, "Low"),
    CheckDef(6, "Content Signals & Clarity", "<dfn> for Key Term Definitions", 1.63, "Low"),
    CheckDef(7, "Content Signals & Clarity", "<time datetime> on Dates", 1.63, "Low"),
    CheckDef(8, "Headings & Titles", "Breadcrumb Schema-DOM Match", 2.17, "High"),
    CheckDef(9, "Structured Markup & Lists", "See Also Semantic Paths", 2.17, "Medium"),
    CheckDef(10, "Internal Linking", "Contextual Internal Links", 2.72, "Medium"),
    CheckDef(11, "Image & Media Optimisation", "Alt Text Non-Empty", 2.72, "High"),
    CheckDef(12, "Headings & Titles", "Heading Capitalization Consistent", 1.63, "Low"),
    CheckDef(13, "Headings & Titles", "H1 Length 20-70 Characters", 2.17, "Medium"),
]
_DATES = (
    r"\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)[a-z]*\.?\s+\d{1,2},?\s+\d{4}\b|"
    r"\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2}/\d{1,2}/\d{4}\b"
)


def features(pages: DataFrame) -> DataFrame:
    """Numbers and lists the checks look at, one narrow row per page."""
    nodes = F.col("nodes")
    non_empty = lambda texts: F.filter(F.transform(texts, T.collapse), lambda t: t != "")
    bold = non_empty(D.texts(D.tagged(nodes, "b", "strong")))
    tables, captions, cites = D.tagged(nodes, "table"), D.tagged(nodes, "caption"), D.tagged(nodes, "cite")
    quotes = D.tagged(nodes, "blockquote")

    def captioned(table):
        first = D.first(F.filter(captions, lambda c: D.contains_element(table, c)))
        return T.trim_blank(T.text_or_empty(first["text"])) != ""

    def cited(quote):
        return F.exists(
            cites, lambda c: D.contains_element(quote, c) | ((c["ord"] == quote["last"] + 1) & (c["up"] == quote["up"]))
        )

    base = pages.withColumn("site_host", U.bare_host(F.col("url"))).select(
        "site_id", "page_id", "parse_error", F.col("url"), "body_text", "anchors", "images", "nodes", "headings",
        T.collapse(F.col("body_text")).alias("body"),
        F.transform("headings", D.level).alias("levels"),
        F.size(D.level_jumps(F.col("headings"))).alias("n_jumps"),
        bold.alias("bold"),
        F.size(tables).alias("n_tables"),
        D.n(tables, lambda t: P.test(t["text"], r"\b(compare|comparison|feature|price|plan|versus|vs|pros|cons)\b")).alias(
            "n_comparison"
        ),
        D.n(tables, captioned).alias("n_captioned"),
        F.size(quotes).alias("n_quotes"),
        D.n(quotes, cited).alias("n_cited"),
        D.n(D.tagged(nodes, "dfn"), lambda e: T.trim_blank(T.text_or_empty(e["text"])) != "").alias("n_dfn"),
        D.n(D.tagged(nodes, "time"), lambda e: T.trim_blank(D.attr_or(e, "datetime")) != "").alias("n_datetime"),
        F.transform(J.breadcrumb_names(J.records(typed_only=False)), T.normalized).alias("crumbs_schema"),
        F.transform(D.breadcrumb_texts(), T.normalized).alias("crumbs_dom"),
        D.see_also_count().alias("n_see_also"),
        F.size(D.contextual_internal(F.col("site_host"))).alias("n_contextual"),
        F.size("images").alias("n_images"),
        D.n(F.col("images"), lambda e: T.trim_blank(D.attr_or(e, "alt")) == "").alias("n_missing_alt"),
        F.filter(
            F.transform(non_empty(D.texts(F.col("headings"))), T.heading_case), lambda c: c != "unknown"
        ).alias("cases"),
        T.utf16_length(T.collapse(D.first_h1())).alias("h1_length"),
    )
    words_of = lambda phrases: F.aggregate(F.transform(phrases, T.word_count), F.lit(0), lambda acc, x: acc + x)
    return base.select(
        "*",
        T.word_count(F.col("body")).alias("n_words"),
        (rate(words_of(F.col("bold")), T.word_count(F.col("body"))) * 100).alias("bold_density"),
        rate(D.n(F.col("bold"), T.is_quality_phrase), F.size("bold")).alias("bold_quality"),
        P.count(F.col("body"), _DATES, "").alias("n_dates"),
        T.dominant_case(F.col("cases")).alias("case_kind"),
        F.array_join("crumbs_schema", " > ").alias("trail_schema"),
        F.array_join("crumbs_dom", " > ").alias("trail_dom"),
    ).drop("body_text", "anchors", "images", "nodes", "headings")


def audit(pages: DataFrame) -> DataFrame:
    c = F.col
    body = c("body")
    intent = (c("n_tables") > 0) | P.test(
        body, r"\b(compare|comparison|versus| vs\.? |features|pricing|plans|pros and cons)\b"
    )
    defines = P.test(body, r"\b[A-Z][A-Za-z0-9 -]{2,}\s+(?:is|are|means|refers to|is defined as)\b", "")
    same = rate(F.size(F.filter("cases", lambda x: x == c("case_kind"))), F.size("cases"), 1.0)
    limit = F.when(c("n_words") < 250, 15).otherwise(8)
    trails = F.contains(c("trail_dom"), c("trail_schema")) | F.contains(c("trail_schema"), c("trail_dom"))
    n_schema, n_dom = F.size("crumbs_schema"), F.size("crumbs_dom")
    verdicts = [
        ([1], Verdict((F.size("levels") > 0) & (c("n_jumps") == 0),
                      evidence={"levels": F.size("levels"), "jumps": c("n_jumps")})),
        ([2], Verdict(
            (F.size("bold") > 0) & c("bold_density").between(0.5, limit) & (c("bold_quality") >= 0.6),
            evidence={"phrases": F.size("bold"), "density": fixed2(c("bold_density")), "limit": limit,
                      "quality": fixed2(c("bold_quality"))})),
        ([3], Verdict(~intent | (c("n_comparison") > 0),
                      evidence={"intent": intent, "tables": c("n_tables"), "comparison": c("n_comparison")})),
        ([4], Verdict(c("n_captioned") == c("n_tables"), skipped=c("n_tables") == 0,
                      evidence={"tables": c("n_tables"), "captioned": c("n_captioned")})),
        ([5], Verdict((c("n_quotes") > 0) & (c("n_cited") == c("n_quotes")),
                      skipped=(c("n_quotes") == 0) & ~P.test(body, "[“”\"']", ""),
                      evidence={"quotes": c("n_quotes"), "cited": c("n_cited")})),
        ([6], Verdict(c("n_dfn") > 0, skipped=~defines, evidence={"dfn": c("n_dfn")})),
        ([7], Verdict((c("n_dates") == 0) | (c("n_datetime") >= c("n_dates")),
                      evidence={"dates": c("n_dates"), "datetimes": c("n_datetime")})),
        ([8], Verdict((n_schema == 0) | ((n_dom > 0) & trails), skipped=(n_schema == 0) & (n_dom == 0),
                      evidence={"schema": c("trail_schema"), "page": c("trail_dom")})),
        ([9], Verdict(c("n_see_also") > 0, evidence={"links": c("n_see_also")})),
        ([10], Verdict(c("n_contextual") >= 2, evidence={"links": c("n_contextual")})),
        ([11], Verdict(c("n_missing_alt") == 0, evidence={"images": c("n_images"), "missing": c("n_missing_alt")})),
        ([12], Verdict((F.size("cases") <= 1) | (same >= 0.8),
                       evidence={"dominant": c("case_kind"), "share": fixed2(same)})),
        ([13], Verdict(c("h1_length").between(20, 70), evidence={"length": c("h1_length")})),
    ]
    return check_rows(features(pages), ["site_id", "page_id"], ON_PAGE, verdicts)
