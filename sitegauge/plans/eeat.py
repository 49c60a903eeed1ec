"""Expertise and trust audit: 21 checks on the home page and up to nine linked pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dom as D
from ..functions import patterns as P
from ..functions import text as T
from ..functions import urls as U
from ..operators.links import answer, by_role, wanted_rows
from ..operators.scoring import EXPERTISE
from ..session import large, stage
from ..sources.captures import one_row
from .rules import CheckDef, Verdict, check_rows

# Id, category, name, weight, severity.
DEFS = [
    CheckDef(1, "Author & Expertise", "Author Byline on Every Article", 3.55, "Critical"),
    CheckDef(2, "Author & Expertise", "Byline Hyperlinked to Bio", 2.65, "High"),
    CheckDef(3, "Author & Expertise", "Author Bio Page Exists", 3.17, "Critical"),
    CheckDef(4, "Author & Expertise", "Bio Page >=150 Words", 2.12, "High"),
    CheckDef(5, "Author & Expertise", "LinkedIn Linked from Bio", 2.65, "High"),
    CheckDef(6, "Author & Expertise", "Author Content Volume >=3", 2.12, "Medium"),
    CheckDef(7, "Editorial Standards", "Editorial Policy Page", 2.65, "High"),
    CheckDef(8, "Trust & Transparency", "Contact Page Physical Address", 2.65, "Critical"),
    CheckDef(9, "Trust & Transparency", "Contact Page Phone Number", 2.12, "High"),
    CheckDef(10, "Trust & Transparency", "Contact Page Company Email", 2.12, "High"),
    CheckDef(11, "Trust & Transparency", "Contact Form Functional", 2.12, "High"),
    CheckDef(12, "Trust & Transparency", "Privacy Policy Substantive", 2.12, "Medium"),
    CheckDef(13, "Trust & Transparency", "Terms of Service", 1.59, "Medium"),
    CheckDef(14, "Trust Signals & Reviews", "Client Logo Section", 1.59, "Medium"),
    CheckDef(15, "Trust & Transparency", "About Page >=300w Depth", 2.65, "High"),
    CheckDef(16, "Citations & Evidence", "Outbound .edu/.gov Links", 2.65, "High"),
    CheckDef(17, "Citations & Evidence", "Inline Source Citations", 2.65, "High"),
    CheckDef(18, "Citations & Evidence", "Verifiable Claim Ratio", 2.65, "High"),
    CheckDef(19, "Citations & Evidence", "Case Studies with Metrics", 2.65, "High"),
    CheckDef(20, "Trust & Transparency", "Team Page Complete", 2.12, "High"),
    CheckDef(21, "Author & Expertise", "Author Experience Quantified", 2.12, "Medium"),
]
# How a linked page of each role is recognised.
ROLES = {
    "about": "about",
    "contact": "contact|get in touch",
    "privacy": "privacy",
    "terms": "terms|conditions|tos",
    "team": "team|people|leadership|authors",
    "editorial": "editorial|fact.check|review.policy|correction",
    "case_study": "case.stud|results|customer.story|success.story",
    "article": "blog|article|insight|news|guide",
}


def role_columns() -> list[Column]:
    """First matching same-site link per role, plus the bio link."""
    site = F.col("site_host")
    return [
        *[D.matching_link(site, pattern)["abs"].alias(role) for role, pattern in ROLES.items()],
        D.bio_link(site)["abs"].alias("bio_home"),
    ]


def target_facts(parsed: DataFrame, url: str = "url") -> DataFrame:
    """What the checks ask of a linked page, as small columns computed where the page is parsed."""
    body = T.collapse(F.col("body_text"))
    anchors = F.col("anchors")
    has_href = lambda pattern: D.n(anchors, lambda a: P.test(D.attr(a, "href"), pattern, ""))
    status = F.col("status") if "status" in parsed.columns else F.lit(200)
    rows = parsed.where(status.between(200, 299)).withColumn("_host", U.bare_host(F.col(url))).select(
        F.col(url).alias("req_url"),
        F.lit(True).alias("found"),
        T.word_count(body).alias("words"),
        T.has_postal_address(body).alias("address"),
        T.has_phone(body).alias("phone"),
        T.has_email(body).alias("email"),
        has_href(r"linkedin\.com").alias("linkedin"),
        has_href("/blog|/article|/news|/insight").alias("content_links"),
        F.size("images").alias("images"),
        P.count(body, r"\b(CEO|Founder|Director|Manager|Lead|Head of)\b", "").alias("role_words"),
        P.test(body, r"\b\d+\+?\s+(years?|yrs?)\b|\b(since|experience)\s+\d{4}\b").alias("experience"),
        P.test(body, r"\b\d+(?:\.\d+)?%|\b\d+x\b|\bROI\b|\brevenue\b|\bsaved\b").alias("metric"),
        D.has_byline().alias("byline"),
        F.coalesce(D.bio_link(F.col("_host"))["abs"], F.lit("")).alias("bio"),
    )
    return one_row(rows, ("req_url",))


_FACTS = (
    "found", "words", "address", "phone", "email", "linkedin", "content_links", "images", "role_words", "experience",
    "metric", "byline", "bio",
)


def audit(pages: DataFrame, targets: DataFrame) -> DataFrame:
    """``targets``: :func:`target_facts` of every captured page.

    Pages are parsed once: what is read of them is written as one narrow row each, and so are the targets.
    """
    c = F.col
    roles = list(ROLES)
    targets = stage(targets, "expertise_targets")
    host = U.bare_host(c("url"))
    citation = (
        D.n(c("anchors"), lambda a: D.attr_or(a, "href").startswith("http") & a["up"].rlike("/(article|main)/"))
        + D.tag_total("cite", "blockquote")
        + D.n(c("anchors"), lambda a: D.has(a, "href") & D.inside(a, "sup")
              & ~(D.attr_or(a, "href").startswith("http") & a["up"].rlike("/(article|main)/")))
    )
    found_on = pages.withColumn("site_host", U.bare_host(c("url"))).select(
        "site_id", "page_id", "parse_error", *role_columns(),
        D.has_byline().alias("home_byline"),
        (D.tag_count("article") > 0).alias("has_article"),
        P.test(c("html"), "blog|article|news|insight").alias("article_words"),
        P.test(c("html"), "trusted by|clients|customers|partners|featured in").alias("client_words"),
        D.n(c("images"), lambda i: D.has(i, "alt")).alias("n_alt"),
        D.any_of(D.outbound_links(host), lambda a: a["host"].rlike(r"\.(edu|gov)$")).alias("edu_gov"),
        citation.alias("n_citations"),
    )
    found_on = stage(found_on, "expertise_home")
    links = found_on.select("site_id", *roles, "bio_home")
    home = found_on.drop(*roles, "bio_home")
    found = by_role(answer(wanted_rows(links, {r: c(r) for r in roles}), targets), roles, _FACTS)
    # the bio link comes from the article page when that page has one
    joined = home.join(large(links.select("site_id", "bio_home", *[c(r).alias(f"{r}_url") for r in roles])), "site_id").join(
        large(found), "site_id", "left"
    )
    article_bio = c("article")["bio"]
    joined = joined.withColumn(
        "bio_url", F.coalesce(F.when(article_bio != "", article_bio), c("bio_home"))
    )
    bio = targets.select(F.col("req_url").alias("bio_url"), F.struct(*_FACTS).alias("bio"))
    known = joined.select("site_id", "bio_url").where(F.coalesce("bio_url", F.lit("")) != "").join(large(bio), "bio_url").drop("bio_url")
    wide = joined.join(large(known), "site_id", "left")
    value = lambda role, fact, default=0: F.coalesce(c(role)[fact], F.lit(default))
    flag = lambda role, fact="found": F.coalesce(c(role)[fact], F.lit(False))
    is_article = flag("article") | c("has_article") | c("article_words")
    byline = F.when(flag("article"), flag("article", "byline")).otherwise(c("home_byline"))
    has_bio_link = F.coalesce(c("bio_url"), F.lit("")) != ""
    verdicts = [
        ([1], Verdict(is_article & byline, evidence={"article": c("article_url")})),
        ([2], Verdict(is_article & has_bio_link, evidence={"bio": c("bio_url")})),
        ([3], Verdict(flag("bio"), evidence={"bio": c("bio_url")})),
        ([4], Verdict(value("bio", "words") >= 150, evidence={"words": c("bio")["words"]})),
        ([5], Verdict(value("bio", "linkedin") > 0, evidence={"links": c("bio")["linkedin"]})),
        ([6], Verdict(value("bio", "content_links") >= 3, evidence={"links": c("bio")["content_links"]})),
        ([21], Verdict(flag("bio", "experience"), evidence={"bio": c("bio_url")})),
        ([7], Verdict(flag("editorial") & (value("editorial", "words") >= 100), evidence={"url": c("editorial_url")})),
        ([8], Verdict(flag("contact", "address"), evidence={"url": c("contact_url")})),
        ([9], Verdict(flag("contact", "phone"), evidence={"url": c("contact_url")})),
        ([10], Verdict(flag("contact", "email"), evidence={"url": c("contact_url")})),
        ([11], Verdict(skipped=True, evidence={"reason": F.lit("needs a form submission")})),
        ([12], Verdict(value("privacy", "words") >= 300, evidence={"words": c("privacy")["words"]})),
        ([13], Verdict(flag("terms") & (value("terms", "words") >= 100), evidence={"words": c("terms")["words"]})),
        ([15], Verdict(value("about", "words") >= 300, evidence={"words": c("about")["words"]})),
        ([20], Verdict(flag("team") & ((value("team", "images") >= 2) | (value("team", "linkedin") >= 2)
                                       | (value("team", "role_words") >= 2)), evidence={"url": c("team_url")})),
        ([14], Verdict(c("client_words") & (c("n_alt") >= 2), evidence={"images": c("n_alt")})),
        ([16], Verdict(c("edu_gov"))),
        ([17], Verdict(is_article & (c("n_citations") > 0), evidence={"citations": c("n_citations")})),
        ([18], Verdict(skipped=True, evidence={"reason": F.lit("needs claim validation")})),
        ([19], Verdict(flag("case_study") & flag("case_study", "metric"), evidence={"url": c("case_study_url")})),
    ]
    return check_rows(wide, ["site_id", "page_id"], EXPERTISE, verdicts)
