"""Structured-data audit: 62 checks on one page's JSON-LD against its text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dom as D
from ..functions import jsonld as J
from ..functions import patterns as P
from ..functions import text as T
from ..functions import urls as U
from ..operators.scoring import STRUCTURED
from .rules import CheckDef, Verdict, check_rows

# Id, category, name, weight, severity.
DEFS = [
    CheckDef(1, "Organization Schema", "Organization Schema Present", 3.07, "Critical"),
    CheckDef(2, "Organization Schema", "Org: name Property", 2.03, "Critical"),
    CheckDef(3, "Organization Schema", "Org: url Property", 1.52, "High"),
    CheckDef(4, "Organization Schema", "Org: logo ImageObject", 1.52, "Medium"),
    CheckDef(5, "Organization Schema", "Org: telephone", 1.52, "Critical"),
    CheckDef(6, "Organization Schema", "Org: address PostalAddress", 2.03, "Critical"),
    CheckDef(7, "Organization Schema", "Org: sameAs >=4", 2.54, "Critical"),
    CheckDef(8, "Organization Schema", "Org: sameAs LinkedIn", 2.03, "High"),
    CheckDef(9, "Organization Schema", "Org: sameAs Wikidata/Crunchbase", 2.03, "High"),
    CheckDef(10, "Organization Schema", "Org: knowsAbout >=5", 2.03, "Medium"),
    CheckDef(11, "Organization Schema", "Org: @id Declared", 1.52, "High"),
    CheckDef(12, "Organization Schema", "Org: foundingDate", 1.02, "Medium"),
    CheckDef(13, "LocalBusiness Schema", "LocalBusiness: GPS", 2.03, "High"),
    CheckDef(14, "LocalBusiness Schema", "LocalBusiness: areaServed", 1.52, "Medium"),
    CheckDef(15, "LocalBusiness Schema", "LocalBusiness: openingHours", 1.52, "Medium"),
    CheckDef(16, "LocalBusiness Schema", "LocalBusiness: @type Specificity", 1.02, "Medium"),
    CheckDef(17, "Article Schema", "Article: headline", 2.03, "Critical"),
    CheckDef(18, "Article Schema", "Article: author Person", 2.03, "High"),
    CheckDef(19, "Article Schema", "Article: datePublished ISO", 1.52, "High"),
    CheckDef(20, "Article Schema", "Article: dateModified=Visible", 2.03, "High"),
    CheckDef(21, "Article Schema", "Article: about Entity", 1.52, "Medium"),
    CheckDef(22, "Article Schema", "Article: image ImageObject", 1.02, "Medium"),
    CheckDef(23, "Article Schema", "Article: publisher->Org", 1.52, "High"),
    CheckDef(24, "Person Schema", "Person Schema on Bio Pages", 2.03, "High"),
    CheckDef(25, "Person Schema", "Person: name+jobTitle+url", 1.52, "Medium"),
    CheckDef(26, "Person Schema", "Person: sameAs LinkedIn", 1.52, "Medium"),
    CheckDef(27, "Person Schema", "Person: knowsAbout", 1.52, "Medium"),
    CheckDef(28, "FAQ & HowTo Schema", "FAQPage When FAQ in DOM", 2.03, "High"),
    CheckDef(29, "FAQ & HowTo Schema", "FAQPage >=3 Items", 1.52, "Medium"),
    CheckDef(30, "FAQ & HowTo Schema", "FAQPage Text >=90% Match", 2.03, "Critical"),
    CheckDef(31, "FAQ & HowTo Schema", "HowTo on Step-by-Step", 1.52, "Medium"),
    CheckDef(32, "Product Schema", "Product: name+brand+desc", 2.03, "Critical"),
    CheckDef(33, "Product Schema", "Product: offers price+avail", 2.03, "Critical"),
    CheckDef(34, "Product Schema", "Product: aggregateRating", 1.52, "High"),
    CheckDef(35, "Product Schema", "Product: GTIN/MPN/SKU", 1.52, "High"),
    CheckDef(36, "Supporting Schema Types", "BreadcrumbList on Interior", 2.03, "High"),
    CheckDef(37, "Supporting Schema Types", "BreadcrumbList Matches DOM", 1.52, "High"),
    CheckDef(38, "Supporting Schema Types", "WebSite on Homepage", 1.02, "Medium"),
    CheckDef(39, "Supporting Schema Types", "@graph Interconnection", 1.52, "Medium"),
    CheckDef(40, "Supporting Schema Types", "ImageObject on Key Images", 1.02, "Medium"),
    CheckDef(41, "Supporting Schema Types", "VideoObject on Videos", 1.02, "Medium"),
    CheckDef(42, "Schema Validation & Quality", "Rich Results Test Zero Errors", 2.54, "Critical"),
    CheckDef(43, "Schema Validation & Quality", "JSON-LD Format (Not Microdata)", 1.52, "High"),
    CheckDef(44, "Schema Validation & Quality", "Absolute HTTPS URLs in Schema", 1.52, "High"),
    CheckDef(45, "Schema-DOM Parity", "Schema-DOM: Price Match", 2.03, "Critical"),
    CheckDef(46, "Schema-DOM Parity", "Schema-DOM: Phone Match", 2.03, "Critical"),
    CheckDef(47, "Schema-DOM Parity", "Schema-DOM: Name Match", 1.52, "High"),
    CheckDef(48, "Schema-DOM Parity", "Schema-DOM: Date Match", 1.52, "High"),
    CheckDef(49, "Schema-DOM Parity", "Schema-DOM: FAQ Match", 1.52, "Critical"),
    CheckDef(50, "Schema-DOM Parity", "Schema-DOM: Availability Match", 1.52, "Critical"),
    CheckDef(51, "Schema Validation & Quality", "No Duplicate @id Values", 1.52, "High"),
    CheckDef(52, "Schema Validation & Quality", "Schema in Server HTML", 2.03, "Critical"),
    CheckDef(53, "FAQ & HowTo Schema", "HowTo: step Array Nested", 1.52, "Medium"),
    CheckDef(54, "LocalBusiness Schema", "LocalBusiness: priceRange", 1.02, "Medium"),
    CheckDef(55, "FAQ & HowTo Schema", "HowTo: totalTime+Cost", 1.02, "Low"),
    CheckDef(56, "Schema Validation & Quality", "Schema Versioning", 0.51, "Low"),
    CheckDef(57, "Specialist Schema Types", "Speakable + Valid Selectors", 1.52, "Medium"),
    CheckDef(58, "Specialist Schema Types", "DefinedTerm on Glossary", 1.52, "Medium"),
    CheckDef(59, "Specialist Schema Types", "Dataset on Research", 1.02, "Medium"),
    CheckDef(60, "Specialist Schema Types", "ProfilePage on Bio Pages", 1.02, "Low"),
    CheckDef(61, "Specialist Schema Types", "Event on Webinars", 1.02, "Low"),
    CheckDef(62, "Specialist Schema Types", "SoftwareApp on Tools", 1.02, "Low"),
]
# Record types that stand for the organisation and for a local business.
ORG_TYPES = (
    "Organization", "LocalBusiness", "Corporation", "OnlineBusiness", "ProfessionalService", "MedicalOrganization",
    "NGO", "EducationalOrganization",
)
LOCAL_TYPES = (
    "LocalBusiness", "ProfessionalService", "FinancialService", "MedicalBusiness", "Store", "Restaurant", "Dentist",
    "MedicalClinic", "HealthAndBeautyBusiness",
)


def features(pages: DataFrame) -> DataFrame:
    nodes = F.col("nodes")
    faq_marks = D.any_of(
        D.every_element(), lambda e: P.test(D.attr(e, "class"), "faq") | P.test(D.attr(e, "id"), "faq")
    )
    map_frame = D.any_of(
        nodes, lambda e: (e["tag"] == "iframe") & F.contains(D.attr_or(e, "src"), F.lit("google.com/maps"))
    )
    embedded = D.n(
        F.concat(nodes, F.col("metas"), F.col("anchors"), F.col("headings"), F.col("images")),
        lambda e: D.has(e, "itemscope") | D.has(e, "typeof") | D.has(e, "property"),
    )
    step = pages.select(
        "site_id", "page_id", "url", "parse_error",
        T.collapse(F.col("body_text")).alias("body"),
        F.col("body_text").alias("raw"),
        "ld", J.records().alias("recs"),
        J.error_count().alias("n_errors"),
        F.size("jsonld").alias("n_blocks"),
        ((D.tag_count("details") > 0) | faq_marks).alias("faq_dom"),
        map_frame.alias("map_frame"),
        (D.tag_count("article") > 0).alias("has_article"),
        D.video_count(extra_host=False).alias("n_videos"),
        F.size("images").alias("n_images"),
        embedded.alias("n_embedded"),
    )
    recs = F.col("recs")
    first_of = lambda *names: J.first(J.of_type(recs, names))
    return step.select(
        "*",
        T.normalized(F.col("body")).alias("norm"),
        first_of(*ORG_TYPES).alias("org"),
        first_of(*LOCAL_TYPES).alias("local"),
        J.first(F.filter(recs, lambda r: J.any_type(J.types(r), "Article|BlogPosting|NewsArticle", "i"))).alias("article"),
        first_of("Person").alias("person"),
        first_of("FAQPage").alias("faq"),
        first_of("HowTo").alias("how_to"),
        first_of("Product").alias("product"),
        first_of("BreadcrumbList").alias("breadcrumb"),
        first_of("WebSite").alias("website"),
        F.flatten(F.transform(recs, J.types)).alias("all_types"),
    )


def audit(pages: DataFrame) -> DataFrame:
    c = F.col
    body, norm, recs = c("body"), c("norm"), c("recs")
    org, local, article, person = c("org"), c("local"), c("article"), c("person")
    faq, how_to, product, breadcrumb = c("faq"), c("how_to"), c("product"), c("breadcrumb")
    has = lambda record, key: J.truthy(J.get(record, key))
    text = J.text_of
    types_have = lambda *names: F.arrays_overlap(c("all_types"), F.array(*[F.lit(n) for n in names]))
    word = lambda pattern: P.test(body, pattern)
    shows = lambda value, cut=None: F.contains(
        norm, T.normalized(value) if cut is None else F.substring(T.normalized(value), 1, cut)
    )
    is_local = local.isNotNull() | word(r"\b(address|directions|near me|hours|open now|visit us)\b") | c("map_frame")
    is_article = article.isNotNull() | c("has_article") | word(r"\b(author|published|updated)\b")
    is_person = person.isNotNull() | word(r"\b(author|founder|team|bio|job title|linkedin)\b")
    is_faq = faq.isNotNull() | c("faq_dom") | (P.count(body, r"\?", "") >= 3)
    is_how_to = how_to.isNotNull() | word(r"\b(step \d|how to|instructions|tutorial)\b")
    is_product = product.isNotNull() | word(r"\b(price|add to cart|sku|in stock|out of stock)\b")
    same_as, knows = J.scalar_texts(org, "sameAs"), J.get_array(org, "knowsAbout")
    linkedin = lambda items: F.exists(items, lambda s: P.test(s, r"linkedin\.com"))
    authority = F.exists(same_as, lambda s: P.test(s, r"wikidata\.org|crunchbase\.com"))
    offers = F.when(J.is_object(J.get(product, "offers")), J.get(product, "offers"))
    scalar = lambda record, key: F.coalesce(J.scalar(record, key), F.lit(""))
    items = J.get_array(faq, "mainEntity")
    faq_match = (F.size(items) > 0) & F.forall(items, lambda i: shows(J.text_value(i), 40))
    geo = J.get(local, "geo")
    duplicates = J.duplicate_ids(recs)
    insecure = F.flatten(F.transform(recs, J.non_https_urls))
    address = J.get(org, "address")
    availability = F.regexp_replace(T.normalized(scalar(offers, "availability")), "https schema org ", "")

    def simple(ids: list[int], record: Column, key: str, skipped: Column) -> tuple[list[int], Verdict]:
        return ids, Verdict(has(record, key), skipped=skipped, evidence={key: J.shown(J.get(record, key))})

    not_local, not_article, not_person = ~is_local, ~is_article, ~is_person
    verdicts = [
        ([1], Verdict(org.isNotNull(), evidence={"types": F.array_join("all_types", ", ")})),
        ([2], Verdict(text(org, "name") != "", evidence={"name": text(org, "name")})),
        ([3], Verdict(text(org, "url").startswith("https://"), evidence={"url": text(org, "url")})),
        ([4], Verdict(text(org, "logo") != "", evidence={"logo": text(org, "logo")})),
        ([5], Verdict(text(org, "telephone") != "", skipped=not_local, evidence={"telephone": text(org, "telephone")})),
        ([6], Verdict((J.is_object(address) & has(address, "@type")) | (text(org, "address") != ""), skipped=not_local)),
        ([7], Verdict(F.size(same_as) >= 4, evidence={"same_as": F.size(same_as)})),
        ([8], Verdict(linkedin(same_as))),
        ([9], Verdict(authority, warning=~authority, evidence={"same_as": F.array_join(same_as, " ")})),
        ([10], Verdict(F.size(knows) >= 5, warning=F.size(knows).between(1, 4), evidence={"topics": F.size(knows)})),
        ([11], Verdict(text(org, "@id").startswith("https://"), evidence={"id": text(org, "@id")})),
        ([12], Verdict(text(org, "foundingDate").rlike(r"^\d{4}(-\d{2}-\d{2})?$"),
                       skipped=~P.test(c("raw"), r"\b(founded|since|established)\b"),
                       evidence={"date": text(org, "foundingDate")})),
        ([13], Verdict(J.is_object(geo) & has(geo, "latitude") & has(geo, "longitude"), skipped=not_local)),
        simple([14], local, "areaServed", not_local),
        ([15], Verdict(has(local, "openingHours") | has(local, "openingHoursSpecification"), skipped=not_local)),
        ([16], Verdict(local.isNotNull() & F.exists(J.types(local), lambda t: t != "LocalBusiness"), skipped=not_local)),
        simple([17], article, "headline", not_article),
        simple([18], article, "author", not_article),
        ([19], Verdict(text(article, "datePublished").rlike(r"^\d{4}-\d{2}-\d{2}"), skipped=not_article)),
        ([20], Verdict(has(article, "dateModified") & shows(text(article, "dateModified"), 10), skipped=not_article)),
        simple([21], article, "about", not_article),
        simple([22], article, "image", not_article),
        simple([23], article, "publisher", not_article),
        ([24], Verdict(person.isNotNull(), skipped=not_person)),
        ([25], Verdict(has(person, "name") & has(person, "jobTitle") & has(person, "url"), skipped=not_person)),
        ([26], Verdict(linkedin(J.scalar_texts(person, "sameAs")), skipped=not_person)),
        ([27], Verdict(F.size(J.get_array(person, "knowsAbout")) > 0, skipped=not_person)),
        ([28], Verdict(faq.isNotNull(), skipped=~is_faq)),
        ([29], Verdict(F.size(items) >= 3, skipped=~is_faq, evidence={"items": F.size(items)})),
        ([30, 49], Verdict(faq_match, skipped=~is_faq, evidence={"items": F.size(items)})),
        ([31], Verdict(how_to.isNotNull(), skipped=~is_how_to)),
        ([53], Verdict(F.size(J.get_array(how_to, "step")) > 0, skipped=~is_how_to)),
        ([55], Verdict(has(how_to, "totalTime") | has(how_to, "estimatedCost"), skipped=~is_how_to,
                       warning=how_to.isNotNull())),
        ([32], Verdict(has(product, "name") & has(product, "brand") & has(product, "description"), skipped=~is_product)),
        ([33], Verdict(has(offers, "price") & has(offers, "availability"), skipped=~is_product)),
        simple([34], product, "aggregateRating", ~is_product),
        ([35], Verdict(has(product, "gtin") | has(product, "gtin13") | has(product, "mpn") | has(product, "sku"),
                       skipped=~is_product)),
        ([36], Verdict(breadcrumb.isNotNull(), skipped=U.path(c("url")) == "/")),
        ([37], Verdict(has(breadcrumb, "itemListElement"), skipped=breadcrumb.isNull())),
        ([38], Verdict(c("website").isNotNull())),
        ([39], Verdict(F.exists(recs, lambda r: has(r, "@id")) & (F.size(recs) > 1), warning=F.size(recs) > 1,
                       evidence={"records": F.size(recs)})),
        ([40], Verdict(types_have("ImageObject"), skipped=c("n_images") == 0)),
        ([41], Verdict(types_have("VideoObject"), skipped=c("n_videos") == 0)),
        ([42], Verdict(c("n_errors") == 0, evidence={"errors": c("n_errors")})),
        ([43], Verdict(c("n_blocks") > 0, warning=c("n_embedded") > 0, evidence={"blocks": c("n_blocks")})),
        ([44], Verdict(F.size(insecure) == 0, evidence={"insecure": F.array_join(insecure, " ")})),
        ([51], Verdict(F.size(duplicates) == 0, evidence={"ids": F.array_join(duplicates, " ")})),
        ([52], Verdict(c("n_blocks") > 0, evidence={"blocks": c("n_blocks")})),
        ([56], Verdict(F.exists(recs, lambda r: has(r, "@context")), warning=F.size(recs) > 0)),
        ([45], Verdict(shows(scalar(offers, "price")), skipped=~is_product | ~has(offers, "price"))),
        ([46], Verdict(shows(text(org, "telephone")), skipped=~has(org, "telephone"))),
        ([47], Verdict(shows(text(org, "name")), skipped=~has(org, "name"))),
        ([48], Verdict(shows(text(article, "datePublished"), 10), skipped=not_article | ~has(article, "datePublished"))),
        ([50], Verdict(F.contains(norm, availability), skipped=~is_product | ~has(offers, "availability"))),
        ([57], Verdict(types_have("SpeakableSpecification"), skipped=~P.test(c("raw"), r"\b(news|article|speakable)\b"))),
        ([58], Verdict(types_have("DefinedTerm"), skipped=~P.test(c("raw"), r"\b(glossary|definition|term)\b"))),
        ([59], Verdict(types_have("Dataset"), skipped=~P.test(c("raw"), r"\b(dataset|research|study|download data)\b"))),
        ([60], Verdict(types_have("ProfilePage"), skipped=not_person)),
        ([61], Verdict(types_have("Event"), skipped=~P.test(c("raw"), r"\b(webinar|event|conference|register)\b"))),
        ([62], Verdict(types_have("SoftwareApplication", "SoftwareApp"),
                       skipped=~P.test(c("raw"), r"\b(tool|software|app|platform)\b"))),
    ]
    return check_rows(features(pages), ["site_id", "page_id"], STRUCTURED, verdicts)
