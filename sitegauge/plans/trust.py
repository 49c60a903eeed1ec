"""Trust-signal audit: 15 checks comparing the home page, its footer, schema and linked pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dom as D
from ..functions import headers as H
from ..functions import jsonld as J
from ..functions import text as T
from ..functions import urls as U
from ..operators.links import answer, by_role, wanted_rows
from ..operators.scoring import TRUST
from ..session import large, stage
from ..sources.captures import one_row
from .rules import CheckDef, Verdict, check_rows
from .structured_data import LOCAL_TYPES, ORG_TYPES

# Id, category, name, weight, severity.
DEFS = [
    CheckDef(1, "NAP & Brand Consistency", "NAP: Footer vs Schema vs Contact", 4.86, "Critical"),
    CheckDef(2, "NAP & Brand Consistency", "City Name Consistent Sitewide", 3.74, "High"),
    CheckDef(3, "NAP & Brand Consistency", "Brand Name Consistent Sitewide", 3.74, "High"),
    CheckDef(4, "NAP & Brand Consistency", "Business Email Company Domain", 2.67, "High"),
    CheckDef(5, "NAP & Brand Consistency", "Address Matches Schema", 3.74, "Critical"),
    CheckDef(6, "NAP & Brand Consistency", "Phone Format Consistent", 2.67, "High"),
    CheckDef(7, "Schema-DOM Parity", "Schema-DOM Price Parity", 4.28, "Critical"),
    CheckDef(8, "NAP & Brand Consistency", "Schema-DOM Name Parity", 3.21, "High"),
    CheckDef(9, "NAP & Brand Consistency", "Schema-DOM Phone Parity", 3.74, "Critical"),
    CheckDef(10, "Schema-DOM Parity", "Schema-DOM Date Parity", 2.67, "High"),
    CheckDef(11, "Technical Trust", "Contact Form Functional", 2.67, "High"),
    CheckDef(12, "Technical Trust", "No Outdated Copyright Year", 2.14, "Medium"),
    CheckDef(13, "Technical Trust", "HTTPS Security Headers", 2.14, "Medium"),
    CheckDef(14, "Technical Trust", "Legal Registration Number", 2.14, "Medium"),
    CheckDef(15, "Technical Trust", "Privacy Policy <24 Months Old", 2.14, "Medium"),
]


def target_texts(parsed: DataFrame, url: str = "url") -> DataFrame:
    """Text of every captured page that answered, one row per address."""
    status = F.col("status") if "status" in parsed.columns else F.lit(200)
    rows = parsed.where(status.between(200, 299)).select(
        F.col(url).alias("req_url"), T.collapse(F.col("body_text")).alias("text")
    )
    return one_row(rows, ("req_url",))


def audit(pages: DataFrame, sites: DataFrame, targets: DataFrame, as_of: Column) -> DataFrame:
    c = F.col
    headers = c("headers") if "headers" in pages.columns else F.create_map().cast("map<string,string>")
    host = U.bare_host(c("url"))
    home = pages.select(
        "site_id", "page_id", "url",
        headers.alias("headers"),
        T.collapse(c("body_text")).alias("body"),
        D.footer_text().alias("footer"),
        "ld", J.records().alias("recs"),
        D.matching_link(host, "contact|get in touch")["abs"].alias("contact_url"),
        D.matching_link(host, "privacy")["abs"].alias("privacy_url"),
    )
    home = stage(home, "trust_home")  # parsed once, read by two branches
    linked = by_role(
        answer(wanted_rows(home, {"contact": c("contact_url"), "privacy": c("privacy_url")}), targets),
        ["contact", "privacy"], ["text"],
    )
    entity = F.coalesce(J.first(J.of_type(c("recs"), LOCAL_TYPES)), J.first(J.of_type(c("recs"), ORG_TYPES)))
    wide = (
        home.join(large(linked), "site_id", "left")
        .join(large(sites.select("site_id", "brand_name", "business_email")), "site_id", "left")
        .withColumn("contact", F.coalesce(c("contact")["text"], F.lit("")))
        .withColumn("privacy", F.coalesce(c("privacy")["text"], F.lit("")))
        .withColumn("entity", entity)
        .select(
            "site_id", "page_id", "url", "headers", "body", "footer", "contact", "privacy", "contact_url",
            "brand_name", "business_email",
            F.concat_ws(" ", "body", "footer", "contact", "privacy").alias("all_text"),
            J.text_of(c("entity"), "name", True).alias("schema_name"),
            J.address_text(c("entity")).alias("address"),
            J.text_of(J.get(c("entity"), "address"), "addressLocality", True).alias("city"),
            J.phones(c("entity")).alias("schema_phones"),
            J.dates(c("recs")).alias("dates"),
            J.prices(J.of_type(c("recs"), ["Product"])).alias("prices"),
        )
        .withColumn("footer_phones", T.phone_digits(T.phone_candidates(c("footer"))))
        .withColumn("contact_phones", T.phone_digits(T.phone_candidates(c("contact"))))
        .withColumn("body_phones", T.phone_digits(T.phone_candidates(c("body"))))
        .withColumn("schema_digits", T.phone_digits(c("schema_phones")))
        .withColumn("emails", T.email_candidates(c("all_text")))
        .withColumn("page_phones", F.array_distinct(F.concat("body_phones", "footer_phones", "contact_phones")))
        .withColumn("brand", F.coalesce(F.when(c("brand_name") != "", c("brand_name")), c("schema_name")))
        .withColumn(
            "expected_domain",
            F.when(F.coalesce(c("business_email"), F.lit("")) != "", U.root_domain(U.domain_from_email(c("business_email"))))
            .otherwise(U.root_domain(U.host(c("url")))),
        )
    )
    shown = T.contains_text
    address, city, brand, name = c("address"), c("city"), c("brand"), c("schema_name")
    every = lambda values: (F.size(values) > 0) & F.forall(values, lambda v: shown(c("body"), v))
    unless_empty = lambda surface, needle: (surface == "") | shown(surface, needle)
    years = T.copyright_years(c("all_text"), as_of)
    updated = T.policy_date(c("privacy"))
    registrations = T.registration_numbers(c("all_text"))
    verdicts = [
        ([1], Verdict(
            (address != "") & shown(c("footer"), address) & shown(c("contact"), address)
            & F.arrays_overlap("schema_digits", "footer_phones") & F.arrays_overlap("schema_digits", "contact_phones"),
            evidence={"address": address, "contact": c("contact_url")})),
        ([2], Verdict((city != "") & unless_empty(c("body"), city) & unless_empty(c("footer"), city)
                      & unless_empty(c("contact"), city), evidence={"city": city})),
        ([3], Verdict((brand != "") & shown(c("body"), brand)
                      & ((name == "") | (T.normalized(name) == T.normalized(brand)))
                      & unless_empty(c("contact"), brand), evidence={"brand": brand, "schema_name": name})),
        ([4], Verdict((F.size("emails") > 0) & F.forall(
            "emails", lambda e: U.root_domain(U.domain_from_email(e)) == c("expected_domain")),
            evidence={"emails": F.array_join("emails", " "), "expected": c("expected_domain")})),
        ([5], Verdict((address != "") & (shown(c("body"), address) | shown(c("contact"), address)
                                         | shown(c("footer"), address)), evidence={"address": address})),
        ([6], Verdict(F.size("page_phones") == 1, evidence={"phones": F.array_join("page_phones", " ")})),
        ([7], Verdict(every(c("prices")), evidence={"prices": F.array_join("prices", " ")})),
        ([8], Verdict((name != "") & shown(c("body"), name), evidence={"schema_name": name})),
        ([9], Verdict((F.size("schema_digits") > 0) & (F.size(F.array_except("schema_digits", "page_phones")) == 0),
                      evidence={"schema": F.array_join("schema_digits", " ")})),
        ([10], Verdict(every(c("dates")), evidence={"dates": F.array_join("dates", " ")})),
        ([11], Verdict(skipped=True, evidence={"reason": F.lit("needs a form submission")})),
        ([12], Verdict(F.exists(years, lambda y: y >= F.year(as_of)), evidence={"years": F.size(years)})),
        ([13], Verdict((U.scheme(c("url")) == "https") & (H.header(c("headers"), "strict-transport-security") != "")
                       & (H.header(c("headers"), "x-content-type-options") != ""))),
        ([14], Verdict(F.size(registrations) > 0, evidence={"numbers": F.array_join(registrations, "; ")})),
        ([15], Verdict(T.add_months_rolling(updated, 24) >= as_of.cast("date"), evidence={"updated": updated})),
    ]
    return check_rows(wide, ["site_id", "page_id"], TRUST, verdicts)
