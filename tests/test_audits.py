"""Audits on the hand-made capture; expected states come from reading the rules."""

import pytest
from pyspark.sql import functions as F

import fixtures as X
from sitegauge import check_definitions
from sitegauge.operators.parse import parse_pages
from sitegauge.plans import eeat, facts as FM, image, indexability, on_page, structured_data, technical, trust
from sitegauge.plans.audit import sitemap_addresses


@pytest.fixture(scope="module")
def facts(spark):
    return FM.build(spark, X.inputs(spark), staged=True)


def states(rows):
    out = {}
    for r in rows.collect():
        out.setdefault(r.site_id, {})[r.check_id] = "S" if r.skipped else "P" if r.passed else "W" if r.warning else "F"
    return out


def listed(states_, state):
    return sorted(i for i, s in states_.items() if s == state)


def test_catalogue_is_complete(spark):
    counts = {r["audit"]: r["count"] for r in check_definitions(spark).groupBy("audit").count().collect()}
    assert counts == {"technical": 237, "answer_engine": 61, "indexability": 26, "structured_data": 62, "on_page": 13, "image": 13, "eeat": 21, "trust": 15}


def test_technical(spark, facts):
    result = states(technical.audit(facts, F.lit(X.AS_OF).cast("timestamp")))
    assert {len(s) for s in result.values()} == {237}
    acme, poor, gone = result["acme"], result["poor"], result["gone"]
    for i in (1, 2, 3, 4, 5, 10, 11, 12, 13, 16, 26, 29, 31, 47, 48, 56, 67, 68, 69, 70, 80, 81, 82, 114, 117, 118, 123, 137, 191, 192, 229):
        assert acme[i] == "P", i
    for i in (15, 20, 27, 35, 45, 46, 71, 83, 92, 116, 125, 136, 139, 143, 199, 235):
        assert acme[i] == "F", i
    for i in (2, 3, 9, 18, 20, 22, 26, 34, 41, 42, 105, 107, 123):
        assert poor[i] == "F", i
    assert listed(gone, "P") == [15, 30, 43, 62, 66, 95, 128, 136, 199, 214, 229, 231]


def test_indexability(spark, facts):
    addresses = sitemap_addresses(facts)
    assert {r.url for r in addresses.collect()} == {"https://acme.com/", "https://acme.com/about"}
    result = states(indexability.audit(facts.home, facts.index, facts.answers.select("req_url", "status"), facts.manual, addresses))
    assert listed(result["acme"], "F") == [] and listed(result["acme"], "S") == [2, 3, 4, 19, 20]
    assert listed(result["poor"], "F") == [7, 8, 9, 16, 25]


def test_linked_page_audits(spark, facts):
    shared = ["url", "status", "body_text", "anchors", "images", "nodes", "headings", "tag_counts"]
    captured = facts.pages.select(*shared).unionByName(facts.parsed_log.where(F.col("user_agent").isNull()).select(*shared))
    result = states(eeat.audit(facts.home, eeat.target_facts(captured)))
    assert listed(result["acme"], "P") == [2, 3, 4, 8, 9, 10, 12, 15, 16, 17] and listed(result["acme"], "S") == [11, 18]
    result = states(trust.audit(facts.home, facts.sites, trust.target_texts(captured), F.lit(X.AS_OF).cast("timestamp")))
    assert listed(result["acme"], "F") == [7, 10, 14] and listed(result["poor"], "P") == []


LD = '<script type="application/ld+json">%s</script>'


@pytest.mark.parametrize("module, html, expected", [
    (on_page, "<h1>One good heading here</h1><h3>skip</h3>", {1: "F", 4: "S", 11: "P", 13: "P"}),
    (on_page, "<h1>Short</h1><table><caption>c</caption><tr><td>price plan</table><blockquote>q<cite>c</cite></blockquote>", {1: "P", 3: "P", 4: "P", 5: "P", 13: "F"}),
    (on_page, "<p>On Jan 5, 2024 we met</p><img src=a>", {1: "F", 7: "F", 11: "F"}),
    (on_page, "<p>On <time datetime='2024-01-05'>Jan 5, 2024</time></p><section><p><a href='/r'>Related</a> <a href='/s'>s</a></p></section>", {7: "P", 9: "P", 10: "P"}),
    (image, "<p>none</p>", {1: "P", 3: "S", 4: "S", 10: "S", 12: "S", 13: "S"}),
    (image, "<img src='/a.png' alt=''><img src='/b.png?v=2' alt='price 5%'>", {1: "F", 2: "F", 5: "F", 6: "W", 8: "F", 10: "W", 13: "F"}),
    (image, "<picture><source type='image/webp' srcset='a.webp'><img src='/my-big_photo.webp' alt=x loading=lazy srcset=a sizes=b></picture><svg><title>t</title><desc>d</desc></svg>",
     {1: "P", 2: "P", 4: "P", 5: "P", 6: "P", 7: "P", 8: "P", 12: "P"}),
    (structured_data, "<p>plain</p>", {1: "F", 2: "F", 5: "S", 9: "W", 17: "S", 36: "S", 42: "P", 43: "F", 52: "F", 56: "F"}),
    (structured_data, LD % "{bad", {1: "F", 42: "F", 43: "P", 52: "P"}),
    (structured_data, LD % '[{"@type":"FAQPage","mainEntity":[{"name":"What is it"},{"name":"Why"},{"name":"How"}]}]' + "<p>What is it? Why? How?</p>",
     {28: "P", 29: "P", 30: "P", 49: "P", 39: "F"}),
    (structured_data, LD % '{"@graph":[{"@type":"Product","name":"N","brand":"B","description":"d","offers":{"price":9.5,"availability":"https://schema.org/InStock"},"sku":"1","url":"http://x/"},{"@type":"WebSite","@id":"#w"}]}' + "<p>N costs 9.5 instock</p>",
     {32: "P", 33: "P", 34: "F", 35: "P", 38: "P", 39: "P", 44: "F", 45: "P", 50: "P"}),
])
def test_page_checks(spark, module, html, expected):
    rows = X.frame(spark, [{"site_id": "s", "page_id": 1, "url": "https://s.com/", "html": f"<html><body>{html}</body></html>"}],
                   "site_id string, page_id bigint, url string, html string")
    got = states(module.audit(parse_pages(rows)))["s"]
    assert {i: got[i] for i in expected} == expected


def test_the_public_call_ends_with_all_outputs(spark):
    """Every published output over the whole capture; page audits, advice and reports included."""
    from sitegauge import audit

    out = audit(spark, X.inputs(spark), X.AS_OF)
    scores = {(r["site_id"], r["audit"]): r["score"] for r in out["audit_scores"].collect()}
    assert {s for s, _ in scores} == {"acme", "poor", "gone"} and len(scores) == 24
    assert all(scores["acme", a] > scores["poor", a] for a in ("answer_engine", "indexability", "structured_data", "on_page", "eeat", "trust"))
    assert scores["acme", "technical"] == scores["poor", "technical"] == 50 > scores["gone", "technical"]  # a failed blocker holds it at 50
    counts = {r["audit"]: r["count"] for r in out["check_results"].groupBy("audit").count().collect()}
    assert counts["technical"] == 3 * 237 and counts["answer_engine"] == 2 * 61 and counts["on_page"] == 2 * 13
    assert [r["site_id"] for r in out["rejected_sites"].collect()] == ["bad"]
    assert out["reports"].count() == 3 and out["csv_rows"].count() > 0 and out["citation_details"].count() > 0
    assert [r["page_id"] for r in out["orphans"].collect()] == [21]
    assert out["recommendations"].where("site_id = 'poor'").count() > 0
