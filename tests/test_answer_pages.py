"""The answer-engine audit reads every page of a site, and lookups across its pages."""

import pytest

import fixtures as X
from sitegauge.plans import answer_engine, facts as FM
from sitegauge.plans.audit import sitemap_addresses

LD = '<script type="application/ld+json">%s</script>'
SHOP = '{"@type":"Store","name":"Deep Shop","telephone":"+1 555 700 8000"}'
PLAIN = "<p>Plain words only</p>"


def states(spark, bodies, log=()):
    """Check states of one site whose n-th page has the n-th body."""
    from sitegauge.sources import captures as C

    origin = "https://deep.example/"
    pages = [{"site_id": "deep", "page_id": i, "url": origin + (f"p{i}" if i else ""), "html": f"<html><body>{b}</body></html>"}
             for i, b in enumerate(bodies)]
    sites = [{"site_id": "deep", "brand_name": "Deep", "website_url": origin, "business_email": "a@deep.example"}]
    facts = FM.build(spark, {
        "sites": X.frame(spark, sites, C.SITES), "fetch_log": X.frame(spark, list(log), C.FETCH_LOG),
        "pages": X.frame(spark, pages, "site_id string, page_id bigint, url string, html string"),
    }, staged=True)
    rows = answer_engine.audit(facts, sitemap_addresses(facts)).collect()
    assert len(rows) == 61
    return {r.check_id: r for r in rows}


@pytest.fixture(scope="module")
def late(spark):
    """Fourteen pages; what counts is on the last ones, and what a record says is shown on another page."""
    faq = LD % '{"@type":"FAQPage","mainEntity":[{"name":"a"},{"name":"b"}]}'
    return states(spark, [PLAIN] * 8 + [
        "<details>faq</details>" + faq, LD % SHOP + LD % '{"@type":"Product","name":"Blue Lamp","brand":"B"}',
        "<p>Blue Lamp by Deep Shop</p>", "<p>Reach us: 555 7008000</p><p>certified and licensed</p>",
        LD % '{"@type":"Store","name":"Other Shop","telephone":"+1 555 700 8111"}', LD % "{broken",
    ])


def test_evidence_of_late_pages_counts(late):
    assert all(late[i].passed for i in (17, 18, 19, 24))
    assert not late[16].passed and late[16].evidence["errors"] == "1"


def test_records_shown_on_another_page(late):
    assert late[36].passed and late[15].passed
    assert late[52].evidence["percent"] == "50"


def test_clash_after_the_tenth_page(spark, late):
    assert not late[70].passed and late[70].evidence["pages"] == "2"
    same = states(spark, [LD % SHOP] * 12)
    assert same[70].passed and same[70].evidence["pages"] == "12"
    clash = states(spark, [LD % SHOP] * 11 + [LD % SHOP.replace("8000", "9000")])
    assert not clash[70].passed and clash[70].evidence["pages"] == "12"


def test_titles_after_the_twentieth_lookup(spark):
    urls = [f"https://deep.example/terms-{i:02d}" for i in range(25)]
    sitemap = "<urlset>" + "".join(f"<url><loc>{u}</loc></url>" for u in urls) + "</urlset>"
    page = "<html><head><title>%s</title></head><body>x</body></html>"
    log = [X.answer("https://deep.example/robots.txt", "Sitemap: https://deep.example/sitemap.xml", site="deep"),
           X.answer("https://deep.example/sitemap.xml", sitemap, "application/xml", site="deep")]
    log += [X.answer(u, page % ("Refund policy" if u.endswith("24") else "Note"), "text/html", site="deep") for u in urls]
    got = states(spark, [PLAIN], log)
    assert got[55].passed and "Refund/Returns" in got[55].evidence["types"]
