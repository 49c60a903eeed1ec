"""The public call judges every captured page of a site."""

import fixtures as X
from sitegauge import audit
from sitegauge.sources import captures as C

GOOD = "<html><body><h1>One good heading here</h1><img src='/a-b.webp' alt='a fine picture'></body></html>"
BAD = "<html><body><h1>Short</h1><h3>skip</h3><img src='/b.png'></body></html>"


def test_later_pages_reach_rows_scores_and_reports(spark):
    pages = [{"site_id": s, "page_id": 10 * n + i, "url": f"https://{s}.example/" + (f"p{i}" if i else ""), "html": GOOD if i == 0 or s == "same" else BAD}
             for n, s in enumerate(("same", "mixed")) for i in range(3)]
    sites = [{"site_id": s, "brand_name": f"Brand {s}", "website_url": f"https://{s}.example/", "business_email": f"a@{s}.example"} for s in ("same", "mixed")]
    out = audit(spark, {"sites": X.frame(spark, sites, C.SITES),
                        "pages": X.frame(spark, pages, "site_id string, page_id bigint, url string, html string")}, X.AS_OF)
    rows = out["page_check_results"].collect()
    per_page = {p: sum(r.page_id == p for r in rows) for p in (0, 1, 2, 10, 11, 12)}
    assert len(set(per_page.values())) == 1 and sum(per_page.values()) == len(rows) > 0
    folded = {(r.site_id, r.audit, r.check_id): r for r in out["check_results"].where("audit in ('structured_data', 'on_page', 'image')").collect()}
    assert 3 * len(folded) == len(rows)
    assert folded["same", "image", 1].passed and folded["same", "image", 1].page_id == 0
    assert not folded["mixed", "image", 1].passed and folded["mixed", "image", 1].page_id == 11
    totals = {(r.site_id, r.audit): r.n for r in out["category_scores"].groupBy("site_id", "audit").agg({"total": "sum"}).toDF("site_id", "audit", "n").collect()}
    assert all(totals["mixed", a] == 3 * sum(k[:2] == ("mixed", a) for k in folded) for a in ("structured_data", "on_page", "image"))
    scores = {(r.site_id, r.audit): r.score for r in out["audit_scores"].collect()}
    assert scores["same", "image"] > scores["mixed", "image"]
