"""Hand-made captures: one rich site, one poor site and one that was never reached."""

from datetime import datetime

import pyarrow as pa
from pyspark.sql import types as T

AS_OF = datetime(2026, 1, 15)
FETCHED = datetime(2026, 1, 14)
ORG = (
    '{"@context":"https://schema.org","@type":"Organization","@id":"https://acme.com/#org","name":"Acme Tools",'
    '"url":"https://acme.com/","logo":"https://acme.com/logo.webp","telephone":"+1 555 123 4567",'
    '"address":{"@type":"PostalAddress","streetAddress":"12 Main Street","addressLocality":"Springfield"},'
    '"sameAs":["https://linkedin.com/company/acme","https://wikidata.org/Q1","https://x.com/a","https://y.com/b"],'
    '"knowsAbout":["a","b","c","d","e"]}'
)
SITE = '{"@context":"https://schema.org","@graph":[{"@type":"WebSite","name":"Acme","potentialAction":{"@type":"SearchAction"}}]}'
WORDS = " ".join(f"word{i}" for i in range(320))
HOME = f"""<!doctype html><html lang="en"><head><title>Acme Tools builds strong software tools</title>
<meta name="description" content="{'Acme Tools sells software and tools for teams of every size. ' * 2}">
<meta name="viewport" content="width=device-width, initial-scale=1"><meta property="og:title" content="Acme">
<meta property="og:description" content="Tools"><meta property="og:image" content="/og.png">
<link rel="canonical" href="https://acme.com/"><style>body{{color:red}}</style>
<script type="application/ld+json">{ORG}</script><script type="application/ld+json">{SITE}</script>
<script src="https://cdn.other.net/a.js" defer></script></head>
<body><header><nav><a href="/">Home</a> <a href="/about">About us</a> <a href="/contact">Contact</a>
<a href="/blog/first-post">Blog</a></nav></header>
<main><article><h1>Acme Tools for busy teams</h1><p>Acme Tools is at 12 Main Street, Springfield. Call +1 555 123 4567.
See <a href="/about">our story</a> and <a href="/pricing">pricing</a>.</p><h2>What is it?</h2><p>{WORDS}</p>
<h2>How does it work?</h2><p>Software that helps teams? Yes 45% faster in 2024 and 2025, 1,200 users, 99% happy.</p>
<img src="/img/big-chart_one.webp" alt="a chart of yearly growth for all of our users" width="10" height="10">
<a href="https://mit.edu/x">Study</a> <a href="https://example.org/y">Source</a></article></main>
<footer><p>12 Main Street, Springfield +1 555 123 4567</p><a href="/privacy">Privacy</a> <a href="/terms">Terms</a>
 &copy; 2026 Acme</footer></body></html>"""
ABOUT = f"<!doctype html><html lang='en'><head><title>About Acme Tools and the team</title></head><body><h1>About Acme Tools</h1><p>{WORDS}</p><a href='/'>h</a></body></html>"
CONTACT = "<!doctype html><html><head><title>Contact</title></head><body><p>Acme Tools, 12 Main Street, Springfield city. +1 555 123 4567 info@acme.com</p></body></html>"
PRIVACY = f"<!doctype html><html><body><p>Last updated: January 5, 2025</p><p>{WORDS}</p></body></html>"
POOR = "<!doctype html><html><head><title>Hi</title></head><body><h1>A</h1><h3>B</h3><p>short cookie notice</p></body></html>"
ROBOTS = "User-agent: *\nDisallow: /private\n\nUser-agent: GPTBot\nDisallow: /\nSitemap: https://acme.com/sitemap.xml\n"
SITEMAP = (
    '<?xml version="1.0"?><urlset><url><loc>https://acme.com/</loc><lastmod>2025-01-01</lastmod></url>'
    "<url><loc>https://acme.com/about</loc><lastmod>2025-01-02</lastmod></url></urlset>"
)
LLMS = "# Acme\n\n## About\nabout service contact policy https://acme.com/about\n" + WORDS
_HTML = {"content-type": "text/html; charset=utf-8", "strict-transport-security": "max-age=63072000", "content-encoding": "br",
         "x-content-type-options": "nosniff", "cf-cache-status": "HIT", "etag": "x"}


def frame(spark, rows, schema):
    fields = T.StructType.fromDDL(schema)
    from pyspark.sql.pandas.types import to_arrow_type

    table = pa.table({
        f.name: pa.array(
            [list(r.get(f.name).items()) if isinstance(r.get(f.name), dict) else r.get(f.name) for r in rows],
            type=to_arrow_type(f.dataType),
        )
        for f in fields
    })
    return spark.createDataFrame(table, schema=fields)


def page(site, page_id, url, html, **extra):
    return {"site_id": site, "page_id": page_id, "url": url, "final_url": url, "status": 200, "headers": _HTML, "html": html,
            "response_ms": 120, "redirect_hops": 0, "depth": 0 if page_id % 10 == 0 else 1, **extra}


def answer(url, body="", content_type="text/plain", status=200, agent=None, mode="follow", site="acme", **headers):
    return {"site_id": site, "req_url": url, "final_url": url, "method": "GET", "user_agent": agent, "redirect_mode": mode,
            "status": status, "headers": {"content-type": content_type, **headers}, "body": body, "response_ms": 50,
            "redirect_hops": 0, "fetched_at": FETCHED}


def inputs(spark):
    from sitegauge.sources import captures as C

    sites = [
        {"site_id": "acme", "brand_name": "Acme Tools", "website_url": "https://acme.com/", "business_email": "info@acme.com"},
        {"site_id": "poor", "brand_name": "Poor Site", "website_url": "http://poor.example/", "business_email": "x@poor.example"},
        {"site_id": "gone", "brand_name": "Gone", "website_url": "gone.example", "business_email": "x@gone.example"},
        {"site_id": "bad", "brand_name": "B", "website_url": "bad.example", "business_email": "x@bad.example"},
    ]
    pages = [
        page("acme", 10, "https://acme.com/", HOME),
        page("acme", 11, "https://acme.com/about", ABOUT),
        page("poor", 20, "http://poor.example/", POOR, headers={"content-type": "text/html"}, response_ms=3000),
        page("poor", 21, "http://poor.example/x_y", POOR, headers={"content-type": "text/html"}),
    ]
    log = [
        answer("https://acme.com/robots.txt", ROBOTS), answer("https://acme.com/sitemap.xml", SITEMAP, "application/xml"),
        answer("https://acme.com/llms.txt", LLMS, "text/markdown"), answer("https://acme.com/ai.txt", "x"),
        answer("https://acme.com/contact", CONTACT, "text/html"), answer("https://acme.com/privacy", PRIVACY, "text/html"),
        answer("https://acme.com/about", ABOUT, "text/html"), answer("https://acme.com/", HOME, "text/html"),
        answer("https://acme.com/og.png", "", "image/png"), answer("https://acme.com/__audit-soft-404-test", "no", "text/html", 404),
        answer("https://mit.edu/x", "", "text/html"), answer("https://example.org/y", "", "text/html", 404),
        answer("http://acme.com/", "", "text/html", 301, mode="manual", location="https://acme.com/"),
        answer("https://acme.com/random-url-123456789-test/", "", "text/html", 404),
        answer("https://acme.com/nonexistent-page-seo-audit-test/", "", "text/html", 404),
        answer("https://acme.com/", HOME, "text/html", agent="OAI-SearchBot/1.0"),
        answer("https://acme.com/", HOME, "text/html", agent="GPTBot/1.2; +https://openai.com/gptbot"),
        answer("https://acme.com/", "<html>blocked</html>", "text/html", 403, agent="Google-Extended"),
    ]
    certs = [{"host": "acme.com", "subject": "CN=acme.com", "valid_to": datetime(2027, 1, 1)}]
    lab = [{"url": "https://acme.com/", "strategy": "mobile", "lcp": 2600.0, "cls": 0.0, "tbt": 100.0, "performance_score": 70}]
    return {
        "sites": frame(spark, sites, C.SITES),
        "pages": frame(spark, pages, "site_id string, page_id bigint, url string, final_url string, status int, headers map<string,string>, html string, response_ms int, redirect_hops int, depth int"),
        "fetch_log": frame(spark, log, C.FETCH_LOG),
        "tls_certs": frame(spark, certs, C.TLS_CERTS),
        "lab_vitals": frame(spark, lab, C.LAB_VITALS),
    }
