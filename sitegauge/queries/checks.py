"""Check rows of the page audits over pages whose verdicts are known in closed form.

Every row of ``part`` becomes one page, put together from pieces that are chosen by conditions on its key. The SQL twins
state the verdict each rule must give for those conditions; they hold no HTML at all.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.links import page_facts
from ..operators.parse import parse_pages
from ..plans import eeat, image, indexability, on_page, structured_data, trust
from ..session import stage
from .common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

Piece = tuple[str, str, str]  # condition on k, text where it holds, text where it does not


URL = "'https://shop.example/p/' || k"


def pages_of(spark, d, pieces: list[Piece], head: list[Piece] = (), url: str = URL):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("k"))
    joined = lambda given: [F.when(F.expr(when), F.lit(yes)).otherwise(F.lit(no)) for when, yes, no in given]
    body = F.concat(
        F.lit("<!doctype html><html lang=\"en\"><head>"), *joined(head), F.lit("</head><body>"), *joined(pieces), F.lit("</body></html>")
    )
    pages = rows.select(F.lit("shop").alias("site_id"), F.col("k").cast("bigint").alias("page_id"), F.expr(url).alias("url"), body.alias("html"))
    return parse_pages(pages)


def verdict_rows(rows):
    return rows.select("page_id", "check_id", "passed", "skipped", "warning")


def verdict_sql(verdicts: dict[int, tuple[str, str, str]]) -> str:
    """(passed, skipped, warning) conditions on k per check; a skipped check counts as passed and never warns."""
    rows = ", ".join(
        f"{{'check_id': {i}, 'p': {p}, 's': {s}, 'w': {w}}}" for i, (p, s, w) in verdicts.items()
    )
    return f"""SELECT k AS page_id, CAST(v.check_id AS INT) AS check_id, v.s OR v.p AS passed, v.s AS skipped, NOT v.s AND v.w AS warning
FROM (SELECT p_partkey AS k, unnest([{rows}]) AS v FROM (SELECT p_partkey, p_partkey AS k FROM part))"""


def add(name: str, module, pieces: list[Piece], verdicts: dict[int, tuple[str, str, str]], head: list[Piece] = (), url: str = URL):
    def query(spark, d):
        return verdict_rows(module.audit(pages_of(spark, d, pieces, head, url)))

    query.__name__, query.__doc__ = name, f"All checks of {module.__name__.rpartition('.')[2]} on pages put together from ``part``."
    QUERIES[name], ORACLES[name] = query, verdict_sql(verdicts)


def when(passed: str, skipped: str = "false", warning: str = "false") -> tuple[str, str, str]:
    return passed, skipped, warning


LD = '<script type="application/ld+json">{}</script>'
WORDS = "<p>" + " ".join(f"word{i}" for i in range(60)) + "</p>"
_TRAIL = ('{"@type":"BreadcrumbList","itemListElement":[{"@type":"ListItem","position":1,"name":"Home"},'
          '{"@type":"ListItem","position":2,"name":"Shop"}]}')

add("checks_on_page", on_page, [
    ("k % 3 = 0", "<h1>Short one</h1>", "<h1>A good heading for this page</h1>"),
    ("k % 2 = 0", "<h2>", "<h3>"), ("k % 5 = 0", "Another Small Heading Here", "Another small heading here"), ("k % 2 = 0", "</h2>", "</h3>"),
    ("true", WORDS, ""),
    ("k % 7 = 0", "<p>seen at <b>Acme Audit Platform</b> today</p>", ""),
    ("k % 11 = 0", "<table><caption>Prices</caption><tr><td>price plan</td></tr></table>", ""),
    ("k % 11 = 1", "<table><tr><td>rows only</td></tr></table>", ""),
    ("k % 13 = 0", "<blockquote>said it <cite>Ann</cite></blockquote>", ""),
    ("k % 13 = 1", "<blockquote>said it</blockquote>", ""),
    ("k % 17 = 0", "<p>Acme is <dfn>a term</dfn> here</p>", ""), ("k % 17 = 1", "<p>Acme is here</p>", ""),
    ("k % 19 = 0", "<p>On Jan 5, 2024 it began</p>", ""), ("k % 19 = 1", "<p>On <time datetime=\"2024-01-05\">Jan 5, 2024</time> it began</p>", ""),
    ("k % 23 < 2", LD.format(_TRAIL), ""),
    ("k % 23 = 0", "<nav class=\"breadcrumb\"><a href=\"/\">Home</a><a href=\"/s\">Shop</a></nav>", ""),
    ("k % 29 = 0", "<section><p><a href=\"/r\">Related</a> <a href=\"/s\">s</a></p></section>", ""),
    ("k % 31 = 0", "<img src=\"/a.png\">", ""), ("k % 31 = 1", "<img src=\"/a.png\" alt=\"x\">", ""),
], {
    1: when("k % 2 = 0"), 2: when("k % 7 = 0"), 3: when("k % 11 <> 1"), 4: when("k % 11 = 0", "k % 11 > 1"),
    # the text of a script counts as text of the page: its quotes call for a quotation
    5: when("k % 13 = 0", "k % 13 > 1 and k % 23 > 1"), 6: when("k % 17 = 0", "k % 17 > 1"), 7: when("k % 19 <> 0"), 8: when("k % 23 = 0", "k % 23 > 1"),
    9: when("k % 29 = 0"), 10: when("k % 29 = 0"), 11: when("k % 31 <> 0"), 12: when("k % 5 <> 0"), 13: when("k % 3 <> 0"),
})

_PLAIN = "k % 4 > 1"  # pages with one plain image; k % 4 = 0 has a picture, k % 4 = 1 no image
add("checks_image", image, [
    (_PLAIN, "<img src=\"/", ""), (f"{_PLAIN} and k % 13 = 0", "img001", ""), (f"{_PLAIN} and k % 13 > 0", "red-garden-door", ""),
    (f"{_PLAIN} and k % 5 = 0", ".png", ""), (f"{_PLAIN} and k % 5 > 0", ".webp", ""), (f"{_PLAIN} and k % 7 = 0", "?v=2", ""), (_PLAIN, "\"", ""),
    (f"{_PLAIN} and k % 3 > 0 and k % 17 = 0", " alt=\"price list\"", ""), (f"{_PLAIN} and k % 3 > 0 and k % 17 > 0", " alt=\"a door\"", ""),
    (f"{_PLAIN} and k % 11 = 0", " class=\"lazyload\"", ""), (f"{_PLAIN} and k % 9 < 4", " srcset=\"/x.webp 1x\" sizes=\"10px\"", ""), (_PLAIN, ">", ""),
    ("k % 4 = 0", "<picture><source ", ""), ("k % 8 = 0", "type=\"image/webp\" srcset=\"/b.webp\">", ""), ("k % 8 = 4", "srcset=\"/b.jpg\">", ""),
    ("k % 4 = 0", "<img src=\"/blue-wooden-door.webp\" alt=\"a door\" srcset=\"/y.webp 1x\" sizes=\"10px\"></picture>", ""),
    ("k % 19 = 0", "<svg><title>t</title><desc>d</desc></svg>", ""), ("k % 19 = 1", "<svg><path d=\"M0\"></path></svg>", ""),
    ("k % 29 = 0", LD.format('{"@type":"ImageObject","url":"https://shop.example/x.webp"}'), ""),
], {
    1: when(f"not ({_PLAIN} and k % 3 = 0)"), 2: when(f"not ({_PLAIN} and k % 5 = 0)"), 3: when("true", "true"),
    4: when("k % 8 = 0", "k % 4 > 0"), 5: when(f"not ({_PLAIN} and k % 7 = 0)"), 6: when(f"not ({_PLAIN} and k % 11 = 0)"),
    7: when(f"not ({_PLAIN} and k % 9 >= 4)"), 8: when(f"not ({_PLAIN} and k % 13 = 0)"), 9: when("true", "true"),
    10: when("false", f"not ({_PLAIN} and k % 3 > 0 and k % 17 = 0)", "true"), 11: when("true", "true"),
    12: when("k % 19 = 0", "k % 19 > 1"), 13: when("k % 29 = 0", "k % 4 = 1"),
})


def record(condition: str, kind: str, fields: dict[str, str], context: str = "") -> list[Piece]:
    """A JSON-LD block with a record of one type; ``fields``: JSON member -> condition."""
    out = [(condition, f'<script type="application/ld+json">{{{context}"@type":"{kind}"', "")]
    out += [(f"({condition}) and ({when_})", f",{member}", "") for member, when_ in fields.items()]
    return [*out, (condition, "}</script>", "")]


_ORG, _LOCAL, _ART, _PERSON, _FAQ, _HOW, _PROD, _CRUMB, _SITE = (
    "k % 3 > 0", "k % 2 = 0", "k % 5 = 0", "k % 7 = 0", "k % 11 = 0", "k % 13 = 0", "k % 17 = 0", "k % 19 = 0", "k % 2 = 1",
)
_SPECIAL = {57: (53, "speakable", "SpeakableSpecification"), 58: (59, "glossary", "DefinedTerm"), 59: (61, "dataset", "Dataset"),
            61: (67, "webinar", "Event"), 62: (71, "software", "SoftwareApplication")}
_HEAD = [
    *record(_ORG, "Organization", {
        '"name":"Acme Tools"': "k % 5 > 0", '"url":"https://shop.example/"': "k % 7 > 0", '"url":"http://shop.example/"': "k % 7 = 0",
        '"logo":"https://shop.example/logo.webp"': "k % 11 > 0", '"telephone":"+1 555 123 4567"': "k % 13 > 0",
        '"address":{"@type":"PostalAddress","streetAddress":"12 Main Street"}': "k % 17 > 0",
        '"sameAs":["https://linkedin.com/company/a","https://wikidata.org/Q1","https://x.com/a","https://y.com/b"]': "k % 19 > 0",
        '"sameAs":["https://x.com/a"]': "k % 19 = 0", '"knowsAbout":["a","b","c","d","e"]': "k % 23 > 1", '"knowsAbout":["a","b"]': "k % 23 = 1",
        '"@id":"https://shop.example/#org"': "k % 29 > 0", '"foundingDate":"2001"': "k % 31 > 0",
    }, '"@context":"https://schema.org",'),
    *record(_LOCAL, "Store", {
        '"geo":{"@type":"GeoCoordinates","latitude":1.5,"longitude":2.5}': "k % 5 > 0", '"areaServed":"Springfield"': "k % 7 > 0",
        '"openingHours":"Mo-Fr"': "k % 11 > 0",
    }),
    *record(_ART, "BlogPosting", {
        '"headline":"H"': "k % 2 = 0", '"author":"A"': "k % 3 = 0", '"datePublished":"2024-01-05"': "k % 7 > 0", '"datePublished":"soon"': "k % 7 = 0",
        '"dateModified":"2024-02-01"': "k % 3 = 1", '"about":"x"': "k % 11 > 0", '"image":"https://shop.example/i.webp"': "k % 13 > 0",
        '"publisher":"P"': "k % 17 > 0",
    }),
    *record(_PERSON, "Person", {
        '"name":"Ann"': "true", '"jobTitle":"J"': "k % 2 = 0", '"url":"https://shop.example/ann"': "k % 3 > 0",
        '"sameAs":["https://linkedin.com/in/ann"]': "k % 5 > 0", '"knowsAbout":["a"]': "k % 11 > 0",
    }),
    *record(f"{_PERSON} and k % 2 = 0", "ProfilePage", {}),
    *record(_FAQ, "FAQPage", {
        '"mainEntity":[{"name":"What it does"},{"name":"Why so"},{"name":"How then"}]': "k % 3 > 0", '"mainEntity":[{"name":"What it does"},{"name":"Why so"}]': "k % 3 = 0",
    }),
    *record(_HOW, "HowTo", {'"step":[{"@type":"HowToStep","text":"x"}]': "k % 2 = 0", '"totalTime":"PT1H"': "k % 3 = 0"}),
    *record(_PROD, "Product", {
        '"name":"N"': "true", '"description":"d"': "true", '"brand":"B"': "k % 2 = 0", '"offers":{"@type":"Offer"': "true", '"price":"19.5"': "k % 3 > 0",
        '"availability":"https://schema.org/InStock"': "k % 5 > 0", '"x":1}': "true", '"aggregateRating":{"ratingValue":4}': "k % 7 > 0", '"sku":"1"': "k % 11 > 0",
    }),
    *record(_CRUMB, "BreadcrumbList", {'"itemListElement":[{"name":"Home"}]': "k % 2 = 0"}),
    *record(_SITE, "WebSite", {'"@id":"https://shop.example/#org"': "k % 47 = 0"}),
    *record("k % 62 = 0", "ImageObject", {}), *record("k % 74 = 0", "VideoObject", {}),
    *[piece for n, _, kind in _SPECIAL.values() for piece in record(f"k % {2 * n} = 0", kind, {})],
    ("k % 41 = 0", '<script type="application/ld+json">{bad</script>', ""),
]
_RECORDS = " + ".join(f"({c})::INT" for c in (
    _ORG, _LOCAL, _ART, _PERSON, f"{_PERSON} and k % 2 = 0", _FAQ, _HOW, _PROD, _CRUMB, _SITE, "k % 62 = 0", "k % 74 = 0",
    *[f"k % {2 * n} = 0" for n, _, _ in _SPECIAL.values()],
))
_ANY_ID = f"(({_ORG} and k % 29 > 0) or ({_SITE} and k % 47 = 0))"
_not = "not ({})".format
add("checks_structured_data", structured_data, [
    ("k % 2 = 0", "<p>2024-02-01 noted</p>", ""), ("k % 3 = 0", "<p>2024-01-05 noted</p>", ""), ("k % 2 = 0", "<p>what it does, why so, how then</p>", ""),
    ("k % 2 = 0", "<p>19.5 instock</p>", ""), ("k % 5 = 0", "<p>+1 555 123 4567</p>", ""), ("k % 4 = 0", "<p>Acme Tools</p>", ""),
    ("k % 31 = 0", "<img src=\"/a.webp\" alt=\"x\">", ""), ("k % 37 = 0", "<video src=\"/a.mp4\"></video>", ""), ("k % 43 = 0", "<div itemscope></div>", ""),
    ("k % 2 = 0", "<p> founded long ago </p>", ""), *[(f"k % {n} = 0", f"<p> {word} words </p>", "") for n, word, _ in _SPECIAL.values()],
], {
    1: when(_ORG), 2: when(f"{_ORG} and k % 5 > 0"), 3: when(f"{_ORG} and k % 7 > 0"), 4: when(f"{_ORG} and k % 11 > 0"),
    5: when(f"{_ORG} and k % 13 > 0", _not(_LOCAL)), 6: when(f"{_ORG} and k % 17 > 0", _not(_LOCAL)), 7: when(f"{_ORG} and k % 19 > 0"),
    8: when(f"{_ORG} and k % 19 > 0"), 9: when(f"{_ORG} and k % 19 > 0", "false", _not(f"{_ORG} and k % 19 > 0")),
    10: when(f"{_ORG} and k % 23 > 1", "false", f"{_ORG} and k % 23 = 1"), 11: when(f"{_ORG} and k % 29 > 0"),
    12: when(f"{_ORG} and k % 31 > 0", "k % 2 = 1"), 13: when("k % 5 > 0", _not(_LOCAL)), 14: when("k % 7 > 0", _not(_LOCAL)),
    15: when("k % 11 > 0", _not(_LOCAL)), 16: when("true", _not(_LOCAL)), 17: when("k % 2 = 0", _not(_ART)), 18: when("k % 3 = 0", _not(_ART)),
    19: when("k % 7 > 0", _not(_ART)), 20: when("k % 3 = 1 and k % 2 = 0", _not(_ART)), 21: when("k % 11 > 0", _not(_ART)),
    22: when("k % 13 > 0", _not(_ART)), 23: when("k % 17 > 0", _not(_ART)), 24: when("true", _not(_PERSON)),
    25: when("k % 2 = 0 and k % 3 > 0", _not(_PERSON)), 26: when("k % 5 > 0", _not(_PERSON)), 27: when("k % 11 > 0", _not(_PERSON)),
    28: when("true", _not(_FAQ)), 29: when("k % 3 > 0", _not(_FAQ)), 30: when("k % 2 = 0", _not(_FAQ)), 49: when("k % 2 = 0", _not(_FAQ)),
    31: when("true", _not(_HOW)), 53: when("k % 2 = 0", _not(_HOW)), 55: when("k % 3 = 0", _not(_HOW), "true"),
    32: when("k % 2 = 0", _not(_PROD)), 33: when("k % 3 > 0 and k % 5 > 0", _not(_PROD)), 34: when("k % 7 > 0", _not(_PROD)),
    35: when("k % 11 > 0", _not(_PROD)), 36: when(_CRUMB, "k % 23 = 0"), 37: when("k % 2 = 0", _not(_CRUMB)), 38: when(_SITE),
    39: when(f"{_ANY_ID} and {_RECORDS} > 1", "false", f"{_RECORDS} > 1"), 40: when("k % 2 = 0", "k % 31 > 0"), 41: when("k % 2 = 0", "k % 37 > 0"),
    42: when("k % 41 > 0"), 43: when("true", "false", "k % 43 = 0"), 44: when(_not(f"{_ORG} and k % 7 = 0")),
    51: when(_not(f"{_SITE} and k % 47 = 0 and {_ORG} and k % 29 > 0")), 52: when("true"), 56: when(_ORG, "false", "true"),
    45: when("k % 2 = 0", _not(f"{_PROD} and k % 3 > 0")), 46: when("k % 5 = 0", _not(f"{_ORG} and k % 13 > 0")),
    47: when("k % 4 = 0", _not(f"{_ORG} and k % 5 > 0")), 48: when("k % 3 = 0 and k % 7 > 0", _not(_ART)),
    50: when("k % 2 = 0", _not(f"{_PROD} and k % 5 > 0")), 60: when("k % 2 = 0", _not(_PERSON)),
    **{i: when("k % 2 = 0", f"k % {n} > 0") for i, (n, _, _) in _SPECIAL.items()},
}, _HEAD, "CASE WHEN k % 23 = 0 THEN 'https://shop.example/' ELSE 'https://shop.example/p/' || k END")


# --- indexability: every part is a site with a home page, perhaps a canonical target, and answers ------------------------

_HOME = "'https://s' || k || '.example/'"
_TARGET = "'https://s' || k || '.example/t'"
_KNOWN = "(k % 5 > 0)"  # the canonical target was captured
_INDEX_HEAD = [
    ("k % 4 = 0", '<link rel="canonical" href="https://s§.example/">', ""), ("k % 4 = 1", '<link rel="canonical" href="https://s§.example/t">', ""),
    ("k % 4 = 2", '<link rel="canonical" href="http://s§.example/other">', ""),
    ("k % 11 = 0", '<meta name="robots" content="noindex">', ""), ("k % 19 = 0", '<meta name="robots" content="nosnippet">', ""),
    ("k % 23 = 0", '<meta name="googlebot" content="max-snippet:10">', ""), ("k % 23 = 1", '<meta name="googlebot" content="max-snippet:-1">', ""),
    ("k % 31 = 0", '<meta name="bingbot" content="max-image-preview:none">', ""),
    ("k % 47 = 0", '<link rel="alternate" hreflang="en" href="https://s§.example/en">', ""), ("k % 47 = 1", '<link rel="alternate" hreflang="english" href="https://s§.example/en">', ""),
]
_LONG = " ".join(f"more{i}" for i in range(120))
_INDEX_BODY = [
    ("true", WORDS, ""), ("k % 29 = 0", f"<div data-nosnippet>{_LONG}</div>", ""), ("k % 43 = 0", '<a href="/l?page=2">next</a>', ""),
    ("k % 53 = 0", '<form action="/login"></form>', ""), ("k % 59 = 0", '<div class="cookie-bar">ok</div>', ""),
    ("k % 61 = 0", "<script>setInterval(\"history.pushState()\", 9)</script>", ""),
    ("k % 67 = 0", f'<div style="display:none">{_LONG}</div>', ""), ("k % 73 = 0", "<script>loadMore()</script>", ""),
]
_INDEX_VERDICTS = {
    1: when("k % 11 > 0"), 2: when("true", "true"), 3: when("true", "true"), 4: when("true", "true"),
    5: when(_not(f"(k % 4 = 0 and k % 11 = 0) or (k % 4 = 1 and {_KNOWN} and k % 3 = 0)")),
    6: when(_not(f"k % 2 = 0 and (k % 11 = 0 or ({_KNOWN} and k % 3 = 0))")), 7: when("k % 4 = 0"), 8: when("k % 4 < 2"),
    9: when(f"k % 4 = 0 or (k % 4 = 1 and {_KNOWN} and k % 13 > 0)"), 10: when(_not(f"k % 4 = 1 and {_KNOWN} and k % 7 = 0")), 11: when("true"),
    12: when("k % 19 > 0"), 13: when("k % 23 > 0"), 14: when("k % 29 > 0"), 15: when("k % 31 > 0"), 16: when("k % 37 < 30"), 17: when("k % 41 > 0"),
    18: when("true"), 19: when("k % 4 < 3", "k % 43 > 0"), 20: when("k % 47 = 0", "k % 47 > 1"), 21: when("k % 53 > 0"),
    22: when("k % 59 > 0 or k % 67 = 0 or k % 29 = 0"), 23: when("k % 61 > 0"), 24: when("k % 67 > 0"), 25: when("k % 71 < 60"),
    26: when("k % 73 > 0 or k % 43 = 0"),
}


def _site_pages(spark, d, head: list[Piece], pieces: list[Piece], url: str):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("k"))
    joined = lambda given: [F.when(F.expr(c), F.lit(yes)).otherwise(F.lit(no)) for c, yes, no in given]
    html = F.concat(F.lit("<!doctype html><html><head>"), *joined(head), F.lit("</head><body>"), *joined(pieces), F.lit("</body></html>"))
    return rows.select(
        "k", F.col("k").cast("string").alias("site_id"), F.col("k").cast("bigint").alias("page_id"), F.expr(url).alias("url"),
        F.replace(html, F.lit("§"), F.col("k").cast("string")).alias("html"),
    )


def checks_indexability(spark, d):
    """All checks of the indexability audit with canonical targets, redirects, probes and sitemap rows."""
    home = _site_pages(spark, d, _INDEX_HEAD, _INDEX_BODY, _HOME).withColumn("status", F.lit(200))
    target = _site_pages(spark, d, [
        ("k % 3 = 0", '<meta name="robots" content="noindex">', ""),
        ("k % 7 = 0", '<link rel="canonical" href="https://s§.example/u">', '<link rel="canonical" href="https://s§.example/t">'),
    ], [], _TARGET).where(_KNOWN).withColumn("status", F.expr("CASE WHEN k % 13 = 0 THEN 404 ELSE 200 END"))
    parsed = parse_pages(home.drop("k"))
    facts = stage(page_facts(parsed.unionByName(parse_pages(target.drop("k")))), "page_facts")  # read by three joins
    keys = home.select("k", "url")
    answers = lambda condition, url, status, location: keys.where(condition).select(
        F.expr(url).alias("req_url"), F.lit(status).alias("status"), F.expr(location).alias("location"))
    probes = [answers("k % 71 < 60", f"{_HOME} || '{p[1:]}'", 404, "''") for p in indexability.PROBES]
    manual = answers("k % 37 < 30", "'http://s' || k || '.example/'", 301, "url").unionByName(
        answers("k % 41 = 0", "'https://www.s' || k || '.example/'", 200, "''"))
    addresses = keys.where("k % 2 = 0").select(
        F.col("k").cast("string").alias("site_id"), F.explode(F.array("url", F.expr(_TARGET))).alias("url"), F.lit(0).alias("place"))
    rows = indexability.audit(parsed, facts, probes[0].unionByName(probes[1]).drop("location"), manual, addresses)
    return verdict_rows(rows)


QUERIES["checks_indexability"], ORACLES["checks_indexability"] = checks_indexability, verdict_sql(_INDEX_VERDICTS)


# --- expertise: a home page, and linked pages of each role ------------------------------------------------------------

_ROLE_PAGES = {  # role: (path, pieces of its page)
    "about": ("about", [("k % 2 = 0", "<p>" + " ".join(f"a{i}" for i in range(300)) + "</p>", "<p>few words</p>")]),
    "contact": ("contact", [("k % 3 = 0", "<p> 12 Main Street, Springfield </p>", ""), ("k % 5 = 0", "<p> +1 555 123 4567 </p>", ""), ("k % 7 = 0", "<p> info@acme.com </p>", "")]),
    "privacy": ("privacy", [("k % 11 = 0", "<p>" + " ".join(f"p{i}" for i in range(300)) + "</p>", "<p>few words</p>")]),
    "terms": ("terms", [("k % 13 = 0", "<p>" + " ".join(f"t{i}" for i in range(100)) + "</p>", "<p>few words</p>")]),
    "team": ("team", [("k % 17 = 0", '<img src="/a.webp"><img src="/b.webp">', "<p>us</p>")]),
    "editorial": ("editorial", [("k % 19 = 0", "<p>" + " ".join(f"e{i}" for i in range(100)) + "</p>", "<p>few words</p>")]),
    "case_study": ("case-studies", [("k % 23 = 0", "<p>it saved 40% of it</p>", "<p>few words</p>")]),
}


def _linked(role: str) -> str:
    """Sites that link the page of a role."""
    return f"(k % 29 <> {list(_ROLE_PAGES).index(role) + 1})"


_ARTICLE, _AUTHOR, _BIO = "k % 41 > 5", "k % 47 > 9", "k % 53 > 9"  # article linked, author linked from it, author page captured
_OWN_BIO = f"({_ARTICLE} and {_AUTHOR})"
_ARTICLE_PAGE = [("k % 43 > 9", "<p> by Ann Smith </p>", "<p> some words </p>"), (_AUTHOR, '<a href="/authors/ann">Ann</a>', "")]
_AUTHOR_PAGE = [
    ("k % 59 > 9", "<p>" + " ".join(f"b{i}" for i in range(160)) + "</p>", "<p>few words</p>"), ("k % 61 > 9", '<a href="https://linkedin.com/in/ann">me</a>', ""),
    ("k % 67 > 9", '<a href="/blog/1">a</a><a href="/blog/2">b</a><a href="/blog/3">c</a>', ""), ("k % 71 > 9", "<p> for 12 years now </p>", ""),
]


def checks_eeat(spark, d):
    """All checks of the expertise audit; most look at linked pages."""
    links = [(_linked(r), f'<a href="/{path}">{r.replace("_", " ")}</a> ', "") for r, (path, _) in _ROLE_PAGES.items()]
    home = _site_pages(spark, d, [], [
        ("true", "<p>plain words</p>", ""), *links, (_ARTICLE, '<a href="/blog">our blog</a> ', ""), ("k % 73 = 0", "<cite>x</cite>", ""), ("k % 31 = 0", '<a href="https://mit.edu/x">research</a>', ""),
        ("k % 37 = 0", '<p>Trusted by these</p><img src="/l1.webp" alt="one"><img src="/l2.webp" alt="two">', ""),
    ], _HOME)
    pages = [_site_pages(spark, d, [], pieces, f"'https://s' || k || '.example/{path}'") for path, pieces in _ROLE_PAGES.values()]
    pages.append(_site_pages(spark, d, [], _ARTICLE_PAGE, "'https://s' || k || '.example/blog'"))
    pages.append(_site_pages(spark, d, [], _AUTHOR_PAGE, "'https://s' || k || '.example/authors/ann'").where(_BIO))
    linked = pages[0]
    for page in pages[1:]:
        linked = linked.unionByName(page)
    return verdict_rows(eeat.audit(parse_pages(home.drop("k")), eeat.target_facts(parse_pages(linked.drop("k")))))


# without an author link the first link of the home page that tells of people counts: about, else team
_EEAT_VERDICTS = {
    1: when(f"{_ARTICLE} and k % 43 > 9"), 2: when(_ARTICLE), 3: when(f"not {_OWN_BIO} or {_BIO}"),
    4: when(f"({_OWN_BIO} and {_BIO} and k % 59 > 9) or (not {_OWN_BIO} and k % 29 <> 1 and k % 2 = 0)"), 5: when(f"{_OWN_BIO} and {_BIO} and k % 61 > 9"),
    6: when(f"{_OWN_BIO} and {_BIO} and k % 67 > 9"), 21: when(f"{_OWN_BIO} and {_BIO} and k % 71 > 9"), 17: when(f"{_ARTICLE} and k % 73 = 0"),
    7: when(f"{_linked('editorial')} and k % 19 = 0"), 8: when(f"{_linked('contact')} and k % 3 = 0"), 9: when(f"{_linked('contact')} and k % 5 = 0"),
    10: when(f"{_linked('contact')} and k % 7 = 0"), 11: when("true", "true"), 12: when(f"{_linked('privacy')} and k % 11 = 0"),
    13: when(f"{_linked('terms')} and k % 13 = 0"), 14: when("k % 37 = 0"), 15: when(f"{_linked('about')} and k % 2 = 0"), 16: when("k % 31 = 0"),
    18: when("true", "true"), 19: when(f"{_linked('case_study')} and k % 23 = 0"), 20: when(f"{_linked('team')} and k % 17 = 0"),
}
QUERIES["checks_eeat"], ORACLES["checks_eeat"] = checks_eeat, verdict_sql(_EEAT_VERDICTS)


# --- trust: a home page with structured data and footer, a contact page and a privacy page -------------------------------

_AS_OF = "2026-01-15"
_PLACE, _PHONE_TEXT = "12 Main Street, Springfield", "+1 555 123 4567"
_FOOT, _FOOT_PHONE, _CONTACT, _CONTACT_PHONE = "k % 17 < 10", "k % 19 < 12", "k % 29 < 20", "k % 31 < 20"
_PHONED, _DATED = f"({_FOOT_PHONE} or {_CONTACT_PHONE})", "(k % 22 = 0)"
_TRUST_VERDICTS = {
    1: when(f"k % 3 > 0 and k % 5 > 0 and {_FOOT} and {_CONTACT} and {_FOOT_PHONE} and {_CONTACT_PHONE}"),
    2: when(f"k % 3 > 0 and {_FOOT} and {_CONTACT}"), 3: when("k % 13 > 0 and k % 37 > 3"), 4: when("k % 41 > 4"),
    5: when(f"k % 3 > 0 and ({_FOOT} or {_CONTACT})"),
    # a date in figures is a run of eight digits, which counts as a number of its own
    6: when(f"({_PHONED} and not {_DATED}) or (not {_PHONED} and {_DATED})"),
    7: when("k % 14 = 0"), 8: when("k % 2 = 0 and k % 13 > 0"), 9: when(f"k % 5 > 0 and {_PHONED}"), 10: when(_DATED), 11: when("true", "true"),
    12: when("k % 23 > 5"), 13: when("k % 47 > 9"), 14: when("k % 53 = 0"), 15: when("k % 43 > 10"),
}


def checks_trust(spark, d):
    """All checks of the trust audit."""
    origin = "'https://s' || k || '.com/"
    home = _site_pages(spark, d, [
        *record("true", "Store", {
            '"name":"Acme Tools"': "k % 2 = 0", '"telephone":"' + _PHONE_TEXT + '"': "k % 5 > 0",
            '"address":{"streetAddress":"12 Main Street","addressLocality":"Springfield"}': "k % 3 > 0",
        }),
        *record("k % 7 = 0", "Product", {'"offers":{"price":"19.5"}': "true"}), *record("k % 11 = 0", "Event", {'"startDate":"2024-01-05"': "true"}),
    ], [
        ("true", "<p>plain words </p>", ""), ("k % 13 > 0", "<p> from Acme Tools here </p>", ""), ("k % 14 = 0", "<p> price 19.5 each </p>", ""),
        (_DATED, "<p> on 2024-01-05 noted </p>", ""), ("k % 53 = 0", "<p> GSTIN 27AAPFU0939F1ZV here </p>", ""),
        ("true", '<a href="/contact">contact</a> <a href="/privacy">privacy</a><footer> all of it ', ""), (_FOOT, _PLACE + " and ", ""),
        (_FOOT_PHONE, _PHONE_TEXT + " or ", ""), ("k % 23 > 5", "&copy; 2026 us", "&copy; 2020 us"), ("true", "</footer>", ""),
    ], f"{origin}'")
    contact = _site_pages(spark, d, [], [
        ("true", "<p> contact us </p>", ""), (_CONTACT, f"<p> {_PLACE} </p>", ""), (_CONTACT_PHONE, f"<p> {_PHONE_TEXT} </p>", ""),
        ("k % 37 > 3", "<p> Acme Tools </p>", ""), ("k % 41 > 4", "<p> info@s§.com </p>", "<p> someone@gmail.com </p>"),
    ], f"{origin}contact'")
    privacy = _site_pages(spark, d, [], [("k % 43 > 10", "<p>Last updated: January 5, 2025</p>", "<p>Last updated: January 5, 2020</p>")], f"{origin}privacy'")
    headers = F.when(F.expr("k % 47 > 9"), F.create_map(F.lit("strict-transport-security"), F.lit("max-age=1"), F.lit("x-content-type-options"), F.lit("nosniff")))
    pages = parse_pages(home.withColumn("headers", F.coalesce(headers, F.create_map(F.lit("server"), F.lit("x")))).drop("k"))
    sites = home.select("site_id", F.lit("Acme Tools").alias("brand_name"), F.concat(F.lit("info@s"), "site_id", F.lit(".com")).alias("business_email"))
    targets = trust.target_texts(parse_pages(contact.unionByName(privacy).drop("k")))
    return verdict_rows(trust.audit(pages, sites, targets, F.lit(_AS_OF).cast("timestamp")))


QUERIES["checks_trust"], ORACLES["checks_trust"] = checks_trust, verdict_sql(_TRUST_VERDICTS)
