"""Minimum-cut extraction: blocks, cut against brute force, whole pages."""

import itertools
import random
import re
from html import unescape

from sitegauge.llm import html_extract as X

SF = "/root/testdata/sf0.01"


def energy(labels, scores, edges):
    own = sum(round(abs(s) * X.SCALE) for s, content in zip(scores, labels) if (s > 0) != content)
    return own + sum(round(w * X.SCALE) for i, j, w in edges if labels[i] != labels[j])


def test_cut_is_a_minimum():
    r = random.Random(1)
    for _ in range(150):
        n = r.randrange(1, 9)
        scores = [r.uniform(-2, 2) for _ in range(n)]
        edges = [(i, j, r.uniform(0, 1.5)) for i in range(n) for j in range(i + 1, n) if r.random() < 0.5]
        best = min(energy(c, scores, edges) for c in itertools.product((False, True), repeat=n))
        assert energy(X.minimum_cut(scores, edges), scores, edges) == best


def test_blocks_and_decoding():
    html = (
        "<!DOCTYPE html><title>T</title><script>var a='</p><p>no';</script><body><nav><a href='/x'>Menu</a></nav>"
        "<article><h1>A &amp; B &lt;c&gt; &am &copy</h1><p>one\n\t two<br>three <b>four<p>five<!-- no --> <i>six</i>&nbsp;seven.</p>"
        "<aside>side note that is rather long, with a sentence. And another.</aside><form><p>Your name, please.</p></form>"
        "<div class='comments'><article><p>Nice text, I liked it a lot.</p></article></div></article><footer>&copy; me</footer>"
    )
    assert X.main_text(html) == "A & B <c> &am ©\n\none two three four\n\nfive six seven."


def test_pages_without_article_tags():
    text = "This is a paragraph of some length, which tells a story of many words in whole sentences. It goes on for a while."
    html = (
        f"<div id=top><ul><li><a href=a>Home</a><li><a href=b>News</a></ul></div><div><h2>Title of it</h2><p>{text}<p>{text}<p>Short.<p>{text}</div>"
        "<div class='cookie-notice'><p>We use cookies on this site. Accept all of them, please, to go on.</p></div><div><a href=c>Imprint</a></div>"
    )
    assert X.main_text(html) == "\n\n".join(["Title of it", text, text, "Short.", text])


def test_odd_pages(spark):
    rows = [(1, "u", None), (1, "u", ""), (2, None, "<p"), (None, "u", "plain words only"), (3, "u", "<article>" + "<p>x y z.</p>" * 3000 + "</article>")]
    docs = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")
    got = X.extract(docs).collect()
    assert [r["text"] for r in got[:3]] == ["", "", ""] and len(got) == 5
    assert got[4]["n_chars"] == len(got[4]["text"]) == 6 * 3000 + 2 * 2999
    assert X.extract(docs.limit(0)).count() == 0


def test_articles_of_the_given_pages(spark):
    """The given pages mark their article; the extracted text is the article's blocks."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in X.extract(pages).collect()}
    for row in pages.collect():
        article = re.search(r"<article>(.*?)</article>", row["html"], re.S)[1]
        parts = [" ".join(unescape(re.sub(r"</?b>|<br>", " ", p)).split()) for p in re.split(r"</?(?:h1|p)>", article)]
        assert got[row["page_id"]] == "\n\n".join(p for p in parts if p)


ARTICLE = "<h1>The title of it</h1>" + "<p>This is a paragraph of some length, which tells a story in whole sentences.</p>" * 3
WANT = "The title of it" + "\n\nThis is a paragraph of some length, which tells a story in whole sentences." * 3


def test_names_of_wrappers_do_not_drop_the_article():
    names = ("has-sidebar", "no-sidebar", "content share", "single-post comments-open", "page-widget-free", "sidebar-layout", "with-menu", "is-modal", "")
    for name in names:
        for inner in ("<article>%s</article>", "<main>%s</main>"):
            html = f"<body><nav><a href=/>Home</a></nav><div class='{name}'>{inner % ARTICLE}</div><footer>Imprint of us</footer>"
            assert X.main_text(html) == WANT, (name, inner)
    for name in ("sidebar", "widget", "header", "promo"):
        assert X.main_text(f"<div class='{name}'><main>{ARTICLE}</main></div>") == WANT, name
    head = ARTICLE.replace("<h1>", "<div class='entry-header'><h1>").replace("</h1>", "</h1></div>")
    assert X.main_text(f"<article>{head}</article>") == WANT


def test_boilerplate_by_name_still_goes():
    for name in ("sidebar", "site-footer", "cookie-notice", "widget-area", "main-navigation", "post-share", "comments-area", "comment-list", "ad", "ad-slot", "newsletter"):
        for order in (0, 1):
            parts = [f"<article>{ARTICLE}</article>", f"<div id='{name}'><p>Some words that stand beside the text, one sentence long.</p></div>"]
            assert X.main_text("".join(parts[::-1] if order else parts)) == WANT, name
    assert X.main_text(f"<article>{ARTICLE}<div class='post-comments'><article class='comment post'><p>I liked the story very much, thanks a lot.</p></article></div></article>") == WANT


def test_forms():
    assert X.main_text(f"<form action=x><input type=\"hidden\" name=v><nav><a href=/>Home</a></nav><article>{ARTICLE}</article></form>") == WANT
    long = "<p>" + "Many words of a page that has no article at all, all of it in a form. " * 8 + "</p>"
    assert X.main_text(f"<form><div>{long}{long}</div><input name=q></form>") != ""
    assert X.main_text(f"<article>{ARTICLE}<form><p>Your name, please, and your address.</p><input name=a><input name=b></form></article>") == WANT


def test_unclosed_elements_end_at_the_next_block():
    for tag in ("button", "select", "noscript", "object", "textarea", "canvas", "svg", "video", "iframe"):
        assert X.main_text(f"<div><{tag}>Menu</div><article>{ARTICLE}</article>") == WANT, tag
        assert X.main_text(f"<div><{tag}>Menu</div><article>{ARTICLE}</article><p><{tag}>x</{tag}></p>") == WANT, tag
        assert X.main_text(f"<article>{ARTICLE}<{tag}>Menu</{tag}></article>") == WANT, tag
    assert X.main_text(f"<article><svg><g><svg></svg></g><text>no</text></svg>{ARTICLE}</article>") == WANT
    assert X.main_text(f"<article>{ARTICLE}</article><script>var a = 1; <p>no</p>") == WANT
