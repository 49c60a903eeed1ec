"""The parse job's tree rules."""

from hypothesis import given, settings
from hypothesis import strategies as st

from sitegauge.operators.parse import parse_page, parse_pages, resolve


def tags(page):
    return dict(page["tag_counts"])


def test_implied_end_tags_and_raw_text():
    page = parse_page("<title>A &amp; B</title><p>one<p>two<ul><li>x<li>y</ul><script>var a='</p>';</script>", "https://e.com/")
    assert page["title"] == "A & B"
    assert tags(page)["p"] == 2 and tags(page)["li"] == 2
    assert page["body_text"] == "onetwoxyvar a='</p>';"
    assert page["visible_words"] == 1


def test_open_formatting_is_reopened_in_the_next_paragraph():
    page = parse_page("<p><b>one<p>two</p><p>three", "https://e.com/")
    assert [e["text"] for e in page["nodes"] if e["tag"] == "b"] == ["one", "two", "three"]


def test_hidden_flag_reaches_descendants():
    page = parse_page("<div style='display: none'><h1>a</h1></div><h2>b</h2>", "https://e.com/")
    assert [h["hid"] for h in page["headings"]] == [True, False]


def test_table_sections_are_implied():
    page = parse_page("<table><tr><td>a<td>b<tr><td>c</table>", "https://e.com/")
    assert tags(page)["tbody"] == 1 and tags(page)["tr"] == 2 and tags(page)["td"] == 3


def test_second_level_sections():
    page = parse_page("<h2>T</h2><p>a b</p><p>c</p><h2>U</h2><p>d</p>", "https://e.com/")
    assert page["h2_sections"] == [{"title": "T", "text": "a b c"}, {"title": "U", "text": "d"}]


def test_resolve():
    assert resolve("https://E.com/a/b?x#y", "../c d") == "https://e.com/c%20d"
    assert resolve("https://e.com/", "//o.net:443/p") == "https://o.net/p"
    assert resolve("https://e.com/", "mailto:a@b.c") == "mailto:a@b.c"
    assert resolve("https://e.com/", "http://[bad") == ""


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="<>/abp \"'=!-&;h1", max_size=80))
def test_any_input_gives_a_closed_tree(source):
    page = parse_page(source, "https://e.com/")
    for family in ("headings", "anchors", "nodes"):
        for e in page[family]:
            assert e["ord"] <= e["last"] < page["dom_nodes"]


def test_raw_text_ends_where_the_source_says():
    """Letters that grow when lower-cased must not shift what follows; an end tag's name must end, too."""
    for letters in ("a" * 12, "\u0130" * 12):
        page = parse_page(f"<p>{letters}</p><script>var x = '</scripty>' + 1;</SCRIPT ><h1>Head</h1>", "http://a/")
        assert [h["text"] for h in page["headings"]] == ["Head"]
        assert page["scripts"][0]["text"] == "var x = '</scripty>' + 1;"


def test_batches_are_cut_by_bytes(spark, monkeypatch):
    import sitegauge.operators.parse as module

    monkeypatch.setattr(module, "SLICE_BYTES", 50)
    rows = [(i, "http://a/", f"<title>t{i}</title><p>{'x' * (i % 90)}") for i in range(40)] + [(99, "http://a/", None)]
    got = {r["page_id"]: r["title"] for r in parse_pages(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert got == {i: f"t{i}" for i in range(40)} | {99: ""}


def test_a_page_that_cannot_be_parsed_is_skipped_with_the_reason(spark):
    from sitegauge.plans import on_page
    from pyspark.sql import functions as F

    pages = parse_pages(spark.createDataFrame([("s", 1, "http://a/", "<h1>x</h1>")], "site_id string, page_id bigint, url string, html string"))
    rows = on_page.audit(pages.withColumn("parse_error", F.lit("ValueError: broken"))).collect()
    assert rows and all(r["skipped"] and r["evidence"] == {"parse_error": "ValueError: broken"} for r in rows)
