"""Scalars, scores and small plans on hand-made rows."""

import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fixtures import frame
from sitegauge.functions import headers as H
from sitegauge.functions import jsonld as J
from sitegauge.functions import robots as R
from sitegauge.functions import text as T
from sitegauge.functions import urls as U
from sitegauge.functions.numbers import clamp_score, half_up
from sitegauge.operators import scoring as S
from sitegauge.operators.ranking import first_distinct
from sitegauge.operators.structured import with_nodes


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).collect()[0]


def test_rounding_and_blanks(spark):
    r = one(spark, a=half_up(F.lit(-2.5)), b=clamp_score(F.lit(150.0)), w=T.word_count(F.lit(" a b\tc ")),
            t=T.trim_blank(F.lit("  x\t")), u=T.utf16_length(F.lit("a\U0001F600")))
    assert (r.a, r.b, r.w, r.t, r.u) == (-2, 100, 3, "x", 3)


def test_two_comparable_forms_differ(spark):
    url = F.lit("https://E.com/a/?b=2&a=1#h")
    r = one(spark, a=U.comparable_url(url), b=U.comparable_page(url), c=U.canonicalize(F.lit("::bad")))
    assert (r.a, r.b, r.c) == ("https://e.com/a/?a=1&b=2", "https://e.com/a", "")


def test_needle_rules_differ(spark):
    r = one(spark, a=T.contains_text(F.lit("x"), F.lit("")), b=T.contains_text_or_blank(F.lit("x"), F.lit("")))
    assert (r.a, r.b) == (False, True)


@pytest.mark.parametrize("text, day", [
    ("Last updated: January 31, 2024", datetime.date(2024, 1, 31)), ("effective 2024-02-03", datetime.date(2024, 2, 3)),
    ("Updated on 3/4/2024", datetime.date(2024, 3, 4)), ("no date", None),
])
def test_policy_dates(spark, text, day):
    assert one(spark, d=T.policy_date(F.lit(text))).d == day


def test_month_overflow_rolls_over(spark):
    r = one(spark, d=T.add_months_rolling(F.lit("2024-02-29").cast("date"), 12), e=F.add_months(F.lit("2024-02-29").cast("date"), 12))
    assert (r.d, r.e) == (datetime.date(2025, 3, 1), datetime.date(2025, 2, 28))


def test_robots_any_matching_group_blocks(spark):
    text = F.lit("User-agent: GPTBot\nDisallow: /\n\nUser-agent: *\nDisallow: /x")
    r = one(spark, a=R.allows(text, F.lit("gptbot")), b=R.allows(text, F.lit("Other")), c=R.allows(F.lit(""), F.lit("GPTBot")))
    assert (r.a, r.b, r.c) == (False, True, True)


def test_robots_star_blocks_named_bot_too(spark):
    text = F.lit("User-agent: GPTBot\nAllow: /\n\nUser-agent: *\nDisallow: /")
    assert one(spark, a=R.allows(text, F.lit("GPTBot"))).a is False


def test_sitemaps(spark):
    xml = F.lit("<sm:urlset><sm:url><sm:loc> <![CDATA[https://a/]]> </sm:loc></sm:url></sm:urlset>")
    r = one(spark, k=R.sitemap_kind(xml), u=R.locations(xml), p=R.sitemap_kind(F.lit("<!doctype html>")), e=R.lastmod_complete(F.lit("<urlset/>")))
    assert (r.k, r.u, r.p, r.e) == ("urlset", ["https://a/"], "invalid", True)


def test_header_readers(spark):
    headers = F.create_map(F.lit("cache-control"), F.lit("max-age=7200"), F.lit("content-length"), F.lit("x"))
    r = one(spark, page=H.cache_policy_ok(F.lit("html"), headers), js=H.cache_policy_ok(F.lit("js"), headers), n=H.content_length(headers),
            s=H.max_snippet(F.lit("noindex, max-snippet: -1")), none=H.max_snippet(F.lit("")))
    assert (r.page, r.js, r.n, r.s, r.none) == (False, True, 0.0, -1, None)


def nodes_of(spark, *blocks):
    return with_nodes(frame(spark, [{"jsonld": list(blocks)}], "jsonld array<string>"))


def test_json_null_is_present_but_not_truthy(spark):
    v = J.first(J.top_blocks())
    r = nodes_of(spark, '{"a":null,"b":0,"c":"","d":[],"e":"0"}').select(
        J.has_key(v, "a").alias("a"), J.has_key(v, "z").alias("z"), *(J.truthy(J.get(v, k)).alias(f"t_{k}") for k in "abcdez")).first()
    assert tuple(r) == (True, False, False, False, False, True, True, False)


def test_graph_wrapper_takes_its_children_types(spark):
    block = '{"@graph":[{"@type":"LocalBusiness","geo":{"@type":"GeoCoordinates"}}]}'
    r = nodes_of(spark, block).select(J.graph_types(J.first(J.top_blocks())).alias("g"), J.deep_types().alias("d")).first()
    assert r.g == ["LocalBusiness"] and sorted(r.d) == ["GeoCoordinates", "LocalBusiness"]


def test_any_depth_of_structured_data(spark):
    for depth in (3, 30, 400, 30_000):
        block = '{"@graph":[' * depth + '{"@type":"Deep","name":' + '{"url":' * depth + '" end "' + "}" * depth + "}" + "]}" * depth
        r = nodes_of(spark, block).select(
            J.graph_types(J.first(J.top_blocks())).alias("g"), F.size(J.records()).alias("n"), J.text_of(J.first(J.records()), "name").alias("t"),
            F.size(J.objects()).alias("objects"), J.error_count().alias("errors")).first()
        assert (r.g, r.n, r.t, r.objects, r.errors) == (["Deep"], 1, "end", 2 * depth + 1, 0)


def test_json_reader_for_deep_texts_agrees_with_the_built_in_one():
    import json
    import random

    from sitegauge.operators.structured import _deep_parse, parse_json

    r = random.Random(3)

    def value(depth):
        kind = r.randrange(8 if depth else 6)
        if kind == 6:
            return [value(depth - 1) for _ in range(r.randrange(4))]
        if kind == 7:
            return {r.choice(["a", "b", "é\"", ""]): value(depth - 1) for _ in range(r.randrange(4))}
        return [1, -2.5e3, "x \n y", True, None, "é"][kind]

    for _ in range(300):
        text = json.dumps(value(4), indent=r.choice([None, 1]))
        assert _deep_parse(text) == json.loads(text)
        cut = text[: r.randrange(len(text))] + r.choice(["", "]", "}", ",", "1", '"'])
        try:
            want = json.loads(cut)
        except ValueError:
            want = ValueError
        try:
            got = _deep_parse(cut)
        except ValueError:
            got = ValueError
        assert got == want, cut
    for bad in ("", " ", "NaN", "[Infinity]", "{'a':1}"):
        with pytest.raises(ValueError):
            parse_json(bad)


CHECK = "site_id int, audit string, category string, check_id int, weight double, passed boolean, skipped boolean, warning boolean, severity string, scope string"


def checks(spark, *rows):
    return frame(spark, [dict(zip(["audit", "category", "weight", "passed", "skipped", "warning", "severity", "scope"], r), site_id=1, check_id=i) for i, r in enumerate(rows)], CHECK)


@pytest.mark.parametrize("audit, score, status", [
    (S.INDEX, 0, "Skipped"), (S.STRUCTURED, 100, "Passed"), (S.ON_PAGE, 100, "Skipped"), (S.IMAGE, 100, "Skipped"), (S.ANSWER, 100, "Passed"),
])
def test_all_skipped(spark, audit, score, status):
    row = S.category_summary(checks(spark, (audit, "c", 2.0, True, True, False, "High", "page"))).collect()[0]
    assert (row["score"], row["status"]) == (score, status)


def test_warning_earns_half_and_blocker_caps(spark):
    rows = checks(spark, (S.IMAGE, "c", 2.0, False, False, True, "High", "page"), (S.IMAGE, "c", 2.0, True, False, False, "High", "page"))
    assert S.skip_aware_scores(rows).collect()[0]["score"] == 75
    rows = checks(spark, (S.TECHNICAL, "c", 1.0, False, False, False, "BLOCKER", "page"), (S.TECHNICAL, "c", 99.0, True, False, False, "MINOR", "page"),
                  (S.TECHNICAL, "c", 1.0, True, False, False, "MINOR", "domain"))
    row = S.technical_scores(rows).collect()[0]
    assert (row["page_score"], row["raw_score"], row["score"], row["grade"]) == (99, 99, 50, "D")


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.booleans(), st.booleans()), min_size=1, max_size=6))
def test_passing_more_never_lowers_a_score(spark, rows):
    def score(change):
        made = [(S.TRUST, "c", float(w), p or change == i, s, False, "High", "page") for i, (w, p, s) in enumerate(rows)]
        return S.skip_aware_scores(checks(spark, *made)).collect()[0]["score"]
    base = score(-1)
    assert 0 <= base <= score(0) <= 100


def test_first_distinct_keeps_first_places_with_a_hot_key(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 40)).alias("site"),
                                    (F.col("id") % 500).cast("string").alias("url"), F.col("id").alias("place"))
    ours = {(r.site, r.url) for r in first_distinct(rows, ["site"], "url", "place", 5).collect()}
    seen, expected = {}, set()
    for i in range(3000):
        site, url = ("hot" if i % 3 == 0 else f"s{i % 40}"), str(i % 500)
        known = seen.setdefault(site, [])
        if url not in known and len(known) < 5:
            known.append(url)
            expected.add((site, url))
    assert ours == expected
