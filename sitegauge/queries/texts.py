"""Text, URL and history queries over documents, conversations, pages and events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..functions import urls as U
from ..operators import classify as CL
from ..operators import ranking as R
from ..operators import trends
from ..operators.taxonomy import BUSINESS_MODELS, INDUSTRIES, SUB_INDUSTRIES
from ..session import shared_dir
from ..sources import report_store as STORE
from .common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


_WORDS = r"regexp_extract_all(text, '[^\s\x0B\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+')"


def _n(pattern: str, flags: str = "i") -> str:
    return f"CAST(len(regexp_extract_all(text, '{pattern}', 0, '{flags}')) AS INT)" if flags else (
        f"CAST(len(regexp_extract_all(text, '{pattern}')) AS INT)")


@register("document_metrics", rf"""SELECT doc_id, CAST(len({_WORDS}) AS INT) AS words, CAST(length(text) + len(regexp_extract_all(text, '[\x{{10000}}-\x{{10FFFF}}]')) AS INT) AS units,
 {_n(r'\b\d+(?:\.\d+)?%|\b\d{4}\b|\b\d+(?:,\d{3})+\b', '')} AS data_points,
 {_n(r'\b\d+(?:\.\d+)?%|\b\d{4}\b|\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b', '')} AS facts,
 {_n(r'\b(source|reference|according to|study|report|research)\b')} AS evidence,
 {_n(r'\b(review|reviews|rating|ratings|testimonial|testimonials)\b')} AS reviews,
 {_n(r'\b(2024|2025|2026|recent|latest|verified)\b')} AS fresh,
 CAST({" + ".join(f"contains(lower(text), '{s}')::INT" for s in T.REVIEW_SOURCES)} AS INT) AS review_sources,
 CAST({" + ".join(f"regexp_matches(text, '{p}', 'i')::INT" for p in T.FOLLOW_UPS)} AS INT) AS follow_ups,
 CAST({" + ".join(f"regexp_matches(text, '{p}', 'i')::INT" for p in T.HEADING_PROGRESSION)} AS INT) AS progression FROM documents""")
def document_metrics(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id", T.word_count(t).alias("words"), T.utf16_length(t).alias("units"), T.data_point_count(t).alias("data_points"),
        T.fact_count(t).alias("facts"), T.evidence_word_count(t).alias("evidence"), T.review_word_count(t).alias("reviews"),
        T.fresh_review_count(t).alias("fresh"), T.review_source_count(t).alias("review_sources"),
        T.pattern_coverage(t, T.FOLLOW_UPS).alias("follow_ups"), T.pattern_coverage(t, T.HEADING_PROGRESSION).alias("progression"),
    )


@register("reading_ease", rf"""WITH w AS (SELECT doc_id, {_WORDS} AS words, greatest(len(regexp_extract_all(text, '[.!?]+')), 1) AS sentences FROM documents),
s AS (SELECT doc_id, len(words) AS n, sentences, coalesce(list_sum(list_transform(list_transform(words, lambda x: regexp_replace(lower(x), '[^a-z]', '', 'g')),
  lambda c: greatest(1, CASE WHEN len(regexp_extract_all(c, '[aeiouy]+')) = 0 THEN 1 ELSE len(regexp_extract_all(c, '[aeiouy]+')) END - CASE WHEN c LIKE '%e' THEN 1 ELSE 0 END))), 0) AS syl FROM w)
SELECT doc_id, round(206.835::DOUBLE - 1.015::DOUBLE * (n / sentences) - 84.6::DOUBLE * (syl / greatest(n, 1)), 6) AS ease FROM s""")
def reading_ease(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(T.flesch_reading_ease(F.col("text")), 6).alias("ease"))


@register("contact_candidates", r"""WITH c AS (SELECT doc_id, text,
  list_distinct(list_filter(list_transform(regexp_extract_all(text, '\+?\d[\d\s().-]{7,}\d'), lambda p: trim(p)), lambda p: length(regexp_replace(p, '[^0-9]+', '', 'g')) >= 8)) AS phones,
  list_distinct(regexp_extract_all(text, '[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}', 0, 'i')) AS mails FROM documents)
SELECT doc_id, CAST(len(phones) AS INT) AS n_phones, array_to_string(list_sort(list_distinct(list_transform(phones, lambda p: regexp_replace(p, '[^0-9]+', '', 'g')))), ' ') AS phone_digits,
 CAST(len(mails) AS INT) AS n_mails, array_to_string(list_sort(mails), ' ') AS mails,
 array_to_string(list_sort(list_distinct(list_transform(mails, lambda m: lower(split_part(m, '@', 2))))), ' ') AS domains,
 regexp_matches(text, '\+?\d[\d\s().-]{7,}') AND regexp_matches(text, '\b(address|visit us|find us|located at|clinic|office|suite|floor|street|st\.|road|rd\.|avenue|ave\.|lane|sector|block|near|opp\.|opposite|bangalore|bengaluru|delhi|mumbai|pune|hyderabad|chennai|kolkata|ncr)\b', 'i') AS nap
FROM c""")
def contact_candidates(spark, d):
    t = F.col("text")
    mails = T.email_candidates(t)
    return table(spark, d, "documents").select(
        "doc_id", F.size(T.phone_candidates(t)).alias("n_phones"),
        F.array_join(F.array_sort(T.phone_digits(T.phone_candidates(t))), " ").alias("phone_digits"),
        F.size(mails).alias("n_mails"), F.array_join(F.array_sort(mails), " ").alias("mails"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(mails, U.domain_from_email))), " ").alias("domains"),
        T.visible_nap(t).alias("nap"),
    )


@register("normalized_texts", r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '&nbsp;', ' ', 'g'), '[^\p{L}\p{N}]+', ' ', 'g'))) AS digest,
 contains(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), trim(regexp_replace(lower(source), '[^\p{L}\p{N}]+', ' ', 'g'))) AS names_source FROM documents""")
def normalized_texts(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", F.md5(T.normalized(F.col("text"))).alias("digest"), T.contains_text(F.col("text"), F.col("source")).alias("names_source"))


@register("legal_and_years", r"""WITH y AS (SELECT doc_id, text, list_distinct(list_filter(list_transform(regexp_extract_all(text, '(?:copyright|©|\(c\))\s*(?:\d{4}\s*[-–]\s*)?(\d{4})', 1, 'i'), lambda v: CAST(v AS INT)), lambda v: v BETWEEN 1990 AND 2027)) AS years,
 list_distinct(regexp_extract_all(text, '\b(?:GSTIN|GST|VAT|EIN|TIN|CIN|LLPIN|Company Registration(?: Number)?|Registration(?: Number)?|Reg\.?\s*No\.?)[:#\s-]*[A-Z0-9-]{6,25}\b', 0, 'i')) AS regs FROM documents)
SELECT doc_id, array_to_string(list_sort(years), ' ') AS years, CAST(len(regs) AS INT) AS n_registrations FROM y""")
def legal_and_years(spark, d):
    years = T.copyright_years(F.col("text"), F.lit("2026-06-01").cast("date"))
    return table(spark, d, "documents").select(
        "doc_id", F.array_join(F.transform(F.array_sort(years), lambda y: y.cast("string")), " ").alias("years"),
        F.size(T.registration_numbers(F.col("text"))).alias("n_registrations"))


_ENTITIES = r"list_distinct(list_transform(regexp_extract_all({}, '\b(?:[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*|\d+(?:\.\d+)?%?|\d{{4}})\b'), lambda x: lower(x)))"


@register("turn_overlap", f"""WITH p AS (SELECT a.conv_id, a.turn, {_ENTITIES.format('a.text')} AS l, {_ENTITIES.format('b.text')} AS r FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
SELECT conv_id, turn, CAST(len(l) AS INT) AS n_entities, CASE WHEN len(l) > 0 THEN CAST(floor(len(list_intersect(l, r)) / len(l) * 100 + 0.5) AS INT) ELSE 0 END AS overlap FROM p""")
def turn_overlap(spark, d):
    """Entities of a turn found again in the next one."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", "text")
    following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next_text"))
    return turns.join(following, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.size(T.entity_set(F.col("text"))).alias("n_entities"),
        T.entity_overlap_percent(F.col("text"), F.col("next_text")).alias("overlap"))


@register("question_signals", rf"""SELECT conv_id, role, CAST(sum(len(regexp_extract_all(text, '\?'))) AS BIGINT) AS marks,
 count(*) FILTER (regexp_matches(text, '\?|\b(what|how|why|when|where|who|can|does|is|are)\b', 'i')) AS question_turns FROM conversations GROUP BY ALL""")
def question_signals(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id", "role").agg(
        F.sum(P.count(F.col("text"), r"\?", "")).alias("marks"), F.count_if(P.test(F.col("text"), T.QUESTION_WORDS)).alias("question_turns"))


_CASE_SQL = r"""WITH w AS (SELECT *, list_filter(regexp_split_to_array(name, '\s+'), lambda x: regexp_matches(x, '[A-Za-z]')) AS ws FROM names),
k AS (SELECT key, ord, CASE WHEN len(ws) = 0 THEN 'unknown'
  WHEN len(list_filter(ws, lambda x: regexp_matches(x, '^[A-Z][a-z0-9]+'))) / len(ws) >= 0.65 THEN 'title'
  WHEN regexp_matches(name, '^[A-Z]') AND len(list_filter(list_slice(ws, 2, len(ws)), lambda x: regexp_matches(x, '^[a-z0-9]'))) >= greatest(1, len(ws) - 2) THEN 'sentence'
  WHEN name = upper(name) AND regexp_matches(name, '[A-Z]') THEN 'upper' ELSE 'mixed' END AS kind FROM w)"""


@register("name_cases", "WITH RECURSIVE names AS (SELECT p_brand AS key, p_partkey AS ord, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) WHEN 2 THEN upper(p_name[1]) || p_name[2:] ELSE p_brand || ' ' || p_name END AS name FROM part), "
          + _CASE_SQL.replace("WITH w", "w", 1) + " SELECT key, kind, count(*) AS n, min(ord) AS first FROM k GROUP BY ALL")
def name_cases(spark, d):
    """N7 over part names in four spellings."""
    c = F.col
    name = F.when(c("p_partkey") % 4 == 0, c("p_name")).when(c("p_partkey") % 4 == 1, F.upper("p_name")).when(
        c("p_partkey") % 4 == 2, F.concat(F.upper(F.substring("p_name", 1, 1)), F.expr("substring(p_name, 2)"))
    ).otherwise(F.concat_ws(" ", "p_brand", "p_name"))
    return table(spark, d, "part").select(c("p_brand").alias("key"), c("p_partkey").alias("ord"), T.heading_case(name).alias("kind")).groupBy(
        "key", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))


_H = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
_S = r"lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1))"
_PATH = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_Q = r"regexp_extract(url, '\?([^#]*)', 1)"
_SORTED = f"array_to_string(list_sort(string_split({_Q}, '&')), '&')"
_CANON = f"{_S} || '://' || {_H} || CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END || CASE WHEN {_Q} = '' THEN '' ELSE '?' || {_SORTED} END"


@register("url_parts", rf"""SELECT page_id, {_S} AS scheme, {_H} AS host, regexp_replace({_H}, '^www\.', '') AS bare, array_to_string(list_slice(string_split(regexp_replace({_H}, '^www\.', ''), '.'), -2, -1), '.') AS root,
 CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END AS path, {_CANON} AS canonical, regexp_replace({_CANON}, '/$', '') AS comparable,
 regexp_replace({_S} || '://' || {_H} || {_PATH}, '/$', '') AS comparable_page,
 CASE WHEN {_H} LIKE 'www.%' THEN {_S} || '://' || {_H}[5:] ELSE {_S} || '://www.' || {_H} END || {_PATH} || CASE WHEN {_Q} = '' THEN '' ELSE '?' || {_Q} END AS other_host,
 CASE WHEN url LIKE '%/' THEN url[1:-2] ELSE url || '/' END AS other_slash, {_S} || '://' || {_H} || upper({_PATH}) AS upper_path, regexp_replace(url, '^https:', 'http:') AS plain_http,
 regexp_matches({_Q}, '(^|&)(utm_source|utm_medium|utm_campaign|gclid|fbclid|msclkid)=') AS tracked, regexp_matches({_Q}, '(^|&)(sort|filter|color|size|page|q|s)=') AS trap,
 regexp_matches({_Q}, '(^|&)(v|ver|version|cache|cachebuster|cb|t|time|timestamp|rand|random)=', 'i') AS buster,
 regexp_replace({_PATH}, '[-_]+', ' ', 'g') AS words, coalesce(list_filter(string_split({_PATH}, '/'), lambda x: x <> '')[-1], '') AS file FROM pages""")
def url_parts(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select(
        "page_id", U.scheme(u).alias("scheme"), U.host(u).alias("host"), U.bare_host(u).alias("bare"), U.root_domain(U.host(u)).alias("root"),
        U.path(u).alias("path"), U.canonicalize(u).alias("canonical"), U.comparable_url(u).alias("comparable"),
        U.comparable_page(u).alias("comparable_page"), U.toggle_www(u).alias("other_host"), U.toggle_slash(u).alias("other_slash"),
        U.upper_path(u).alias("upper_path"), U.with_http(u).alias("plain_http"), U.has_tracking_param(u).alias("tracked"),
        (F.size(U.trap_params(u)) > 0).alias("trap"), U.has_cache_buster(u).alias("buster"), U.path_words(u).alias("words"),
        U.file_name(u).alias("file"),
    )


@register("url_hashes", """SELECT page_id, list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(url, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, c: (a * 31 + c) & CAST(4294967295 AS BIGINT)) AS hash,
 '"' || replace(url, '"', '""') || '"' AS cell FROM pages""")
def url_hashes(spark, d):
    return table(spark, d, "pages").select("page_id", T.rolling_hash(F.col("url")).alias("hash"), T.csv_cell(F.col("url")).alias("cell"))


@register("asset_kinds", r"""WITH n AS (SELECT p_partkey, 'https://cdn.example.com/' || replace(p_name, ' ', CASE WHEN p_partkey % 3 = 0 THEN '-' ELSE '' END) || list_extract(['.css','.js','.mjs','.json','.xml','.txt','.svg','.webp','.woff2','.pdf','/feed','.bin'], CAST(p_partkey % 12 + 1 AS INT)) || CASE WHEN p_partkey % 5 = 0 THEN '?v=2' ELSE '' END AS url FROM part),
f AS (SELECT *, regexp_replace(split_part(url, '?', 1), '^https://[^/]*/', '') AS p FROM n)
SELECT p_partkey, CASE WHEN p LIKE '%.css' THEN 'css' WHEN regexp_matches(p, '\.m?js$') THEN 'js' WHEN p LIKE '%.json' THEN 'json' WHEN regexp_matches(p, '\.xml$|feed') THEN 'xml' WHEN p LIKE '%.txt' THEN 'txt' WHEN p LIKE '%.svg' THEN 'svg' WHEN p LIKE '%.webp' THEN 'image' WHEN p LIKE '%.woff2' THEN 'font' ELSE 'other' END AS kind,
 regexp_matches(url, '\.(svg|webp|pdf)(\?|$)') AS media, length(regexp_replace(split_part(p, '/', -1), '\.[a-z0-9]+$', '')) >= 8 AND regexp_matches(regexp_replace(split_part(p, '/', -1), '\.[a-z0-9]+$', ''), '[a-z]{3,}[-_][a-z0-9]{2,}') AS descriptive FROM f""")
def asset_kinds(spark, d):
    c = F.col
    ends = F.array(*[F.lit(e) for e in (".css", ".js", ".mjs", ".json", ".xml", ".txt", ".svg", ".webp", ".woff2", ".pdf", "/feed", ".bin")])
    url = F.concat(F.lit("https://cdn.example.com/"), F.when(c("p_partkey") % 3 == 0, F.replace("p_name", F.lit(" "), F.lit("-"))).otherwise(
        F.replace("p_name", F.lit(" "), F.lit(""))), F.element_at(ends, (c("p_partkey") % 12 + 1).cast("int")),
        F.when(c("p_partkey") % 5 == 0, "?v=2").otherwise(""))
    return table(spark, d, "part").select("p_partkey", url.alias("url")).select(
        "p_partkey", U.asset_kind(c("url")).alias("kind"), U.is_media(c("url")).alias("media"), U.is_descriptive_file(c("url")).alias("descriptive"))


_KEYWORDS = "kw(kind, item_ord, label, keyword, gram, phrase) AS (VALUES " + ", ".join(
    f"('{kind}', {i}, '{label}', '{k}', '{k.replace('-', ' ')}', {str(' ' in k).lower()})"
    for kind, items in zip(CL.KINDS, (INDUSTRIES, SUB_INDUSTRIES, BUSINESS_MODELS)) for i, (label, _, ks) in enumerate(items) for k in ks if len(k) >= 3) + ")"


def _documents_as_pages(spark, d):
    """Documents with part names mixed in, so that keywords of several industries occur."""
    words = [k for items in (INDUSTRIES, SUB_INDUSTRIES) for _, _, ks in items for k in ks[:4]]
    pool = F.array(*[F.lit(w) for w in words])
    pick = lambda m: F.element_at(pool, (F.col("doc_id") * m % len(words) + 1).cast("int"))
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("page_id"), F.concat_ws(" ", pick(3), pick(3), pick(5)).alias("title"),
        F.concat_ws(" ", pick(3), F.lit("online"), pick(3), pick(7)).alias("h1"), F.concat_ws(" ", F.col("text"), pick(3), pick(11), pick(3), pick(3), pick(3)).alias("body"))


def _pool_sql() -> str:
    words = [k for items in (INDUSTRIES, SUB_INDUSTRIES) for _, _, ks in items for k in ks[:4]]
    lst = "[" + ", ".join(f"'{w}'" for w in words) + "]"
    pick = lambda m: f"list_extract({lst}, CAST(doc_id * {m} % {len(words)} + 1 AS INT))"
    return f"""docs AS (SELECT doc_id AS page_id, {pick(3)} || ' ' || {pick(3)} || ' ' || {pick(5)} AS title, {pick(3)} || ' online ' || {pick(3)} || ' ' || {pick(7)} AS h1,
  text || ' ' || {pick(3)} || ' ' || {pick(11)} || ' ' || {pick(3)} || ' ' || {pick(3)} || ' ' || {pick(3)} AS body FROM documents),
sig AS (SELECT page_id, 'title' AS signal, 8.0 AS weight, 0 AS o, trim(regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS text FROM docs UNION ALL
  SELECT page_id, 'h1', 7.0, 2, trim(regexp_replace(lower(h1), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) FROM docs UNION ALL
  SELECT page_id, 'body', 1.2, 7, trim(regexp_replace(lower(body), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) FROM docs),
hit AS (SELECT page_id, kind, item_ord, label, signal, weight, keyword, phrase, len(regexp_extract_all(text, '\\b' || gram || '\\b')) AS n FROM sig, kw WHERE contains(text, gram)),
pts AS (SELECT *, CAST(least(n, CASE WHEN signal = 'body' THEN 3 ELSE 2 END) * weight * CASE WHEN phrase THEN 1.35 ELSE 1 END AS DECIMAL(18,6)) AS p FROM hit WHERE n > 0),
item AS (SELECT page_id, kind, item_ord, label, sum(p) AS score, count(DISTINCT CASE WHEN weight >= 4 THEN signal END) AS strong, count(DISTINCT keyword) AS keywords FROM pts GROUP BY ALL)"""


@register("keyword_scores", f"WITH {_KEYWORDS}, {_pool_sql()} SELECT page_id, kind, label, CAST(score AS DOUBLE) AS score, CAST(strong AS INT) AS strong, CAST(keywords AS INT) AS keywords FROM item")
def keyword_scores(spark, d):
    """C1-C3 over documents whose title, heading and text are the signals."""
    docs = _documents_as_pages(spark, d)
    hits = CL.keyword_hits(CL.signal_rows(docs, {n: F.col(n) for n in ("title", "h1", "body")}))
    return CL.item_scores(hits).select(
        "page_id", "kind", "label", F.col("score").cast("double").alias("score"), F.size("strong").alias("strong"), F.size("keywords").alias("keywords"))


def _lists(kind: str) -> str:
    return f"(SELECT page_id, list(struct_pack(s := score, label := label, strong := strong, kw := keywords) ORDER BY score DESC, item_ord) AS l FROM item WHERE kind = '{kind}' GROUP BY page_id)"


@register("classification", f"""WITH {_KEYWORDS}, {_pool_sql()},
parent(label, parent) AS (VALUES {", ".join(f"('{l}', '{p}')" for l, p, _ in SUB_INDUSTRIES)}),
ind AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, item_ord) AS r FROM item WHERE kind = 'industry'),
sub AS (SELECT item.*, parent, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, item_ord) AS r FROM item JOIN parent USING (label) WHERE kind = 'sub'),
top AS (SELECT d.page_id, coalesce(i.label, 'Healthcare') AS il, coalesce(i.score, 0) AS isc, coalesce(i.strong, 0) AS ist, coalesce(i.keywords, 0) AS ik, coalesce(s.label, 'Aesthetic Dermatology') AS sl, coalesce(s.parent, 'Healthcare') AS sp, coalesce(s.score, 0) AS ssc, coalesce(s.strong, 0) AS sst, coalesce(s.keywords, 0) AS sk
  FROM docs d LEFT JOIN ind i ON i.page_id = d.page_id AND i.r = 1 LEFT JOIN sub s ON s.page_id = d.page_id AND s.r = 1),
flags AS (SELECT *, (isc >= 7 AND ist >= 1 AND ik >= 2) OR (ssc >= 9 AND sst >= 1 AND sk >= 2) AS known, ssc >= 10 AND sst >= 1 AND sk >= 2 AND il <> sp AS conflict, isc < ssc * 0.75 OR ist < sst AS weak FROM top),
aligned AS (SELECT f.page_id, min_by(s.label, s.r) AS al FROM flags f JOIN sub s ON s.page_id = f.page_id AND s.parent = f.il AND s.score >= 8 AND s.strong >= 1 AND s.keywords >= 2 WHERE conflict AND NOT weak GROUP BY f.page_id)
SELECT page_id, CASE WHEN NOT known THEN 'Unclassified' WHEN conflict AND weak THEN sp ELSE il END AS industry, CASE WHEN NOT known THEN 'Insufficient Evidence' ELSE coalesce(al, sl) END AS sub_industry FROM flags LEFT JOIN aligned USING (page_id)""")
def classification(spark, d):
    """C4 over the same signals."""
    docs = _documents_as_pages(spark, d)
    hits = CL.keyword_hits(CL.signal_rows(docs, {n: F.col(n) for n in ("title", "h1", "body")}))
    return CL.decide(CL.item_scores(hits), docs).select("page_id", "industry", "sub_industry")


@register("classification_full")
def classification_full(spark, d):
    """C4-C6 with model, confidence and rejected categories."""
    docs = _documents_as_pages(spark, d)
    hits = CL.keyword_hits(CL.signal_rows(docs, {n: F.col(n) for n in ("title", "h1", "body")}))
    return CL.decide(CL.item_scores(hits), docs)


@register("issue_trend", """WITH w AS (SELECT time_bucket(INTERVAL 7 DAYS, ts, TIMESTAMP '1970-01-05') AS week, CASE WHEN event_type = 'error' THEN 'high' WHEN value > 50 THEN 'medium' ELSE 'low' END AS impact FROM events),
g AS (SELECT week, count(*) FILTER (impact = 'high') AS high, count(*) FILTER (impact = 'medium') AS medium, count(*) FILTER (impact = 'low') AS low, count(*) AS total FROM w GROUP BY ALL)
SELECT week, high, medium, low, total, total - lag(total) OVER (ORDER BY week) AS change FROM g""")
def issue_trend(spark, d):
    """Events as stored issue records."""
    c = F.col
    impact = F.when(c("event_type") == "error", "high").when(c("value") > 50, "medium").otherwise("low")
    return trends.issue_trend(table(spark, d, "events"), "ts", impact, F.lit(1).cast("bigint"))


@register("latest_reports", "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_reports(spark, d):
    """Newest stored version per id."""
    rows = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type", "value")
    return trends.latest_per_id(rows, "user_id", "ts", "event_id").select("user_id", "event_id", "event_type", "value")


@register("report_store", """SELECT user_id AS id, event_id, event_type, value FROM (
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def report_store(spark, d):
    """Events as versions of a report per user, saved in three parts, the first one again, and read back."""
    c = F.col
    path = f"{shared_dir(spark)}/sitegauge/{uuid.uuid4().hex}/store"
    rows = table(spark, d, "events").select(c("user_id").alias("id"), c("ts").alias("created_at"), "event_id", "event_type", "value")
    for part in (0, 1, 2, 0):
        STORE.save_reports(rows.where(c("event_id") % 3 == part), path, version=("created_at", "event_id"))
    return STORE.read_reports(spark, path).select("id", "event_id", "event_type", "value")


@register("first_rows", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn <= 4")
def first_rows(spark, d):
    """W1."""
    return R.first_k(table(spark, d, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], 4).select("o_custkey", "o_orderkey")


@register("first_distinct_values", """WITH m AS (SELECT l_suppkey, l_partkey, min(l_orderkey * 10 + l_linenumber) AS place FROM lineitem GROUP BY ALL)
SELECT l_suppkey, l_partkey, place FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY place, l_partkey) AS rn FROM m) WHERE rn <= 20""")
def first_distinct_values(spark, d):
    """S3 + W1."""
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"))
    return R.first_distinct(rows, ["l_suppkey"], "l_partkey", "place", 20)


@register("last_value_wins", "SELECT o_custkey, max_by(o_orderstatus, o_orderkey) AS status, max(o_orderkey) AS last_key FROM orders GROUP BY ALL")
def last_value_wins(spark, d):
    """S2."""
    rows = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("last_key"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("place"))
    return R.last_wins(rows, ["o_custkey"], "place").select("o_custkey", "status", "last_key")


@register("url_sources", r"""SELECT url, 'x' AS tag FROM (SELECT url FROM pages UNION SELECT regexp_replace(url, '[?#].*$', '') FROM pages)""")
def url_sources(spark, d):
    """Union of address sources without duplicates."""
    urls = table(spark, d, "pages").select("url")
    bare = urls.select(F.regexp_replace("url", r"[?#].*$", "").alias("url"))
    return R.union_distinct(urls, bare).withColumn("tag", F.lit("x"))


@register("uncovered_parts", "SELECT s_suppkey, count(*) AS missing FROM (SELECT DISTINCT l_suppkey AS s_suppkey, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey EXCEPT SELECT DISTINCT l_suppkey, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity > 45) GROUP BY ALL")
def uncovered_parts(spark, d):
    """Brands a supplier sells, less those it has a large line of; both sets come from one pass of partial sums."""
    part = table(spark, d, "part").select("p_partkey", "p_brand")
    sold = table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(
        F.col("l_suppkey").alias("s_suppkey"), "p_brand").agg(F.bool_or(F.col("l_quantity") > 45).alias("large"))
    return sold.where(~F.col("large")).groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("missing"))
