"""Structured-data queries over JSON-LD derived from parts and suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsonld as J
from ..functions import text as T
from ..operators.structured import with_nodes
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


def part_blocks(spark, d):
    """One or two script texts per part: plain, in an array, in ``@graph``, broken, blank or without brand."""
    c = F.col
    k = c("p_partkey")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    offers = text('{"@type":"Offer","price":', F.format_string("%.2f", c("p_retailprice")), ',"availability":"https://schema.org/InStock"}')
    product = text(
        '{"@context":"https://schema.org","@type":["Product","Thing"],"@id":"https://shop.example/p/', (k % 50).cast("string"), '","name":" ', c("p_name"), ' "',
        F.when(k % 3 != 0, text(',"brand":{"@type":"Brand","name":"', c("p_brand"), '"}')).otherwise(',"brand":null'), ',"offers":', offers,
        F.when(k % 4 == 0, ',"aggregateRating":{"@type":"AggregateRating","ratingValue":5,"reviewCount":40}').otherwise(""),
        ',"url":"', F.when(k % 6 == 0, "http").otherwise("https"), '://shop.example/p/', k.cast("string"), '"}',
    )
    crumbs = text('{"@type":"BreadcrumbList","itemListElement":[{"name":"Home"},{"item":{"name":"', c("p_type"), '"}}]}')
    block = (
        F.when(k % 17 == 0, F.substring(product, 1, 40)).when(k % 5 == 0, text("[", product, ",", crumbs, "]"))
        .when(k % 5 == 1, text('{"@graph":[', product, ",", crumbs, "]}")).otherwise(product)
    )
    return table(spark, d, "part").select(
        k, "p_name", "p_brand", F.when(k % 13 == 0, F.array(block, F.lit("  "))).otherwise(F.array(block)).alias("jsonld"))


_K = "p_partkey"
_BAD = f"({_K} % 17 = 0)"


@register("record_parsing", f"""SELECT {_K}, CAST({_BAD}::INT + ({_K} % 13 = 0)::INT AS INT) AS errors, CAST({_BAD}::INT AS INT) AS errors_lenient,
 CAST(CASE WHEN {_BAD} THEN 0 WHEN {_K} % 5 IN (0, 1) THEN 2 ELSE 1 END AS INT) AS n_records, CAST(CASE WHEN {_BAD} THEN 0 WHEN {_K} % 5 = 1 THEN 3 WHEN {_K} % 5 = 0 THEN 2 ELSE 1 END AS INT) AS n_untyped,
 CASE WHEN {_BAD} THEN '' WHEN {_K} % 5 IN (0, 1) THEN 'Product,Thing,BreadcrumbList' ELSE 'Product,Thing' END AS types,
 CASE WHEN NOT {_BAD} THEN list_aggregate(list_sort(list_concat(CASE WHEN {_K} % 3 <> 0 THEN ['Brand'] ELSE [] END, ['Offer','Product','Thing'], CASE WHEN {_K} % 4 = 0 THEN ['AggregateRating'] ELSE [] END, CASE WHEN {_K} % 5 IN (0, 1) THEN ['BreadcrumbList'] ELSE [] END)), 'string_agg', ',') ELSE '' END AS deep_types,
 NOT {_BAD} AND {_K} % 5 IN (0, 1) AS has_trail FROM part""")
def record_parsing(spark, d):
    """Errors under both blank rules, records, types through the graph and at every depth."""
    return with_nodes(part_blocks(spark, d)).select(
        "p_partkey", J.error_count().alias("errors"), J.error_count(False).alias("errors_lenient"), F.size(J.records()).alias("n_records"),
        F.size(J.records(typed_only=False)).alias("n_untyped"),
        F.array_join(F.flatten(F.transform(J.records(), J.types)), ",").alias("types"),
        F.array_join(F.array_sort(J.deep_types()), ",").alias("deep_types"),
        (F.size(J.of_type(J.records(), ["BreadcrumbList"])) > 0).alias("has_trail"),
    )


@register("record_values", f"""SELECT {_K}, CASE WHEN {_BAD} THEN '' ELSE p_name END AS name, CASE WHEN {_BAD} OR {_K} % 3 = 0 THEN '' ELSE p_brand END AS brand, CASE WHEN {_BAD} THEN '' ELSE 'https://shop.example/p/' || ({_K} % 50) END AS id,
 NOT {_BAD} AS brand_key, NOT {_BAD} AND {_K} % 3 <> 0 AS brand_set, CASE WHEN {_BAD} THEN NULL ELSE round(p_retailprice, 2) END AS price,
 CAST(CASE WHEN {_BAD} THEN 100 ELSE 50 + CASE WHEN {_K} % 3 <> 0 THEN 25 ELSE 0 END + CASE WHEN {_K} % 4 = 0 THEN 25 ELSE 0 END END AS INT) AS coverage, NOT {_BAD} AND {_K} % 4 = 0 AS suspicious, NOT {_BAD} AS complete,
 CAST(CASE WHEN NOT {_BAD} AND {_K} % 6 = 0 THEN 1 ELSE 0 END AS INT) AS insecure, CASE WHEN NOT {_BAD} AND {_K} % 5 IN (0, 1) THEN 'Home > ' || p_type ELSE '' END AS trail FROM part""")
def record_values(spark, d):
    """Text values, presence, coverage, ratings, insecure addresses and trails."""
    c = F.col
    rows = with_nodes(part_blocks(spark, d)).select("p_partkey", "ld", J.records().alias("recs")).select(
        "*", J.of_type(c("recs"), ["Product"]).alias("products")).select("*", J.first(c("products")).alias("p"))
    return rows.select(
        "p_partkey", J.text_of(c("p"), "name").alias("name"), J.text_of(c("p"), "brand").alias("brand"), J.text_of(c("p"), "@id").alias("id"),
        J.has_key(c("p"), "brand").alias("brand_key"), J.truthy(J.get(c("p"), "brand")).alias("brand_set"),
        F.round(J.number(J.get(c("p"), "offers"), "price"), 2).alias("price"), J.product_coverage(c("products")).alias("coverage"),
        J.is_suspicious_rating(c("products")).alias("suspicious"), J.is_complete_product(c("products")).alias("complete"),
        F.size(F.flatten(F.transform("recs", J.non_https_urls))).alias("insecure"), F.array_join(J.breadcrumb_names(c("recs")), " > ").alias("trail"),
    )


@register("organisation_records", """WITH n AS (SELECT s_suppkey, s_name, n_name, CAST(floor(abs(s_acctbal)) AS BIGINT) AS b FROM supplier JOIN nation ON n_nationkey = s_nationkey)
SELECT s_suppkey, CAST(s_suppkey % 6 AS INT) AS n_same_as, s_suppkey % 6 > 0 AS linkedin, s_suppkey || ' Main Street, ' || n_name AS address, CAST(CASE WHEN s_suppkey % 2 = 0 THEN 2 ELSE 1 END AS INT) AS n_phones,
 array_to_string(list_sort(list_concat(['555' || lpad(CAST(b AS VARCHAR), 7, '0')], CASE WHEN s_suppkey % 2 = 0 THEN ['1800' || lpad(CAST(b AS VARCHAR), 7, '0')] ELSE [] END)), ' ') AS digits,
 s_suppkey % 3 = 0 AS latitude, s_suppkey % 4 = 0 AS area, CAST(CASE WHEN s_suppkey % 10 = 0 THEN 1 ELSE 0 END AS INT) AS n_duplicates, '2024-01-0' || (s_suppkey % 9 + 1) AS dates FROM n""")
def organisation_records(spark, d):
    """Same-as links, address, phones, geo properties, dates and repeated ids."""
    c = F.col
    k = c("s_suppkey")
    nation = table(spark, d, "nation").select("n_nationkey", "n_name")
    rows = table(spark, d, "supplier").join(F.broadcast(nation), c("s_nationkey") == c("n_nationkey"))
    balance = F.lpad(F.floor(F.abs("s_acctbal")).cast("string"), 7, "0")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    same_as = F.array_join(F.transform(F.when(k % 6 > 0, F.sequence(F.lit(1), (k % 6).cast("int"))).otherwise(F.array().cast("array<int>")),
                                       lambda i: text('"https://', F.when(i == 1, "linkedin.com").otherwise("x.example"), "/", i.cast("string"), '"')), ",")
    org = text(
        '{"@type":"LocalBusiness","@id":"#', k.cast("string"), '","name":"', c("s_name"), '","telephone":"+555 ', balance, '","address":{"streetAddress":"', k.cast("string"),
        ' Main Street","addressLocality":"', c("n_name"), '"},"sameAs":[', same_as, "]",
        F.when(k % 2 == 0, text(',"contactPoint":[{"telephone":"1800 ', balance, '"}]')).otherwise(""),
        F.when(k % 3 == 0, ',"geo":{"latitude":null,"longitude":1.5}').otherwise(""), F.when(k % 4 == 0, ',"areaServed":"all"').otherwise(""),
        ',"foundingDate":"2001","datePublished":"2024-01-0', (k % 9 + 1).cast("string"), '"}',
    )
    blocks = F.when(k % 10 == 0, F.array(org, text('{"@type":"Thing","@id":"#', k.cast("string"), '"}'))).otherwise(F.array(org))
    base = with_nodes(rows.select(k, blocks.alias("jsonld"))).select("*", J.records().alias("recs")).select("*", J.first(c("recs")).alias("org"))
    links = J.same_as_urls(F.filter(J.objects(), lambda r: J.any_type(J.graph_types(r), "LocalBusiness")))
    local = F.filter("recs", lambda r: J.any_type(J.types(r), "LocalBusiness"))
    digits = T.phone_digits(J.phones(c("org")))
    return base.select(
        "s_suppkey", F.size(links).alias("n_same_as"), F.exists(links, lambda u: F.contains(u, F.lit("linkedin.com"))).alias("linkedin"),
        J.address_text(c("org")).alias("address"), F.size(J.phones(c("org"))).alias("n_phones"), F.array_join(F.array_sort(digits), " ").alias("digits"),
        J.has_property(local, "latitude").alias("latitude"), J.has_property(local, "areaServed").alias("area"),
        F.size(J.duplicate_ids(c("recs"))).alias("n_duplicates"), F.array_join(J.dates(c("recs")), ",").alias("dates"),
    )


@register("nested_records", f"""SELECT {_K}, CAST(3 + {_K} % 28 AS INT) AS depth, CAST(CASE WHEN {_K} % 2 = 0 THEN 2 ELSE 1 END AS INT) AS n_records, 'Deep' || CASE WHEN {_K} % 2 = 0 THEN ',Side' ELSE '' END AS graph_types,
 CAST(2 * (3 + {_K} % 28) + 3 + CASE WHEN {_K} % 2 = 0 THEN 1 ELSE 0 END AS INT) AS n_objects, p_name AS name, p_brand AS brand_inside, {_K} % 3 = 0 AS latitude, CAST(CASE WHEN {_K} % 5 = 0 THEN 1 ELSE 0 END AS INT) AS insecure FROM part""")
def nested_records(spark, d):
    """J2, J4-J7, J9 at 3 to 30 levels: records and types through nested graphs, texts through chains of names, objects and addresses inside."""
    c = F.col
    k = c("p_partkey")
    depth = (k % 28 + 3).cast("int")
    deep = lambda opens, inner, closes: F.concat(F.repeat(F.lit(opens), depth), *inner, F.repeat(F.lit(closes), depth))
    record = [
        F.lit('{"@type":"Deep","name":'), deep('{"name":', [F.lit('" '), c("p_name"), F.lit(' "')], "}"), F.lit(',"about":[{"maker":{"brand":"'), c("p_brand"), F.lit('"'),
        F.when(k % 3 == 0, ',"latitude":null').otherwise(""), F.lit(',"link":"'), F.when(k % 5 == 0, "http").otherwise("https"), F.lit('://x.example/"}}]}'),
        F.when(k % 2 == 0, ',[[{"@type":"Listed"}]],{"@type":"Side"}').otherwise(""),
    ]
    block = deep('{"@graph":[', record, "]}")
    rows = with_nodes(table(spark, d, "part").select(k, "p_name", "p_brand", F.array(block).alias("jsonld")))
    top = J.first(J.top_blocks())
    maker = J.first(F.filter(J.objects(), lambda r: J.has_key(r, "brand")))
    listed = F.when(k % 2 == 0, 1).otherwise(0)
    return rows.select(
        k, (F.size(F.filter(J.objects(), lambda r: J.has_key(r, "@graph")))).alias("depth"), (F.size(J.records()) - listed).alias("n_records"),
        F.array_join(J.graph_types(top), ",").alias("graph_types"), (F.size(J.objects()) - listed).alias("n_objects"),
        J.text_of(J.first(J.of_type(J.records(), ["Deep"])), "name").alias("name"), J.text_of(maker, "brand").alias("brand_inside"),
        J.has_property(J.of_type(J.records(), ["Deep"]), "latitude").alias("latitude"), F.size(J.non_https_urls(top)).alias("insecure"))
