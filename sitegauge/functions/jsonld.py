"""Structured-data readers (J1-J13) over the node table of a page (``ld``, made by :mod:`operators.structured`).

A value is a node; what lies inside it, at any depth, is an interval of node numbers, and a property is one lookup. Everything
works inside the row: no explode and no shuffle is needed to answer page-level questions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.structured import NODE
from . import patterns as P
from .text import trim_blank

_NODES = f"array<{NODE}>"


def nodes() -> Column:
    return F.coalesce(F.col("ld")["nodes"], F.array().cast(_NODES))


def _none() -> Column:
    return F.array().cast(_NODES)


def _at(number: Column) -> Column:
    return F.get(F.col("ld")["nodes"], number)


def error_count(blank_is_error: bool = True) -> Column:
    """Unparsable blocks; one audit ignores blank ones, the others count them."""
    bad = F.coalesce(F.col("ld")["bad"], F.lit(0))
    return bad if blank_is_error else bad - F.coalesce(F.col("ld")["blank"], F.lit(0))


def is_object(value: Column) -> Column:
    return F.coalesce(value["kind"] == "o", F.lit(False))


def get(value: Column, key: str) -> Column:
    return _at(F.try_element_at(value["kids"], F.lit(key)))


def get_array(value: Column, key: str) -> Column:
    """The property as array: single values are wrapped, absent gives an empty array."""
    prop = get(value, key)
    return F.when(prop.isNull(), _none()).when(prop["kind"] == "a", F.transform(prop["items"], _at)).otherwise(F.array(prop))


def truthy(value: Column) -> Column:
    """Present and not null, false, zero or the empty string."""
    empty = value["kind"].isin("z", "f") | (value["kind"].isin("s", "n") & value["text"].isin("", "0"))
    zero_text = (value["kind"] == "s") & (value["text"] == "0")
    return F.coalesce(~empty | zero_text, F.lit(False))


def has_key(value: Column, key: str) -> Column:
    """Own property test: JSON null counts as present."""
    return F.coalesce(F.map_contains_key(value["kids"], F.lit(key)), F.lit(False))


def string_of(value: Column) -> Column:
    """Text of a JSON string, NULL for every other kind."""
    return F.when(value["kind"] == "s", value["text"])


def scalar(value: Column, key: str) -> Column:
    """Text of a string, number or truth value, NULL for others."""
    prop = get(value, key)
    return F.when(prop["kind"] != "z", prop["text"])


def number(value: Column, key: str) -> Column:
    return scalar(value, key).try_cast("double")


def shown(value: Column) -> Column:
    """A property of a record as JSON, for evidence."""
    return F.when(value["kind"] == "s", F.to_json(F.array(value["text"])).substr(F.lit(2), F.length(F.to_json(F.array(value["text"]))) - 2)).otherwise(
        F.coalesce(value["json"], value["text"]))


def strings(value: Column, key: str) -> Column:
    """The property's string items."""
    return F.transform(F.filter(get_array(value, key), lambda v: v["kind"] == "s"), lambda v: v["text"])


def scalar_texts(value: Column, key: str) -> Column:
    return F.transform(get_array(value, key), lambda v: F.coalesce(v["text"], F.lit("[object Object]")))


def types(record: Column) -> Column:
    """The record's own types as text."""
    return F.coalesce(record["types"], F.array().cast("array<string>"))


def records(typed_only: bool = True) -> Column:
    """Records through arrays and ``@graph`` in document order."""
    return F.filter(nodes(), lambda v: v["flat"] & v["typed"] if typed_only else v["flat"])


def top_blocks() -> Column:
    """Values of the blocks with a top-level array spread into its items."""
    return F.filter(nodes(), lambda v: v["top"])


def objects() -> Column:
    """Every object at any level."""
    return F.filter(nodes(), lambda v: v["kind"] == "o")


def _once(value: Column, work: Callable[[Column], Column]) -> Column:
    """``work`` on a value that is computed once, not again for every node it is held against."""
    return F.get(F.transform(F.array(value), work), 0)


def objects_of(values: Column) -> Column:
    """J4 from some records on: these and all objects inside them."""
    inside = lambda spans: F.filter(nodes(), lambda v: (v["kind"] == "o") & F.exists(spans, lambda r: v["n"].between(r["n"], r["last"])))
    return _once(F.transform(values, lambda r: F.struct(r["n"].alias("n"), r["last"].alias("last"))), inside)


def deep_types() -> Column:
    """J5, first form: string types of every object."""
    return F.flatten(F.transform(objects(), lambda r: strings(r, "@type")))


def graph_types(record: Column) -> Column:
    """J5, second form: own types plus those reached through ``@graph`` arrays."""
    reached = lambda n, last: F.filter(nodes(), lambda v: (v["kind"] == "o") & v["n"].between(n, last) & (v["chain"] <= n))
    of = lambda r: F.flatten(F.transform(reached(r["n"], r["last"]), lambda v: strings(v, "@type")))
    nothing = F.array().cast("array<string>")
    return _once(record, lambda r: F.when((r["kind"] == "o") & (r["last"] > r["n"]), of(r)).otherwise(nothing))


def any_type(types_: Column, pattern: str, flags: str = "") -> Column:
    return F.exists(types_, lambda t: P.test(t, pattern, flags))


def of_type(values: Column, names: Sequence[str]) -> Column:
    wanted = F.array(*[F.lit(n) for n in names])
    return F.filter(values, lambda r: F.arrays_overlap(types(r), wanted))


def first(values: Column) -> Column:
    """First record, NULL for none."""
    return F.get(values, 0)


def text_value(value: Column, numbers: bool = False) -> Column:
    """A string, else the text of name, url or ``@id``; numbers only where asked for."""
    return F.coalesce(value["counted" if numbers else "said"], F.lit(""))


def text_of(record: Column, key: str, numbers: bool = False) -> Column:
    return text_value(get(record, key), numbers)


# Address parts in the order they are written out.
ADDRESS_PARTS = ("streetAddress", "addressLocality", "addressRegion", "postalCode", "addressCountry")


def address_text(record: Column) -> Column:
    """Address parts joined with commas."""
    parts = F.array(*[text_of(get(record, "address"), key, True) for key in ADDRESS_PARTS])
    return F.array_join(F.filter(parts, lambda p: p != ""), ", ")


def _texts(values: list[Column]) -> Column:
    return F.filter(F.array(*values), lambda t: t != "")


def dates(values: Column) -> Column:
    keys = ("datePublished", "dateModified", "uploadDate", "startDate", "endDate")
    return F.flatten(F.transform(values, lambda r: _texts([text_of(r, k, True) for k in keys])))


def prices(values: Column) -> Column:
    keys = ("price", "lowPrice", "highPrice")

    def offer_prices(record: Column) -> Column:
        return F.flatten(
            F.transform(get_array(record, "offers"), lambda o: _texts([text_of(o, k, True) for k in keys]))
        )

    return F.flatten(F.transform(values, offer_prices))


def phones(record: Column) -> Column:
    own = _texts([text_of(record, "telephone", True)])
    contacts = F.transform(get_array(record, "contactPoint"), lambda c: text_of(c, "telephone", True))
    return F.concat(own, F.filter(contacts, lambda t: t != ""))


def own_or_nested(record: Column, key: str) -> Column:
    """The property on a record, else on its geo, else on its address."""
    geo, address = get(record, "geo"), get(record, "address")
    nested = F.when(is_object(geo), has_key(geo, key)).when(is_object(address), has_key(address, key))
    return has_key(record, key) | F.coalesce(nested, F.lit(False))


def has_property(values: Column, key: str) -> Column:
    """The property on one of the records or inside them."""
    return F.exists(objects_of(values), lambda r: own_or_nested(r, key))


def non_https_urls(record: Column) -> Column:
    """Plain addresses in the record's texts and keys, at any depth."""
    inside = lambda r: F.filter(nodes(), lambda v: v["plain_urls"].isNotNull() & v["n"].between(r["n"], r["last"]))
    return _once(record, lambda r: F.flatten(F.transform(inside(r), lambda v: v["plain_urls"])))


def duplicate_ids(values: Column) -> Column:
    """J13."""
    ids = F.filter(F.transform(values, lambda r: text_of(r, "@id")), lambda i: i != "")
    return F.array_distinct(F.filter(ids, lambda i: F.size(F.filter(ids, lambda x: x == i)) > 1))


# Product properties that count towards coverage.
PRODUCT_FIELDS = ("name", "brand", "offers", "aggregateRating")


def product_coverage(values: Column) -> Column:
    """Whole percent of product fields some record carries, 100 without records."""
    carries = lambda key: F.exists(values, lambda r: truthy(get(r, key))).cast("int")
    present = sum((carries(key) for key in PRODUCT_FIELDS), F.lit(0))
    return F.when(F.size(values) > 0, F.floor(present * 100 / len(PRODUCT_FIELDS) + 0.5).cast("int")).otherwise(100)


def is_complete_product(values: Column) -> Column:
    offer_like = lambda r: truthy(get(r, "offers")) | truthy(get(r, "aggregateRating")) | truthy(get(r, "review"))
    return F.exists(values, lambda r: truthy(get(r, "name")) & offer_like(r))


def review_aggregate(values: Column) -> Column:
    """First object with a rating value and a review count."""
    rated = F.filter(objects_of(values), lambda r: truthy(get(r, "ratingValue")) & truthy(get(r, "reviewCount")))
    return first(rated)


def is_suspicious_rating(values: Column) -> Column:
    agg = review_aggregate(values)
    value = lambda key: F.coalesce(number(agg, key), F.lit(0.0))
    return (value("ratingValue") == 5) & (value("reviewCount") >= 20)


def same_as_urls(values: Column) -> Column:
    return F.flatten(F.transform(values, lambda r: strings(r, "sameAs")))


def breadcrumb_names(values: Column) -> Column:
    """Item names of the first breadcrumb record."""
    trail = get(first(of_type(values, ["BreadcrumbList"])), "itemListElement")
    entries = F.when(trail["kind"] == "a", F.transform(trail["items"], _at)).otherwise(_none())
    name = lambda entry: trim_blank(F.coalesce(scalar(entry, "name"), scalar(get(entry, "item"), "name"), F.lit("")))
    return F.filter(F.transform(entries, name), lambda n: n != "")
