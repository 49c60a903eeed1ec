"""Which phrases of a site its pages show: a positional index of units instead of texts held against lists.

A text falls into units, a word with the signs after it. Where a phrase occurs, its inner units are whole units of the text, its
first unit ends one and its last unit begins one. Pages become (site, page, position, unit) rows; phrases become (site, unit, place)
rows, first and last units by way of the site's distinct units. An equi-join on the rarest unit of each phrase gives the starts to
look at; there the other units are checked by position. No page text and no list of phrases is moved, and both sides spread by
unit and by position.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = r"[\p{L}\p{N}]+[^\p{L}\p{N}]*|^[^\p{L}\p{N}]+"
GRAM = 3
PHONE_DIGITS = 7


def units(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(UNIT), F.lit(0))


def _edge_keys(unit: Column) -> Column:
    """What a piece may be found by: the whole unit, and its last, first and inner letters, up to ``GRAM``."""
    size = F.length(unit)
    sizes = F.filter(F.array(*[F.lit(k) for k in range(1, GRAM + 1)]), lambda k: k <= size)
    key = lambda side, value: F.struct(F.lit(side).alias("side"), value.alias("key"))
    inner = F.flatten(F.transform(sizes, lambda k: F.transform(F.sequence(F.lit(1), size - k + 1), lambda i: unit.substr(i, k))))
    return F.concat(
        F.array(key("whole", unit)), F.transform(sizes, lambda k: key("end", unit.substr(size - k + 1, k))), F.transform(sizes, lambda k: key("start", unit.substr(F.lit(1), k))),
        F.transform(F.array_distinct(inner), lambda g: key("inside", g)),
    )


def shown(texts: DataFrame, phrases: DataFrame, site: str = "site_id", keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> DataFrame:
    """(site, phrase, on_site) of the ``phrases`` (site, phrase) that a row of ``texts`` (site, page, own, text) contains; ``on_site``: one with ``own`` does.

    An empty phrase is in every text and is not looked up. Null texts show nothing.
    """
    c = F.col
    index = texts.select(site, "page", "own", F.posexplode(units(c("text"))).alias("position", "unit"))
    parts = phrases.where("phrase != ''").select(site, "phrase").distinct().select(site, "phrase", units(c("phrase")).alias("units")).select(
        site, "phrase", F.size("units").alias("n"), F.posexplode("units").alias("place", "piece"))
    side = F.when(c("n") == 1, "inside").when(c("place") == 0, "end").when(c("place") == c("n") - 1, "start").otherwise("whole")
    parts = keep(parts.withColumn("side", side), "phrase_parts")
    vocabulary = index.groupBy(site, "unit").agg(F.count("*").alias("met")).join(parts.select(site).distinct(), site, "left_semi")
    vocabulary = keep(vocabulary, "phrase_vocabulary")
    # how each piece stands in the site's units, and how often
    size = F.least(F.length("piece"), F.lit(GRAM))
    pieces = parts.select(site, "side", "piece").distinct().withColumn("key", F.when(c("side") == "whole", c("piece")).when(
        c("side") == "end", c("piece").substr(F.length("piece") - size + 1, size)).otherwise(c("piece").substr(F.lit(1), size)))
    keys = vocabulary.select(site, "unit", "met", F.explode(_edge_keys(c("unit"))).alias("k")).select(site, "unit", "met", "k.side", "k.key")
    leads = keep(keys.join(pieces, [site, "side", "key"]).where(_fits()).select(site, "side", "piece", "unit", "met"), "phrase_leads")
    met = leads.groupBy(site, "side", "piece").agg(F.sum("met").alias("met"))
    rarest = parts.join(met, [site, "side", "piece"]).groupBy(site, "phrase", "n").agg(
        F.count("*").alias("known"), F.min_by(F.struct("place", "side", "piece"), F.struct("met", "place")).alias("anchor")).where("known = n")
    anchors = rarest.select(site, "phrase", "n", "anchor.*").join(leads, [site, "side", "piece"]).select(site, "phrase", "n", "place", "unit")
    starts = keep(index.join(anchors, [site, "unit"]).select(site, "phrase", "n", "page", "own", c("place").alias("anchor"), (c("position") - c("place")).alias("start")), "phrase_starts")
    others = starts.where("n > 1").join(parts.drop("n"), [site, "phrase"]).where("place != anchor").withColumn("position", c("start") + c("place"))
    there = others.join(index.drop("own"), [site, "page", "position"]).where(_fits()).groupBy(site, "phrase", "n", "page", "start").agg(
        F.count("*").alias("met"), F.bool_or("own").alias("own")).where("met = n - 1")
    return starts.where("n = 1").select(site, "phrase", "own").union(there.select(site, "phrase", "own")).groupBy(site, "phrase").agg(F.bool_or("own").alias("on_site"))


def _fits() -> Column:
    """A piece stands in a unit as its side asks."""
    side, unit, piece = F.col("side"), F.col("unit"), F.col("piece")
    return F.when(side == "whole", unit == piece).when(side == "end", F.endswith(unit, piece)).when(side == "start", F.startswith(unit, piece)).otherwise(F.contains(unit, piece))


def shown_digits(texts: DataFrame, numbers: DataFrame, site: str = "site_id") -> DataFrame:
    """(site, number) of the digit strings of at most ``PHONE_DIGITS`` that stand in the digits of a text (site, digits)."""
    digits = F.col("digits")
    grams = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.transform(
        F.array(*[F.lit(k) for k in range(1, PHONE_DIGITS + 1)]), lambda k: digits.substr(i, k)))))
    found = texts.where(F.length(digits) > 0).select(site, F.explode(grams).alias("number")).distinct()
    return numbers.select(site, "number").distinct().join(found, [site, "number"], "left_semi")
