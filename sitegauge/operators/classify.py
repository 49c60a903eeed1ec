"""Business classification against a keyword taxonomy.

All keywords are found in one walk over each text, through one prefix tree, and meet the taxonomy in an equi-join with
a small broadcast table; there is no page x keyword product. Counts fold per page, signal and keyword before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import small_table

from ..functions import dom as D
from ..functions import text as T
from ..functions import urls as U
from ..functions.numbers import half_up
from .taxonomy import BUSINESS_MODELS, INDUSTRIES, SUB_INDUSTRIES

# Signals in reading order with their weights.
SIGNALS = (
    ("title", 8), ("description", 7), ("h1", 7), ("h2", 5), ("navigation", 4), ("productService", 6), ("schema", 5),
    ("body", 1.2), ("domain", 0.35),
)
STRONG_WEIGHT, PHRASE_BONUS, SHORTEST_KEYWORD = 4, 1.35, 3
KINDS = ("industry", "sub", "model")
_DECIMAL = "decimal(18,6)"


def _gram(keyword: str) -> str:
    """A keyword as normalised text holds it."""
    return " ".join("".join(ch if ch.isalnum() else " " for ch in keyword.lower()).split())


def keyword_table(spark: SparkSession) -> DataFrame:
    """The taxonomy as rows: kind, item, keyword and number of words (a few hundred rows, fixed)."""
    rows = []
    for kind, items in zip(KINDS, (INDUSTRIES, SUB_INDUSTRIES, BUSINESS_MODELS)):
        for item_ord, (label, _, keywords) in enumerate(items):
            for keyword_ord, keyword in enumerate(keywords):
                if len(keyword) >= SHORTEST_KEYWORD:
                    rows.append((kind, item_ord, label, keyword_ord, keyword, _gram(keyword), " " in keyword))
    return small_table(spark, 
        rows, "kind string, item_ord int, label string, keyword_ord int, keyword string, gram string, phrase boolean"
    )


def page_signals(pages: DataFrame, url: str = "url", body_limit: int | None = None) -> DataFrame:
    """One row per page and signal. ``body_limit`` restores a cut of the body text; None reads it whole."""
    c = F.col
    body = T.collapse(c("body_text"))
    if body_limit is not None:
        body = F.substring(body, 1, body_limit)
    h2 = F.filter(c("headings"), lambda h: h["tag"] == "h2")
    texts = {
        "title": c("title"),
        "description": D.meta_first("description"),
        "h1": D.first_h1(),
        "h2": D.joined(h2, " "),
        "navigation": D.navigation_text(),
        "productService": D.product_service_text(),
        "schema": F.array_join("jsonld", " "),
        "body": body,
        "domain": F.regexp_replace(U.domain_from_url(c(url)), "[.-]", " "),
    }
    return signal_rows(pages, texts)


def signal_rows(rows: DataFrame, texts: dict[str, Column], key: str = "page_id") -> DataFrame:
    """Long form of any set of signal texts."""
    packed = F.array(*[
        F.struct(
            F.lit(i).alias("signal_ord"), F.lit(name).alias("signal"), F.lit(weight).cast(_DECIMAL).alias("weight"),
            T.normalized(texts[name]).alias("text"),
        )
        for i, (name, weight) in enumerate(SIGNALS) if name in texts
    ])
    return rows.select(key, F.explode(packed).alias("s")).select(key, "s.*").where(F.col("text") != "")


def all_grams() -> list[str]:
    """The word runs of all keywords (fixed, about 380)."""
    return sorted({_gram(k) for items in (INDUSTRIES, SUB_INDUSTRIES, BUSINESS_MODELS) for _, _, ks in items for k in ks if len(k) >= SHORTEST_KEYWORD})


def trie_pattern(grams: list[str]) -> str:
    """The runs as one prefix tree: common beginnings are read once, and the longest run is tried first."""
    tree: dict = {}
    for gram in grams:
        node = tree
        for sign in gram:
            node = node.setdefault(sign, {})
        node[""] = {}

    def written(node: dict) -> str:
        ways = [sign + written(below) for sign, below in sorted(node.items()) if sign]
        if not ways:
            return ""
        body = ways[0] if len(ways) == 1 and "" not in node else f"(?:{'|'.join(ways)})"
        return body + "?" if "" in node else body

    return written(tree)


def prefix_rows(grams: list[str]) -> list[tuple[str, str]]:
    """The longest run found at a word, and each run that starts with the same words, itself included."""
    known = set(grams)
    out = []
    for gram in grams:
        words = gram.split()
        out += [(gram, " ".join(words[:n])) for n in range(1, len(words) + 1) if " ".join(words[:n]) in known]
    return out


def grams(text: Column) -> Column:
    """The longest keyword run at every word of a text, in one walk through the tree; only hits leave the row.

    The match is a look-ahead, so a run may start inside another one. Signs beyond ASCII end a word for the
    keywords, and keep their neighbours apart. The text is normalised: one blank between words.
    """
    pattern = rf"(?<![a-z0-9_])(?=({trie_pattern(all_grams())})(?![a-z0-9_]))"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def keyword_hits(signals: DataFrame, key: str = "page_id") -> DataFrame:
    """C2, first half: occurrences per page, signal and keyword."""
    spark = signals.sparkSession
    runs = small_table(spark, prefix_rows(all_grams()), "longest string, gram string")
    wanted = runs.join(F.broadcast(keyword_table(spark)), "gram").drop("gram")
    exploded = signals.select(key, "signal_ord", "signal", "weight", F.explode(grams(F.col("text"))).alias("longest"))
    return (
        exploded.join(F.broadcast(wanted), "longest")
        .groupBy(key, "kind", "item_ord", "label", "signal_ord", "signal", "weight", "keyword_ord", "keyword", "phrase")
        .agg(F.count(F.lit(1)).cast("int").alias("n"))
    )


def item_scores(hits: DataFrame, key: str = "page_id") -> DataFrame:
    """C2 + C3: score, strong signals and matched keywords per page and taxonomy item."""
    cap = F.when(F.col("signal") == "body", 3).otherwise(2)
    bonus = F.when(F.col("phrase"), F.lit(PHRASE_BONUS)).otherwise(F.lit(1.0)).cast(_DECIMAL)
    points = (F.least(F.col("n"), cap).cast(_DECIMAL) * F.col("weight") * bonus).cast("decimal(28,8)")
    strong = (F.col("signal") != "domain") & (F.col("weight") >= STRONG_WEIGHT)
    first_seen = F.struct(
        (F.col("signal_ord") * 1000 + F.col("keyword_ord")).alias("place"), F.col("keyword").alias("keyword")
    )
    return hits.groupBy(key, "kind", "item_ord", "label").agg(
        F.sum(points).alias("score"),
        F.array_sort(F.collect_set(F.when(strong, F.col("signal")))).alias("strong"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(first_seen)), lambda s: s["keyword"])).alias("keywords"),
    )


_ITEM = "struct<score:decimal(38,8),ord:int,label:string,parent:string,allowed:array<string>,strong:array<string>,keywords:array<string>>"


def _ranked(kind: str, items: tuple) -> Column:
    """All items of a kind with this page's score, best first; the taxonomy order breaks ties."""
    hits = F.filter(F.col("hits"), lambda h: h["kind"] == kind)
    none = F.array().cast("array<string>")
    fixed = F.array(*[
        F.struct(
            F.lit(i).alias("ord"), F.lit(label).alias("label"),
            (F.lit(extra) if isinstance(extra, str) else F.lit(None).cast("string")).alias("parent"),
            (F.array(*[F.lit(a) for a in extra]) if isinstance(extra, tuple) and extra else none).alias("allowed"),
        )
        for i, (label, extra, _) in enumerate(items)
    ])

    def row(score: Column, item: Column, strong: Column, keywords: Column) -> Column:
        return F.struct(
            score.cast("decimal(38,8)").alias("score"), item["ord"].alias("ord"), item["label"].alias("label"),
            item["parent"].alias("parent"), item["allowed"].alias("allowed"), strong.alias("strong"), keywords.alias("keywords"),
        )

    # only items with hits are sorted, by score and place; a hit scores above zero, so all others follow in order
    found = F.sort_array(F.transform(hits, lambda h: F.struct(
        (-h["score"]).alias("down"), h["item_ord"].alias("ord"), h["score"].alias("score"), h["strong"].alias("strong"),
        h["keywords"].alias("keywords"),
    )))
    ranked = F.transform(found, lambda h: row(h["score"], F.get(fixed, h["ord"]), h["strong"], h["keywords"]))
    ords = F.transform(hits, lambda h: h["item_ord"])
    others = T.let(ords, lambda seen: F.transform(
        F.filter(fixed, lambda item: ~F.array_contains(seen, item["ord"])), lambda item: row(F.lit(0), item, none, none)))
    return F.concat(ranked, others)


def _enough(item: Column, score: int, signals: int = 1) -> Column:
    return F.coalesce(
        (item["score"] >= score) & (F.size(item["strong"]) >= signals) & (F.size(item["keywords"]) >= 2), F.lit(False)
    )


def _rejected(item: Column, winner: Column, reason: str) -> Column:
    shown = F.array_join(F.slice(item["keywords"], 1, 5), ", ")
    return F.struct(
        item["label"].alias("category"),
        F.concat(
            F.lit(f"{reason}. Selected "), winner, F.lit(" instead. Evidence: "),
            F.when(shown != "", shown).otherwise("weak"),
        ).alias("reason"),
    )


def decide(scores: DataFrame, pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Winners, conflicts, rejected categories and confidence, one row per page.

    A page has at most as many item rows as the taxonomy has items, so its list is bounded.
    """
    c = F.col
    hits = scores.groupBy(key).agg(
        F.collect_list(F.struct("kind", "item_ord", c("score").cast("decimal(38,8)").alias("score"), "strong", "keywords")).alias("hits")
    )
    empty = F.array().cast("array<struct<kind:string,item_ord:int,score:decimal(38,8),strong:array<string>,keywords:array<string>>>")
    ranked = (
        pages.select(key).join(hits, key, "left").withColumn("hits", F.coalesce("hits", empty))
        .select(
            key, _ranked("industry", INDUSTRIES).alias("ind"), _ranked("sub", SUB_INDUSTRIES).alias("sub"),
            _ranked("model", BUSINESS_MODELS).alias("mod"),
        )
    )
    top_ind, top_sub = F.get(c("ind"), 0), F.get(c("sub"), 0)
    conflict = _enough(top_sub, 10) & (top_ind["label"] != top_sub["parent"])
    weak = (top_ind["score"] < top_sub["score"] * F.lit(0.75).cast("decimal(3,2)")) | (
        F.size(top_ind["strong"]) < F.size(top_sub["strong"])
    )
    step = ranked.select(
        "*", top_ind.alias("ind0"), top_sub.alias("sub0"),
        (_enough(top_ind, 7) | _enough(top_sub, 9)).alias("known"),
        (conflict & weak).alias("use_parent"), (conflict & ~weak).alias("seek_aligned"),
    ).select(
        "*",
        F.get(F.filter("ind", lambda i: i["label"] == c("sub0")["parent"]), 0).alias("parent"),
        F.get(F.filter("sub", lambda s: (s["parent"] == c("ind0")["label"]) & _enough(s, 8)), 0).alias("aligned"),
    ).select(
        "*",
        F.when(c("use_parent"), c("parent")).otherwise(c("ind0")).alias("industry_"),
        F.when(c("seek_aligned") & c("aligned").isNotNull(), c("aligned")).otherwise(c("sub0")).alias("sub_"),
    )
    allowed = lambda m: (F.size(m["allowed"]) == 0) | F.array_contains(m["allowed"], c("industry_")["label"])
    step = step.withColumn("model_", F.coalesce(F.get(F.filter("mod", allowed), 0), F.get("mod", 0)))
    ind, sub, mod = c("industry_"), c("sub_"), c("model_")
    share = F.lit(0.55).cast("decimal(3,2)")

    def rivals(column: str, chosen: Column, reason: str) -> Column:
        close = F.filter(
            F.slice(c(column), 2, 4),
            lambda r: (r["score"] >= chosen["score"] * share) & (F.size(r["strong"]) > 0) & (r["label"] != chosen["label"]),
        )
        return F.transform(close, lambda r: _rejected(r, chosen["label"], reason))

    none = F.array().cast("array<struct<category:string,reason:string>>")
    switched = F.when(c("use_parent"), F.array(_rejected(
        c("ind0"), ind["label"], "Rejected broad industry because sub-industry page evidence pointed elsewhere"
    ))).when(c("seek_aligned") & c("aligned").isNotNull(), F.array(_rejected(
        c("sub0"), sub["label"], "Rejected sub-industry because it conflicted with stronger industry evidence"
    ))).otherwise(none)
    rejected = F.slice(F.concat(
        switched,
        rivals("ind", ind, "Rejected because evidence was weaker or less specific"),
        rivals("sub", sub, "Rejected because sub-industry evidence was weaker or conflicted with final industry"),
    ), 1, 8)
    too_weak = F.transform(
        F.filter(F.slice("ind", 1, 3), lambda r: r["score"] > 0),
        lambda r: F.struct(
            r["label"].alias("category"),
            F.concat(F.lit("Rejected because page evidence was too weak: "),
                     F.array_join(F.slice(r["keywords"], 1, 5), ", ")).alias("reason"),
        ),
    )
    runner_up = lambda column, chosen: F.coalesce(
        F.get(F.filter(c(column), lambda r: r["label"] != chosen["label"]), 0)["score"], F.lit(0).cast("decimal(38,8)")
    )
    union = lambda name: F.array_distinct(F.concat(ind[name], sub[name], mod[name]))
    number = lambda value: value.cast("double")
    gap = lambda chosen, column: F.greatest(F.lit(0.0), number(chosen["score"]) - number(runner_up(column, chosen)))
    total = number(ind["score"]) + number(sub["score"]) + number(mod["score"])
    margin = gap(ind, "ind") + gap(sub, "sub") + gap(mod, "mod")
    step = step.select(
        "*", F.size(union("strong")).alias("n_signals"), F.size(union("keywords")).alias("n_keywords"),
        total.alias("total"), margin.alias("margin"), rejected.alias("rejected_"), too_weak.alias("too_weak"),
    )
    s, k = c("n_signals"), c("n_keywords")
    raw = half_up(
        24 + F.least(F.lit(34.0), c("total") * 0.45) + F.least(F.lit(22.0), c("margin") * 0.55) + s * 4
        + F.least(F.lit(10), k)
    )
    ceiling = lambda condition, limit: F.when(condition, limit).otherwise(96)
    confidence = F.greatest(F.lit(22), F.least(
        raw, ceiling((s < 2) | (k < 3), 48), ceiling(s < 3, 68), ceiling((s < 4) | (k < 5), 84), ceiling((s < 5) | (k < 5), 90),
    ))
    evidence = F.slice(F.array_distinct(F.concat(sub["keywords"], mod["keywords"], ind["keywords"])), 1, 16)
    known = c("known")
    return step.select(
        key,
        F.when(known, ind["label"]).otherwise("Unclassified").alias("industry"),
        F.when(known, sub["label"]).otherwise("Insufficient Evidence").alias("sub_industry"),
        F.when(known, mod["label"]).otherwise("Unknown").alias("business_model"),
        F.when(known, confidence).otherwise(22).cast("int").alias("confidence"),
        F.when(known, evidence).otherwise(F.array().cast("array<string>")).alias("evidence_keywords"),
        F.when(known, c("rejected_")).otherwise(c("too_weak")).alias("rejected"),
    )


def classify_pages(pages: DataFrame, key: str = "page_id", body_limit: int | None = None) -> DataFrame:
    """C1-C6 for parsed pages."""
    signals = page_signals(pages, body_limit=body_limit)
    return decide(item_scores(keyword_hits(signals)), pages)
