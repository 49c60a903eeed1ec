"""Personal-data spans by weak supervision: several labelers vote, expectation-maximisation weighs them.

1. *Base spans* of four kinds (email, ip, card, phone) by strict patterns and checks; they always stay.
2. *Candidates*: looser patterns of the same kinds, such as a card number that stands next to a phone number, where the strict
   pattern runs over both and fails, or an address written with "(at)".
3. *Votes*: a pattern labeler (strict shape and checksum), a gazetteer labeler (top-level domains, card issuers, country codes,
   address ranges), a context labeler (words and signs around the span) and a form labeler (grouping and separators) each vote
   for, against or not at all.
4. *Reliabilities*: all votes of all texts are counted by pattern; expectation-maximisation on these counts (a two-class
   Dawid-Skene model per kind) estimates how often each labeler is right and the probability of each pattern.
5. *Classifier*: a naive Bayes model over features of the span is trained on those probabilities as soft labels; candidates it
   accepts are added to the base spans, unless they overlap one of their kind.

Scale: texts are scanned once by built-in expressions and nothing of them is shuffled; the staged table has one narrow row per
document. What comes to the driver is a table of counts with at most ``4 kinds x 3^4 votes x 2^4 features`` rows.

Offsets are code points, ends are exclusive. Patterns use atomic quantifiers, so long runs of one character class take linear time.

Defined cases: null and empty texts have no spans; rows with equal ids are treated one by one; without candidates nothing
is trained and base spans are returned alone; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("pattern", "gazetteer", "context", "form")
FEATURES = ("apart_before", "apart_after", "long", "mixed")
NONE, AGAINST, FOR = 0, 1, 2
CONTEXT_CHARS = 40

# Strict patterns. \G lets a match start where the last one ended; else it starts at the first character of its class.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Looser patterns of the candidates.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}+\x20?+[(\[](?:at|AT)[)\]]\x20?+[A-Za-z0-9-]{2,63}+(?:(?:\.|\x20?+[(\[](?:dot|DOT)[)\]]\x20?+)[A-Za-z0-9-]{2,63}+)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:\x20?+[(\[](?:dot|DOT)[)\]]\x20?+[0-9]{1,3}+){3}(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{16,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3})(?![0-9])",
    "phone": r"(?<![0-9])(?:\+|00)[1-9][0-9]{0,2}\x20?\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])|(?<![0-9+(])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
# Gazetteers and context words.
DOMAINS = "com|org|net|edu|gov|info|io|de|fr|es|uk|it|eu|ch|at|us|ca|au|jp|cn|in|br"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|35|6011|62|65)"
COUNTRIES = r"^(?:\+|00)(?:1|20|27|3[0-9]|4[0-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])"
WORDS = {
    "email": "mail|contact|write|reach|adresse|correo|courriel",
    "ip": "host|server|address|login|from|adresse|serveur|servidor",
    "card": "card|visa|credit|payment|karte|carte|tarjeta",
    "phone": "call|phone|tel|mobile|fax|telefon|appel|llama",
}
ROUNDS = 40


def _span_type() -> str:
    return "array<struct<kind:string,start:int,end:int,value:string,before:string,after:string>>"


def matched(text: Column, kind: str, pattern: str) -> Column:
    """All matches with their place and surroundings: the gaps between matches give the offsets."""
    gaps = F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.arrays_zip(F.slice(gaps, 1, F.size(values)).alias("g"), values.alias("v"), F.slice(gaps, 2, F.size(values)).alias("n"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["g"])
        end = start + F.length(x["v"])
        span = F.struct(
            F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["v"].alias("value"),
            F.right(x["g"], F.lit(CONTEXT_CHARS)).alias("before"), F.left(x["n"], F.lit(1)).alias("after"),
        )
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(_span_type()).alias("out"))
    return F.aggregate(steps, zero, step)["out"]


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def strict(kind: str, value: Column) -> Column:
    """The check that a match of the strict pattern must pass."""
    if kind == "ip":
        plain = F.transform(F.split(value, r"\."), lambda p: F.ltrim(p, F.lit("0")))
        return F.forall(plain, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    count = F.length(digits(value))
    if kind == "card":
        return count.between(16, 19) & F.call_function("luhn_check", digits(value))
    return count.between(8, 15) if kind == "phone" else F.lit(True)


def _passing(kind: str):
    return lambda s: strict(kind, s["value"])


def _counted(kind: str):
    return lambda s: s["base"] & (s["kind"] == kind)


def base_spans(text: Column) -> Column:
    """Array of the strict spans of all kinds, in the order of :data:`KINDS`."""
    parts = []
    for kind in KINDS:
        spans = F.filter(matched(text, kind, BASE[kind]), _passing(kind))
        parts.append(F.when(_possible(text, kind), spans).otherwise(F.array().cast(_span_type())))
    return F.concat(*parts)


def _possible(text: Column, kind: str) -> Column:
    """A cheap test that most texts fail."""
    return F.contains(text, F.lit("@")) if kind == "email" else F.contains(text, F.lit("+")) if kind == "phone" else text.rlike("[0-9]")


def loose_spans(text: Column, base: Column) -> Column:
    """Candidates that overlap no base span of their kind."""
    parts = []
    for kind in KINDS:
        spans = matched(text, kind, LOOSE[kind])
        free = F.filter(spans, lambda s: ~F.exists(base, lambda b: (b["kind"] == s["kind"]) & (b["start"] < s["end"]) & (s["start"] < b["end"])))
        possible = text.rlike("[(\\[](?:at|AT)[)\\]]") if kind == "email" else text.rlike("[0-9]")
        parts.append(F.when(possible, free).otherwise(F.array().cast(_span_type())))
    return F.concat(*parts)


def _vote(supports: Column, opposes: Column) -> Column:
    return F.when(supports, FOR).when(opposes, AGAINST).otherwise(NONE)


def votes(span: Column) -> list[Column]:
    """The four labelers' votes on a span."""
    kind, value = span["kind"], span["value"]
    by_kind = lambda options: F.coalesce(*[F.when(kind == k, v) for k, v in options.items()])
    flat = F.regexp_replace(value, r"\x20?[(\[](?:dot|DOT)[)\]]\x20?", ".")
    flat = F.regexp_replace(flat, r"\x20?[(\[](?:at|AT)[)\]]\x20?", "@")
    number = digits(value)
    shaped = by_kind({k: flat.rlike(f"^(?:{BASE[k]})$".replace("|\\G", "")) & strict(k, flat) for k in KINDS})
    known = by_kind({
        "email": F.lower(flat).rlike(rf"\.(?:{DOMAINS})$"), "ip": ~flat.rlike(r"^(?:0|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])\."),
        "card": number.rlike(ISSUERS), "phone": value.rlike(COUNTRIES),
    })
    before = F.lower(span["before"])
    named = by_kind({k: before.rlike(rf"(?:{w})\W{{0,4}}(?:\w{{1,6}}\W{{1,3}})?$") for k, w in WORDS.items()})
    inside = F.right(span["before"], F.lit(1)).rlike(r"[\w=\"'/#&]") | span["after"].rlike(r"[\w\"'=/]")
    formed = by_kind({
        "email": flat.rlike("^[^@]{2,}@"), "ip": ~flat.rlike(r"(?:^|\.)0[0-9]"),
        "card": value.rlike(r"^[0-9]+$|^[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}$"),
        "phone": value.rlike(r"^\+?[0-9]{0,3}\x20?\([0-9]{3}\)\x20?[0-9]{3}-[0-9]{4}$|^\+[0-9]{1,3}(?:[\x20.-][0-9]{3}){2}[\x20.-][0-9]{4}$"),
    })
    abstains = (kind == "phone") & ~value.rlike(r"^(?:\+|00)")
    return [
        _vote(shaped, ~shaped), _vote(known, ~known & ~abstains), _vote(named, inside), _vote(formed, ~formed),
    ]


def features(span: Column) -> list[Column]:
    value = span["value"]
    return [
        ~F.right(span["before"], F.lit(1)).rlike(r"[\p{L}0-9_]"), ~span["after"].rlike(r"[\p{L}0-9_]"),
        F.length(value) >= 16, value.rlike("[^0-9A-Za-z]"),
    ]


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One narrow row per document: doc_id and its spans with votes and features."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    rows = rows.withColumn("base", base_spans(F.col("text"))).withColumn("loose", loose_spans(F.col("text"), F.col("base")))

    def judged(spans: Column, is_base: bool) -> Column:
        return F.transform(spans, lambda s: F.struct(
            s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(is_base).alias("base"),
            F.array(*votes(s)).alias("votes"), F.array(*[f.cast("int") for f in features(s)]).alias("features"),
        ))

    return rows.select("doc_id", F.concat(judged(F.col("base"), True), judged(F.col("loose"), False)).alias("spans"))


def reliabilities(counts: list[tuple[tuple, int]]) -> tuple[float, list[list[list[float]]], dict[tuple, float]]:
    """Two-class Dawid-Skene on (votes, count): share of true spans, vote rates [labeler][class][vote] and P(true | votes)."""
    share = 0.5
    rates = [[[0.2, 0.6, 0.2], [0.2, 0.1, 0.7]] for _ in LABELERS]
    posterior: dict[tuple, float] = {}
    total = sum(n for _, n in counts)
    for _ in range(ROUNDS):
        for pattern, _ in counts:
            yes = math.log(share) + sum(math.log(rates[i][1][v]) for i, v in enumerate(pattern))
            no = math.log(1 - share) + sum(math.log(rates[i][0][v]) for i, v in enumerate(pattern))
            posterior[pattern] = 1 / (1 + math.exp(min(500.0, no - yes)))
        true = sum(n * posterior[p] for p, n in counts)
        share = (true + 1) / (total + 2)
        for i in range(len(LABELERS)):
            for c in (0, 1):
                weight = [1.0, 1.0, 1.0]
                for p, n in counts:
                    weight[p[i]] += n * (posterior[p] if c else 1 - posterior[p])
                rates[i][c] = [w / sum(weight) for w in weight]
    return share, rates, posterior


def train(counts: list[tuple[str, tuple, tuple, int]]) -> dict[str, dict[str, float]]:
    """Per kind the log-odds weights of the naive Bayes classifier, from (kind, votes, features, count) rows.

    The inputs of the classifier are the votes and the span features, labelled with the probabilities of the vote model.
    """
    model: dict[str, dict[str, float]] = {}
    for kind in sorted({c[0] for c in counts}):
        rows = [(v, f, n) for k, v, f, n in counts if k == kind]
        merged: dict[tuple, int] = {}
        for v, _, n in rows:
            merged[v] = merged.get(v, 0) + n
        share, rates, posterior = reliabilities(sorted(merged.items()))
        weights = {"bias": math.log(share / (1 - share))}
        for i, name in enumerate(LABELERS):
            for vote in (NONE, AGAINST, FOR):
                weights[f"{name}={vote}"] = math.log(rates[i][1][vote] / rates[i][0][vote])
        for i, name in enumerate(FEATURES):
            for value in (0, 1):
                yes = 1 + sum(n * posterior[v] for v, f, n in rows if f[i] == value)
                no = 1 + sum(n * (1 - posterior[v]) for v, f, n in rows if f[i] == value)
                all_yes = 2 + sum(n * posterior[v] for v, _, n in rows)
                all_no = 2 + sum(n * (1 - posterior[v]) for v, _, n in rows)
                weights[f"{name}={value}"] = math.log((yes / all_yes) / (no / all_no))
        model[kind] = {k: round(w, 6) for k, w in weights.items()}
    return model


def score(span: Column, model: dict[str, dict[str, float]]) -> Column:
    """Log-odds of a span with votes and features; null for a kind without a model."""
    cases = []
    for kind, weights in model.items():
        parts = F.lit(weights["bias"])
        for i, name in enumerate(LABELERS):
            parts = parts + F.element_at(F.array(*[F.lit(weights[f"{name}={v}"]) for v in (NONE, AGAINST, FOR)]), F.get(span["votes"], i) + 1)
        for i, name in enumerate(FEATURES):
            parts = parts + F.element_at(F.array(*[F.lit(weights[f"{name}={v}"]) for v in (0, 1)]), F.get(span["features"], i) + 1)
        cases.append(F.when(span["kind"] == kind, parts))
    return F.coalesce(*cases) if cases else F.lit(None).cast("double")


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id and ``spans`` (kind, start, end, base), base spans first by kind and start, then the added ones."""
    rows = stage(candidates(docs, doc_id, text), "pii_candidates")
    single = rows.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes", "s.features").count()
    counts = [(r["kind"], tuple(r["votes"]), tuple(r["features"]), r["count"]) for r in single.collect()]  # bounded, see above
    model = train(sorted(counts))
    kept = F.filter("spans", lambda s: s["base"] | (score(s, model) > 0))
    return rows.select("doc_id", F.transform(kept, lambda s: F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"),
    )).alias("spans"))


def _order(span: Column) -> Column:
    return F.coalesce(*[F.when(span["kind"] == k, i) for i, k in enumerate(KINDS)])


def joined(spans: Column) -> Column:
    """``kind:start:end`` of the spans by kind and start, joined by commas."""
    keyed = F.transform(spans, lambda s: F.struct(_order(s).alias("o"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts per kind and digests of the base spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(F.filter("spans", _counted(k))).cast("bigint").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(F.encode(joined(base), "UTF-8"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))

