"""Temperature mixing of sources to target weights.

Token shares of the sources are raised to an exponent between 0 (even weights) and 1 (natural weights). The exponent is
bisected on a fixed grid: the smallest one that repeats no source more than ``max_epochs`` times, and not below the largest
one whose weights reach ``target_entropy`` (a fraction of the entropy of even weights); where both are asked for and clash,
the repetition limit wins. Each source then gets a token budget and is read in whole permuted passes (epochs), the
last one cut where its budget ends. Token offsets in that stream give the block: every block holds the same share of each
source, and rows of a block are ordered by a hash.

Without ``budget`` the mix covers the corpus: the source with the highest natural share is read exactly once, all others at
least once. With ``budget`` the weights share out that many tokens and a source may be read in part.

Scale: one pass counts words into a narrow staged table; texts are not moved. Running token sums go by (source, epoch,
hash bucket), so that a source with a third of all rows is summed by many tasks; bucket totals are added up separately.

Defined cases: a null source is a source of its own, null text has no tokens, sources without tokens are read once, rows
that are equal in id and text are separate rows with the same place in the order, an empty table gives an empty mix.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .common import key_text

GRID = 1024
BUCKET_DIGITS = 3
WORDS = r"[^\x20\x09-\x0D]+"
FAN = 32


@dataclass(frozen=True)
class Mix:
    """Parameters of a mix; production values are the defaults."""

    max_epochs: float | None = 2.0
    target_entropy: float | None = None
    budget: int | None = None
    block_tokens: int = 1_000_000
    seed: str = "mix"


def token_counts(docs: DataFrame, source: str = "source", text: str = "text", doc_id: str = "doc_id", seed: str = "mix") -> DataFrame:
    """Narrow rows: id, source, number of words and a hash of the row that orders it in every epoch."""
    return docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), key_text(F.col(source)).alias("source_key"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("bigint").alias("n_tokens"),
        row_key(F.col(doc_id), F.col(text), seed).alias("row_key"),
    )


def row_key(doc_id: Column, text: Column, seed: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), key_text(doc_id), F.md5(key_text(text))))


def epoch_key(epoch: Column, key: Column) -> Column:
    return F.md5(F.concat_ws(":", epoch.cast("string"), key))


def source_totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("source_key").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows"))


def _facts(totals: DataFrame, points: list[int]) -> list[tuple[float, float]]:
    """For each grid point: most epochs of a source in a covering mix, and entropy of the weights against even weights."""
    some = totals.where("tokens > 0")
    top, n = some.agg(F.max("tokens"), F.count("*")).first()
    if not n:
        return [(1.0, 1.0) for _ in points]
    share = F.col("tokens").cast("double") / F.lit(float(top))
    columns = []
    for k in points:
        power = F.pow(share, F.lit(k / GRID))
        columns += [F.max(F.pow(share, F.lit(k / GRID - 1))), F.sum(power), F.sum(power * F.log(power))]
    row = some.agg(*columns).first()
    entropies = [math.log(z) - s / z for z, s in zip(row[1::3], row[2::3])]
    return [(e, h / math.log(n) if n > 1 else 1.0) for e, h in zip(row[0::3], entropies)]


def _edge(totals: DataFrame, holds, low: int, high: int) -> tuple[int, int]:
    """Neighbouring grid points between which ``holds`` changes from its value at ``low`` to that at ``high``."""
    while high - low > 1:
        points = sorted({low + (high - low) * i // FAN for i in range(1, FAN)} - {low, high})
        for point, facts in zip(points, _facts(totals, points)):
            if holds(facts):
                high = point
                break
            low = point
    return low, high


def exponent(totals: DataFrame, mix: Mix) -> float:
    """The exponent on the grid; 1.0 where nothing is asked for."""
    (epochs0, _), (_, entropy1) = _facts(totals, [0, GRID])
    by_epochs, by_entropy = 0, GRID
    if mix.max_epochs is not None and epochs0 > mix.max_epochs:
        by_epochs = _edge(totals, lambda f: f[0] <= mix.max_epochs, 0, GRID)[1]
    if mix.target_entropy is not None and entropy1 < mix.target_entropy:
        by_entropy = _edge(totals, lambda f: f[1] < mix.target_entropy, 0, GRID)[0]
    if mix.target_entropy is None:
        return (by_epochs if mix.max_epochs is not None else GRID) / GRID
    return max(by_epochs, by_entropy) / GRID


def budgets(totals: DataFrame, mix: Mix) -> DataFrame:
    """Per source: weight, token budget and number of passes begun."""
    alpha = exponent(totals, mix)
    power = F.pow(F.col("tokens").cast("double"), F.lit(alpha))
    top, z = totals.agg(F.max("tokens"), F.sum(F.when(F.col("tokens") > 0, power))).first()
    tokens = F.col("tokens").cast("double")
    cover = tokens * F.pow(tokens / F.lit(float(top or 1)), F.lit(alpha - 1))
    weight = power / F.lit(float(z or 1))
    wanted = cover if mix.budget is None else F.lit(float(mix.budget)) * weight
    budget = F.when(F.col("tokens") > 0, F.floor(wanted + 0.5)).otherwise(0).cast("bigint")
    out = totals.withColumn("weight", F.when(F.col("tokens") > 0, weight).otherwise(0.0)).withColumn("budget", budget)
    passes = F.when(F.col("tokens") > 0, F.greatest(F.ceil(F.col("budget") / F.col("tokens")), F.lit(0 if mix.budget else 1))).otherwise(1)
    return out.select("source_key", "tokens", "weight", "budget", passes.cast("int").alias("passes"))


def occurrences(counts: DataFrame, shares: DataFrame, mix: Mix) -> DataFrame:
    """One row per reading of a row: epoch, token offset in the source's stream, block and order in the block."""
    total = shares.agg(F.sum("budget")).first()[0] or 0
    n_blocks = max(1, -(-total // mix.block_tokens))
    read = counts.join(shares, "source_key").withColumn("epoch", F.explode(F.expr("sequence(0, passes - 1)")))
    read = read.where("passes > 0").withColumn("order_key", epoch_key(F.col("epoch"), F.col("row_key")))
    read = read.withColumn("bucket", F.substring("order_key", 1, BUCKET_DIGITS))
    sums = read.groupBy("source_key", "epoch", "bucket").agg(F.sum("n_tokens").alias("held"))
    before = Window.partitionBy("source_key", "epoch").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source_key", "epoch", "bucket", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source_key", "epoch", "bucket").orderBy("order_key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    read = read.join(sums, ["source_key", "epoch", "bucket"])
    read = read.withColumn(
        "offset", F.col("epoch") * F.col("tokens") + F.col("base") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))
    )
    whole = (F.col("epoch") == 0) & (F.col("budget") >= F.col("tokens"))
    read = read.where(whole | (F.col("offset") < F.col("budget")))
    at = F.floor(F.col("offset").cast("double") * F.lit(float(n_blocks)) / F.col("budget"))
    block = F.when(F.col("budget") > 0, F.least(at, F.lit(n_blocks - 1))).otherwise(0)
    return read.withColumn("block", block.cast("bigint"))


def mix_rows(docs: DataFrame, mix: Mix = Mix(), source: str = "source", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The mix as narrow rows: doc_id, source, n_tokens, epoch, token_offset, block, order_key."""
    counts = stage(token_counts(docs, source, text, doc_id, mix.seed), "mix_counts")
    shares = stage(budgets(stage(source_totals(counts), "mix_totals"), mix), "mix_shares")
    return occurrences(counts, shares, mix).select(
        "doc_id", "source", "n_tokens", "epoch", F.col("offset").alias("token_offset"), "block", "order_key"
    )


def mixed_documents(docs: DataFrame, mix: Mix = Mix(), source: str = "source", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with every row as often as the mix reads it.

    A cut pass is a prefix in hash order, so one key per source decides it: rows are repeated where they lie.
    """
    counts = stage(token_counts(docs, source, text, doc_id, mix.seed), "mix_counts")
    shares = stage(budgets(stage(source_totals(counts), "mix_totals"), mix), "mix_shares")
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(F.lit(1))
    last = occurrences(counts, shares, mix).where(F.col("epoch") == whole)
    cuts = last.groupBy("source_key").agg(F.max("order_key").alias("cut_key"))
    plan = shares.join(cuts, "source_key", "left").select(
        F.col("source_key").alias("__source"), whole.cast("int").alias("__whole"), F.col("cut_key").alias("__cut")
    )
    again = epoch_key(F.col("__whole"), row_key(F.col(doc_id), F.col(text), mix.seed)) <= F.col("__cut")
    copies = F.col("__whole") + F.coalesce(again.cast("int"), F.lit(0))
    joined = docs.withColumn("__source", key_text(F.col(source))).join(stage(plan, "mix_plan"), "__source")
    repeated = joined.withColumn("__copies", copies).where("__copies > 0")
    return repeated.withColumn("__copy", F.explode(F.expr("sequence(1, __copies)"))).select(*[F.col(f"`{c}`") for c in docs.columns])
