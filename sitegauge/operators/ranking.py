"""First-k, top-k and ordered selections.

Every limit here is a feature of the report. ``row_number() <= k`` lets Spark keep only k rows per
key before the shuffle, so one hot site never gathers all its rows in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_k(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int | None) -> DataFrame:
    """The first ``k`` rows per key; ``None`` keeps all."""
    if k is None:
        return rows
    window = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(window)).where(F.col("_rn") <= k).drop("_rn")


def top_k(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """Ranked rows with their rank kept."""
    window = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def first_distinct(rows: DataFrame, keys: Sequence[str], value: str, order: str, k: int | None) -> DataFrame:
    """S3 then W1: distinct values by first appearance, then the first ``k`` of them.

    Duplicates are folded by a partial aggregate before anything is ordered.
    """
    others = [c for c in rows.columns if c not in {*keys, value, order}]
    folded = rows.groupBy(*keys, value).agg(
        F.min(order).alias(order), *[F.min_by(c, order).alias(c) for c in others]
    )
    return first_k(folded, keys, [F.col(order), F.col(value)], k)


def last_wins(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row per key, the latest by ``order``."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("_row")).select(*keys, "_row.*")


def union_distinct(*frames: DataFrame) -> DataFrame:
    """S1."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out.distinct()


def first_failing(rows: DataFrame, key: str, ok: Column, label: str, order: str, samples: int = 3) -> DataFrame:
    """Share of passing rows, the first failing one and a few samples, without ordering all rows.

    Failing rows are cut to the sample size per key before they are gathered.
    """
    totals = rows.groupBy(key).agg(
        F.count(F.lit(1)).cast("int").alias("total"),
        F.count_if(ok).cast("int").alias("passed"),
        F.min_by(F.when(~ok, F.col(label)), F.when(~ok, F.col(order))).alias("first_issue"),
    )
    failing = first_k(rows.where(~ok), [key], [F.col(order)], samples)
    listed = failing.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(order, label))), lambda s: s[label]).alias("samples")
    )
    return totals.join(listed, key, "left")


def worst_categories(categories: DataFrame, k: int = 3, key: Sequence[str] = ("site_id",)) -> DataFrame:
    """Failed descending, score ascending."""
    failing = categories.where((F.col("status") != "Skipped") & (F.col("failed") > 0))
    return top_k(failing, key, [F.col("failed").desc(), F.col("score"), F.col("audit"), F.col("category")], k)


def weakest_audits(tabs: DataFrame, k: int = 2, key: str = "site_id") -> DataFrame:
    """Score ascending, issues descending, then tab order."""
    return top_k(tabs, [key], [F.col("score"), F.col("issues").desc(), F.col("tab_ord")], k)
