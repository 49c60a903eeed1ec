"""Issue trend over stored audit runs, and A8: latest report per id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def issue_trend(
    runs: DataFrame, time: str, impact: Column, amount: Column, keys: tuple[str, ...] = (), every: str = "1 week"
) -> DataFrame:
    """Issues per week and impact, with the change against the week before.

    Rows collapse to one per week first; the window then runs over the few weeks only.
    """
    weekly = (
        runs.withColumn("_impact", impact)
        .withColumn("_amount", amount)
        .groupBy(*keys, F.window(F.col(time), every, startTime="4 days").alias("w"))
        .agg(*[F.sum(F.when(F.col("_impact") == i, F.col("_amount")).otherwise(0)).alias(i) for i in ("high", "medium", "low")])
        .select(*keys, F.col("w.start").alias("week"), "high", "medium", "low")
        .withColumn("total", F.col("high") + F.col("medium") + F.col("low"))
    )
    order = W.partitionBy(*(keys or (F.lit(1),))).orderBy("week")
    return weekly.withColumn("change", F.col("total") - F.lag("total").over(order))


def latest_per_id(rows: DataFrame, key: str, time: str, tie: str | None = None) -> DataFrame:
    """Newest stored version per id, folded by a partial aggregate instead of a sort."""
    others = [c for c in rows.columns if c != key]
    order = F.struct(time, tie) if tie else F.col(time)
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("_row")).select(key, "_row.*")
