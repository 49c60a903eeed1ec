"""Running values along a sorted table, where one key may span any number of partitions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

ROWS = 50_000


def parts_for(n: int) -> int:
    return max(1, math.ceil(n / ROWS))


def ordered(rows: DataFrame, n: int, *by: str | Column) -> DataFrame:
    """``rows`` (``n`` of them) in sorted ranges, written down with ``part`` (the range) and ``seq`` (rises along the whole order)."""
    ranged = rows.repartitionByRange(parts_for(n), *by).sortWithinPartitions(*by).withColumn("seq", F.monotonically_increasing_id())
    return stage(ranged.withColumn("part", F.shiftright("seq", 33)), "ordered")


def running(rows: DataFrame, key: list[str], values: dict[str, tuple[Callable[[Column], Column], Column]]) -> DataFrame:
    """Add inclusive running aggregates per ``key`` along ``seq``; ``rows`` is sorted so that keys are contiguous.

    Within a range a window does it. A key that comes from the range before takes over what it had there: one row per range
    passes that on, so no task sees a whole key.
    """
    local = Window.partitionBy("part", *key).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = rows.withColumns({name: work(value).over(local) for name, (work, value) in values.items()})
    groups = rows.groupBy("part", *key).agg(F.min("seq").alias("seq"), *(work(value).alias(name) for name, (work, value) in values.items()))
    ends = groups.groupBy("part").agg(
        F.min_by(F.struct(*key), "seq").alias("first"), F.max_by(F.struct(*key, *values), "seq").alias("last"),
    )
    nothing = [F.lit(None).cast(here.schema[name].dataType).alias(name) for name in values]
    both = ends.select("part", F.lit(0).alias("gives"), *(F.col(f"first.{k}").alias(k) for k in key), *nothing).union(
        ends.select("part", F.lit(1).alias("gives"), *(F.col(f"last.{c}").alias(c) for c in (*key, *values))))
    before = Window.partitionBy(*key).orderBy("part", "gives").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.withColumns({f"_{name}": work(F.col(name)).over(before) for name, (work, _) in values.items()})
    carried = carried.where("gives = 0").select("part", *key, *(f"_{name}" for name in values))
    joined = here.join(carried, ["part", *key], "left")
    whole = {}
    for name, (work, _) in values.items():
        merge = {F.sum: lambda a, b: a + b, F.bit_xor: lambda a, b: a.bitwiseXOR(b), F.max: F.greatest}[work]
        whole[name] = F.when(F.col(f"_{name}").isNull(), F.col(name)).when(F.col(name).isNull(), F.col(f"_{name}")).otherwise(merge(F.col(name), F.col(f"_{name}")))
    return joined.withColumns(whole).drop(*(f"_{name}" for name in values))


def following(rows: DataFrame, key: list[str], value: str, name: str) -> DataFrame:
    """Add ``value`` of the next row of the same ``key`` along ``seq``, over the borders of ranges too."""
    here = rows.withColumn(name, F.lead(value).over(Window.partitionBy("part", *key).orderBy("seq")))
    ends = rows.groupBy("part").agg(F.min_by(F.struct(*key, value), "seq").alias("first"), F.max_by(F.struct(*key, F.col("seq").alias("_seq")), "seq").alias("last"))
    kind = rows.schema[value].dataType
    both = ends.select(F.lit(0).alias("last_of"), "part", F.lit(None).cast("bigint").alias("seq"), *(F.col(f"first.{c}").alias(c) for c in (*key, value))).union(
        ends.select(F.lit(1), "part", F.col("last._seq"), *(F.col(f"last.{k}").alias(k) for k in key), F.lit(None).cast(kind)))
    after = both.withColumn("_next", F.lead(value).over(Window.partitionBy(*key).orderBy("part", "last_of")))
    after = after.where("last_of = 1 AND _next IS NOT NULL").select("part", *key, "seq", "_next")
    return here.join(after, ["part", *key, "seq"], "left").withColumn(name, F.coalesce(name, "_next")).drop("_next")
