"""Exact k-th value per group without sorting or gathering a group (AG5: upper median).

Every round counts the values of each group in ``CELLS`` equal cells between its bounds, keeps the cell that holds the wanted rank
and takes that cell's smallest and largest value as the next bounds. Counting is an aggregate with partial sums, so a group of any
size sends at most ``CELLS`` rows from each task; a cell of one value ends the search. Cells are equal in value and in order of size
by turns, so that a few rounds do for any spread.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

CELLS = 4096


def _by_size(v: Column) -> Column:
    """Rises with ``v``; the smallest number above 0 gives about 1."""
    return F.when(v == 0, 0.0).otherwise(F.signum(v) * (F.ln(F.abs(v)) + 746))


def kth_value(rows: DataFrame, keys: Sequence[str], value: str, rank: Callable[[Column], Column], name: str = "value") -> DataFrame:
    """``keys``, ``n`` and the value at ``rank`` (from 0, given the count ``n``) of the group's sorted values, as double.

    Null and NaN values do not count; a group without values, or with a rank outside it, has no row. Null keys are one group.
    """
    c = F.col
    number = c(value).cast("double")
    left = stage(rows.where(number.isNotNull() & ~F.isnan(number)).select(*keys, number.alias("_v")), "selection")
    bounds = left.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    bounds = bounds.withColumn("_k", rank(c("n")).cast("bigint")).where((c("_k") >= 0) & (c("_k") < c("n")))
    found, even = None, True
    while True:
        bounds = stage(bounds, "selection_bounds")
        done = bounds.where("_lo = _hi").select(*keys, "n", c("_lo").alias(name))
        found = done if found is None else found.union(done)
        open_ = bounds.where("_lo < _hi")
        if open_.isEmpty():
            return found
        same = [left[k].eqNullSafe(open_[k]) for k in keys]
        inside = left.join(open_, [*same, left["_v"].between(open_["_lo"], open_["_hi"])]).select(*(open_[k] for k in keys), "n", "_k", "_v", "_lo", "_hi")
        v, lo, hi = (c(x) if even else _by_size(c(x)) for x in ("_v", "_lo", "_hi"))
        even = not even
        width = hi - lo  # beyond the largest number: halves
        share = F.when(width == 0, 0.0).when(width < F.lit(float("inf")), (v - lo) / width).otherwise((v / 2 - lo / 2) / (hi / 2 - lo / 2))
        cell = F.when(c("_v") == c("_hi"), CELLS - 1).otherwise(F.least(F.floor(share * CELLS), F.lit(CELLS - 2)))
        cells = inside.groupBy(*keys, "n", "_k", cell.alias("_cell")).agg(F.count("*").alias("_in"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        upto = F.sum("_in").over(Window.partitionBy(*keys).orderBy("_cell"))  # at most CELLS rows a group
        bounds = cells.withColumn("_upto", upto).where((c("_k") < c("_upto")) & (c("_k") >= c("_upto") - c("_in"))).select(
            *keys, "n", "_lo", "_hi", (c("_k") - (c("_upto") - c("_in"))).alias("_k"))


def upper_median(rows: DataFrame, keys: Sequence[str], value: str, name: str = "median") -> DataFrame:
    """The middle value of each group, the upper one of two."""
    return kth_value(rows, keys, value, lambda n: F.floor(n / 2), name).drop("n")
