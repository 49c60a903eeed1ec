"""Rounding, clamping and rate rules shared by all scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(value: Column) -> Column:
    """Round half towards plus infinity (``round`` would send -2.5 to -3)."""
    return F.floor(value + F.lit(0.5)).cast("int")


def clamp_score(value: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), half_up(value)))


def rate(part: Column, whole: Column, empty: float = 0.0) -> Column:
    """``part / whole`` with an explicit value for the empty set."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(float(empty)))


def percent(part: Column, whole: Column, empty: float = 0.0) -> Column:
    return half_up(rate(part, whole, empty) * 100)


def fixed2(value: Column) -> Column:
    return F.round(value, 2)
