"""Check definitions and the step from wide verdict columns to long check rows."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import small_table


@dataclass(frozen=True)
class CheckDef:
    check_id: int
    category: str
    name: str
    weight: float
    severity: str
    scope: str = "page"


@dataclass(frozen=True)
class Verdict:
    """Outcome columns of one check; ``evidence`` maps a label to the value that was looked at."""

    passed: Column | bool = True
    skipped: Column | bool = False
    warning: Column | bool = False
    evidence: Mapping[str, Column] = field(default_factory=dict)


DEF_SCHEMA = (
    "audit string, check_id int, ordinal int, category string, category_ord int, name string, weight double, "
    "severity string, scope string"
)


def definitions(
    spark: SparkSession, audit: str, defs: Sequence[CheckDef], category_order: Iterable[str] = ()
) -> DataFrame:
    """The audit's definition table (at most a few hundred rows, fixed)."""
    order = list(dict.fromkeys([*category_order, *(d.category for d in defs)]))
    rows = [
        (audit, d.check_id, i, d.category, order.index(d.category), d.name, float(d.weight), d.severity, d.scope)
        for i, d in enumerate(defs)
    ]
    return small_table(spark, rows, DEF_SCHEMA)


def _bool(value: Column | bool) -> Column:
    return F.coalesce(F.lit(value) if isinstance(value, bool) else value, F.lit(False))


def _evidence(values: Mapping[str, Column]) -> Column:
    if not values:
        return F.create_map().cast("map<string,string>")
    parts = []
    for label, value in values.items():
        parts += [F.lit(label), F.coalesce(value.cast("string"), F.lit(""))]
    return F.create_map(*parts)


def check_rows(
    wide: DataFrame, keys: Sequence[str], audit: str, verdicts: Sequence[tuple[Sequence[int], Verdict]]
) -> DataFrame:
    """One row per key and check id.

    Each verdict is computed once and published under all its ids; the fan-out happens inside the
    row, so nothing is shuffled here. The outcomes are a column of their own before they are exploded: a projection
    computes an expression that several checks share once, a generator computes it anew at every mention. Checks of a
    page that could not be parsed (``parse_error``) are skipped with that reason.
    """
    broken = F.col("parse_error").isNotNull() if "parse_error" in wide.columns else None
    skipped = lambda v: _bool(v.skipped) if broken is None else broken | _bool(v.skipped)
    reason = lambda v: _evidence(v.evidence) if broken is None else F.when(
        broken, F.create_map(F.lit("parse_error"), F.col("parse_error"))).otherwise(_evidence(v.evidence))
    outcome = F.array(*[
        F.struct(
            F.array(*[F.lit(i) for i in ids]).alias("ids"),
            (skipped(v) | _bool(v.passed)).alias("passed"),
            skipped(v).alias("skipped"),
            (~skipped(v) & _bool(v.warning)).alias("warning"),
            reason(v).alias("evidence"),
        )
        for ids, v in verdicts
    ])
    return (
        wide.select(*keys, outcome.alias("_outcomes"))
        .select(*keys, F.explode_outer("_outcomes").alias("o"))
        .select(*keys, F.lit(audit).alias("audit"), F.explode("o.ids").alias("check_id"), "o.*")
        .drop("ids")
    )


def describe(rows: DataFrame, defs: DataFrame) -> DataFrame:
    """Check rows with their definitions (broadcast: the definition table has a fixed size)."""
    text = F.array_join(
        F.transform(F.map_entries("evidence"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", "
    )
    return rows.join(F.broadcast(defs), ["audit", "check_id"]).withColumn("evidence_text", text)
