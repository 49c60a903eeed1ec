"""Report sinks (A6, A7); the store is in :mod:`report_store`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(reports: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A6."""
    reports.write.mode(mode).json(path)


def write_csv(rows: DataFrame, path: str, mode: str = "errorifexists", key: str = "site_id") -> None:
    """All cells quoted; lines of one site stay together and in order."""
    ordered = rows.repartition(F.col(key)).sortWithinPartitions(key, "block", "ord")
    ordered.select(key, "c1", "c2", "c3", "c4", "c5").write.mode(mode).option("quoteAll", "true").option(
        "emptyValue", ""
    ).csv(path)
