"""Registered queries; every one reads the given tables."""

from . import audits, checks, readers, records, scores, sites, texts

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _module in (scores, texts, sites, records, audits, checks, readers):
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)

__all__ = ["ORACLES", "QUERIES"]
