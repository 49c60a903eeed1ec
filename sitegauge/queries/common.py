"""Shared table readers and derived relations of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import scoring as S
from ..operators.parse import parse_pages
from ..session import spread


# tables whose rows are costly to read: texts, pages and the parts that records are derived from
TEXT_TABLES = ("documents", "conversations", "pages", "part")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in TEXT_TABLES else rows


def check_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Check rows derived from ``lineitem``; :data:`CHECKS_SQL` is the same relation."""
    li = table(spark, sf_dir, "lineitem")
    pick = lambda column, names: F.element_at(F.array(*[F.lit(n) for n in names]), (column + 1).cast("int"))
    skipped = F.col("l_tax") == 0
    passed = skipped | (F.col("l_discount") < 0.06)
    audit = pick(F.col("l_orderkey") % 8, S.AUDITS)
    hard = pick(F.col("l_partkey") % 4, ("BLOCKER", "MAJOR", "MINOR", "ADVISORY"))
    soft = pick(F.col("l_partkey") % 4, ("Critical", "High", "Medium", "Low"))
    return li.select(
        F.col("l_suppkey").alias("site_id"), audit.alias("audit"),
        F.concat("l_returnflag", "l_linestatus").alias("category"), F.col("l_linenumber").cast("int").alias("check_id"),
        F.col("l_quantity").alias("weight"), passed.alias("passed"), skipped.alias("skipped"),
        (~passed & (F.col("l_tax") > 0.06)).alias("warning"),
        F.when(audit.isin(S.TECHNICAL, S.ANSWER), hard).otherwise(soft).alias("severity"),
        F.when(F.col("l_partkey") % 2 == 0, "page").otherwise("domain").alias("scope"),
        F.col("l_partkey").alias("part"), F.col("l_orderkey").alias("line_order"),
    )


_AUDIT_SQL = "list_extract([" + ", ".join(f"'{a}'" for a in S.AUDITS) + "], CAST(l_orderkey % 8 + 1 AS INT))"
CHECKS_SQL = f"""
raw AS (
  SELECT *, {_AUDIT_SQL} AS audit, (l_tax = 0 OR l_discount < 0.06) AS ok FROM lineitem
), checks AS (
  SELECT l_suppkey AS site_id, audit, l_returnflag || l_linestatus AS category, CAST(l_linenumber AS INT) AS check_id,
    l_quantity AS weight, ok AS passed, l_tax = 0 AS skipped, (NOT ok AND l_tax > 0.06) AS warning,
    CASE WHEN audit IN ('technical', 'answer_engine')
      THEN list_extract(['BLOCKER','MAJOR','MINOR','ADVISORY'], CAST(l_partkey % 4 + 1 AS INT))
      ELSE list_extract(['Critical','High','Medium','Low'], CAST(l_partkey % 4 + 1 AS INT)) END AS severity,
    CASE WHEN l_partkey % 2 = 0 THEN 'page' ELSE 'domain' END AS scope, l_partkey AS part, l_orderkey AS line_order
  FROM raw
)"""
CLAMP = "CAST(greatest(0, least(100, floor({} + 0.5))) AS INT)"


def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured pages with their host as site and the lowest page id as home page."""
    pages = table(spark, sf_dir, "pages")
    return pages.select(U.host(F.col("url")).alias("site_id"), F.col("page_id").cast("bigint").alias("page_id"), "url", "html")


def parsed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..plans.facts import complete_pages

    pages = complete_pages(site_pages(spark, sf_dir)).withColumn("response_ms", F.lit(200))
    return parse_pages(pages, base="final_url")


HOST_SQL = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
