"""Shared inputs of the audits: parsed pages and small per-address facts.

Everything that reads HTML or other bodies is computed next to the scan and kept as narrow columns,
so the joins on addresses move facts, not documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from ..functions import dom as D
from ..functions import headers as H
from ..functions import patterns as P
from ..functions import robots as R
from ..functions import text as T
from ..functions import urls as U
from ..operators.links import assign_order, page_facts
from ..operators.parse import parse_pages
from ..operators.sitemaps import feed_average_words
from ..session import stage, stage_by
from ..sources import captures as C


@dataclass
class Facts:
    """Frames the audits share."""

    sites: DataFrame
    pages: DataFrame
    parsed_log: DataFrame
    answers: DataFrame
    manual: DataFrame
    index: DataFrame
    log: DataFrame
    certs: DataFrame
    vitals: DataFrame
    rendered: DataFrame | None
    staged: bool = False

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """A narrow intermediate table, written once where stages are asked for; the plans behind it stay small."""
        return stage(df, name) if self.staged else df

    @property
    def home(self) -> DataFrame:
        return self.pages.where(F.col("is_primary"))


def complete_columns(df: DataFrame, schema: str, spark: SparkSession) -> DataFrame:
    """Input with every column of the schema; absent ones are NULL."""
    wanted = T_.StructType.fromDDL(schema)
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted
    ])


def complete_pages(pages: DataFrame) -> DataFrame:
    """Captured pages with all columns the audits read."""
    defaults = {
        "final_url": F.col("url"),
        "status": F.lit(200),
        # a capture without headers holds pages only
        "headers": F.create_map(F.lit("content-type"), F.lit("text/html")),
        "response_ms": F.lit(None).cast("int"),
        "redirect_hops": F.lit(0),
        "depth": F.lit(None).cast("int"),
        "source": F.lit(None).cast("string"),
    }
    for name, value in defaults.items():
        if name not in pages.columns:
            pages = pages.withColumn(name, value)
        elif name in ("final_url", "headers", "status"):
            pages = pages.withColumn(name, F.coalesce(F.col(name), value))
    return assign_order(pages)


def script_flags(text: Column) -> dict[str, Column]:
    """H15 over one script text."""
    return {
        "history_trap": D.matches_any(text, D.HISTORY_TRAPS),
        "exit_trap": D.matches_any(text, D.EXIT_TRAPS),
        "yields": P.test(text, D.YIELDING),
        "injects": P.test(text, D.INJECTS_ABOVE),
    }


def answer_facts(log: DataFrame) -> DataFrame:
    """Narrow facts of default answers. Text readers run only on the files they are meant for."""
    body, headers = F.col("body"), F.col("headers")
    path = U.path(F.col("req_url"))
    only = lambda condition, value: F.when(condition, value)
    robots, llms = path == "/robots.txt", path == "/llms.txt"
    feed = path.isin("/feed", "/rss", "/atom.xml")
    script = U.asset_kind(F.col("req_url")) == "js"
    lower = F.lower(T.text_or_empty(body))
    topics = sum((F.contains(lower, F.lit(t)).cast("int") for t in ("about", "service", "contact", "policy")), F.lit(0))
    return log.select(
        "req_url", "status", "headers", F.coalesce("fetched_at", F.timestamp_seconds(F.lit(0))).alias("fetched_at"),
        H.header(headers, "content-type").alias("content_type"),
        H.header(headers, "location").alias("location"),
        F.coalesce("final_url", "req_url").alias("landed"),
        F.xxhash64("body").alias("body_hash"),
        F.length(T.text_or_empty(body)).alias("body_chars"),
        H.has_markup(body).alias("markup"),
        H.passes_firewall(F.col("status"), body).alias("passes_firewall"),
        only(robots, body).alias("robots_text"),
        only(llms, T.word_count(body)).alias("llms_words"),
        only(llms, T.llms_sections(body)).alias("llms_sections"),
        only(llms, P.test(body, r"^#|\n[-*]\s|\[[^\]]+\]\([^)]+\)", "m")).alias("llms_markdown"),
        only(llms, topics).alias("llms_topics"),
        only(feed, feed_average_words(body)).alias("feed_words"),
        only(P.test(body, "<(?:[\\w.-]+:)?(urlset|sitemapindex)"), R.lastmod_complete(body)).alias("lastmod_ok"),
        *[only(script, flag).alias(name) for name, flag in script_flags(body).items()],
    )


def build(spark: SparkSession, inputs: dict[str, DataFrame], staged: bool) -> Facts:
    """Parse once, derive facts once. With ``staged`` both are written and read back."""
    keep = (lambda df, name: stage(df, name)) if staged else (lambda df, name: df)
    # answers are looked up by many roles: bucketed by address they stay where they are
    keep_by = (lambda df, name: stage_by(df, name, "req_url")) if staged else (lambda df, name: df)
    log = complete_columns(inputs.get("fetch_log", C.empty(spark, C.FETCH_LOG)), C.FETCH_LOG, spark)
    pages = C.page_rows(complete_pages(inputs["pages"]))
    parsed = keep(parse_pages(pages, base="final_url"), "page_features")
    html_rows = log.where(
        (H.is_html_response(F.col("headers"), F.col("body")) | F.col("user_agent").isNotNull())
        & (F.coalesce("method", F.lit("GET")) == "GET")
    ).select(
        "site_id", F.col("req_url").alias("url"), F.coalesce("final_url", "req_url").alias("final_url"), "user_agent",
        F.coalesce("redirect_mode", F.lit("follow")).alias("redirect_mode"), "status", "headers",
        F.col("body").alias("html"), "fetched_at",
    )
    parsed_log = keep(parse_pages(html_rows, base="final_url"), "answer_features")
    follow = F.coalesce("redirect_mode", F.lit("follow")) == "follow"
    plain_agent = F.col("user_agent").isNull()
    answers = C.one_per_url(answer_facts(log.where(follow & plain_agent)))
    manual = C.one_per_url(answer_facts(log.where(~follow & plain_agent)))
    default_parsed = parsed_log.where(plain_agent & (F.col("redirect_mode") == "follow"))
    index = page_facts(
        default_parsed.select("url", "status", "headers", "metas", "link_tags", "body_text").unionByName(
            parsed.select("url", "status", "headers", "metas", "link_tags", "body_text")
        )
    )
    return Facts(
        sites=inputs["sites"], pages=parsed, parsed_log=parsed_log, answers=keep_by(answers, "answers"),
        manual=keep_by(manual.select("req_url", "status", "location"), "manual_answers"), index=keep_by(index, "index"), log=log,
        certs=inputs.get("tls_certs", C.empty(spark, C.TLS_CERTS)),
        vitals=complete_columns(inputs.get("lab_vitals", C.empty(spark, C.LAB_VITALS)), C.LAB_VITALS, spark),
        rendered=inputs.get("rendered_pages"), staged=staged,
    )
