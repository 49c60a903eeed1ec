"""Site health on a stream of captures: partial sums per site that take back re-captured pages.

A micro-batch gives narrow facts of its pages. A page that was seen before, in any earlier batch, is taken back with the facts it was
counted with and counted again with its newest capture; an older capture that comes late changes nothing. What a batch writes are
its facts and signed sums per site and per title, each in the folder of its epoch: a replayed batch overwrites its own rows, and
the state of a site is a sum over a few rows. Facts lie in folders by a hash of the page, so a batch reads the folders it touches.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T_
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..operators import scoring as S
from ..plans.rules import Verdict, check_rows
from ..session import small_table, stage
from ..sources.captures import one_row

# Fixed values: (check id, weight, severity, scope) of the checks behind the site health score.
HEALTH_CHECKS = ((16, 8, "MAJOR", "page"), (17, 5, "MAJOR", "page"), (22, 6, "MAJOR", "domain"), (24, 7, "MAJOR", "page"), (25, 4, "MINOR", "page"),
                 (26, 5, "MAJOR", "page"), (96, 4, "MINOR", "page"))
PAGE_KEY = ("site_id", "page_id")
FACTS = "site_id string, page_id bigint, captured_at timestamp, title string, n_h1 int, h1_length int, hierarchy_ok boolean, n_links int"
FOLDERS = 64


def marks() -> dict[str, Column]:
    """What is counted per page."""
    c = F.col
    return {
        "n_pages": F.lit(True), "titled": c("title") != "", "title_length": T.utf16_length(c("title")).between(30, 60), "usable": c("n_h1") >= 1,
        "single": c("n_h1") == 1, "h1_length": (c("n_h1") == 1) & c("h1_length").between(10, 90), "hierarchy": c("hierarchy_ok"), "few_links": c("n_links") < 3,
    }


def scores(totals: DataFrame, repeated: DataFrame) -> DataFrame:
    """Score and grade per site from the counts of :func:`marks` and the number of pages with a ``repeated`` title."""
    c = F.col
    share = lambda name: c(name) / c("n_pages")
    sites = totals.join(repeated, "site_id", "left").withColumn("n_pages", c("n_pages").cast("int"))
    verdicts = {
        16: share("titled") >= 0.95, 17: share("title_length") >= 0.8, 22: F.coalesce("repeated", F.lit(0)) / c("n_pages") <= 0.1,
        24: (share("usable") >= 0.7) | (share("single") >= 0.6), 25: share("h1_length") >= 0.6, 26: share("hierarchy") >= 0.6, 96: c("few_links") == 0,
    }
    rows = check_rows(sites, ["site_id", "n_pages"], S.TECHNICAL, [([i], Verdict(v)) for i, v in verdicts.items()])
    defs = small_table(totals.sparkSession, [(i, float(w), s, sc) for i, w, s, sc in HEALTH_CHECKS], "check_id int, weight double, severity string, scope string")
    graded = S.technical_scores(rows.join(F.broadcast(defs), "check_id"))
    return graded.join(sites.select("site_id", "n_pages"), "site_id").select("site_id", "n_pages", "page_score", "domain_score", "score", "grade")


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a folder of epochs, empty before the first."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return small_table(spark, [], schema)


def update(facts: DataFrame, epoch: int, out: str) -> None:
    """Take the page facts of one batch into the state at ``out``."""
    spark = facts.sparkSession
    folder = F.pmod(F.xxhash64(*PAGE_KEY), F.lit(FOLDERS)).cast("int")
    fields = T_.StructType.fromDDL(FACTS).fieldNames()
    new = stage(one_row(facts.select(*fields), PAGE_KEY, F.col("captured_at")).withColumn("folder", folder), "batch_facts")
    touched = [r["folder"] for r in new.select("folder").distinct().collect()]  # at most FOLDERS
    before = _stored(spark, f"{out}/facts", f"{FACTS}, epoch bigint, folder int").where(F.col("epoch") < epoch).where(F.col("folder").isin(touched))
    old = one_row(before.drop("epoch", "folder").join(new.select(*PAGE_KEY), list(PAGE_KEY), "left_semi"), PAGE_KEY, F.col("captured_at"))
    rest = [n for n in fields if n not in PAGE_KEY]
    pairs = new.join(old.select(*PAGE_KEY, F.struct(*rest).alias("was")), list(PAGE_KEY), "left")
    now = F.struct(*rest)
    order = lambda s: F.struct(s["captured_at"], F.xxhash64(s["title"], s["n_h1"], s["h1_length"], s["hierarchy_ok"], s["n_links"]))
    changed = stage(pairs.where(F.col("was").isNull() | (order(now) > order(F.col("was")))), "changed_facts")
    changed.select(*fields, "folder").write.mode("overwrite").partitionBy("folder").parquet(f"{out}/facts/epoch={epoch}")
    signed = changed.select("site_id", *rest, F.lit(1).alias("sign")).union(changed.where("was IS NOT NULL").select("site_id", *(F.col("was")[n] for n in rest), F.lit(-1)))
    sums = signed.groupBy("site_id").agg(*(F.sum(F.when(mark, F.col("sign")).otherwise(0)).alias(name) for name, mark in marks().items()))
    sums.write.mode("overwrite").parquet(f"{out}/sites/epoch={epoch}")
    signed.groupBy("site_id", "title").agg(F.sum("sign").alias("n")).write.mode("overwrite").parquet(f"{out}/titles/epoch={epoch}")


def current(spark: SparkSession, out: str) -> DataFrame:
    """Health of every site from the sums so far."""
    names = list(marks())
    totals = _stored(spark, f"{out}/sites", "site_id string, " + ", ".join(f"{n} bigint" for n in names)).groupBy("site_id").agg(
        *(F.sum(n).alias(n) for n in names)).where("n_pages > 0")
    titles = _stored(spark, f"{out}/titles", "site_id string, title string, n bigint").groupBy("site_id", "title").agg(F.sum("n").alias("n"))
    return scores(totals, titles.where("n > 1 AND title != ''").groupBy("site_id").agg(F.sum("n").alias("repeated")))


def run(captures: DataFrame, facts_of, out: str, checkpoint: str) -> StreamingQuery:
    """Keep the state at ``out`` up to date with a stream of captures; ``facts_of`` turns captures into :data:`FACTS`."""
    return captures.writeStream.foreachBatch(lambda batch, epoch: update(facts_of(batch), epoch, out)).option("checkpointLocation", checkpoint).start()
