"""The report store. A save replaces by id; one version of each report is kept.

Reports lie in folders by home day (the day of an id's first saved version, which never changes) and by a hash of the id.
A save rewrites only the folders in which its ids live; a get by id opens one hash folder of each day, and within its files
Parquet's own statistics and Bloom filter on the id decide what is read. Null ids count as one id, null times as oldest.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.trends import latest_per_id
from ..session import stage

SHARDS = 16
# fitted to the ids of each file, 64 KB at least; without the second setting every filter has a megabyte
BLOOM = {"parquet.bloom.filter.enabled#id": "true", "parquet.bloom.filter.adaptive.enabled": "true"}
NO_DAY = "1970-01-01"


def _shard(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SHARDS)).cast("int")


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The store with the columns of all its files, so that a rewritten folder loses none."""
    try:
        return spark.read.option("mergeSchema", "true").parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _homes(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Ids known to the store keep their day; only ids and folder names are read for it."""
    known = stored.select(F.col("id").alias("known_id"), F.col("home_day").alias("known_day"), F.col("home_shard").alias("known_shard"))
    same = F.col("id").eqNullSafe(F.col("known_id")) & (F.col("home_shard") == F.col("known_shard"))
    return batch.join(known, same, "left").withColumn("home_day", F.coalesce("known_day", "home_day")).drop(*known.columns)


def save_reports(reports: DataFrame, path: str, version: tuple[str, ...] = ("created_at",)) -> None:
    """Save by id. The greatest ``version`` stays, and of equal ones the one saved now; saving again changes nothing.

    Needs the columns ``id`` and ``created_at``. One writer at a time; the rows to write are staged first, so that a
    job that loses executors never reads folders that it is replacing.
    """
    spark = reports.sparkSession
    newest = lambda rows: latest_per_id(rows.withColumn("_version", F.struct(*version, "_saved")), "id", "_version").drop("_version")
    day = F.coalesce(F.to_date("created_at"), F.lit(NO_DAY).cast("date"))
    batch = newest(reports.withColumn("_saved", F.lit(1))).withColumn("home_day", day).withColumn("home_shard", _shard(F.col("id")))
    stored = _stored(spark, path)
    if stored is not None:
        batch = stage(_homes(batch, stored), "report_batch")
        # at most as many rows as there are days times SHARDS
        touched = batch.select("home_day", "home_shard").distinct()
        kept = stored.join(F.broadcast(touched), ["home_day", "home_shard"], "left_semi").withColumn("_saved", F.lit(0))
        batch = newest(kept.unionByName(batch, allowMissingColumns=True))
    rows = stage(batch.drop("_saved"), "reports")
    order = ("home_day", "home_shard", "id")
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").options(
        **BLOOM, partitionOverwriteMode="dynamic").partitionBy("home_day", "home_shard").parquet(path)


def read_reports(spark: SparkSession, path: str, report_id=None, since: str | None = None, merge_schema: bool = False) -> DataFrame:
    """All reports, one by id, or those created at or after ``since``; filters reach folders and scan.

    ``merge_schema`` shows columns that only some folders have, at the price of reading every file's footer.
    """
    rows = spark.read.option("mergeSchema", str(merge_schema).lower()).parquet(path)
    if since is not None:
        rows = rows.where(F.col("created_at") >= F.lit(since).cast("timestamp"))
    if report_id is not None:
        wanted = F.lit(report_id).cast(rows.schema["id"].dataType)
        rows = rows.where((F.col("home_shard") == _shard(wanted)) & (F.col("id") == wanted))
    return rows.drop("home_day", "home_shard")
