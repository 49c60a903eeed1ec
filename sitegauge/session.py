"""Session defaults and durable stage boundaries."""

from __future__ import annotations

import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def build_session(app: str = "sitegauge", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, as named by the cluster.

    Only where the cluster names none (unit tests in one JVM) a local folder is used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    local = os.path.join(tempfile.gettempdir(), "sitegauge-stages")
    spark.conf.set("sitegauge.local.stage.dir", local)
    return local


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a Parquet table and read it back.

    A written table survives the loss of executors and, unlike a row checkpoint, keeps column
    and nested-field pruning for every reader behind it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sitegauge/{uuid.uuid4().hex}/{name}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


BUCKET_ROWS = 1 << 20
LEAST_BUCKETS, MOST_BUCKETS = 8, 8192


def stage_by(df: DataFrame, name: str, key: str, buckets: int | None = None) -> DataFrame:
    """Write ``df`` once, bucketed and sorted by ``key``: joins and aggregates on the key read it without an exchange.

    The number of buckets, a power of two, follows from the rows; give that of another table to join the two in place.
    """
    spark = df.sparkSession
    plain = stage(df, name)
    if buckets is None:
        buckets = LEAST_BUCKETS
        rows = plain.count()
        while buckets < MOST_BUCKETS and rows > buckets * BUCKET_ROWS:
            buckets *= 2
    table = f"{name}_{uuid.uuid4().hex}"
    plain.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key).option(
        "path", f"{shared_dir(spark)}/sitegauge/{table}").saveAsTable(table)
    return spark.table(table)


def large(df: DataFrame) -> DataFrame:
    """Side of a join that grows with the input: never sent whole through the driver, however small it is estimated.

    Estimates come from the bytes of narrow columns; texts and addresses built from them are far larger.
    """
    return df.hint("merge")


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A fixed dimension table as a local relation.

    The rows travel inside the plan: no job, no partitions, and an exact size for the broadcast.
    """
    fields = T._parse_datatype_string(schema).fields
    table = pa.table(
        {f.name: pa.array([row[i] for row in rows], type=to_arrow_type(f.dataType)) for i, f in enumerate(fields)}
    )
    return spark.createDataFrame(table, schema=T.StructType(fields))


TASK_ROWS = 10_000


def spread(df: DataFrame) -> DataFrame:
    """Spread a scan whose rows lie in few splits, so that costly per-row work uses all cores and tasks stay short.

    Splits are cut by bytes, but a row group is read whole by one of them: a large file written as one group has many
    splits and rows in a single one. So the rows of each split are counted (from the file footers), not the splits.
    A capture whose largest split is no more than a core's share passes through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    rows = df.groupBy(F.spark_partition_id().alias("split")).count().agg(F.max("count"), F.sum("count")).first()
    largest, total = rows[0] or 0, rows[1] or 0
    if df.rdd.getNumPartitions() >= cores and largest * cores <= total:
        return df
    return df.repartition(max(cores, -(-total // TASK_ROWS)))
