"""Page features of a stream equal those of a batch."""

from pyspark.sql import functions as F

from sitegauge.streaming.pages import refresh_site_counts, stream_features

SF = "/root/testdata/sf0.001"


def test_batch_equals_stream(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    source = str(tmp_path / "in")
    pages.repartition(3).write.parquet(source)
    facts = lambda df: stream_features(df).select("page_id", "title", F.size("anchors").alias("links"), "dom_nodes")
    query = (facts(spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1).parquet(source)).writeStream
             .format("memory").queryName("features").outputMode("append").start())
    query.processAllAvailable()
    query.stop()
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(spark.table("features")) == key(facts(pages))


def test_site_counts_refresh_per_batch(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    pages.repartition(2).write.parquet(source)
    query = refresh_site_counts(spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1).parquet(source), out, str(tmp_path / "ckpt"))
    query.processAllAvailable()
    query.stop()
    total = spark.read.parquet(out).agg(F.sum("n_pages")).collect()[0][0]
    assert total == pages.count()


def test_site_health_from_shuffled_and_repeated_batches(spark, tmp_path):
    from sitegauge.queries.sites import QUERIES, _health_facts
    from sitegauge.streaming import health

    facts = _health_facts(spark, SF).withColumn("captured_at", F.timestamp_seconds(F.col("page_id") * 0 + 1000))
    old = facts.withColumns({"captured_at": F.timestamp_seconds(F.lit(10)), "title": F.lit("old"), "n_links": F.lit(0)})
    for at, part in enumerate((facts.sample(0.4, 1), old.sample(0.8, 2), facts.sample(0.5, 3), old, facts)):
        part.orderBy(F.rand(at)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(health.FACTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = health.run(stream, lambda batch: batch, f"{tmp_path}/state", f"{tmp_path}/ckpt")
    query.processAllAvailable()
    query.stop()
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(health.current(spark, f"{tmp_path}/state")) == key(QUERIES["site_health"](spark, SF))
    health.update(old, 99, f"{tmp_path}/state")  # late: nothing newer
    assert key(health.current(spark, f"{tmp_path}/state")) == key(QUERIES["site_health"](spark, SF))
    moved = facts.where("page_id < 40").withColumns({"captured_at": F.timestamp_seconds(F.lit(2000)), "title": F.lit(None).cast("string")})
    health.update(moved, 100, f"{tmp_path}/state")
    assert key(health.current(spark, f"{tmp_path}/state")) != key(QUERIES["site_health"](spark, SF))
    health.update(facts.where("page_id < 40").withColumn("captured_at", F.timestamp_seconds(F.lit(3000))), 101, f"{tmp_path}/state")
    assert key(health.current(spark, f"{tmp_path}/state")) == key(QUERIES["site_health"](spark, SF))
