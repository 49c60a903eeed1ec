"""Answers bucketed by address: lookups leave them where they are."""

import re

from pyspark.sql import functions as F
from sitegauge.operators import links as L
from sitegauge.session import stage_by


def exchanges(spark, df):
    plan = df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return re.findall(r"\(\d+\) (?:Exchange|BroadcastExchange)\nInput \[\d+\]: (.*)", plan)


def test_no_exchange_above_the_log(spark):
    address = F.concat(F.lit("https://a.example/"), F.col("id"))
    log = stage_by(spark.range(3000).select(address.alias("req_url"), (F.col("id") % 5).cast("int").alias("status")), "log", "req_url")
    wanted = spark.range(0, 6000, 7).select((F.col("id") % 3).alias("site_id"), F.lit("page").alias("role"), address.alias("req_url"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = L.answer(wanted, log)
        found = exchanges(spark, joined)
        assert len(found) == 1 and "status" not in found[0]
        rows = joined.collect()
        assert len(rows) == 858 and all((r.status is None) == (int(r.req_url[18:]) >= 3000) for r in rows)
        assert exchanges(spark, log.groupBy("req_url").agg(F.max("status"))) == []
        other = stage_by(wanted, "wanted", "req_url", 8)
        assert exchanges(spark, L.answer(other, log)) == []
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
