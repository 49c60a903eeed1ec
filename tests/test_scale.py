"""Steps whose cost must follow the input: spreading, joins, slices and shared expressions."""

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from sitegauge.functions import patterns as P
from sitegauge.operators import structured
from sitegauge.plans.rules import Verdict, check_rows
from sitegauge.queries.checks import checks_eeat, checks_indexability, checks_trust
from sitegauge.session import TASK_ROWS, spread


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_row_group_in_many_splits_is_spread(spark, tmp_path):
    n = 5 * TASK_ROWS
    pq.write_table(pa.table({"k": range(n), "text": [f"text {i * 7919}" for i in range(n)]}), tmp_path / "one.parquet", row_group_size=n)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = spark.read.parquet(str(tmp_path / "one.parquet"))
        assert rows.rdd.getNumPartitions() >= 4  # splits enough, rows in one of them
        held = [r["count"] for r in spread(rows).groupBy(F.spark_partition_id()).count().collect()]
        assert sum(held) == n and max(held) <= TASK_ROWS + 10
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    even = spark.range(0, n, 1, 8)
    assert spread(even) is even


def test_growing_sides_are_not_broadcast(spark, tmp_path):
    spark.range(40).select(F.col("id").alias("p_partkey")).write.parquet(str(tmp_path / "part.parquet"))
    for query in (checks_eeat, checks_indexability, checks_trust):
        assert "BroadcastHashJoin" not in plan(query(spark, str(tmp_path))), query.__name__


def test_outcomes_are_computed_before_they_are_exploded(spark):
    wide = spark.range(4).select(F.col("id").alias("page_id"), F.concat(F.lit("a "), F.col("id")).alias("text"))
    slow = F.regexp_count("text", F.lit("[a-z]+"))
    rows = check_rows(wide, ["page_id"], "x", [([1, 2], Verdict(slow > 0, warning=slow > 1)), ([3], Verdict(slow > 5, skipped=slow > 6))])
    generate = [line for line in plan(rows).splitlines() if "Generate" in line]
    assert len(generate) == 2 and not any("regexp" in line for line in generate)
    assert "Filter" not in plan(rows)
    assert [(r.check_id, r.passed) for r in rows.orderBy("page_id", "check_id").limit(3).collect()] == [(1, True), (2, True), (3, False)]


def test_node_tables_are_made_in_slices(spark):
    batch = pa.RecordBatch.from_pydict({"jsonld": [["x" * 1000]] * 1000 + [None]})
    parts = list(structured.slices(batch, [1000] * 1000 + [0]))
    assert len(parts) >= 4 and sum(p.num_rows for p in parts) == 1001
    assert max(p.num_rows for p in parts) * 1000 <= structured.SLICE_BYTES + 1000
    rows = spark.range(0, 3000, 1, 1).select("id", F.array(F.concat(F.lit('{"@type":"Product","sku":"'), F.col("id"), F.lit('"}'))).alias("jsonld"))
    got = structured.with_nodes(rows).select("id", F.col("ld.nodes")[0]["types"][0].alias("t"), F.size("ld.nodes").alias("n")).collect()
    assert len(got) == 3000 and all(r.t == "Product" and r.n == got[0].n for r in got)


def test_blank_class_holds_the_same_code_points(spark):
    codes = [c for c in range(1, 0x10000) if not 0xD800 <= c <= 0xDFFF]
    rows = spark.createDataFrame([(c, chr(c)) for c in codes], "c int, s string")
    got = rows.select("c", F.col("s").rlike(P.BLANK).alias("blank"), F.col("s").rlike(P.NON_BLANK_RUN).alias("other"),
                      F.col("s").rlike(P.rx(r"[\d\s().-]")).alias("mixed"), F.col("s").rlike(f"[{P.OTHER_BLANKS}]").alias("most")).collect()
    for r in got:
        known = chr(r.c) in structured.BLANKS
        # a code point between the far blanks and digits of other scripts are none of them
        assert (r.blank, r.other, r.most) == (known, not known, known and r.c != 32), r.c
        assert r.mixed == (known or chr(r.c) in "0123456789().-"), r.c
