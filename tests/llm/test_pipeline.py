"""The corpus pipeline: stages, columns, SQL."""

import os

import corpus_pipeline
import pytest
from sitegauge.llm.common import read

from oracle import compare, connect

SF = "/root/testdata/sf0.001"


def test_matches_sql(spark):
    if not os.path.isdir(SF):
        pytest.skip("test data absent")
    assert compare(spark, connect(SF), corpus_pipeline.run, corpus_pipeline.ORACLE_SQL, SF) is None


def test_stages_keep_the_columns_of_documents(spark):
    docs = read(spark, SF, "documents")
    for name, work in corpus_pipeline.STAGES[:-1]:
        assert work(spark, docs.limit(20), SF).columns == docs.columns, name
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "mixing", "sharding"]


def test_odd_documents(spark):
    """Null cells, empty and repeated rows, an empty table and a column of a result's name pass every stage."""
    prose = "The first of these was a text in which the words of it are as they should be, and that is for the best. " * 4
    rows = [(1, prose, "en", "s", 5), (1, prose, "en", "s", 5), (None, None, None, None, None), (2, "", "en", None, 0), (3, "x " * 50, "xx", "t", 1), (4, prose + "Not more.", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").selectExpr("*", "'mine' as shard", "1 as kept")
    for rows in (docs, docs.limit(0)):
        for name, work in corpus_pipeline.STAGES:
            rows = work(spark, rows, SF)
            found = rows.collect()
            assert "shard" in rows.columns and len(found) <= 12, name
    assert not found
