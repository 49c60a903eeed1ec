"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage

__all__ = ["arrow_rows", "bounded_batches", "key_text", "read", "stage", "text_slices", "with_column"]

SLICE_BYTES = 2 << 20
BATCH_ROWS = 1000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches hold ``BATCH_ROWS`` rows at most: batches of texts are held on both sides of a Python worker."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into zero-copy slices of about ``limit`` bytes of ``column``; one long text is a slice of its own."""
    sizes = pc.binary_length(batch.column(batch.schema.get_field_index(column))).to_pylist()
    start = held = 0
    for i, size in enumerate(sizes):
        if held and held + (size or 0) > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size or 0
    if start < len(sizes):
        yield batch.slice(start)
    pa.default_memory_pool().release_unused()  # workers are kept for later stages


def arrow_rows(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def with_column(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Append ``name`` last; a column of that name in the input gives way."""
    return df.drop(name).withColumn(name, value)


def key_text(column: Column) -> Column:
    """A string that tells null from every value."""
    return F.when(column.isNull(), "n").otherwise(F.concat(F.lit("s"), column.cast("string")))
