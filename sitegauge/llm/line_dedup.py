"""Line dedup over whole texts with per-document keep bitmaps.

A line's key is the line without blanks at both ends and with A-Z lower-cased. A key of at least ``min_length`` code points that
occurs in two or more documents is kept in the document with the smallest id only. Lines become (128-bit hash, document,
position) rows, dealt by ranges of the hash and sorted within by document and position; the first document of each
hash streams past first and all later rows are drops. What comes back per document is a compressed bitmap: the lengths of
alternate runs of kept and dropped lines, so a document without drops is one number. Texts are not in that exchange.

Scale: hash ranges are cut from the (even) hash values themselves, so no sampling pass is needed. A key that holds a large part
of all rows is found on a sample of texts, its first document is computed by an aggregate with partial sums, and its rows are
then decided where they lie; only the list of such keys is broadcast, which the share that makes a key hot bounds to
``1 / HOT_SHARE`` entries. Missing one in the sample costs time, never rows.

Defined cases: null or empty text is one empty line; rows with a null id count as one document that ranks last; rows with
equal ids are one document; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_LENGTH = 10
HOT_SHARE = 0.001
SAMPLE_SHARE = 0.02
SAMPLE_FLOOR = 20
RANGE_BITS = 14
LAST = (1 << 63) - 1


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(BLANKS)), UPPER, LOWER)


def document_rank(doc_id: Column) -> Column:
    """Null ids rank after all others."""
    return F.coalesce(doc_id, F.lit(LAST))


def text_mark(text: Column) -> Column:
    """Tells rows with one id but different texts apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def keyed_lines(docs: DataFrame, min_length: int) -> DataFrame:
    """Rows (hash_a, hash_b, rank, mark, position) of all lines whose key is long enough."""
    rows = docs.select(
        document_rank(F.col("doc_id")).alias("rank"), text_mark(F.col("text")).alias("mark"),
        F.posexplode(lines_of(F.col("text"))).alias("position", "line"),
    ).withColumn("key", line_key(F.col("line"))).where(F.length("key") >= min_length)
    return rows.select(F.xxhash64("key").alias("hash_a"), F.xxhash64(F.lit("b"), "key").alias("hash_b"), "rank", "mark", "position")


def hot_keys(docs: DataFrame, min_length: int) -> DataFrame | None:
    """Keys that hold much of all rows, with their first document; None when the sample shows none."""
    sample = keyed_lines(docs.sample(False, SAMPLE_SHARE, 11), min_length)
    total = sample.count()
    least = max(SAMPLE_FLOOR, int(total * HOT_SHARE))
    found = [r["hash_a"] for r in sample.groupBy("hash_a").count().where(F.col("count") >= least).collect()]  # at most 1 / HOT_SHARE
    if not found:
        return None
    rows = keyed_lines(docs, min_length).where(F.col("hash_a").isin(found))
    return rows.groupBy("hash_a", "hash_b").agg(F.min("rank").alias("first"))


def dropped_lines(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """(rank, mark, position) of every line to drop."""
    lines = keyed_lines(docs, min_length)
    hot = hot_keys(docs, min_length)
    if hot is None:
        lines = lines.withColumn("first", F.lit(None).cast("bigint"))
    else:
        lines = lines.join(F.broadcast(hot), ["hash_a", "hash_b"], "left")
    decided = F.col("first").isNotNull()
    # rows of hot keys are spread by document; ranges of the hash hold all others
    place = F.when(decided, F.pmod(F.xxhash64("rank", "mark"), F.lit(1 << RANGE_BITS))).otherwise(F.shiftrightunsigned("hash_a", 64 - RANGE_BITS))
    lines = lines.where(~decided | (F.col("rank") > F.col("first"))).withColumn("hash_range", place)
    streamed = Window.partitionBy("hash_range", "hash_a", "hash_b").orderBy("rank", "position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.repartition("hash_range").withColumn("first", F.coalesce("first", F.first("rank").over(streamed)))
    return lines.where(F.col("rank") > F.col("first")).select("rank", "mark", "position")


def runs_of(positions: Column, n_lines: Column) -> Column:
    """Run lengths kept, dropped, kept, ... of ``n_lines`` lines, from the sorted dropped positions."""
    size = F.size(positions)
    starts = F.filter(positions, lambda p, i: (i == 0) | (F.get(positions, i - 1) != p - 1))
    ends = F.transform(F.filter(positions, lambda p, i: (i == size - 1) | (F.get(positions, i + 1) != p + 1)), lambda p: p + 1)
    edges = F.flatten(F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda z: F.array(z["s"], z["e"])))
    bounds = F.concat(F.array(F.lit(0)), edges, F.array(n_lines))
    lengths = F.transform(F.slice(bounds, 2, F.size(bounds) - 1), lambda b, i: b - F.get(bounds, i))
    return F.when((F.size(lengths) > 1) & (F.element_at(lengths, -1) == 0), F.slice(lengths, 1, F.size(lengths) - 1)).otherwise(lengths)


def line_drops(docs: DataFrame, min_length: int = MIN_LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document with drops: rank, mark and the sorted positions of its dropped lines (at most its own lines)."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return dropped_lines(rows, min_length).groupBy("rank", "mark").agg(F.array_sort(F.collect_set("position")).alias("positions"))


def keep_bitmaps(docs: DataFrame, min_length: int = MIN_LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, mark, ``n_lines``, ``n_dropped`` and ``keep_runs``, the compressed keep bitmap."""
    drops = line_drops(docs, min_length, doc_id, text)
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), document_rank(F.col(doc_id).cast("bigint")).alias("rank"), text_mark(F.col(text)).alias("mark"),
        F.size(lines_of(F.col(text))).alias("n_lines"),
    )
    positions = F.coalesce("positions", F.array().cast("array<int>"))
    return rows.join(drops, ["rank", "mark"], "left").select(
        "doc_id", "mark", F.col("n_lines").cast("bigint").alias("n_lines"), F.size(positions).cast("bigint").alias("n_dropped"),
        runs_of(positions, F.col("n_lines")).alias("keep_runs"),
    )


def kept_text(text: Column, keep_runs: Column) -> Column:
    """Apply a keep bitmap: runs at even places (from 0) are kept."""
    lines = lines_of(text)
    state = F.aggregate(
        keep_runs, F.struct(F.lit(1).alias("at"), F.lit(True).alias("on"), F.array().cast("array<string>").alias("kept")),
        lambda s, n: F.struct(
            (s["at"] + n).alias("at"), (~s["on"]).alias("on"),
            F.when(s["on"] & (n > 0), F.concat(s["kept"], F.slice(lines, s["at"], n))).otherwise(s["kept"]).alias("kept"),
        ),
    )
    return F.array_join(state["kept"], "\n")


def deduplicated(docs: DataFrame, min_length: int = MIN_LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_lines, n_dropped, keep_runs and the text of the kept lines."""
    drops = line_drops(docs, min_length, doc_id, text)
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), document_rank(F.col(doc_id).cast("bigint")).alias("rank"),
        text_mark(F.col(text)).alias("mark"),
    ).join(drops, ["rank", "mark"], "left")
    rows = rows.withColumn("n", F.size(lines_of(F.col("text"))))
    positions = F.coalesce("positions", F.array().cast("array<int>"))
    rows = rows.withColumn("keep_runs", runs_of(positions, F.col("n")))
    text_out = F.when(F.col("positions").isNull(), F.coalesce("text", F.lit(""))).otherwise(kept_text(F.col("text"), F.col("keep_runs")))
    return rows.select(
        "doc_id", F.col("n").cast("bigint").alias("n_lines"), F.size(positions).cast("bigint").alias("n_dropped"), "keep_runs",
        text_out.alias("text"),
    )
