"""Substring dedup: words covered by a window of ``window`` words that also starts earlier go.

Documents are ranked by id (null last) and by a hash of the text; a window is earlier in a document of lower rank, or further
ahead in the same one. Rows with equal id and text are one document: none is a copy of the other, all get the same result.

Method: documents are packed into chunks of about ``CHUNK_BYTES``, a table bucketed by chunk, so that texts are shuffled once.
Every chunk settles its own repeats by itself. Pass one: it writes a count-min sketch of its distinct windows, ``DEPTH`` rows of
cells, as sorted differences in blocks of cells; blocks are merged over all chunks, and the cells that two or more chunks hit go
back as one bit per cell. An estimate is never below the count, so no repeated window is lost. Pass two: windows that all rows
estimate repeated, one per chunk and value, are grouped exactly by 96 bits of hash, and one bit each goes back: does a document
of lower rank hold it.

Scale: the width of the sketch grows with the bytes of the input, so the share of false estimates does not; it is spread over
block groups and never broadcast. What is moved is about three bytes per window, twelve per repeated one, and bits back. A window
that all documents share has one row per chunk, since chunks settle repeats first. Chunks, blocks and parts are dealt by hashes
and sized by the input, so each fits a task.

Defined cases: null or empty text has no words; null ids rank last; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import itertools
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir
from . import words as W
from .common import stage
from .line_dedup import document_rank, text_mark

WINDOW = 20
DEPTH = 2
CHUNK_BYTES = 8 << 20
PACK_BYTES = 32 << 20
LEAST_CHUNKS = 8
MOST_BUCKETS = 16384
BLOCK_BITS = 24
PART_WINDOWS = 1 << 21
PACKED = pa.schema([("doc_id", pa.int64()), ("rank", pa.int64()), ("mark", pa.int64()), ("copies", pa.int64()), ("text", pa.large_string())])
U64 = W.U64


def shape(docs: DataFrame) -> dict:
    """Number of chunks, bits of a sketch row, of a block of it and of a part: functions of the bytes of all texts alone."""
    n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("bigint")), F.lit(0))).first()[0]
    bits = max(10, n_bytes.bit_length())
    return {
        "chunks": max(LEAST_CHUNKS, math.ceil(n_bytes / CHUNK_BYTES)),
        "bits": bits, "block_bits": min(bits, BLOCK_BITS),
        "part_bits": max(1, (n_bytes // 6 // PART_WINDOWS).bit_length()),
    }


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, blob): the documents of one chunk among some input, compressed together; equal documents are counted."""

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        same = table.select(["chunk", "rank", "mark"]).append_column("row", pa.array(np.arange(len(table)))).group_by(["chunk", "rank", "mark"]).aggregate([("row", "min"), ("row", "count")])
        same = same.sort_by([("chunk", "ascending"), ("row_min", "ascending")])
        rows = table.take(same["row_min"]).append_column("copies", same["row_count"])
        chunks = rows["chunk"].to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(chunks)) + 1).tolist(), len(chunks)]
        blobs = []
        for a, b in itertools.pairwise(cuts):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, PACKED, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(rows.slice(a, b - a).select(PACKED.names).cast(PACKED).combine_chunks())
            blobs.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(chunks[cuts[:-1]], pa.int32()), pa.array(blobs, pa.binary())], ["chunk", "blob"])

    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if size >= PACK_BYTES:
            yield flush(held)
            held, size = [], 0
    if held:
        yield flush(held)


def chunk_table(docs: DataFrame, chunks: int) -> DataFrame:
    """The packed documents as a table bucketed by chunk in the shared folder: later passes join to it without moving it."""
    spark = docs.sparkSession
    rows = docs.select(
        "doc_id", document_rank(F.col("doc_id")).alias("rank"), text_mark(F.col("text")).alias("mark"), F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("chunk", F.pmod(F.xxhash64("rank", "mark"), F.lit(chunks)).cast("int"))
    buckets, name = min(chunks, MOST_BUCKETS), f"substring_chunks_{uuid.uuid4().hex}"
    packed = rows.mapInArrow(pack, "chunk int, blob binary").repartition(buckets, "chunk")
    packed.write.format("parquet").bucketBy(buckets, "chunk").option("path", f"{shared_dir(spark)}/sitegauge/{name}").saveAsTable(name)
    return spark.table(name)


class Chunk:
    """The documents of a chunk in rank order, and its distinct windows with the place of their first start."""

    def __init__(self, table: pa.Table, window: int):
        docs: dict[tuple, list] = {}
        for blob in table["blob"]:
            rows = pa.ipc.open_stream(pa.py_buffer(blob.as_buffer())).read_all()
            for doc_id, rank, mark, copies, text in zip(*(rows[c].to_pylist() for c in PACKED.names)):
                docs.setdefault((rank, mark), [doc_id, 0, text])[1] += copies
        self.keys = sorted(docs)
        self.docs = [docs[k] for k in self.keys]
        for doc in self.docs:
            doc[2] = doc[2].encode()
        marks = [W.marks(text) for *_, text in self.docs]
        self.sizes = np.array([len(m) for m in marks], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        whole = np.concatenate([np.empty(0, U64), *marks])
        a, b = W.window_marks(whole, window), W.window_marks(whole, window, 1)
        inside = np.zeros(len(whole) + 1, np.int8)  # windows that cross into the next document are none
        ends = self.starts[1:]
        np.add.at(inside, np.maximum(ends - window + 1, self.starts[:-1]), 1)
        np.add.at(inside, ends, -1)
        self.places = np.flatnonzero(np.cumsum(inside[:len(a)]) == 0)
        a, b = a[self.places], b[self.places]
        order = np.argsort(a, kind="stable")
        sa, sb = a[order], b[order]
        if ((sa[1:] == sa[:-1]) & (sb[1:] != sb[:-1])).any():
            order = np.lexsort((b, a))
            sa, sb = a[order], b[order]
        new = np.ones(len(order), bool)
        new[1:] = (sa[1:] != sa[:-1]) | (sb[1:] != sb[:-1])
        self.a, self.b, self.first = sa[new], sb[new], self.places[order[new]]
        self.value_of = np.empty(len(order), np.int64)
        self.value_of[order] = np.cumsum(new) - 1

    def cells(self, row: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct cells of one sketch row, and the cell of each distinct window as an index into them."""
        cells, index = np.unique((self.a if row == 0 else W.mixed(self.b + U64(row))) >> U64(64 - bits), return_inverse=True)
        return cells, index

    def repeated(self, back: pa.Table, sizes: dict) -> np.ndarray:
        """Per distinct window: do all rows of the merged sketch estimate it repeated."""
        flags = {(k, r, g): v for k, r, g, v in zip(*(back[c].to_pylist() for c in ("kind", "row", "grp", "bits")))}
        out = np.ones(len(self.a), bool)
        for row in range(DEPTH):
            cells, index = self.cells(row, sizes["bits"])
            hit = np.zeros(len(cells), bool)
            for block, lo, hi in blocks_of(cells, sizes["block_bits"]):
                if (found := flags.get((0, row, block))) is not None:
                    hit[lo:hi] = unpacked(found, hi - lo)
            out &= hit[index]
        return out

    def candidates(self, repeated: np.ndarray, part_bits: int) -> Iterator[tuple[int, np.ndarray]]:
        """(part, indices of distinct windows in order of place), for the windows that are estimated repeated."""
        some = np.flatnonzero(repeated)
        parts = (self.a[some] >> U64(64 - part_bits)).astype(np.int64)
        order = np.lexsort((self.first[some], parts))
        some, parts = some[order], parts[order]
        cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
        for lo, hi in itertools.pairwise(cuts):
            if hi > lo:
                yield int(parts[lo]), some[lo:hi]


def blocks_of(cells: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(block, from, to) of sorted cells."""
    blocks = (cells >> U64(bits)).astype(np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
    for lo, hi in itertools.pairwise(cuts):
        if hi > lo:
            yield int(blocks[lo]), lo, hi


def packed_cells(cells: np.ndarray) -> bytes:
    """Sorted offsets within a block: differences by byte planes, compressed."""
    steps = np.diff(cells.astype(np.uint32), prepend=np.uint32(0))
    return zstandard.compress(steps.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked_cells(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)


def unpacked(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def columns(schema: str, *arrays) -> pa.Table:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table([pa.array(a, kinds[k]) for a, (_, k) in zip(arrays, fields)], names=[n for n, _ in fields])


SKETCH = "row int, block bigint, chunk int, cells binary"
BACK = "chunk int, kind int, row int, grp bigint, bits binary"
CANDIDATES = "part bigint, chunk int, hash_a binary, hash_b binary, ranks binary, marks binary, counts binary"
RESULT = "doc_id bigint, n_words bigint, n_removed bigint, text string"


def sketches(chunks: DataFrame, sizes: dict, window: int) -> DataFrame:
    """Every chunk's own sketch, block by block."""

    def work(key: tuple, table: pa.Table) -> pa.Table:
        chunk, out = Chunk(table, window), []
        for row in range(DEPTH):
            cells, _ = chunk.cells(row, sizes["bits"])
            for block, lo, hi in blocks_of(cells, sizes["block_bits"]):
                out.append((row, block, key[0].as_py(), packed_cells(cells[lo:hi] & U64((1 << sizes["block_bits"]) - 1))))
        return columns(SKETCH, *(zip(*out) if out else ((),) * 4))

    return chunks.groupBy("chunk").applyInArrow(work, SKETCH)


def merged(parts: DataFrame, sizes: dict) -> DataFrame:
    """Back to each chunk, per block: which of its cells two or more chunks hit."""
    size = 1 << sizes["block_bits"]

    def work(key: tuple, table: pa.Table) -> pa.Table:
        once, twice, out = np.zeros(size, bool), np.zeros(size, bool), []
        for data in table["cells"]:
            cells = unpacked_cells(data.as_py())
            twice[cells] |= once[cells]
            once[cells] = True
        for chunk, data in zip(table["chunk"].to_pylist(), table["cells"]):
            hit = twice[unpacked_cells(data.as_py())]
            if hit.any():
                out.append((chunk, 0, key[0].as_py(), key[1].as_py(), np.packbits(hit).tobytes()))
        return columns(BACK, *(zip(*out) if out else ((),) * 5))

    return parts.groupBy("row", "block").applyInArrow(work, BACK)


def candidates(chunks: DataFrame, flags: DataFrame, sizes: dict, window: int) -> DataFrame:
    """The windows that are estimated repeated, one per chunk and value, packed by part of the hash."""

    def work(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if len(left) and len(right):
            chunk = Chunk(left, window)
            for part, some in chunk.candidates(chunk.repeated(right, sizes), sizes["part_bits"]):
                docs, counts = np.unique(np.searchsorted(chunk.starts, chunk.first[some], "right") - 1, return_counts=True)
                ranks, marks = np.array([chunk.keys[d] for d in docs], np.int64).T
                out.append((part, key[0].as_py(), chunk.a[some].tobytes(), (chunk.b[some] >> U64(32)).astype(np.uint32).tobytes(),
                            ranks.tobytes(), marks.tobytes(), counts.astype(np.int64).tobytes()))
        return columns(CANDIDATES, *(zip(*out) if out else ((),) * 7))

    return chunks.groupBy("chunk").cogroup(flags.groupBy("chunk")).applyInArrow(work, CANDIDATES)


def settled(rows: DataFrame) -> DataFrame:
    """Exact grouping. Back to each chunk, per part: which of its windows a document of lower rank holds."""

    def work(key: tuple, table: pa.Table) -> pa.Table:
        def whole(name, kind):
            return [np.frombuffer(x.as_buffer(), kind) for x in table[name]]

        a, b, counts = whole("hash_a", np.uint64), whole("hash_b", np.uint32), whole("counts", np.int64)
        sizes = [len(x) for x in a]
        repeats = np.concatenate(counts)
        rank, mark = (np.repeat(np.concatenate(whole(c, np.int64)), repeats) for c in ("ranks", "marks"))
        a, b = np.concatenate(a), np.concatenate(b)
        order = np.lexsort((mark, rank, b, a))
        a, b, rank, mark = a[order], b[order], rank[order], mark[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        late = np.empty(len(a), bool)
        late[order] = (rank != rank[head]) | (mark != mark[head])
        out, at = [], 0
        for chunk, n in zip(table["chunk"].to_pylist(), sizes):
            if late[at:at + n].any():
                out.append((chunk, 1, 0, key[0].as_py(), np.packbits(late[at:at + n]).tobytes()))
            at += n
        return columns(BACK, *(zip(*out) if out else ((),) * 5))

    return rows.groupBy("part").applyInArrow(work, BACK)


def kept(chunks: DataFrame, back: DataFrame, sizes: dict, window: int) -> DataFrame:
    """Every document with the words that no repeated window covers."""

    def work(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return columns(RESULT, (), (), (), ())
        chunk = Chunk(left, window)
        late = np.zeros(len(chunk.a), bool)
        found = {g: v for k, g, v in zip(*(right[c].to_pylist() for c in ("kind", "grp", "bits"))) if k == 1}
        if found:
            for part, some in chunk.candidates(chunk.repeated(right, sizes), sizes["part_bits"]):
                if part in found:
                    late[some] = unpacked(found[part], len(some))
        gone = chunk.places[late[chunk.value_of] | (chunk.first[chunk.value_of] != chunk.places)]
        cover = np.zeros(chunk.starts[-1] + window + 1, np.int64)
        cover[gone] += 1
        cover[gone + window] -= 1
        keep = np.cumsum(cover)[:chunk.starts[-1]] == 0
        out = []
        for (doc_id, copies, text), lo, hi in zip(chunk.docs, chunk.starts[:-1], chunk.starts[1:]):
            mine = keep[lo:hi]
            rest = b" ".join(text.split() if mine.all() else itertools.compress(text.split(), mine.tolist())).decode()
            out += [(doc_id, hi - lo, int((~mine).sum()), rest)] * copies
        return columns(RESULT, *zip(*out))

    return chunks.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(work, RESULT)


def deduplicated(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed and the kept words joined by one blank."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    sizes = shape(rows)
    chunks = chunk_table(rows, sizes["chunks"])
    flags = stage(merged(sketches(chunks, sizes, window), sizes), "repeated_cells")
    late = stage(settled(candidates(chunks, flags, sizes, window)), "later_windows")
    return kept(chunks, flags.union(late), sizes, window)
