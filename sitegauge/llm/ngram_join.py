"""Exact similarity join on word n-gram sets with signature trees, and its groups.

Texts become sets of hashed n-grams (five words by default); two texts link when the Jaccard similarity is at least
``percent`` / 100. Results are the connected groups of links.

1. *Sets.* One pass turns each text into its size, a hash of the set, a prefix and a bitmap. Linked sets share at least one
   token of their prefixes (the first ``n - ceil(percent * n / 100) + 1`` tokens in an order common to all sets), so only sets that
   meet in a prefix token are compared. Tokens that are frequent in a bounded sample come last in the order; the sample
   changes the work, never the result. Equal sets have one hash and take part once.
2. *Meeting.* (token, set, size) rows are grouped by token and sorted by size; sets without a neighbour of a fitting size drop
   out. What is left is named after the first set of its list, and lists of one name are taken together, since
   copies and shared passages meet in many tokens.
3. *Signature trees.* A tree over a list keeps in each node the OR and the AND of the bitmaps below it and their range of sizes. A
   dual traversal drops pairs of nodes whose sizes do not fit or whose highest possible overlap (the larger size less the
   bits that all sets of one node have and no set of the other) is too small. Sets that keep a partner go on.
4. *Links.* Only the texts of those sets are read again. A second traversal over their full sets counts overlaps
   exactly. It skips nodes whose sets already are in one group, so a group of near copies makes links in proportion to
   its size.

Lists with many tokens are cut into blocks and compared block by block: a task holds two blocks of about ``BLOCK_TOKENS``.

Scale: no pairs are shuffled, only sets with the names of their lists. Between stages, narrow tables are written to the shared
folder.

Defined cases: null or blank texts have an empty set and are groups of their own; texts of fewer words than an n-gram
have one n-gram, the whole; rows with equal ids are told apart by their text; a null id ranks last and is named only if its whole
group has none; an empty table gives an empty table; other columns are not read. Sets and n-grams are held as 64-bit
hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage
from .common import bounded_batches, text_slices
from .graph import components
from .line_dedup import LAST, document_rank, text_mark

NGRAM = 5
PERCENT = 75
SAMPLE_ROWS = 20_000
SAMPLE_COUNT = 5
MAX_FREQUENT = 200_000
BLOCK_TOKENS = 500_000
BROADCAST_ROWS = 1_000_000  # narrow id rows; beyond it the join is a shuffle
LEAF = 8
SEEN = 1_000_000
CACHE = 200_000
_MIX = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def ngram_set(text: str | None, hashes: WordHashes, ngram: int = NGRAM) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of a text."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    coded = np.array([hashes[w] for w in words], dtype=np.uint64)
    size = min(ngram, len(coded))
    n = len(coded) - size + 1
    mixed = np.full(n, size, dtype=np.uint64)
    for i in range(size):
        mixed = (mixed ^ coded[i : i + n]) * _MIX[i % len(_MIX)]
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def resolution(n: int) -> int:
    """Bits of a bitmap for a set of ``n`` tokens: four to eight per token, a power of two."""
    return max(64, 1 << (n.bit_length() + 2))


def bitmap(tokens: np.ndarray) -> np.ndarray:
    bits = np.zeros(resolution(len(tokens)), dtype=np.uint8)
    bits[(tokens & np.uint64(len(bits) - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def fold(words: np.ndarray, size: int) -> np.ndarray:
    """A bitmap (or rows of bitmaps) at the coarser resolution of ``size`` words."""
    while words.shape[-1] > size:
        half = words.shape[-1] // 2
        words = words[..., :half] | words[..., half:]
    return words


def enough(overlap, n_a, n_b, percent: int = PERCENT):
    return (100 + percent) * overlap >= percent * (n_a + n_b)


def bound(a: np.ndarray, n_a: int, b: np.ndarray, n_b: int) -> int:
    """Highest possible overlap of two sets by their bitmaps."""
    size = min(len(a), len(b))
    a, b = fold(a, size), fold(b, size)
    return min(n_a - int(np.bitwise_count(a & ~b).sum()), n_b - int(np.bitwise_count(b & ~a).sum()))


def prefix_length(n: int, percent: int) -> int:
    return n + (-percent * n) // 100 + 1


def frequent_tokens(docs: DataFrame, ngram: int) -> np.ndarray:
    """Tokens that many texts of a bounded sample share; they come last in the order of tokens."""
    rows = docs.count()
    if not rows:
        return np.zeros(0, dtype=np.uint64)
    sample = docs.select("text").sample(False, min(1.0, SAMPLE_ROWS / rows), 7)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for part in text_slices(batch, "text"):
                sets = [ngram_set(t, hashes, ngram) for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["token"])

    counts = sample.mapInArrow(run, "token bigint").groupBy("token").count().where(F.col("count") >= SAMPLE_COUNT)
    top = counts.orderBy(F.desc("count"), "token").limit(MAX_FREQUENT).select("token").toArrow()
    return np.sort(top.column("token").to_numpy().astype(np.int64).view(np.uint64))


SETS = "doc_id bigint, mark bigint, n int, sid bigint, low bigint, prefix array<bigint>, bits binary"


def document_sets(docs: DataFrame, ngram: int, percent: int) -> DataFrame:
    """One row per text: size, set hash, and (once per set and task) prefix and bitmap."""
    frequent = frequent_tokens(docs, ngram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), set()
        for batch in batches:
            for part in text_slices(batch, "text"):
                sizes, sids, lows, prefixes, maps = [], [], [], [], []
                for text in part.column(2).to_pylist():
                    tokens = ngram_set(text, hashes, ngram)
                    n = len(tokens)
                    sid = set_hash(tokens) if n else None
                    sizes.append(n)
                    sids.append(sid)
                    lows.append(int(tokens[:1].view(np.int64)[0]) if n else None)
                    if not n or sid in seen:
                        prefixes.append(None)
                        maps.append(None)
                        continue
                    if len(seen) < SEEN:
                        seen.add(sid)
                    ordered = tokens
                    if len(frequent):
                        late = frequent[np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)] == tokens
                        if late.any():
                            ordered = np.concatenate([tokens[~late], tokens[late]])
                    prefixes.append(ordered[: prefix_length(n, percent)].view(np.int64))
                    maps.append(bitmap(tokens).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(sizes, pa.int32()), pa.array(sids, pa.int64()),
                     pa.array(lows, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(maps, pa.binary())],
                    names=["doc_id", "mark", "n", "sid", "low", "prefix", "bits"],
                )

    return docs.select("doc_id", "mark", "text").mapInArrow(run, SETS)


def fits(small: str, large: str, percent: int) -> str:
    return f"100L * {small} >= {percent}L * {large}"


def meetings(sets: DataFrame, percent: int) -> DataFrame:
    """Distinct rows (name, sid, n): sets that meet another set of fitting size in a prefix token, under the first set of that list."""
    rows = sets.where("prefix is not null").select("sid", "n", F.explode("prefix").alias("token"))
    by_size = Window.partitionBy("token").orderBy("n", "sid")
    rows = rows.withColumn("same", F.lag("sid").over(by_size)).where("same is null or same != sid").drop("same")
    rows = rows.withColumns({"before_n": F.lag("n").over(by_size), "after_n": F.lead("n").over(by_size)})
    lower, upper = F.expr(fits("before_n", "n", percent)), F.expr(fits("n", "after_n", percent))
    # a list is cut where sizes leap, so that its name is a set of its own part
    rows = rows.withColumn("part", F.sum((~F.coalesce(lower, F.lit(False))).cast("int")).over(by_size.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.where(lower | upper)
    part = Window.partitionBy("token", "part").orderBy("n", "sid")
    return rows.withColumn("name", F.first("sid").over(part)).select("name", "sid", "n").distinct()


def set_hash(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes(), len(tokens)) - (1 << 63)


def full_sets(sids: DataFrame, docs: DataFrame, sets: DataFrame, ngram: int) -> DataFrame:
    """(sid, tokens) of the wanted sets; one text of each is read again."""
    chosen = sets.where("sid is not null").join(sids, "sid", "left_semi").groupBy("sid").agg(F.min(F.struct("doc_id", "mark")).alias("d"))
    chosen = stage(chosen.select(F.col("d.doc_id").alias("i"), F.col("d.mark").alias("m")), "ngram_texts")
    few = chosen.count() <= BROADCAST_ROWS
    wanted = docs.select("doc_id", "mark", "text").join(
        F.broadcast(chosen) if few else chosen, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("mark") == F.col("m")), "left_semi"
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for part in text_slices(batch, "text"):
                found = [ngram_set(t, hashes, ngram) for t in part.column(part.schema.get_field_index("text")).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([set_hash(t) for t in found], pa.int64()), pa.array([t.tobytes() for t in found], pa.binary())], names=["sid", "tokens"]
                )

    return stage(wanted.mapInArrow(read, "sid bigint, tokens binary").dropDuplicates(["sid"]), "ngram_tokens")


class Node:
    """A range of a sorted list."""

    __slots__ = ("all_of", "any_of", "hi", "left", "lo", "max_n", "min_n", "right")

    def __init__(self, tree: Tree, lo: int, hi: int):
        self.lo, self.hi = lo, hi
        if hi - lo <= LEAF:
            self.left = self.right = None
            self.any_of = np.bitwise_or.reduce(tree.bits[lo:hi], axis=0)
            self.all_of = np.bitwise_and.reduce(tree.bits[lo:hi], axis=0)
            self.min_n, self.max_n = int(tree.n[lo:hi].min()), int(tree.n[lo:hi].max())
        else:
            mid = (lo + hi) // 2
            self.left, self.right = Node(tree, lo, mid), Node(tree, mid, hi)
            self.any_of = self.left.any_of | self.right.any_of
            self.all_of = self.left.all_of & self.right.all_of
            self.min_n, self.max_n = min(self.left.min_n, self.right.min_n), max(self.left.max_n, self.right.max_n)


class Tree:
    """Signature tree of sets with bitmaps of one resolution; sets with the same lowest token, as copies have, lie together."""

    def __init__(self, at: np.ndarray, n: np.ndarray, low: np.ndarray, bits: np.ndarray):
        order = np.lexsort((n, low))
        self.at, self.n, self.bits = at[order], n[order], bits[order]
        self.root = Node(self, 0, len(at))


class Roots:
    """Groups of the places of a list."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def one(self, places: np.ndarray) -> int | None:
        """The group of all the places, None if there are several."""
        first = self.find(int(places[0]))
        return first if all(self.find(int(p)) == first for p in places[1:]) else None


def _apart(one: Tree, x: Node, other: Tree, y: Node, percent: int, roots: Roots | None) -> bool:
    """No set of ``x`` needs to be compared with one of ``y``."""
    if 100 * x.max_n < percent * y.min_n or 100 * y.max_n < percent * x.min_n:
        return True
    most = min(
        x.max_n - int(np.bitwise_count(x.all_of & ~y.any_of).sum()), y.max_n - int(np.bitwise_count(y.all_of & ~x.any_of).sum())
    )
    if not enough(most, x.min_n, y.min_n, percent):
        return True
    if roots is None:
        return False
    group = roots.one(one.at[x.lo : x.hi])
    return group is not None and group == roots.one(other.at[y.lo : y.hi])


def dual(one: Tree, other: Tree, percent: int, roots: Roots | None = None) -> Iterator[tuple[int, int]]:
    """Places of sets, one of each tree (each pair once if it is one tree), that the bounds do not rule out.

    With ``roots``, which the caller may join while the pairs come, pairs within one group are passed over.
    """
    todo = [(one.root, other.root)]
    while todo:
        x, y = todo.pop()
        if _apart(one, x, other, y, percent, roots):
            continue
        if x.left is None and y.left is None:
            a, b = slice(x.lo, x.hi), slice(y.lo, y.hi)
            bits_a, bits_b = one.bits[a][:, None], other.bits[b][None]
            n_a, n_b = one.n[a][:, None], other.n[b][None]
            most = np.minimum(n_a - np.bitwise_count(bits_a & ~bits_b).sum(-1, dtype=np.int64), n_b - np.bitwise_count(bits_b & ~bits_a).sum(-1, dtype=np.int64))
            keep = enough(most, n_a, n_b, percent)
            if x is y:
                keep &= np.tri(x.hi - x.lo, k=-1, dtype=bool)
            for i, j in zip(*np.nonzero(keep)):
                i, j = int(one.at[x.lo + i]), int(other.at[y.lo + j])
                if roots is None or roots.find(i) != roots.find(j):
                    yield i, j
        elif x is y:
            todo += [(x.left, x.right), (x.right, x.right), (x.left, x.left)]  # near sets first
        elif y.left is None or (x.left is not None and x.hi - x.lo >= y.hi - y.lo):
            todo += [(x.left, y), (x.right, y)]
        else:
            todo += [(x, y.left), (x, y.right)]


def list_pairs(n: list, low: list, block: list, bits: list, percent: int, roots: Roots | None = None) -> Iterator[tuple[int, int]]:
    """Places of candidate pairs of one list, or of two blocks of it when ``block`` has two values."""
    words = np.array([len(b) for b in bits])
    n, low, block = (np.array(x, dtype=np.int64) for x in (n, low, block))
    blocks = np.unique(block).tolist()
    x, y = blocks[0], blocks[-1]

    def tree(chosen: np.ndarray, size: int) -> Tree | None:
        at = np.flatnonzero(chosen)
        return Tree(at, n[at], low[at], np.stack([fold(bits[i], size) for i in at])) if len(at) else None

    for size in np.unique(words).tolist():
        own, next_up = words == size, words == 2 * size  # fitting sizes are in one resolution or in neighbouring ones
        first, second = tree(own & (block == x), size), tree(own & (block == y), size) if x != y else None
        combinations = [(first, first if x == y else second), (first, tree(next_up & (block == y), size))]
        if x != y:
            combinations.append((second, tree(next_up & (block == x), size)))
        for one, other in combinations:
            if one is not None and other is not None:
                yield from dual(one, other, percent, roots)


KEY = ("name", "x", "y")


def lists_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of each list, from batches sorted by :data:`KEY` (the first three columns)."""
    held: list = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and row[:3] != held[0][:3]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def partnered(met: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """Rows (name, x, y, block, sid) of sets that keep a partner in the signature tree of their list."""
    sums = met.groupBy("name").agg(F.sum("n").alias("tokens"), F.count("*").alias("c")).where("c > 1")
    sums = sums.select("name", F.ceil(F.col("tokens") / BLOCK_TOKENS).cast("int").alias("blocks"))
    rows = met.join(sums, "name").withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.expr("sequence(0, blocks - 1)")))
    rows = rows.select("name", F.least("block", "with").alias("x"), F.greatest("block", "with").alias("y"), "block", "sid", "n")
    rows = rows.join(maps.select("sid", "low", "bits"), "sid").select(*KEY, "block", "sid", "n", "low", "bits")
    rows = rows.repartition(*KEY).sortWithinPartitions(*KEY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in lists_of(batches):
            name, x, y, block, sid, n, low, bits = zip(*rows)
            if len(rows) == 1 or (x[0] != y[0] and len(set(block)) == 1):
                continue
            kept = sorted({i for p in list_pairs(n, low, block, [np.frombuffer(b, np.uint64) for b in bits], percent) for i in p})
            if kept:
                columns = [[c[i] for i in kept] for c in (name, x, y, block, sid)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()))],
                    names=[*KEY, "block", "sid"],
                )

    return rows.mapInArrow(run, "name bigint, x int, y int, block int, sid bigint")


def links_of(kept: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join the groups of each list; overlaps are counted exactly."""
    rows = kept.join(tokens, "sid").select(*KEY, "block", "sid", "tokens").repartition(*KEY).sortWithinPartitions(*KEY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in lists_of(batches):
            _, _, _, block, sid, cells = zip(*rows)
            sets = [np.frombuffer(c, np.uint64) for c in cells]
            roots, links = Roots(len(sets)), []
            sizes, lows = [len(t) for t in sets], [int(t[:1].view(np.int64)[0]) for t in sets]
            for i, j in list_pairs(sizes, lows, block, [bitmap(t) for t in sets], percent, roots):
                if enough(len(np.intersect1d(sets[i], sets[j], assume_unique=True)), len(sets[i]), len(sets[j]), percent):
                    roots.up[roots.find(i)] = roots.find(j)
                    links.append((sid[i], sid[j]))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return rows.mapInArrow(run, "a bigint, b bigint")


def groups(docs: DataFrame, ngram: int = NGRAM, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, mark (hash of the text), n_shingles, component_id."""
    return grouped(docs, ngram, percent, doc_id, text).drop("root")


def grouped(docs: DataFrame, ngram: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """:func:`groups` with ``root``, which names the group also where no row of it has an id; null for texts without words."""
    rows = bounded_batches(docs).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).withColumn("mark", text_mark(F.col("text")))
    sets = stage(document_sets(rows, ngram, percent), "ngram_sets")
    maps = sets.where("bits is not null").groupBy("sid").agg(F.first("low").alias("low"), F.first("bits").alias("bits"))
    kept = stage(partnered(stage(meetings(sets, percent), "ngram_meetings"), maps, percent), "ngram_partners")
    tokens = full_sets(kept.select("sid").distinct(), rows, sets, ngram)
    roots = components(stage(links_of(kept, tokens, percent), "ngram_links"))

    firsts = sets.where("sid is not null").groupBy("sid").agg(F.min(document_rank(F.col("doc_id"))).alias("first"))
    firsts = firsts.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    least = firsts.groupBy("root").agg(F.min("first").alias("component_id"))
    named = stage(firsts.join(least, "root").select("sid", "root", "component_id"), "ngram_named")
    empty = sets.where("sid is null").select("doc_id", "mark", "n", F.col("doc_id").alias("component_id"), F.lit(None).cast("bigint").alias("root"))
    full = sets.where("sid is not null").select("sid", "doc_id", "mark", "n").join(named, "sid")
    full = full.select("doc_id", "mark", "n", F.nullif("component_id", F.lit(LAST)).alias("component_id"), "root")
    return full.unionByName(empty).select("doc_id", "mark", F.col("n").cast("bigint").alias("n_shingles"), "component_id", "root")


def one_of_each(docs: DataFrame, ngram: int = NGRAM, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` per group: that of the smallest id (null last), then of the smallest text hash, then the one with the largest hash of
    all columns. Texts without words are in no group and all stay."""
    keys = [document_rank(F.col("doc_id")).alias("__rank"), F.col("mark").alias("__mark")]
    found = stage(grouped(docs, ngram, percent, doc_id, text).where("root is not null").select("doc_id", "mark", "component_id", "root"), "ngram_found")
    # rows that share the group's smallest id are as a rule one
    ahead = found.where("doc_id <=> component_id").select(*keys, "root")
    firsts = ahead.groupBy("root").agg(F.min("__mark").alias("first"))
    later = found.where("not doc_id <=> component_id").select(*keys).union(ahead.join(firsts, "root").where("__mark != first").select("__rank", "__mark"))
    later = stage(later.distinct(), "ngram_later")
    marked = docs.withColumns({"__rank": document_rank(F.col(doc_id).cast("bigint")), "__mark": text_mark(F.col(text))})
    later = F.broadcast(later) if later.count() <= BROADCAST_ROWS else later  # texts stay where they are if the ids are few
    kept = marked.join(later, ["__rank", "__mark"], "left_anti")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    twins = stage(ahead.groupBy("__rank", "__mark").count().where("count > 1").drop("count"), "ngram_twins")
    n_twins = twins.count()
    if not n_twins:
        return kept.select(*columns)
    twins = F.broadcast(twins) if n_twins <= BROADCAST_ROWS else twins
    rest = kept.join(twins, ["__rank", "__mark"], "left_anti").select(*columns)
    whole = F.struct(*[c.alias(f"c{i}") for i, c in enumerate(columns)])
    one = kept.join(twins, ["__rank", "__mark"], "left_semi").groupBy("__rank", "__mark").agg(F.max_by(whole, F.xxhash64(F.to_json(whole))).alias("one"))
    return rest.union(one.select(*[F.col("one")[f"c{i}"].alias(c) for i, c in enumerate(docs.columns)]))
