"""Conversation prefix trie, with subtree figures by the Euler tour technique.

Each distinct sequence of first turns (role, text) is a node; a conversation is a member of every node on its path. A node is
named by its smallest member and its depth.

Method: a running hash along each conversation marks its prefixes; equal marks are one node. Every node has an enter and an exit
arc; the arc after is that of the first child, the next sibling or the parent, found in one sort of nodes and children. The tour
is ranked in two steps: ranges of nodes walk the stretches of the tour that stay within them and shorten each to one link,
and pointer jumping ranks the shortened list. Prefix sums at the positions of the arcs then give, for each node, sum at its exit
less sum before its enter: leaves and saved tokens of its subtree.

Scale: sorts are by ranges of full keys, and running values pass over the borders of ranges, so one long conversation, one popular
turn or one node with many children is spread. Ranges hold about ``ordered.ROWS`` rows. Each arc has one arc before it, so the joins of the ranking have no hot
key; they take one round per doubling of the number of links between ranges. The hash of a node's end members reads their ids in
order, in pieces of ``PIECE``: such a hash can't be split, but it streams.

Defined cases: turns with null conv_id belong to no conversation; null role or text is empty; turns are ordered by turn (null
first), then role and text; repeated rows are turns of their own; other columns are not read; without conversations there is no root
and the result is empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ordered as O
from .common import stage
from .ordered import following, ordered, parts_for, running

PIECE = 1000
HEAD_MOST = 5


def turn_marks(conversations: DataFrame) -> DataFrame:
    """(conv_id, position from 1, mark_a, mark_b, size) of every turn; texts end here."""
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    places = ordered(rows.select("*", F.length("text").cast("bigint").alias("size")), rows.count(), "conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    marked = places.select("conv_id", "part", "seq", "size", F.xxhash64("role", "text").alias("mark_a"), F.xxhash64(F.lit("b"), "role", "text").alias("mark_b"))
    counted = running(marked, ["conv_id"], {"position": (F.sum, F.lit(1).cast("bigint"))})
    return stage(counted.select("conv_id", "position", "mark_a", "mark_b", "size"), "turn_marks")


def with_shared_heads(turns: DataFrame) -> DataFrame:
    """Steps (conv_id, kind, position, marks, size) of conversations whose first h turns are those of the conversation c - c % 100; h = crc32(c) % 6.

    Every conversation has a step of kind 0, also one that is left without turns.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEAD_MOST + 1)).alias("h")
    ids = turns.select("conv_id").distinct()
    heads = turns.where(F.col("conv_id") % 100 == 0).where(F.col("position") <= HEAD_MOST).withColumnRenamed("conv_id", "base")
    taken = ids.select("conv_id", (F.col("conv_id") - F.col("conv_id") % 100).alias("base"), h).join(heads, "base").where("position <= h")
    columns = ["conv_id", "kind", "position", "mark_a", "mark_b", "size"]
    zero = F.lit(0).cast("bigint")
    return ids.select("conv_id", F.lit(0).alias("kind"), zero.alias("position"), zero.alias("mark_a"), zero.alias("mark_b"), zero.alias("size")).union(
        taken.withColumn("kind", F.lit(1)).select(*columns)).union(
        turns.withColumn("h", h).where("position > h").withColumn("kind", F.lit(2)).select(*columns))


def as_they_are(turns: DataFrame) -> DataFrame:
    """Steps of the conversations as given."""
    zero = F.lit(0).cast("bigint")
    roots = turns.select("conv_id").distinct()
    return roots.select("conv_id", F.lit(0).alias("kind"), zero.alias("position"), zero.alias("mark_a"), zero.alias("mark_b"), zero.alias("size")).union(
        turns.select("conv_id", F.lit(2).alias("kind"), "position", "mark_a", "mark_b", "size"))


def members(steps: DataFrame) -> DataFrame:
    """(conv_id, depth, a, b, up_a, up_b, size): the mark of every prefix of every conversation, and of the one before."""
    rows = ordered(steps, steps.count(), "conv_id", "kind", "position")
    rows = running(rows, ["conv_id"], {"depth": (F.sum, F.lit(1).cast("bigint"))}).withColumn("depth", F.col("depth") - 1)
    at = {c: F.when(F.col("depth") == 0, F.lit(0).cast("bigint")).otherwise(F.xxhash64("depth", "mark_a", "mark_b", F.lit(c))) for c in ("a", "b")}
    rows = stage(rows.select("conv_id", "depth", "size", "part", "seq", *(at[c].alias(f"own_{c}") for c in at)), "steps")
    rows = running(rows, ["conv_id"], {c: (F.bit_xor, F.col(f"own_{c}")) for c in at})
    return stage(rows.select("conv_id", "depth", "a", "b", *(F.col(c).bitwiseXOR(F.col(f"own_{c}")).alias(f"up_{c}") for c in at), "size"), "members")


def nodes(paths: DataFrame) -> DataFrame:
    """One row per distinct prefix."""
    return stage(paths.groupBy("depth", "a", "b").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("size").alias("size"), F.min("up_a").alias("up_a"), F.min("up_b").alias("up_b")), "nodes")


def linked(tree: DataFrame, n: int) -> DataFrame:
    """Per node: parent, first child and next sibling (their conv_id), by one sort of nodes ahead of their children."""
    columns = ["conv_id", "depth"]
    both = tree.select("a", "b", F.col("depth").alias("at"), F.lit(0).alias("child"), *columns).union(
        tree.where("depth > 0").select("up_a", "up_b", F.col("depth") - 1, F.lit(1), *columns))
    rows, key = ordered(both, 2 * n, "a", "b", "at", "child", "conv_id"), ["a", "b", "at"]
    rows = following(rows, key, "conv_id", "next")
    rows = running(rows, key, {"parent": (F.max, F.when(F.col("child") == 0, F.col("conv_id")))})
    child = F.col("child") == 1
    return stage(rows.groupBy(*columns).agg(
        F.max(F.when(child, F.col("parent"))).alias("parent"), F.max(F.when(~child, F.col("next"))).alias("down"), F.max(F.when(child, F.col("next"))).alias("over"),
    ), "links")


LOCAL = "conv_id bigint, depth bigint, kind int, head_conv bigint, head_depth bigint, head_kind int, offset bigint, is_head boolean, next_conv bigint, next_depth bigint, next_kind int, length bigint"


def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walk the stretches of the tour within one range of nodes: every arc gets its head and place; heads get the head after their stretch."""
    rows = [r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "depth", "parent", "down", "over")))]
    after: dict[tuple, tuple | None] = {}
    for conv, depth, parent, down, over in rows:
        after[conv, depth, 0] = (conv, depth, 1) if down is None else (down, depth + 1, 0)
        if over is not None:
            after[conv, depth, 1] = (over, depth, 0)
        else:
            after[conv, depth, 1] = None if depth == 0 else (parent, depth - 1, 1)
    inner = {arc for arc in after.values() if arc in after}
    out: list[tuple] = []
    for head in after:
        if head in inner:
            continue
        arc, stretch = head, []
        while arc is not None and arc in after:
            stretch.append(arc)
            arc = after[arc]
        for i, here in enumerate(stretch):
            out.append((*here, *head, i, not i, *(arc if arc and not i else (None,) * 3), None if i else len(stretch)))
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    fields = [f.split() for f in LOCAL.split(", ")]
    columns = list(zip(*out)) if out else [()] * len(fields)
    yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [f for f, _ in fields])


def positions(links: DataFrame, n: int) -> DataFrame:
    """(conv_id, depth, kind, position): the place of every arc on the tour, from 0."""
    ranges = links.repartitionByRange(parts_for(n), "conv_id", "depth")
    arcs = stage(ranges.mapInArrow(shorten, LOCAL), "stretches")
    heads = arcs.where("is_head").select("conv_id", "depth", "kind", "next_conv", "next_depth", "next_kind", F.col("length").alias("rest"))
    jumps = max(0, (heads.count() - 1).bit_length())
    for _ in range(jumps):  # after j rounds every link spans 2 ** j stretches
        ahead = heads.toDF("next_conv", "next_depth", "next_kind", "then_conv", "then_depth", "then_kind", "more")
        joined = heads.join(ahead, ["next_conv", "next_depth", "next_kind"], "left")
        heads = stage(joined.select("conv_id", "depth", "kind", F.col("then_conv").alias("next_conv"), F.col("then_depth").alias("next_depth"),
                                    F.col("then_kind").alias("next_kind"), (F.col("rest") + F.coalesce("more", F.lit(0))).alias("rest")), "jumps")
    ranked = heads.select(F.col("conv_id").alias("head_conv"), F.col("depth").alias("head_depth"), F.col("kind").alias("head_kind"), "rest")
    placed = arcs.join(ranked, ["head_conv", "head_depth", "head_kind"])
    return placed.select("conv_id", "depth", "kind", (F.lit(2 * n) - F.col("rest") + F.col("offset")).alias("position"))


def subtree_sums(arcs: DataFrame, weights: list[str]) -> DataFrame:
    """Per node: for each weight (on enter arcs) its sum over the subtree, from prefix sums at the two arcs."""
    rows = arcs.withColumns({"seq": F.col("position"), "part": F.expr(f"position div {O.ROWS}"), "tour": F.lit(0)})
    rows = running(rows, ["tour"], {f"sum_{c}": (F.sum, F.col(c)) for c in weights})
    enter = F.col("kind") == 0
    return rows.groupBy("conv_id", "depth").agg(*(
        (F.max(F.when(~enter, F.col(f"sum_{c}"))) - F.max(F.when(enter, F.col(f"sum_{c}") - F.col(c)))).alias(c) for c in weights))


def end_hashes(paths: DataFrame) -> DataFrame:
    """(a, b, depth, ends_sha256) of the nodes where conversations end: SHA-256 of their ids in order, comma-joined."""
    last = paths.groupBy("conv_id").agg(F.max_by(F.struct("a", "b", "depth"), "depth").alias("end")).select("conv_id", "end.*")
    rows = ordered(last, last.count(), "a", "b", "depth", "conv_id")
    rows = rows.withColumn("piece", F.expr(f"seq div {PIECE}"))
    pieces = rows.groupBy("part", "piece", "a", "b", "depth").agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    names = ["a", "b", "depth"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows_of(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.int64(), pa.int64(), pa.int64(), pa.string()))], [*names, "ends_sha256"])

        now, state, done = None, None, []
        for batch in batches:
            for a, b, depth, ids in zip(*(batch.column(c).to_pylist() for c in (*names, "ids"))):
                if (a, b, depth) != now:
                    if state:
                        done.append((*now, state.hexdigest()))
                    now, state = (a, b, depth), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if done:
                yield rows_of(done)
                done = []
        if state:
            yield rows_of([(*now, state.hexdigest())])

    streamed = pieces.repartition(*names).sortWithinPartitions(*names, "part", "piece").select(*names, "ids")
    return streamed.mapInArrow(work, "a bigint, b bigint, depth bigint, ends_sha256 string")


def trie(steps: DataFrame) -> DataFrame:
    """Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    paths = members(steps)
    tree = nodes(paths)
    n = tree.count()
    links = linked(tree, n)
    key = ["conv_id", "depth"]
    leaf = F.col("down").isNull()
    weighted = tree.join(links, key).select(*key, leaf.cast("bigint").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved_tokens"))
    arcs = positions(links, n).join(weighted, key)
    enter = F.col("kind") == 0
    arcs = stage(arcs.withColumns({c: F.when(enter, F.col(c)).otherwise(F.lit(0)) for c in ("n_leaves", "saved_tokens")}), "tour")
    children = links.where("depth > 0").groupBy(F.col("parent").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    out = tree.join(links.select(*key, "parent"), key).join(subtree_sums(arcs, ["n_leaves", "saved_tokens"]), key).join(children, key, "left")
    out = out.join(end_hashes(paths), ["a", "b", "depth"], "left")
    return out.select(
        "conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
