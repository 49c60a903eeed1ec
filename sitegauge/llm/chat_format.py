"""Preference formatting: one prompt and two masked completions per pair of conversations.

A pair has a chosen and a rejected conversation. Their longest common prefix of turns (equal role and text) is rendered once
as the prompt; what follows in each is rendered as its completion, with the spans (code points, end exclusive) of the assistant's
texts and their end marks, which are the only places to train on. Turns are rendered as ``<|im_start|>role\\ntext<|im_end|>\\n``.

Where a corpus has plain conversations only, :func:`next_answers` makes pairs: the rejected side is the same conversation with
its last assistant turn answered by the next conversation that has one, whatever the gap between the ids; the last one takes
the first one's. Every conversation with an assistant turn makes a pair as soon as there are two.

Scale: turns are gathered to conversations by one exchange (a conversation becomes one training row in any case) and written;
ids are sorted in ranges, and only one row of each range goes into the window that joins the ranges up. Answers meet narrow id
pairs, and those the conversations, by one-to-one equi-joins. Everything is built-in expressions.

Defined cases: turns are ordered by number, then role, then text, null numbers last; repeated turns are kept; a null role is
an empty role, a null text an empty text; marks inside a text are escaped by a backslash; equal conversations have empty
completions; conversations without an assistant turn or without an id make no pair in :func:`next_answers`, nor does the only
one with an assistant turn; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage
from .ordered import following, ordered

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
LAST_TURN = (1 << 63) - 1


def conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id and its turns (role, text) in order."""
    rows = turns.select(
        F.col(conv_id).alias("conv_id"),
        F.struct(
            F.coalesce(F.col(turn).cast("bigint"), F.lit(LAST_TURN)).alias("turn"), F.coalesce(role, F.lit("")).alias("role"),
            F.coalesce(text, F.lit("")).alias("text"),
        ).alias("t"),
    )
    listed = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    return listed.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def next_ids(ids: DataFrame) -> DataFrame:
    """Each distinct ``conv_id`` with the next one as ``rejected_id``, the greatest with the smallest."""
    n, first = ids.agg(F.count("conv_id"), F.min("conv_id")).first()
    along = following(ordered(ids, n, "conv_id"), [], "conv_id", "rejected_id")
    wrapped = F.coalesce("rejected_id", F.lit(first).cast(ids.schema["conv_id"].dataType))
    return along.select("conv_id", wrapped.alias("rejected_id")).where("rejected_id <> conv_id")


def next_answers(convs: DataFrame) -> DataFrame:
    """Pairs (pair_id, chosen_id, rejected_id, chosen, rejected) from single conversations."""
    held = stage(convs.where(F.col("conv_id").isNotNull() & F.exists("turns", lambda t: t["role"] == "assistant")), "conversations")
    answers = F.filter("turns", lambda t: t["role"] == "assistant")
    donors = held.select(F.col("conv_id").alias("rejected_id"), F.element_at(answers, -1)["text"].alias("answer"))
    given = next_ids(held.select("conv_id")).join(donors, "rejected_id")
    place = F.array_max(F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i)))
    swapped = F.transform("turns", lambda t, i: F.when(
        i == F.col("place"), F.struct(t["role"].alias("role"), F.col("answer").alias("text"))).otherwise(t))
    return held.withColumn("place", place).join(given, "conv_id").select(
        F.col("conv_id").alias("pair_id"), F.col("conv_id").alias("chosen_id"), "rejected_id", F.col("turns").alias("chosen"),
        swapped.alias("rejected"),
    )


def paired(convs: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (pair_id, chosen_id, rejected_id) with the turns of both conversations."""
    chosen = convs.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("chosen"))
    rejected = convs.select(F.col("conv_id").alias("rejected_id"), F.col("turns").alias("rejected"))
    return pairs.select("pair_id", "chosen_id", "rejected_id").join(chosen, "chosen_id").join(rejected, "rejected_id").select(
        "pair_id", "chosen_id", "rejected_id", "chosen", "rejected"
    )


def escaped(text: Column) -> Column:
    return F.replace(text, F.lit("<|im_"), F.lit("<\\|im_"))


def head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), escaped(turn["role"]), F.lit("\n"))


def body(turn: Column) -> Column:
    return F.concat(escaped(turn["text"]), F.lit(CLOSE))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(head(t), body(t), F.lit("\n"))), "")


def trained_spans(turns: Column) -> Column:
    """Spans of the assistant's texts with their end marks in the rendered turns."""
    def step(state: Column, t: Column) -> Column:
        start = state["at"] + F.length(head(t))
        end = start + F.length(body(t))
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        spans = F.when(t["role"] == "assistant", F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct((end + 1).alias("at"), spans.alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return F.aggregate(turns, zero, step)["spans"]


def common_turns(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two arrays of turns."""
    least = F.least(F.size(a), F.size(b))
    zipped = F.slice(F.arrays_zip(a.alias("a"), b.alias("b")), F.lit(1), least)
    other = F.array_min(F.filter(F.transform(zipped, lambda z, i: F.when(z["a"] != z["b"], i)), lambda i: i.isNotNull()))
    return F.coalesce(other, least)


def formatted(pairs: DataFrame) -> DataFrame:
    """Prompt, completions and masks of pairs with turns."""
    rows = pairs.withColumn("n_common", common_turns(F.col("chosen"), F.col("rejected")))
    rest = lambda side: F.slice(F.col(side), F.col("n_common") + 1, F.size(side))
    return rows.select(
        "pair_id", "chosen_id", "rejected_id", "n_common", rendered(F.slice("chosen", F.lit(1), F.col("n_common"))).alias("prompt"),
        rendered(rest("chosen")).alias("chosen"), rendered(rest("rejected")).alias("rejected"),
        trained_spans(rest("chosen")).alias("chosen_mask"), trained_spans(rest("rejected")).alias("rejected_mask"),
    )


def mask_text(mask: Column) -> Column:
    return F.array_join(F.transform(mask, lambda m: F.concat_ws(":", m["start"].cast("string"), m["end"].cast("string"))), ",")
