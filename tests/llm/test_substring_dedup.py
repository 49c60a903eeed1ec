"""Substring dedup: brute force over all windows, few bits in the sketch, odd rows."""

import random

import numpy as np
import pytest

from sitegauge.llm import substring_dedup as S
from sitegauge.llm import words as W


def brute(rows, window):
    split = lambda t: [w.decode() for w in (t or "").encode().split()]
    docs = sorted({((S_LAST if d is None else d), mark, tuple(split(t))) for d, mark, t in rows})
    first = {}
    for rank, mark, words in docs:
        for i in range(len(words) - window + 1):
            first.setdefault(words[i:i + window], (rank, mark, i))
    out = {}
    for rank, mark, words in docs:
        keep = [True] * len(words)
        for i in range(len(words) - window + 1):
            if first[words[i:i + window]] != (rank, mark, i):
                keep[i:i + window] = [False] * window
        out[rank, mark] = (len(words), keep.count(False), " ".join(w for w, k in zip(words, keep) if k))
    return [(d, *out[S_LAST if d is None else d, mark]) for d, mark, _ in rows]


S_LAST = (1 << 63) - 1


def check(spark, rows, window):
    from sitegauge.llm.line_dedup import text_mark
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as chunk", "2L as rank", "'m' as mark").repartition(4)
    marked = [(r["doc_id"], r["m"], r["text"]) for r in docs.select("doc_id", "text", text_mark(F.col("text")).alias("m")).collect()]
    got = [tuple(r) for r in S.deduplicated(docs, window).collect()]
    assert sorted(got, key=repr) == sorted(brute(marked, window), key=repr)


@pytest.mark.parametrize("window", [1, 3, 20])
def test_against_brute_force(spark, window):
    r = random.Random(window)
    pool = [" ".join(r.choice("abcdefgh") for _ in range(r.randrange(1, 3 * window))) for _ in range(30)]
    rows = [(r.randrange(50), r.choice([" ", "\n", "\t\r "]).join(r.choice(pool) for _ in range(r.randrange(1, 6)))) for _ in range(90)]
    odd = [(None, rows[0][1]), (None, rows[0][1]), (None, rows[1][1]), (7, None), (8, ""), (9, " \n"), (3, rows[3][1]), rows[4], rows[4], (60, "a b   " * 30)]
    check(spark, rows + odd, window)


def test_wrong_estimates_do_not_change_the_result(spark, monkeypatch):
    """A sketch of a few cells calls nearly all windows repeated; the exact grouping settles them."""
    monkeypatch.setattr(S, "shape", lambda docs: {"chunks": 5, "bits": 10, "block_bits": 6, "part_bits": 2})
    r = random.Random(4)
    texts = [" ".join(str(r.randrange(500)) for _ in range(200)) for _ in range(20)]
    rows = [(i, texts[i % 20] + f" end {i} " + texts[(i * 7) % 20][:150]) for i in range(60)]
    check(spark, rows, 20)


def test_empty_and_long(spark):
    assert S.deduplicated(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    check(spark, [(1, "x" * 3_000_000 + " y"), (2, "one word " * 30_000), (3, " ".join(map(str, range(30_000))))], 20)


def test_word_marks():
    r = random.Random(2)
    for _ in range(50):
        data = "".join(r.choice("ab \n\té\x0b ") for _ in range(r.randrange(0, 400))).encode()
        starts, ends = W.ranges(data)
        words = [data[a:b] for a, b in zip(starts, ends)]
        assert words == data.split()
        found = W.marks(data)
        assert len(set(zip(words, found.tolist()))) == len(set(words)) == len(set(found.tolist()))
    long = (b"q" * 300 + b" ") * 3 + b"z " * 400_000 + b"q" * 300
    found = W.marks(long)
    assert len(found) == 400_004 and len(set(found.tolist())) == 2 and found[0] == found[-1]
    assert (W.window_marks(found, 7)[3:400_003 - 7] == W.window_marks(found, 7)[3]).all()
    assert len(W.window_marks(np.arange(5, dtype=np.uint64), 6)) == 0
