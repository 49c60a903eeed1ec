"""Lookup table and placement."""

from collections import Counter

import pytest
from sitegauge.llm import sharding as S


def brute_table(shards, size):
    orders = []
    for s in shards:
        offset, stride = S.preference(s, size)
        orders.append([(offset + j * stride) % size for j in range(size)])
    owner, turn = {}, 0
    while len(owner) < size:
        shard = turn % len(shards)
        owner[next(p for p in orders[shard] if p not in owner)] = shard
        turn += 1
    return [owner[i] for i in range(size)]


def test_table_is_even_and_as_the_rule_says():
    names = [f"s{i}" for i in range(7)]
    table = S.permutation_table(names, 503)
    assert table == brute_table(names, 503)
    counts = Counter(table).values()
    assert max(counts) - min(counts) <= 1


def test_few_slots_move():
    names = [f"s{i}" for i in range(10)]
    before, after = S.permutation_table(names, 1009), S.permutation_table(names[:-1], 1009)
    moved = sum(names[a] != names[b] for a, b in zip(before, after) if names[a] != "s9")
    assert moved < 0.2 * 1009


@pytest.mark.parametrize("shards, size", [([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 2), (["a"], (1 << 20) + 7)])
def test_bad_tables(shards, size):
    with pytest.raises(ValueError):
        S.permutation_table(shards, size)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (None, None)], "doc_id bigint, slot string")
    got = S.place(docs, "doc_id", ["x", "y", "z"], 31)
    assert got.columns == ["doc_id", "slot", "shard"]
    rows = got.collect()
    assert len(rows) == 4 and len({(r["doc_id"], r["slot"], r["shard"]) for r in rows}) == 2
    assert S.place(docs.limit(0), "doc_id", ["x"], 31).count() == 0
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
