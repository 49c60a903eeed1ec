"""Temperature mixing: exponent, budgets, occurrences, repeated rows."""

import math
import random
from collections import Counter

from sitegauge.llm import mixing as M


def table(spark, sizes, seed=1):
    r = random.Random(seed)
    rows, i = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((i, " ".join("w" for _ in range(r.randrange(1, 30))), source))
            i += 1
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)


def weights(tokens, alpha):
    total = sum(t**alpha for t in tokens.values())
    return {s: t**alpha / total for s, t in tokens.items()}


def entropy(tokens, alpha):
    w = weights(tokens, alpha).values()
    return -sum(x * math.log(x) for x in w) / math.log(len(tokens))


def tokens_of(docs):
    return {r["source"]: r["t"] for r in docs.selectExpr("source", "size(split(text, ' ')) as n").groupBy("source").agg({"n": "sum"}).withColumnRenamed("sum(n)", "t").collect()}


def test_exponent_is_the_edge_of_the_limits(spark):
    docs = table(spark, {"a": 200, "b": 40, "c": 11, "d": 3})
    tokens = tokens_of(docs)
    totals = M.source_totals(M.token_counts(docs))
    most = lambda alpha: max((t / max(tokens.values())) ** (alpha - 1) for t in tokens.values())
    by_epochs = M.exponent(totals, M.Mix(max_epochs=3.0))
    assert most(by_epochs) <= 3.0 < most(by_epochs - 1 / M.GRID)
    by_entropy = M.exponent(totals, M.Mix(max_epochs=None, target_entropy=0.9))
    assert entropy(tokens, by_entropy) >= 0.9 > entropy(tokens, by_entropy + 1 / M.GRID)
    assert M.exponent(totals, M.Mix(max_epochs=3.0, target_entropy=0.99)) == by_epochs
    assert M.exponent(totals, M.Mix(max_epochs=None)) == 1.0
    assert M.exponent(totals, M.Mix(max_epochs=1e9)) == 0.0


def test_covering_mix_reads_whole_passes(spark):
    docs = table(spark, {"a": 120, "b": 30, "c": 9})
    rows = M.mix_rows(docs, M.Mix(max_epochs=2.5, block_tokens=500)).collect()
    tokens, got = tokens_of(docs), Counter()
    for r in rows:
        got[r["source"]] += r["n_tokens"]
    first = Counter(r["doc_id"] for r in rows if r["epoch"] == 0)
    assert set(first.values()) == {1} and len(first) == 159
    alpha = M.exponent(M.source_totals(M.token_counts(docs)), M.Mix(max_epochs=2.5))
    for s, t in tokens.items():
        budget = math.floor(t * (t / max(tokens.values())) ** (alpha - 1) + 0.5)
        assert budget <= got[s] < budget + 30
    blocks = Counter((r["block"], r["source"]) for r in rows)
    n_blocks = max(b for b, _ in blocks) + 1
    for s in "ab":  # each block holds its share of each source
        held = [sum(r["n_tokens"] for r in rows if r["block"] == b and r["source"] == s) for b in range(n_blocks)]
        assert max(held) - min(held) <= 60
    copies = Counter(r["doc_id"] for r in rows)
    repeated = Counter(r["doc_id"] for r in M.mixed_documents(docs, M.Mix(max_epochs=2.5)).collect())
    assert repeated == copies


def test_budget(spark):
    docs = table(spark, {"a": 120, "b": 30})
    rows = M.mix_rows(docs, M.Mix(max_epochs=None, budget=400)).collect()
    assert 400 <= sum(r["n_tokens"] for r in rows) < 460
    assert Counter(r["doc_id"] for r in M.mixed_documents(docs, M.Mix(max_epochs=None, budget=400)).collect()) == Counter(r["doc_id"] for r in rows)


def test_odd_rows(spark):
    rows = [(1, "a b", None), (1, "a b", None), (None, None, "s"), (2, "", "empty"), (3, "x " * 100_000, "s")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "1 as tokens", "2 as passes", "3 as bucket")
    out = M.mixed_documents(docs)
    assert out.columns == docs.columns
    got = Counter((r["doc_id"], r["source"]) for r in out.collect())
    assert set(got) == {(1, None), (None, "s"), (2, "empty"), (3, "s")} and got[2, "empty"] == got[3, "s"] == 1 and got[1, None] == 4
    assert M.mixed_documents(docs.limit(0)).count() == M.mix_rows(docs.limit(0)).count() == 0
