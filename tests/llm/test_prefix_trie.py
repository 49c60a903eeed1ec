"""Prefix trie: brute force on random conversations, with ranges of a few rows so that every key spans several."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from sitegauge.llm import ordered as O
from sitegauge.llm import prefix_trie as P


def rebuilt(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(v)] for c, v in convs.items()}
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in convs}
    return convs, {c: convs.get(c - c % 100, [])[:h[c]] + own[h[c]:] for c, own in convs.items()}


def brute(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
        ends[tuple(convs[c])].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, cs in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(cs) - 1) * (len(p[-1][1]) if p else 0)
    sha = lambda p: hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()
    return sorted((cs[0], len(p), members[p[:-1]][0] if p else None, len(cs), kids[p], leaves[p], saved[p], sha(p)) for p, cs in members.items())


def check(spark, rows, shared=True):
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "'x' as depth", "1 as part", "2 as seq").repartition(3)
    turns = P.turn_marks(table)
    own, heads = rebuilt(rows)
    got = [tuple(r) for r in P.trie(P.with_shared_heads(turns) if shared else P.as_they_are(turns)).collect()]
    assert sorted(got, key=lambda r: r[:2]) == sorted(brute(heads if shared else own), key=lambda r: r[:2])


@pytest.mark.parametrize("per_range", [3, 17, 50_000])
def test_random_conversations(spark, monkeypatch, per_range):
    monkeypatch.setattr(O, "ROWS", per_range)
    r = random.Random(per_range)
    few = per_range < 10
    rows = []
    for c in [*range(0, 8 if few else 60), *range(100, 105 if few else 130), 207, 399]:
        for t in range(r.randrange(0, 5 if few else 9)):
            rows.append((c, t, r.choice(["user", "assistant", None]), r.choice(["a", "bb", "", None, "long"])))
    rows += [(3, None, "user", "first"), (4, 1, "user", "a"), (4, 1, "user", "a"), (None, 1, "user", "a")]
    check(spark, rows)
    check(spark, rows, shared=False)


def test_one_long_conversation_and_many_copies(spark, monkeypatch):
    monkeypatch.setattr(O, "ROWS", 40)
    monkeypatch.setattr(P, "PIECE", 7)
    rows = [(5, t, "user", f"turn {t}") for t in range(300)] + [(6, t, "user", f"turn {t}") for t in range(150)]
    rows += [(1000 + i, 0, "user", "same") for i in range(90)] + [(2000 + i, 0, "user", f"child {i}") for i in range(60)]
    check(spark, rows, shared=False)


def test_empty_and_turnless(spark):
    check(spark, [])
    check(spark, [(None, 1, "user", "a")])
    lonely = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 == 3)
    check(spark, [(lonely, 0, "user", "x"), (lonely, 1, "user", "y" * 500_000)])  # no conversation 100: left without turns
