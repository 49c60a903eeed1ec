"""Signature-tree similarity join against brute force."""

import random
import re

import numpy as np
from sitegauge.llm import ngram_join as J
from sitegauge.llm.graph import components


def brute_links(sets, percent=75):
    out = set()
    for i in range(len(sets)):
        for j in range(i + 1, len(sets)):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                out.add((i, j))
    return out


def brute_sets(texts, ngram=5):
    upper = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    out = []
    for t in texts:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(upper)) if w]
        k = min(ngram, len(words))
        out.append({tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set())
    return out


def brute_components(ids, sets):
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in brute_links(sets):
        root[find(j)] = find(i)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return [least[find(i)] for i in range(len(sets))]


def corpus(seed, families=12):
    """Families of near copies of many sizes, shared passages, short and empty texts."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(r.choice(words) for _ in range(40))
    texts = [None, "", " \n\t", "one", "One", "one two three", "one two\tthree", "é à ü ö ñ", "É à ü ö ñ"]
    for _ in range(families):
        base = [r.choice(words) for _ in range(r.choice((6, 20, 60, 200, 900)))]
        for _ in range(r.choice((1, 3, 12, 40))):
            copy = list(base)
            for _ in range(r.randrange(0, 1 + len(copy) // 25)):
                copy[r.randrange(len(copy))] = r.choice(words)
            if r.random() < 0.3:
                copy = copy[: int(len(copy) * r.uniform(0.7, 1.0)) + 1]
            text = " ".join(copy)
            texts.append(text + " " + passage if r.random() < 0.3 else text)
    return texts


def test_trees_lose_no_link():
    hashes = J.WordHashes()
    for seed in range(4):
        texts = [t for t in corpus(seed) if (t or "").split()]
        sets = [J.ngram_set(t, hashes) for t in texts]
        wanted = brute_links([set(s.tolist()) for s in sets])
        for blocks in (1, 3):
            block = [i % blocks for i in range(len(sets))]
            found, roots = set(), J.Roots(len(sets))
            for x in range(blocks):
                for y in range(x, blocks):
                    at = [i for i in range(len(sets)) if block[i] in (x, y)]
                    given = [len(sets[i]) for i in at], [int(sets[i][:1].view(np.int64)[0]) for i in at], [block[i] for i in at], [J.bitmap(sets[i]) for i in at]
                    found |= {(min(at[i], at[j]), max(at[i], at[j])) for i, j in J.list_pairs(*given, 75)}
            assert wanted <= found
            assert len(found) < len(sets) ** 2 / 4
        checked = 0
        for i, j in J.list_pairs([len(s) for s in sets], [int(s[:1].view(np.int64)[0]) for s in sets], [0] * len(sets), [J.bitmap(s) for s in sets], 75, roots):
            checked += 1
            if (min(i, j), max(i, j)) in wanted:
                roots.up[roots.find(i)] = roots.find(j)
        assert all(roots.find(i) == roots.find(j) for i, j in wanted) and checked < len(found)


def test_bound_and_prefix_are_safe():
    r = np.random.default_rng(5)
    for _ in range(300):
        n = int(r.integers(1, 80))
        a = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[r.random(len(a)) < 0.9], r.integers(0, 1 << 63, int(r.integers(0, 9))).astype(np.uint64)]))
        if not len(b):
            continue
        both = len(np.intersect1d(a, b))
        assert J.bound(J.bitmap(a), len(a), J.bitmap(b), len(b)) >= both
        if J.enough(both, len(a), len(b)):
            assert set(a[: J.prefix_length(len(a), 75)].tolist()) & set(b[: J.prefix_length(len(b), 75)].tolist())


def test_components_of_stars_chains_and_rings(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 201), (201, 202), (202, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 130)} | {201: 200, 202: 200}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_groups_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_TOKENS", 2000)  # lists are cut into several blocks
    monkeypatch.setattr(J, "BROADCAST_ROWS", 3)
    texts = corpus(11)
    random.Random(2).shuffle(texts)
    ids = [3 * i + 1 for i in range(len(texts))]
    rows = [(i, t, None, 0) for i, t in zip(ids, texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, prefix string, mark int").repartition(5)
    got = {r["doc_id"]: r for r in J.groups(docs).collect()}
    sets = brute_sets(texts)
    assert [got[i]["n_shingles"] for i in ids] == [len(s) for s in sets]
    assert [got[i]["component_id"] for i in ids] == brute_components(ids, sets)
    kept = {r["doc_id"] for r in J.one_of_each(docs).collect()}
    assert kept == {i for i in ids if got[i]["component_id"] == i}


def test_odd_rows(spark):
    rows = [(5, "a b c d e f g"), (5, "a b c d e f g"), (5, "other words that link with nothing at all"), (None, "A b c d e f g"), (None, None), (None, "x y z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in J.groups(docs).collect())
    assert got == sorted([("5", 3, "5"), ("5", 3, "5"), ("5", 4, "5"), ("None", 3, "5"), ("None", 0, "None"), ("None", 1, "None")])
    assert J.groups(docs.limit(0)).count() == 0
    long = " ".join(str(i) for i in range(60_000))
    docs = spark.createDataFrame([(1, long), (2, long + " end")], "doc_id bigint, text string")
    assert [r["component_id"] for r in J.groups(docs).collect()] == [1, 1]


def test_one_row_of_each_group_stays(spark):
    same, near = " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}" for i in range(59))
    rows = [(1, same, "x"), (1, same, "y"), (1, near, "z"), (2, same, "x"), (None, same, "x")]  # one group
    rows += [(None, "alone " + " ".join(f"v{i}" for i in range(40)), "p")] * 3  # no id at all, repeated whole
    rows += [(None, " ".join(f"u{i}" for i in range(40)), "p"), (None, " ".join(f"u{i}" for i in range(41)), "q"), (None, " ".join(f"u{i}" for i in range(41)), None)]
    rows += [(9, "", "e"), (9, "", "e"), (None, None, "e"), (None, None, "e")]  # no words: in no group
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, root string").repartition(4)
    got = sorted((str(r["doc_id"]), (r["text"] or "")[:2], r["root"] or "") for r in J.one_of_each(docs).collect())
    assert [g[:2] for g in got] == [("1", "w0"), ("9", ""), ("9", ""), ("None", ""), ("None", ""), ("None", "al"), ("None", "u0")]
    again = sorted((str(r["doc_id"]), (r["text"] or "")[:2], r["root"] or "") for r in J.one_of_each(docs.repartition(7)).collect())
    assert again == got
