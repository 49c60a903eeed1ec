"""Periodic runs: brute force over all lags, on random, periodic and odd texts."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sitegauge.llm import period_runs as P
from sitegauge.llm import queries
from sitegauge.llm import words as W


def brute(words, least=12):
    out, n = set(), len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, 2 * q):
                piece = words[i:i + length]
                if not any(all(piece[x] == piece[x + d] for x in range(length - d)) for d in range(1, q)):
                    out.add((i, i + length, q))
            i = max(j, i + 1)
    return out


def found(words, least=12, scale=16):
    ids = {w: W.marks(str(w).encode())[0] for w in set(words)}
    array = np.array([*(ids[w] for w in words), 0], np.uint64)
    runs = P.runs_of(array, [len(words)], least, scale)
    assert len(runs) == len(set(runs))
    return set(runs)


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


@pytest.mark.parametrize("scale", [4, 8, 16])
def test_random_and_structured_texts(scale):
    r = random.Random(scale)
    texts = [fibonacci(300), list("ab" * 50 + "a" + "ab" * 60 + "a"), ["x"] * 200, list("aab" * 30 + "aba" * 40), list(("a" * 70 + "b") * 3)]
    texts += [list("ab" * n + "a" + "ab" * m) for n, m in ((40, 40), (41, 60), (60, 33))] + [list(("abc" * 30 + "ab") * 2)]
    for _ in range(60):
        text = []
        while len(text) < 250:
            block = [r.choice("abc") for _ in range(r.randrange(1, 60))]
            text += (block * r.randrange(1, 5))[:r.randrange(1, 240)]
        texts.append(text)
    texts += [[r.choice("ab") for _ in range(220)] for _ in range(20)]
    for text in texts:
        assert found(text, scale=scale) == brute(text), "".join(text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("ab"), min_size=1, max_size=12), st.integers(1, 9)), min_size=1, max_size=8))
def test_repeated_blocks(parts):
    text = [w for block, n in parts for w in block * n]
    assert found(text, scale=4) == brute(text)


def test_texts_of_a_table(spark):
    r = random.Random(1)
    pool = ["uno", "dos", "trés", "quattuor"]
    texts = [" ".join(r.choice(pool) for _ in range(r.randrange(0, 90))) for _ in range(40)]
    texts += [None, "", " \n\t", "same " * 500, ("many words in a row of eleven, then again one more " * 9).replace(" a ", "\n"), "x" * 1_000_000 + " y", "a b"]
    rows = [(i % 40, t, "z") for i, t in enumerate(texts)] + [(None, "q w " * 20, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, runs string").repartition(3)
    got = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in P.find(docs).collect()]
    want = []
    for d, text, _ in rows:
        words = [w.decode() for w in (text or "").encode().split()]
        runs = sorted(brute(words), key=lambda x: (x[0], x[2]))
        gone = {i for s, e, q in runs for i in range(s + q, e)}
        want.append((d, len(words), [(s, e - s, q) for s, e, q in runs], " ".join(w for i, w in enumerate(words) if i not in gone)))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert P.digest(P.find(docs.limit(0))).count() == 0


def test_long_text_with_long_periods():
    r = random.Random(3)
    block = [r.randrange(5000) for _ in range(7001)]
    text = [r.randrange(5000) for _ in range(900)] + block * 3 + block[:500]
    assert (900, 900 + 3 * 7001 + 500, 7001) in found(text) or any(q == 7001 and e >= 900 + 3 * 7001 + 500 for _, e, q in found(text))


def test_query_against_brute_force(spark):
    import hashlib
    import zlib

    import duckdb

    sf_dir = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet' WHERE length(text) < 6000").fetchall()
    got = {r["doc_id"]: r for r in queries.op13_period_runs(spark, sf_dir).collect()}
    assert len(got) == len(duckdb.sql(f"SELECT doc_id FROM '{sf_dir}/documents.parquet'").fetchall())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    planted = 0
    for d, text in rows:
        words = [w.decode() for w in (text or "").encode().split()]
        n, h = len(words), zlib.crc32(str(d).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
            planted += 1
        runs = sorted(brute(words), key=lambda x: (x[0], x[2]))
        gone = {i for s, e, q in runs for i in range(s + q, e)}
        r = got[d]
        assert r["n_runs"] == len(runs)
        assert r["runs_sha256"] == sha("".join(f"{s},{e - s},{q}\n" for s, e, q in runs))
        assert r["collapsed_sha256"] == sha(" ".join(w for i, w in enumerate(words) if i not in gone))
        best = min(runs, key=lambda x: (x[0] - x[1], x[0], x[2]), default=None)
        assert (r["start"], r["length"], r["period"]) == ((best[0], best[1] - best[0], best[2]) if best else (None, None, None))
        assert r["exponent_milli"] == (1000 * (best[1] - best[0]) // best[2] if best else None)
    assert planted > 5
