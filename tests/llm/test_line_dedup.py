"""Line dedup: brute force, hot keys, bitmaps, odd rows."""

import random

from sitegauge.llm import line_dedup as L

BLANKS = " \t\n\x0b\x0c\r"
LOWER = {ord(c): c.lower() for c in L.UPPER}


def brute(rows):
    key = lambda line: line.strip(BLANKS).translate(LOWER)
    rank = lambda d: L.LAST if d is None else d
    docs = {}
    for d, text in rows:
        for line in (text or "").split("\n"):
            docs.setdefault(key(line), set()).add(rank(d))
    out = []
    for d, text in rows:
        lines = (text or "").split("\n")
        keep = [not (len(key(x)) >= 10 and len(docs[key(x)]) > 1 and rank(d) > min(docs[key(x)])) for x in lines]
        out.append((d, len(lines), keep.count(False), "\n".join(x for x, k in zip(lines, keep) if k), keep))
    return out


def runs(keep):
    out, on, n = [], True, 0
    for k in keep:
        if k != on:
            out.append(n)
            on, n = k, 0
        n += 1
    return [*out, n]


def compare(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as rank", "'x' as line").repartition(4)
    got = L.deduplicated(docs).collect()
    want = sorted(((str(d), n, k, t, runs(b)) for d, n, k, t, b in brute(rows)), key=repr)
    assert sorted(((str(r["doc_id"]), r["n_lines"], r["n_dropped"], r["text"], list(r["keep_runs"])) for r in got), key=repr) == want
    maps = L.keep_bitmaps(docs).collect()
    assert sorted((str(r["doc_id"]), r["n_lines"], r["n_dropped"], list(r["keep_runs"])) for r in maps) == sorted((d, n, k, b) for d, n, k, _, b in want)


def test_random_documents(spark):
    r = random.Random(8)
    pool = ["a line of text %d" % i for i in range(30)] + ["short", "", " A LINE of text 3\t", "é line of text", "exactly 10", "123456789 "]
    rows = [(r.randrange(60), "\n".join(r.choice(pool) for _ in range(r.randrange(1, 9)))) for _ in range(150)]
    compare(spark, [*rows, (None, "a line of text 1\nown line of none"), (None, None), (7, ""), (8, "\n\n")])


def test_hot_line_is_decided_without_its_exchange(spark, monkeypatch):
    monkeypatch.setattr(L, "SAMPLE_SHARE", 1.0)
    rows = [(i, f"the hot line of all\nline number {i} here\nTHE hot line of all ") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert L.hot_keys(docs, 10).count() == 1
    compare(spark, rows)


def test_empty_and_long(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert L.deduplicated(docs).count() == 0
    compare(spark, [(1, "x" * 2_000_000), (2, "x" * 2_000_000 + "\nrest of the text"), (3, "\n".join(["many lines of it"] * 20_000))])
