"""Quality measures against brute force, divergence, odd rows."""

import random
import re

import numpy as np
from sitegauge.llm import quality as Q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = {p for i, w in enumerate(windows) if windows.count(w) > 1 for p in range(i, i + 5)}
    lines = text.split("\n")
    dups = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(hit)


def test_counts_match_brute_force():
    r = random.Random(6)
    for _ in range(400):
        text = "".join(r.choice(["a", "b", "é", "日本", "#", "|", "\n", "\n", "\t", " ", " ", "word", "\x0b", " "]) for _ in range(r.randrange(0, 90)))
        assert Q.measure(text, "en", None, Q.Rules())[:5] == brute(text)


def test_windows_of_large_vocabularies():
    r = random.Random(2)
    words = [f"w{r.randrange(9000)}" for _ in range(20_000)]
    words[500:520] = words[9000:9020]
    assert Q.repeated_words(words) == 40


def test_distance():
    p, q = np.array([1.0, 2, 3]), np.array([2.0, 4, 6])
    assert Q.js_distance(p, q) == 0.0
    assert Q.js_distance(np.array([1.0, 0]), np.array([0, 1.0])) == 1.0


def prose(seed, n=120):
    r = random.Random(seed)
    return " ".join(r.choice("the of and to in that was house river walked quietly over green fields".split()) for _ in range(n)).capitalize() + "."


def test_strange_texts_are_rejected(spark):
    rows = [(i, prose(i), "en") for i in range(40)]
    shouting = " ".join(w.upper() + "!!" for w in prose(77).split())
    symbols = " ".join(w + "###$$$" for w in prose(78).split())
    rows += [(100, shouting, "en"), (101, symbols, "en"), (102, "too short", "en"), (103, "again and again it goes on " * 30, "en"), (104, "SHORT BUT LOUD!! " + "one two three four five six seven", "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").selectExpr("*", "1 as kept", "'x' as key").repartition(3)
    got = {r["doc_id"]: r for r in Q.judge(docs).collect()}
    assert [i for i in got if not got[i]["kept"]] and {i for i in got if not got[i]["kept"]} == {100, 101, 102, 103}
    assert {i for i in got if got[i]["base_failed"]} == {102, 103}
    assert {r["doc_id"] for r in Q.judge(docs, only_kept=True).collect()} == set(got) - {100, 101, 102, 103}
    assert Q.judge(docs, only_kept=True).columns == docs.columns


def test_odd_rows(spark):
    rows = [(1, None, None), (1, None, None), (None, "", "en"), (2, prose(1), "tlh"), (3, "x" * 500_000, "fr")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = Q.judge(docs).collect()
    assert len(got) == 5 and [r["kept"] for r in got if r["doc_id"] == 2] == [True]
    assert Q.judge(docs.limit(0)).count() == 0


def test_every_language_has_its_own_reference(spark, monkeypatch):
    """Clean texts of two scripts beside each other stay, in any mix; a text in the script of another language goes."""
    r = random.Random(9)
    latin = lambda: " ".join(r.choice("casa della sera molto bello andare quando insieme sempre strada".split()) for _ in range(120)) + "."
    cyrillic = lambda: " ".join(r.choice("дом вечер очень красивый идти когда вместе всегда улица ночь".split()) for _ in range(120)) + "."
    for most in (Q.MOST_LANGUAGES, 1):
        monkeypatch.setattr(Q, "MOST_LANGUAGES", most)
        for n_latin, n_cyrillic in ((25, 25), (45, 12), (12, 45)):
            rows = [(i, latin(), "it") for i in range(n_latin)] + [(100 + i, cyrillic(), "ru") for i in range(n_cyrillic)]
            rows += [(200, cyrillic(), "it"), (201, cyrillic(), None), (202, latin(), "one of a kind"), (203, latin(), "ru")]
            docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").selectExpr("*", "1 as chars", "2 as n").repartition(3)
            got = Q.judge(docs, keep=["doc_id", "chars", "n"])
            assert {x["doc_id"] for x in got.where("NOT kept").collect()} == {200, 203} and got.count() == len(rows)
