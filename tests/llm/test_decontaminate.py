"""Suffix automaton against brute force; removal, blocks, odd rows."""

import random
import re

from sitegauge.llm import decontaminate as D


def brute(doc, items, window):
    hit, got = set(), set()
    for item, words in items:
        n = min(window, len(words))
        wins = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else ()
        for i in range(len(doc) - n + 1):
            if tuple(doc[i : i + n]) in wins:
                hit |= set(range(i, i + n))
                got.add(item)
    return hit, got


def test_automaton_matches_brute_force():
    r = random.Random(3)
    for _ in range(1500):
        kinds, window = r.choice((2, 3, 6)), r.choice((2, 3, 4, 5))
        make = lambda n: [b"%d" % r.randrange(kinds) for _ in range(n)]
        items = [(str(k), make(r.randrange(0, 9))) for k in range(r.randrange(0, 7))]
        doc = make(r.randrange(0, 30))
        spans, found = D.Automaton(items, window).hits(doc)
        assert ({p for a, b in spans for p in range(a, b)}, found) == brute(doc, items, window)


def test_removal():
    text = "Keep this, One-two (three) FOUR! and that é."
    assert D.words_of(text)[2:6] == [b"one", b"two", b"three", b"four"]
    assert D.without_words(text, [(2, 6)]) == "Keep this, ! and that é."
    assert D.without_words(text, [(0, 1), (8, 9)]) == " this, One-two (three) FOUR! and that ."


def corpus():
    r = random.Random(5)
    words = [f"w{i}" for i in range(50)]
    items = [(i, " ".join(r.choice(words) for _ in range(r.choice((3, 12, 30))))) for i in range(30)] + [(90, None), (91, "..."), (92, "w1")]
    docs = []
    for i in range(120):
        text = " ".join(r.choice(words[:20] + ["other"] * 20) for _ in range(r.randrange(0, 60)))
        if r.random() < 0.4:
            text += ". " + items[r.randrange(30)][1].upper() + "! end of it " + "more " * r.randrange(40)
        docs.append((i, text))
    return docs, items


def test_report_in_blocks_equals_brute_force(spark):
    docs, items = corpus()
    table = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    coded = [(str(i), D.words_of(t)) for i, t in items]
    for block_words in (D.BLOCK_WORDS, 60):
        assert (len(D.item_blocks(bench, "item_id", "text", 10, block_words)) > 1) == (block_words == 60)
        got = {r["doc_id"]: r for r in D.report(table, bench, block_words=block_words).collect()}
        for i, text in docs:
            hit, found = brute(D.words_of(text), coded, 10)
            assert (got[i]["n_hit"], got[i]["n_items"], got[i]["contaminated"]) == (len(hit), len(found), bool(hit))


def test_cleaned_documents_hold_no_window(spark):
    docs, items = corpus()
    items = [(i, t) for i, t in items if t and len(t.split()) >= 10]
    table = spark.createDataFrame([(i, t, len(t)) for i, t in docs], "doc_id bigint, text string, n_chars bigint")
    out = D.decontaminate(table, spark.createDataFrame(items, "item_id bigint, text string"), length="n_chars")
    rows, coded = out.collect(), [(str(i), D.words_of(t)) for i, t in items]
    assert out.columns == table.columns
    for r in rows:
        assert r["n_chars"] == len(r["text"]) and not brute(D.words_of(r["text"]), coded, 10)[0]
    whole = dict(docs)
    for i in set(whole) - {r["doc_id"] for r in rows}:
        words = D.words_of(whole[i])
        assert len(brute(words, coded, 10)[0]) > 0.5 * len(words)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (1, None), (None, ""), (2, "a b c " * 60_000)], "doc_id bigint, text string").selectExpr("*", "1 as hit_spans")
    bench = spark.createDataFrame([(None, "a b c a b c a b c a b"), (7, "a b c a b c a b c a b")], "item_id bigint, text string")
    got = D.report(docs, bench).collect()
    assert [r["n_words"] for r in got] == [0, 0, 0, 180_000] and got[3]["n_hit"] == 179_999 and got[3]["n_items"] == 2
    assert D.decontaminate(docs, bench).count() == 3
    assert D.decontaminate(docs, bench.limit(0)).count() == 4 and D.report(docs.limit(0), bench).count() == 0
    assert re.fullmatch("[0-9a-f]{64}", got[0]["items_sha256"])


def test_one_automaton_at_a_time(monkeypatch):
    import gc
    import weakref

    live, most = weakref.WeakSet(), []

    class Counted(D.Automaton):
        def __init__(self, *args):
            super().__init__(*args)
            live.add(self)
            gc.collect()
            most.append(len(live))

    monkeypatch.setattr(D, "Automaton", Counted)
    blocks = [[(str(b), " ".join(f"w{b}x{i}" for i in range(30)))] for b in range(12)]
    text = "before " + blocks[3][0][1] + " between " + blocks[9][0][1]
    assert D.hits_of([[text, None], [""]], blocks, 10, None) == [([[(1, 31), (32, 62)], []], [["3", "9"], []]), ([[]], [[]])]
    assert len(most) == 12 and max(most) == 1


def test_long_items_are_cut_without_loss(spark):
    words = [f"w{i}" for i in range(500)]
    bench = spark.createDataFrame([(1, " ".join(words)), (2, "a b c"), (3, None)], "item_id int, text string")
    docs = spark.createDataFrame([(i, " ".join(words[i:i + 10])) for i in range(0, 491, 7)] + [(1000, " ".join(words[40:400])), (1001, "x a b c y")], "doc_id bigint, text string")
    for block_words in (D.BLOCK_WORDS, 60, 20):
        got = {r["doc_id"]: r for r in D.report(docs, bench, block_words=block_words).collect()}
        assert all(got[i]["n_hit"] == 10 and got[i]["n_items"] == 1 for i in range(0, 491, 7))
        assert (got[1000]["n_hit"], got[1001]["n_hit"], got[1001]["n_items"]) == (360, 3, 1)
