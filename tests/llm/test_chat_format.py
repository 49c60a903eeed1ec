"""Preference formatting against a brute-force version."""

import random

from sitegauge.llm import chat_format as C


def render(turns):
    out, spans = "", []
    for role, text in turns:
        out += f"<|im_start|>{role}\n"
        start = len(out)
        out += text.replace("<|im_", "<\\|im_") + "<|im_end|>"
        if role == "assistant":
            spans.append((start, len(out)))
        out += "\n"
    return out, spans


def brute(chosen, rejected):
    k = 0
    while k < min(len(chosen), len(rejected)) and chosen[k] == rejected[k]:
        k += 1
    c, r = render(chosen[k:]), render(rejected[k:])
    return k, render(chosen[:k])[0], c[0], r[0], c[1], r[1]


def test_given_pairs_match_brute_force(spark):
    r = random.Random(3)
    texts = ["", "yes", "no <|im_end|> no", "é日😀", "line\nline"]
    convs = {i: [("user" if j % 2 == 0 else "assistant", r.choice(texts)) for j in range(r.randrange(1, 7))] for i in range(60)}
    rows = [(i, j, role, text) for i, turns in convs.items() for j, (role, text) in enumerate(turns)]
    r.shuffle(rows)
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 as turns", "2 as pair_id")
    pairs = [(n, r.randrange(60), r.randrange(60)) for n in range(200)] + [(900, 5, 5)]
    got = C.formatted(C.paired(C.conversations(table), spark.createDataFrame(pairs, "pair_id bigint, chosen_id bigint, rejected_id bigint"))).collect()
    assert len(got) == len(pairs)
    for row in got:
        want = brute(convs[row["chosen_id"]], convs[row["rejected_id"]])
        have = (row["n_common"], row["prompt"], row["chosen"], row["rejected"], [tuple(m) for m in row["chosen_mask"]], [tuple(m) for m in row["rejected_mask"]])
        assert have == want
        if row["pair_id"] == 900:
            assert row["chosen"] == row["rejected"] == ""


def test_next_answers_and_odd_rows(spark):
    rows = [
        (1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "q2"), (2, 0, "user", "q"), (2, 1, "assistant", "b"), (3, 0, "user", "only"),
        (4, None, "assistant", "late"), (4, 0, None, None), (4, 0, None, None), (5, 0, "assistant", None), (None, 0, "assistant", "x"), (None, 1, "user", "y"),
    ]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r["pair_id"]: r for r in C.formatted(C.next_answers(C.conversations(table))).collect()}
    assert {i: r["rejected_id"] for i, r in got.items()} == {1: 2, 2: 4, 4: 5, 5: 1}
    one = brute([("user", "q"), ("assistant", "a"), ("user", "q2")], [("user", "q"), ("assistant", "b"), ("user", "q2")])
    assert (got[1]["n_common"], got[1]["prompt"], got[1]["chosen"], got[1]["rejected"]) == one[:4]
    four = brute([("", ""), ("", ""), ("assistant", "late")], [("", ""), ("", ""), ("assistant", "")])
    assert (got[4]["n_common"], got[4]["prompt"], got[4]["chosen"], got[4]["rejected"]) == four[:4]
    assert C.formatted(C.next_answers(C.conversations(table.limit(0)))).count() == 0


def test_long_text(spark):
    table = spark.createDataFrame([(1, 0, "assistant", "x" * 3_000_000), (2, 0, "assistant", "y")], "conv_id bigint, turn bigint, role string, text string")
    row = C.formatted(C.next_answers(C.conversations(table))).first()
    assert len(row["chosen"]) > 3_000_000 and row["n_common"] == 0
    assert C.formatted(C.next_answers(C.conversations(table))).count() == 2


def test_gaps_between_ids_lose_no_pair(spark, monkeypatch):
    """Ids far apart, over many ranges; conversations without an answer between them; one alone makes no pair."""
    monkeypatch.setattr("sitegauge.llm.ordered.ROWS", 7)
    r = random.Random(8)
    ids = sorted(r.sample(range(-10**12, 10**12), 100))
    answered = [i for n, i in enumerate(ids) if n % 3]
    rows = [(i, 0, "user", "q") for i in ids] + [(i, 1, "assistant", f"a{i}") for i in answered]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = C.next_answers(C.conversations(table)).collect()
    assert {g["pair_id"]: g["rejected_id"] for g in got} == dict(zip(answered, answered[1:] + answered[:1]))
    assert all(g["rejected"][1]["text"] == f"a{g['rejected_id']}" and g["chosen"][1]["text"] == f"a{g['pair_id']}" for g in got)
    alone = table.where(f"conv_id = {answered[0]}")
    assert C.next_answers(C.conversations(alone)).count() == 0
