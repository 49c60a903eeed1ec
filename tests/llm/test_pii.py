"""Personal data: base spans against Python's regular expressions, votes, training, added spans."""

import hashlib
import random
import re

from sitegauge.llm import pii as P

SF = "/root/testdata/sf0.01"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(number):
    values = [int(c) for c in reversed(number)]
    return (sum(values[0::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def passes(kind, value):
    number = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 16 <= len(number) <= 19 and luhn(number)
    return kind == "email" or 8 <= len(number) <= 15


def brute(text):
    return [
        (kind, m.start(), m.end()) for kind, pattern in PATTERNS.items() for m in re.finditer(pattern, text or "") if passes(kind, m.group())
    ]


def check(rows, got):
    for (_, text), row in zip(rows, got):
        spans = brute(text)
        assert [row[f"n_{k}"] for k in P.KINDS] == [sum(s[0] == k for s in spans) for k in P.KINDS], (text, row)
        want = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert row["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), (text[:200], want, row)
        assert set(filter(None, want.split(","))) <= set(row["spans"].split(","))


def test_base_spans_match_brute_force(spark):
    r = random.Random(4)
    pieces = ["a@b.co", "x.y_z@m-n.o.p", "@", ".", "..", "1.2.3.4", "256.1.1.1", "001.002.003.0255", "1.2.3.4.5.6.7.8", "4111111111111111", " ", "-", "+",
              "4111 1111 1111 1111", "+1 (569) 555-6633", "+49.30.1234567", "é", "日本", "_e@f.g", "12", "9", "(", ")", "\n", "a", "😀", "+1", "0"]
    rows = [(i, "".join(r.choice(pieces) for _ in range(r.randrange(1, 14)))) for i in range(1500)]
    rows += [(5000, None), (5001, ""), (5002, "7" * 50_000), (5003, "a" * 50_000 + "@"), (5004, "1 " * 20_000), (5005, "+" + "1 " * 9), (5006, "a@b." * 2000 + "c")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as spans", "2 as base")
    got = sorted(P.digest(P.find(docs)).collect(), key=lambda x: x["doc_id"])
    check(rows, got)


def test_base_spans_of_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id")
    rows = [(x["doc_id"], x["text"]) for x in docs.collect()]
    check(rows, sorted(P.digest(P.find(docs)).collect(), key=lambda x: x["doc_id"]))


def test_method_adds_what_strict_patterns_run_over(spark):
    both = "ouah +1 (569) 555-6633 4795326016703902 thre"
    rows = [(i, f"text {i} with card 4111111111111111 here and +1 (569) 555-66{i:02d} there") for i in range(60)]
    rows += [(100, both), (101, 'token = "f17524f7594f8e408f2f4107082864557a78a90"'), (102, "order 1234567890123456 of today")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {x["doc_id"]: x["spans"] for x in P.digest(P.find(docs)).collect()}
    assert got[100] == "card:23:39,phone:5:22"
    assert got[101] == "" and got[102] == ""


def test_reliabilities_find_the_good_labelers():
    r = random.Random(9)
    counts = {}
    for _ in range(4000):
        true = r.random() < 0.6
        right = lambda share: (2 if true else 1) if r.random() < share else (1 if true else 2)
        votes = (right(0.95), right(0.9), right(0.55) if r.random() < 0.5 else 0, right(0.85))
        counts[votes] = counts.get(votes, 0) + 1
    share, rates, posterior = P.reliabilities(sorted(counts.items()))
    assert abs(share - 0.6) < 0.05
    assert rates[0][1][2] > 0.9 and rates[2][1][2] < 0.5
    assert posterior[2, 2, 2, 2] > 0.99 > 0.01 > posterior[1, 1, 1, 1]


def test_nothing_to_train_on(spark):
    docs = spark.createDataFrame([(1, "plain"), (1, "plain"), (None, None)], "doc_id bigint, text string")
    assert [x["spans"] for x in P.digest(P.find(docs)).collect()] == ["", "", ""]
    assert P.find(docs.limit(0)).count() == 0
