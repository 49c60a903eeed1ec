"""Phrases on a site's pages by a positional index: against plain containment, on a large site, and what its exchanges carry."""

import random
import re

from pyspark.sql import functions as F

from fixtures import frame
from sitegauge.operators import phrases as PH
from sitegauge.plans import answer_engine as A

TEXTS = "site_id string, page bigint, own boolean, text string"


def test_agrees_with_containment(spark):
    r = random.Random(5)
    words = ["ab", "abc", "b", "é", "7", "zz", "cab"]
    gaps = [" ", ", ", "-", "  ", ". ", ""]
    text = lambda n: "".join(r.choice(words) + r.choice(gaps) for _ in range(r.randrange(n)))
    texts = [{"site_id": r.choice("st"), "page": i, "own": r.random() < 0.5, "text": r.choice(["", " ", "--"]) + text(14)} for i in range(40)]
    texts.append({"site_id": "s", "page": 99, "own": True, "text": None})
    wanted = {(r.choice("stu"), p) for _ in range(150) for p in [text(4), text(3)[1:], (text(5) + "x")[:-2], r.choice(gaps)]}
    asked = frame(spark, [{"site_id": s, "phrase": p} for s, p in sorted(wanted)], "site_id string, phrase string")
    got = {(x.site_id, x.phrase): x.on_site for x in PH.shown(frame(spark, texts, TEXTS), asked).collect()}
    want = {}
    for s, p in wanted:
        hits = [t["own"] for t in texts if t["site_id"] == s and p and p in (t["text"] or "")]
        if hits:
            want[s, p] = any(hits)
    assert got == want and len(want) > 40


def test_digits(spark):
    texts = frame(spark, [{"site_id": "s", "digits": "0012345678"}, {"site_id": "t", "digits": ""}], "site_id string, digits string")
    asked = frame(spark, [{"site_id": s, "number": n} for s in "st" for n in ("0012345", "2345678", "78", "0", "87", "12346")], "site_id string, number string")
    assert {tuple(x) for x in PH.shown_digits(texts, asked).collect()} == {("s", n) for n in ("0012345", "2345678", "78", "0")}


def _site(spark, n):
    """One site of ``n`` pages whose records name what only a page far away shows."""
    i = F.col("id")
    claims = F.array(F.struct(F.lpad((i % 5000).cast("string"), 7, "9").alias("phone"), F.concat(F.lit("shop number "), i, F.lit(" ltd")).alias("name")))
    content = spark.range(n).select(F.lit("big").alias("site_id"), F.lit(True).alias("is_site"), claims.alias("claims"),
                                    F.array(F.concat(F.lit("lamp "), i)).alias("product_names"))
    body = F.concat(F.lit("We are Shop Number "), i + 1, F.when(i == n - 2, " Ltd").otherwise(" Inc"), F.lit(", call 999 "), F.lpad((i + 1) % 5000, 4, "9"), F.lit(". lamp 77x"))
    rows = spark.range(n).select(F.lit("big").alias("site_id"), i.alias("ord"), F.lit(True).alias("is_site"), body.alias("body"))
    folded = spark.range(1).select(F.lit("big").alias("site_id"), *(F.lit(v).alias(k) for k, v in {
        "nap": False, "no_entity": False, "claim_shown": False, "has_products": True, "product_shown": False}.items()))
    return folded, content, rows


def test_site_of_ten_thousand_pages(spark):
    folded, content, rows = _site(spark, 10_000)
    got = A.shown_elsewhere(folded, content, rows, lambda df, name: df)
    assert [tuple(r) for r in got.collect()] == [("big", True, True)]
    none = A.shown_elsewhere(folded, content, rows.withColumn("body", F.lit("nothing of that, lam p 77")), lambda df, name: df)
    assert [tuple(r) for r in none.collect()] == [("big", False, False)]


def test_no_text_and_no_list_in_an_exchange(spark):
    folded, content, rows = _site(spark, 50)
    plan = A.shown_elsewhere(folded, content, rows, lambda df, name: df)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    exchanged = re.findall(r"\(\d+\) (?:Exchange|BroadcastExchange)\nInput \[\d+\]: (.*)", plan)
    assert exchanged
    assert not any(re.search(r"\b(body|text|claims|product_names|digits)#", x) for x in exchanged), exchanged
