"""The keyword tree against a word-by-word search."""

import random

from pyspark.sql import functions as F

from sitegauge.operators import classify as CL

GRAMS = CL.all_grams()


def brute(text):
    """Every keyword run at every word; words of other signs than ASCII letters and digits match nothing."""
    words, out = text.split(" "), []
    plain = lambda w: w.isascii() and w != ""
    known = {tuple(g.split()) for g in GRAMS}
    for at in range(len(words)):
        for n in range(1, max(map(len, known)) + 1):
            run = tuple(words[at:at + n])
            if len(run) == n and all(map(plain, run)) and run in known:
                out.append(" ".join(run))
    return sorted(out)


def found(spark, texts):
    prefixes = {}
    for longest, gram in CL.prefix_rows(GRAMS):
        prefixes.setdefault(longest, []).append(gram)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = rows.select("i", CL.grams(F.col("t")).alias("g")).collect()
    return {r["i"]: sorted(p for g in r["g"] for p in prefixes[g]) for r in got}


def test_runs_at_every_word(spark):
    rng = random.Random(5)
    pool = [w for g in GRAMS for w in g.split()] + ["zebra", "clinics", "skinny", "é", "naïve"]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randrange(0, 60))) for _ in range(150)]
    texts += ["", "skin clinic", "skin clinics", "laser hair removal treatment", "x" * 200_000, " ".join(GRAMS), "skin é clinic"]
    assert found(spark, texts) == {i: brute(t) for i, t in enumerate(texts)}


def test_a_sign_beyond_ascii_ends_a_word(spark):
    """As the compatible rule has it: a keyword beside such a letter counts, one across it does not."""
    assert found(spark, ["éclinic", "skinéclinic", "clinic_x", "clinic2"]) == {0: ["clinic"], 1: ["clinic", "skin"], 2: [], 3: []}


def test_scores_of_empty_and_null_texts(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "Skin-clinic & skin clinic")], "page_id int, title string")
    hits = CL.keyword_hits(CL.signal_rows(rows, {"title": F.col("title")})).collect()
    assert {r["page_id"] for r in hits} == {3}
    assert {(r["keyword"], r["n"]) for r in hits if r["label"] == "Aesthetic Dermatology"} == {("skin clinic", 2)}


def test_every_item_is_ranked_once(spark):
    rows = spark.createDataFrame([(1, "skin clinic laser treatment software crm"), (2, "nothing here")], "page_id int, title string")
    decided = CL.decide(CL.item_scores(CL.keyword_hits(CL.signal_rows(rows, {"title": F.col("title")}))), rows)
    got = {r["page_id"]: r for r in decided.collect()}
    assert got[1]["industry"] == "Healthcare" and got[1]["sub_industry"] == "Aesthetic Dermatology"
    assert got[2]["industry"] == "Unclassified" and got[2]["rejected"] == []
