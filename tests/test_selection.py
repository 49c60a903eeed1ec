"""Exact k-th values: random groups against sorted lists, extreme numbers, odd rows."""

import math
import random

from fixtures import frame
from pyspark.sql import functions as F
from sitegauge.operators import selection as SEL


def test_against_sorted_lists(spark, monkeypatch):
    monkeypatch.setattr(SEL, "CELLS", 64)
    r = random.Random(1)
    kinds = [lambda: r.gauss(0, 1), lambda: float(r.randrange(4)), lambda: r.choice([1e308, -1e308, 5e-324, 0.0, -0.0, 1.0, math.nextafter(1.0, 2)]), lambda: 10.0 ** r.randrange(-300, 300)]
    rows = [{"k": k, "v": kinds[k % 4]()} for k in range(8) for _ in range(r.randrange(1, 60))]
    rows += [{"k": 9, "v": None}, {"k": 10, "v": float("nan")}, {"k": 10, "v": 2.0}, {"k": None, "v": 3.0}, {"k": None, "v": 4.0}]
    values = {}
    for x in rows:
        if x["v"] is not None and not math.isnan(x["v"]):
            values.setdefault(x["k"], []).append(x["v"])
    table = frame(spark, rows, "k int, v double").repartition(3)
    for rank, want in ((lambda n: F.floor(n / 2), lambda v: sorted(v)[len(v) // 2]), (lambda n: F.lit(0), min), (lambda n: n - 1, max)):
        got = {x["k"]: (x["n"], x["value"]) for x in SEL.kth_value(table, ["k"], "v", rank).collect()}
        assert got == {k: (len(v), want(v)) for k, v in values.items()}
    assert {x["k"] for x in SEL.kth_value(table, ["k"], "v", lambda n: F.lit(50)).collect()} == {k for k, v in values.items() if len(v) > 50}
    assert SEL.upper_median(table.limit(0), ["k"], "v").count() == 0
