"""Report sinks: written and read back."""

import csv
import json
from glob import glob

from sitegauge.sources import sinks


def test_json_lines(spark, tmp_path):
    rows = spark.createDataFrame([("a", [("x", 1)]), ("b", [])], "site_id string, tabs array<struct<tab:string,score:int>>")
    sinks.write_json(rows, f"{tmp_path}/j")
    got = [json.loads(line) for f in glob(f"{tmp_path}/j/*.json") for line in open(f, encoding="utf-8")]
    assert sorted(got, key=lambda r: r["site_id"]) == [{"site_id": "a", "tabs": [{"tab": "x", "score": 1}]}, {"site_id": "b", "tabs": []}]


def test_csv_lines_of_a_site_stay_together(spark, tmp_path):
    rows = [(s, b, o, f'c "{b}{o}"', "", "x,y", None, "é") for s in ("s1", "s2", "s3") for b in (1, 0) for o in (2, 1)]
    sinks.write_csv(spark.createDataFrame(rows, "site_id string, block int, ord int, c1 string, c2 string, c3 string, c4 string, c5 string").repartition(4), f"{tmp_path}/c")
    for path in glob(f"{tmp_path}/c/*.csv"):
        lines = list(csv.reader(open(path, encoding="utf-8", newline=""), escapechar="\\"))
        sites = [line[0] for line in lines]
        assert sites == sorted(sites)
        for site in set(sites):
            assert [line[1] for line in lines if line[0] == site] == ['c "01"', 'c "02"', 'c "11"', 'c "12"']
    assert sum(len(list(csv.reader(open(p, encoding="utf-8"), escapechar="\\"))) for p in glob(f"{tmp_path}/c/*.csv")) == 12
