"""The report store: replaced by id, one version, few files opened or rewritten."""

import os
from datetime import datetime, timedelta
from glob import glob

from sitegauge.sources.report_store import SHARDS, read_reports, save_reports

SCHEMA = "id string, created_at timestamp, body string"


def at(day, hour=0):
    return datetime(2024, 1, 1) + timedelta(days=day - 1, hours=hour)


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def bodies(rows):
    out = [(r["id"], r["body"]) for r in rows.collect()]
    assert len(out) == len(set(i for i, _ in out))
    return dict(out)


def files(path):
    return set(glob(f"{path}/home_day=*/home_shard=*/*.parquet"))


def files_read(rows):
    """Files the executed scan opened, by its own metric."""
    rows.collect()
    node = rows._jdf.queryExecution().executedPlan()
    leaves = node.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size()))


def test_newest_version_stays(spark, tmp_path):
    path = f"{tmp_path}/s"
    save_reports(frame(spark, [("a", at(1), "old"), ("b", at(1), "b1"), ("a", at(1, 2), "second")]), path)
    assert bodies(read_reports(spark, path)) == {"a": "second", "b": "b1"}
    save_reports(frame(spark, [("a", at(2, 5), "new")]), path)
    save_reports(frame(spark, [("a", at(1, 1), "late")]), path)
    assert bodies(read_reports(spark, path)) == {"a": "new", "b": "b1"}
    assert bodies(read_reports(spark, path, report_id="b")) == {"b": "b1"}
    assert bodies(read_reports(spark, path, since="2024-01-02")) == {"a": "new"}
    save_reports(frame(spark, [("a", at(2, 5), "same time, saved later")]), path)
    assert bodies(read_reports(spark, path, report_id="a")) == {"a": "same time, saved later"}


def test_a_save_rewrites_only_its_folders(spark, tmp_path):
    path = f"{tmp_path}/s"
    rows = [(f"r{i}", at(1 + i % 5), f"b{i}") for i in range(400)]
    save_reports(frame(spark, rows), path)
    before = files(path)
    assert len({f.split("/home_")[1] for f in before}) == 5
    again = [(f"r{i}", at(30), "new") for i in (3, 8)]
    for _ in range(3):
        save_reports(frame(spark, again), path)
        after = files(path)
        assert len(after) == len(before)
        assert all("home_day=2024-01-04" in f for f in before ^ after)
        assert len(before - after) <= 2
    assert bodies(read_reports(spark, path)) == {**{i: b for i, _, b in rows}, "r3": "new", "r8": "new"}


def test_a_get_opens_one_folder_of_a_day(spark, tmp_path):
    path = f"{tmp_path}/s"
    save_reports(frame(spark, [(f"r{i}", at(1 + i % 5), "x" * 50) for i in range(1000)]), path)
    assert all(os.path.getsize(f) < 80_000 for f in files(path))  # the smallest filter has 64 KB
    n_days = 5
    whole = files_read(read_reports(spark, path))
    assert whole >= n_days * (SHARDS - 1)
    one = read_reports(spark, path, report_id="r77")
    assert files_read(one) <= 2 * n_days < whole / 4 and one.count() == 1
    assert "EqualTo(id,r77)" in one._jdf.queryExecution().executedPlan().toString()


def test_nulls_empty_batches_and_new_columns(spark, tmp_path):
    path = f"{tmp_path}/s"
    save_reports(frame(spark, [(None, None, "n1"), ("", at(1), "empty id"), (None, at(1), "n2"), ("t", None, "no time")]), path)
    assert bodies(read_reports(spark, path)) == {None: "n2", "": "empty id", "t": "no time"}
    save_reports(frame(spark, []), path)
    save_reports(frame(spark, [(None, at(3), "n3", 7)], SCHEMA + ", extra int"), path)
    assert bodies(read_reports(spark, path)) == {None: "n3", "": "empty id", "t": "no time"}
    whole = {r["id"]: r["extra"] for r in read_reports(spark, path, merge_schema=True).collect()}
    assert whole == {None: 7, "": None, "t": None}
    save_reports(frame(spark, [("t", at(1), "timed")]), path)
    assert {r["id"]: r["extra"] for r in read_reports(spark, path, merge_schema=True).collect()} == whole
