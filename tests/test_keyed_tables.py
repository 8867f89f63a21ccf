"""Keyed tables: only touched buckets are written, replays and repeats change nothing, old folders go."""

import glob
import os

import pytest

from tidegauge.sources import sinks

SCHEMA = "key string, ver int, x string"


def folders(path):
    return {tuple(p.split("/")[-2:]) for p in glob.glob(f"{path}/rows/epoch=*/_bucket=*")}


def table_of(spark, path, epoch):
    return sorted(map(tuple, sinks.read_table(spark, path, epoch).collect()), key=str)


def test_one_key_rewrites_one_bucket(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([(f"k{n}", 1, "old") for n in range(200)] + [(None, 1, "none")], SCHEMA)
    assert len(sinks.write_rows(first, path, 0, ["key"], "ver", 8)) == 8
    before = {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{path}/rows/epoch=0/*/*.parquet")}
    one = spark.createDataFrame([("k7", 2, "new")], SCHEMA)
    touched = sinks.write_rows(one, path, 1, ["key"], "ver", 8)
    assert len(touched) == 1 and len([f for f in folders(path) if f[0] == "epoch=1"]) == 1
    assert before == {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{path}/rows/epoch=0/*/*.parquet")}
    want = sorted([(f"k{n}", 1, "old") for n in range(200) if n != 7] + [("k7", 2, "new"), (None, 1, "none")], key=str)
    assert table_of(spark, path, 1) == want
    assert ("k7", 1, "old") in table_of(spark, path, 0)  # the epoch before is still whole


@pytest.mark.parametrize("replayed", [True, False])
def test_the_same_rows_twice(spark, tmp_path, replayed):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], SCHEMA)
    later = spark.createDataFrame([("b", 2, "z"), ("c", 1, "w")], SCHEMA)
    sinks.write_rows(rows, path, 0, ["key"], "ver")
    sinks.write_rows(later, path, 1, ["key"], "ver")
    once = table_of(spark, path, 1)
    sinks.write_rows(later, path, 1 if replayed else 2, ["key"], "ver")
    assert table_of(spark, path, 1 if replayed else 2) == once == [("a", 1, "x"), ("b", 2, "z"), ("c", 1, "w")]


def test_older_folders_are_removed(spark, tmp_path):
    path = str(tmp_path / "t")
    for epoch in range(5):
        sinks.write_rows(spark.createDataFrame([("a", epoch, "x"), (f"k{epoch}", 1, "y")], SCHEMA), path, epoch, ["key"], "ver", 4)
    assert len(table_of(spark, path, 4)) == 6 and len(table_of(spark, path, 3)) == 5
    assert sorted(os.path.basename(p) for p in glob.glob(f"{path}/pointers/*")) == ["epoch=3", "epoch=4"]
    live = {(f"epoch={e}", f"_bucket={b}") for k in (3, 4) for b, e in sinks._pointers(spark, path, k)[0].items()}
    assert folders(path) == live


def test_empty_epochs(spark, tmp_path):
    path, none = str(tmp_path / "t"), spark.createDataFrame([], SCHEMA)
    assert sinks.write_rows(none, path, 0, ["key"], "ver") == set() and table_of(spark, path, 0) == []
    sinks.write_rows(spark.createDataFrame([("a", 1, "x")], SCHEMA), path, 1, ["key"], "ver")
    assert sinks.write_rows(none, path, 2, ["key"], "ver") == set() and table_of(spark, path, 2) == [("a", 1, "x")]
