"""Quoted files read in splits against Python's reader of the same files."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from pitsignal.sources.quoted import quoted_records, read_quoted

SCHEMA = "i long, a string, b string"


@pytest.fixture
def small_splits(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def write(path, rows, end="\n", quoting=csv.QUOTE_MINIMAL):
    with open(path, "w", newline="") as f:
        out = csv.writer(f, lineterminator=end, quoting=quoting)
        out.writerow(["i", "a\nx", "b"])
        out.writerows(rows)


def test_one_file_is_read_by_many_tasks(spark, tmp_path, small_splits):
    rnd = random.Random(3)
    parts = ["x", "y,z", '"', "\n", "\n\n", "\r\n", "end", " "]
    rows = [(i, "".join(rnd.choices(parts, k=rnd.randrange(1, 9))), f"b{i}") for i in range(400)]
    # One record is longer than several splits, and one begins a line with a quote.
    rows[200] = (200, "long\n" * 900, '"\n"')
    write(tmp_path / "one.csv", rows)
    records = quoted_records(spark, str(tmp_path / "one.csv"))
    assert records.select("block").distinct().count() > 5
    got = read_quoted(spark, str(tmp_path / "one.csv"), SCHEMA)
    assert sorted(map(tuple, got.collect())) == rows


def test_other_line_ends_several_files_and_blank_records(spark, tmp_path, small_splits):
    first = [(i, f"p\r\nq{i}", "r") for i in range(60)]
    write(tmp_path / "w.csv", first, "\r\n", csv.QUOTE_ALL)
    (tmp_path / "v.csv").write_text('i,a,b\n\n7,,""\nno number,s,t')
    (tmp_path / "u.csv").write_text("i,a,b\n")
    got = read_quoted(spark, str(tmp_path), SCHEMA)
    rows = sorted(map(tuple, got.collect()), key=str)
    assert rows == sorted([*first, (7, None, ""), (None, "s", "t")], key=str)
    assert read_quoted(spark, str(tmp_path / "u.csv"), SCHEMA).count() == 0
    bare = read_quoted(spark, str(tmp_path / "u.csv"), "i string, a string, b string", header=False)
    assert [tuple(r) for r in bare.collect()] == [("i", "a", "b")]


def test_an_unpaired_quote_is_an_error(spark, tmp_path):
    (tmp_path / "x.csv").write_text('i,a,b\n1,"open,c\n2,d,e\n')
    with pytest.raises(ValueError, match="x.csv"):
        read_quoted(spark, str(tmp_path / "x.csv"), SCHEMA)


def test_only_broken_records_are_shuffled(spark, tmp_path):
    write(tmp_path / "y.csv", [(1, "a\nb", "c"), (2, "d", "e")])
    plan = read_quoted(spark, str(tmp_path / "y.csv"), SCHEMA).filter(F.col("i") > 0)._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
