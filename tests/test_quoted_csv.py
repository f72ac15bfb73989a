"""Splittable quoted CSV: equal to Python's csv module whatever the byte ranges."""

import csv
import random

import pytest

from reqscope.sources import quoted_csv
from reqscope.sources.labelled import load_dataset

PIECES = ["a", "bb", "\n", "\r\n", ",", '"', '""', " ", 'x"y', "é", "\n\n", "word", "\r", "NA", ""]


@pytest.fixture
def small_ranges(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    yield lambda size: spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def _write(path, header, rows, **kw):
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f, **kw).writerows([header, *rows])


@pytest.mark.parametrize("size", [400, 10**8])
def test_equals_the_csv_module(spark, tmp_path, small_ranges, size):
    rng = random.Random(1)
    text = lambda: "".join(rng.choice(PIECES) for _ in range(rng.choice([0, 1, 3, 8, 120])))
    rows = [(str(i), text(), rng.choice(["1", "0", "", "z"])) for i in range(90)]
    header = ["id", "te\nxt", "l"]
    _write(tmp_path / "a.csv", header, rows[:60], lineterminator="\r\n", quoting=csv.QUOTE_ALL)
    _write(tmp_path / "b.csv", header, rows[60:], lineterminator="\n", quoting=csv.QUOTE_MINIMAL)
    small_ranges(size)
    got = quoted_csv.read_quoted_csv(spark, str(tmp_path), header).collect()
    assert sorted((r[0], r[1] or "", r[2] or "") for r in got) == sorted(rows)


def test_a_record_over_many_ranges(spark, tmp_path, small_ranges):
    long = "line with, comma\n" * 60  # about 1,000 bytes: whole ranges lie inside the record
    rows = [("first", "1"), (long, "0"), ("last \"word\"", "1")]
    _write(tmp_path / "a.csv", ["requirement_text", "label"], rows)
    small_ranges(200)
    path = str(tmp_path / "a.csv")
    states = quoted_csv.range_states(quoted_csv.numbered_lines(spark, path)).collect()
    assert len(states) > 4 and sum(r["state"] for r in states) > 2  # one file, many tasks, several begin inside quotes
    assert {r["open"]["open_block"] for r in states if r["state"]} == {0}  # all belong to the record begun in the first range
    got = load_dataset(spark, path, "A", "quoted_csv").collect()
    assert sorted((r["requirement_text"], r["label"]) for r in got) == sorted((t, int(v)) for t, v in rows)


def test_lines_of_whole_records_are_not_shuffled_by_record(spark, tmp_path):
    _write(tmp_path / "a.csv", ["t", "l"], [("plain", "1"), ("", ""), ("two\nlines", "0")])
    got = quoted_csv.records(spark, str(tmp_path))
    assert sorted(r["text"] for r in got.collect()) == ['"two\nlines",0', ",", "plain,1"]


def test_open_quote_is_an_error_and_empty_files_are_empty(spark, tmp_path):
    (tmp_path / "a.csv").write_text('t,l\n"never closed,1\nx,2\n')
    with pytest.raises(ValueError, match="ends inside quotes"):
        quoted_csv.records(spark, str(tmp_path / "a.csv"))
    (tmp_path / "b.csv").write_text("t,l\n\n\n")
    assert quoted_csv.read_quoted_csv(spark, str(tmp_path / "b.csv"), ["t", "l"]).collect() == []
    (tmp_path / "c.csv").write_text("t,t2\nx\ny,1,extra\n")  # missing values are null, values too many go
    assert sorted(quoted_csv.read_quoted_csv(spark, str(tmp_path / "c.csv"), ["t", "t2"]).collect(), key=str) == [("x", None), ("y", "1")]
