"""Quoted CSV read in splits against the reader that takes a file as a whole, and Python's own."""

from __future__ import annotations

import csv
import io
import random

import pytest

from stallmark.sources import records

PARTS = ['"', '""', ",", "\n", "a", "bc d", "é", " ", "", "'", "\n\n", '","', "x" * 30]


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda size: [spark.conf.set(k, v) for k, v in zip(before, (size, 8))]
    for k, v in before.items():
        spark.conf.set(k, v)


def written(path, seed: int, end: str, n: int = 150) -> list[tuple]:
    rnd = random.Random(seed)
    rows = [tuple("".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 6))) or "-" for _ in range(3)) for _ in range(n)]
    text = io.StringIO()
    csv.writer(text, lineterminator=end).writerows([("one", "t wo", "three"), *rows])
    path.write_bytes(text.getvalue().encode())
    return rows


@pytest.mark.parametrize("end, size", [("\n", 50), ("\n", 333), ("\r\n", 70), ("\n", 10_000_000)])
def test_line_breaks_and_quotes_across_splits(spark, small_splits, tmp_path, end, size):
    want = []
    for k in range(3):
        want += written(tmp_path / f"{k}.csv", k, end)
    small_splits(size)
    df = records.read_quoted(spark, str(tmp_path))
    assert df.columns == ["one", "t wo", "three"]
    # The reader trims nothing; a quoted empty text would be null to it.
    assert sorted(map(tuple, df.collect())) == sorted(want)
    if size < 1000:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    small_splits(10_000_000)
    whole = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path))
    assert sorted(map(tuple, whole.collect())) == sorted(want)


def test_a_field_longer_than_several_splits(spark, small_splits, tmp_path):
    long = "\n".join(f"line {i}, \"quoted\"" for i in range(300))
    with open(tmp_path / "f.csv", "w", newline="") as file:
        csv.writer(file).writerows([("a", "b"), ("1", long), ("2", "x"), ("3", long + "\n"), ("4", "end")])
    small_splits(200)
    assert sorted(map(tuple, records.read_quoted(spark, str(tmp_path / "f.csv")).collect())) == [
        ("1", long), ("2", "x"), ("3", long + "\n"), ("4", "end")]


def test_odd_lines(spark, small_splits, tmp_path):
    (tmp_path / "f.csv").write_text('a,b\n1,5" disk\n\n2,"x ""y"""\n3\n4,,\n5,""')
    small_splits(8)
    assert sorted(map(tuple, records.read_quoted(spark, str(tmp_path / "f.csv")).collect()), key=str) == [
        ("1", '5" disk'), ("2", 'x "y"'), ("3", None), ("4", None), ("5", None)]
    (tmp_path / "g.csv").write_text("a,b\n")
    assert records.read_quoted(spark, str(tmp_path / "g.csv")).collect() == []


@pytest.mark.parametrize("line, inside, after", [
    ('a,b', False, False), ('a,"b', False, True), ('"a","b"', False, False), ('x""', True, True), ('x"",y"', True, False),
    ('x",y,"', True, True), ('5" disk', False, False), ('"', False, True), ('"', True, False), ("", True, True), ('","', True, True)])
def test_state_after_a_line(line, inside, after):
    assert records.inside_after(line, inside) == after
