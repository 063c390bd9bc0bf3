"""CSV with line breaks inside quotes, read in splits.

A split of a file begins anywhere, perhaps inside a quoted field. So each split is read as if it began outside and as if it began
inside, and what both come to at its end is kept: one row for each split. Putting these rows together in the order of the
splits tells how each of them really begins. A second reading then cuts records; the few that go beyond their split
are put together from their parts.

A quote opens a field at the start of a record or after a delimiter, and closes it unless it is doubled; other quotes are text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What closes a field that is open, and what opens one.
_CLOSE = re.compile(r'(?:[^"]|"")*"(?!")')
_OPEN = re.compile(r',"')


def inside_after(line: str, inside: bool) -> bool:
    """Whether a field is open after a line that begins with one open (``inside``) or not."""
    if '"' not in line:
        return inside
    at, start = 0, not inside
    while True:
        if inside:
            found = _CLOSE.match(line, at)
            if found is None:
                return True
        elif start and line.startswith('"'):
            found = re.compile('"').match(line)
        else:
            found = _OPEN.search(line, at)
            if found is None:
                return False
        at, start, inside = found.end(), False, not inside


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of all files in the order of each split."""
    return spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _runs(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[tuple, list[str]]]:
    """Lines in order with the split they are of; a split may come in several runs."""
    for batch in batches:
        keys, lines = list(zip(*(batch[c].to_pylist() for c in columns))), batch["value"].to_pylist()
        at = 0
        while at < len(lines):
            to = at
            while to < len(lines) and keys[to] == keys[at]:
                to += 1
            yield keys[at], lines[at:to]
            at = to


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each split: whether a field is open at its end if it began outside, if inside, and whether then a record ended in it."""
    key, state = None, (False, True, False)

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"file": [key[0]], "block": [key[1]], "outside": [state[0]], "inside": [state[1]], "ended": [state[2]]})

    for own, lines in _runs(batches, ["file", "block"]):
        if own != key:
            if key is not None:
                yield row()
            key, state = own, (False, True, False)
        outside, inside, ended = state
        for line in lines:
            outside, inside = inside_after(line, outside), inside_after(line, inside)
            ended |= not inside
        state = outside, inside, ended
    if key is not None:
        yield row()


def _begins(lines: DataFrame) -> DataFrame:
    """(file, block, open, origin): whether a split begins inside a field, and in which split that record began.

    One row for each split of the input, put together file by file.
    """
    ends = lines.mapInArrow(_ends, "file string, block long, outside boolean, inside boolean, ended boolean")
    splits = ends.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("block", "outside", "inside", "ended"))).alias("splits"))
    start = F.struct(F.lit(False).alias("open"), F.lit(0).cast("long").alias("origin"),
                     F.array().cast("array<struct<block:bigint,open:boolean,origin:bigint>>").alias("out"))

    def step(so_far, split):
        after = F.when(so_far["open"], split["inside"]).otherwise(split["outside"])
        stays = so_far["open"] & ~split["ended"]
        return F.struct(after.alias("open"), F.when(stays, so_far["origin"]).otherwise(split["block"]).alias("origin"),
                        F.concat(so_far["out"], F.array(F.struct(
                            split["block"].alias("block"), so_far["open"].alias("open"), so_far["origin"].alias("origin")))).alias("out"))

    return splits.select("file", F.inline(F.aggregate("splits", start, step)["out"]))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records, and parts of records that go beyond their split (with the split where the record began)."""
    def rows(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(
            zip(*found) if found else [()] * 4, (pa.string(), pa.int64(), pa.int64(), pa.string()))], ["file", "origin", "block", "record"])

    key, pending, origin, inside, header = None, [], None, False, False
    for own, lines in _runs(batches, ["file", "block", "open", "origin"]):
        found = []
        if own != key:
            if pending:
                found.append((*key[:1], key[1] if origin is None else origin, key[1], "\n".join(pending)))
            key, pending, inside, header = own, [], own[2], own[1] == 0
            origin = own[3] if inside else None
        for line in lines:
            inside = inside_after(line, inside)
            pending.append(line.removesuffix("\r"))
            if not inside:
                if header:
                    header = False
                elif origin is not None or pending != [""]:
                    found.append((own[0], origin, own[1], "\n".join(pending)))
                pending, origin = [], None
        yield rows(found)
    if pending:
        yield rows([(key[0], key[1] if origin is None else origin, key[1], "\n".join(pending))])


def read_quoted(spark: SparkSession, path: str) -> DataFrame:
    """The records of CSV files in UTF-8 with a header each, as text columns by the names in the header of one of them.

    ``path`` is a file, a folder or a pattern. A file is read by as many tasks as it has splits. Line breaks inside quotes come
    out as ``\\n``. Empty lines are no records, missing columns are null. The header must end in the first split.
    """
    columns = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).columns
    lines = _lines(spark, path)
    # One row for each split.
    placed = lines.join(F.broadcast(_begins(lines)), ["file", "block"])
    cut = placed.select("value", "file", "block", "open", "origin").mapInArrow(_cut, "file string, origin long, block long, record string")
    parts = cut.filter("origin is not null").groupBy("file", "origin").agg(
        F.sort_array(F.collect_list(F.struct("block", "record"))).alias("parts"))
    records = cut.filter("origin is null").select("record").union(
        parts.select(F.array_join(F.transform("parts", lambda p: p["record"]), "\n").alias("record")))
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in columns)
    options = {"multiLine": "true", "quote": '"', "escape": '"'}
    return records.select(F.from_csv("record", schema, options).alias("r")).select("r.*")
