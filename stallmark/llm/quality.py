"""Quality of documents, learnt from labels: boosted trees over statistics of the text.

Statistics are taken from whole texts in Arrow batches, without a shuffle: shares of character classes from a count of
bytes, lengths, and repetitions of words and lines. The trees are fitted on the driver on at most ``sample`` labelled
rows, those whose id and text have the smallest hashes; a fixed number of rows, whatever the input. Scoring is numpy
over a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .boosting import Trees, fit
from .chunks import frugal

#: Labelled rows the trees are fitted on, at most.
SAMPLE = 20_000
_KINDS = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".,;:", b"'\"()-",
          b"!?", b"*#$%&@^~+=", b"|<>[]{}\\/_`")
_KIND_OF = np.zeros((256, len(_KINDS) + 1))
for _k, _chars in enumerate(_KINDS):
    _KIND_OF[list(_chars), _k] = 1
_KIND_OF[128:, -1] = 1
WIDTH = _KIND_OF.shape[1] + 12


def statistics(text: str | None) -> list[float]:
    """WIDTH figures of one text; all 0 for null, empty and blank ones."""
    words = (text or "").split()
    if not words:
        return [0.0] * WIDTH
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    shares = np.bincount(raw, minlength=256) @ _KIND_OF / len(raw)
    n, lines = len(words), [line for line in text.split("\n") if line.strip()]
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = sum(not w[-1].isalnum() for w in words) / n
    return [*shares.tolist(), float(np.log1p(len(raw))), float(np.log1p(n)), float(np.log1p(len(lines))), n / len(lines),
            float(lengths.mean()), float(lengths.std()), float(lengths.max()), float((lengths == 1).mean()),
            len(set(words)) / n, sum(map(eq, words, words[1:])) / n, len(set(lines)) / len(lines), ends]


def _measured(rows: DataFrame, text: str, output: str, kind: T.DataType, make) -> DataFrame:
    """Replace ``text`` by what ``make(matrix of statistics)`` gives for a batch."""
    kept = [c for c in rows.columns if c != text]
    schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField(output, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t.as_py()) for t in batch[text]]).reshape(-1, WIDTH)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), make(x)], [*kept, output])

    return rows.mapInArrow(run, schema)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; ids that are null have none."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
          sample: int = SAMPLE) -> Trees:
    """Trees from the documents with a label whose fold is not 1.

    An id with several labels has their majority; without one it is left out. Null labels do not count. Without any
    label, every score is 0.5.
    """
    voted = (labels.filter(F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.avg(label).alias("mean"))
             .filter("mean <> 0.5 and id is not null").filter(fold(F.col("id")) != 1)
             .select("id", (F.col("mean") > 0.5).cast("int").alias("y"))
             .orderBy(F.xxhash64("id"), "id").limit(sample))
    # At most ``sample`` ids, so the broadcast is bounded. Texts are measured where they are; figures are gathered.
    rows = (docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(voted), "id")
            .select("y", F.xxhash64("id").alias("a"), F.xxhash64("text").alias("b"), "text"))
    matrix = _measured(rows, "text", "x", T.ArrayType(T.DoubleType()), lambda x: pa.array(list(x), pa.list_(pa.float64())))
    learnt = matrix.orderBy("a", "b").limit(sample).select("y", "x").toArrow()
    x = np.array(learnt["x"].to_pylist(), float).reshape(-1, WIDTH)
    return fit(x, learnt["y"].to_numpy().astype(float))


def score(docs: DataFrame, trees: Trees, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` and ``score``, the probability of good quality, for each row."""
    rows = docs.select(*keep, F.col(text).alias("_text"))
    return _measured(rows, "_text", "score", T.DoubleType(), lambda x: pa.array(trees.score(x)))


def quality_scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
                   label: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out (fold 1), score and predicted (1 from 0.5 on) of each row.

    Null, empty and blank texts are scored by statistics that are all 0. Rows with a null id are not held out.
    Repeated rows stay repeated. Other columns are not read. An empty table gives an empty result.
    """
    trees = train(docs, labels, doc_id, text, label, sample)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(fold(F.col(doc_id)) == 1, F.lit(False)).alias("held_out"),
                       F.col(text).alias("text"))
    scored = score(rows, trees, ["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
              label: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs``, all columns, with a score of 0.5 or more."""
    trees = train(docs, labels, doc_id, text, label, sample)
    rows = docs.select(F.expr("struct(*)").alias("row"))
    schema = rows.schema
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t.as_py()) for t in batch["row"].field(place)]).reshape(-1, WIDTH)
            yield batch.filter(pa.array(trees.score(x) >= 0.5))

    return rows.mapInArrow(frugal(run), schema).select("row.*")
