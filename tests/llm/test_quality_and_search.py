"""Boosted trees, quality scores on held-out rows, and exact search against plain Python."""

from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pytest

from stallmark.llm import boosting, quality, topk
from tests.conftest import SMALL


def test_trees_learn_and_step_like_a_walk():
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < -0.5)).astype(float)
    trees = boosting.fit(x[:2000], y[:2000])
    assert ((trees.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.97
    inner = trees.feature.shape[1]
    for row in x[:20]:
        total = trees.start
        for feature, cut, leaf in zip(trees.feature, trees.cut, trees.leaf):
            k = 0
            while k < inner:
                k = 2 * k + (2 if row[feature[k]] > cut[k] else 1)
            total += leaf[k - inner]
        assert trees.score(row[None, :])[0] == pytest.approx(1 / (1 + math.exp(-total)))


@pytest.mark.parametrize("y", [[], [1.0, 1.0], [0.0]])
def test_one_class_or_none(y):
    trees = boosting.fit(np.zeros((len(y), 3)), np.array(y))
    want = (sum(y) + 0.5) / (len(y) + 1)
    assert trees.score(np.zeros((2, 3))) == pytest.approx([want, want])


def test_statistics_of_odd_texts(odd):
    for r in odd.collect():
        figures = quality.statistics(r.text)
        assert len(figures) == quality.WIDTH and all(map(math.isfinite, figures))
    assert quality.statistics(None) == quality.statistics(" \n") == [0.0] * quality.WIDTH


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scored = {r.doc_id: r for r in quality.quality_scores(docs, labels).collect()}
    for doc_id, r in scored.items():
        assert r.held_out == (zlib.crc32(str(doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [r for r in labels.collect() if scored[r.doc_id].held_out]
    assert sum(scored[r.doc_id].predicted == r.quality for r in held) / len(held) > 0.95
    # Labels of held-out rows are never looked at.
    turned = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id AS string) AS binary)) % 3 = 1, 1 - quality, quality) AS quality")
    again = {r.doc_id: r.score for r in quality.quality_scores(docs, turned).collect()}
    assert again == {d: r.score for d, r in scored.items()}


def test_quality_of_odd_documents(spark, odd, none):
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(1, None), (2, 1), (None, 1), (3, 1)], "doc_id long, quality int")
    assert quality.quality_scores(odd, labels).count() == odd.count()
    kept = quality.keep_good(odd, labels)
    assert kept.columns == odd.columns and kept.count() <= odd.count()
    assert {r.score for r in quality.quality_scores(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(none, labels).collect() == [] and quality.keep_good(none, labels).collect() == []


def best(rows: list[tuple], k: int, every: int) -> list[tuple]:
    whole = []
    for i, v in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole.append((i, tuple(math.floor(float(np.float32(x)) * 256) for x in v)))
    out = []
    for q, v in {w for w in whole if w[0] is not None and w[0] % every == 0}:
        found = sorted((-min(sum(a * b for a, b in zip(v, w)), topk.LONG), i is None, i or 0) for i, w in whole if i != q and len(w) == len(v))
        out += [(q, r, None if n else i, -s) for r, (s, n, i) in enumerate(found[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [4, 1024])
def test_search_is_exact(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "HELD", 20)
    monkeypatch.setattr(topk, "FAN", 2 if block == 4 else 64)
    rnd = random.Random(4)
    # Few different values: ties everywhere, one vector that a third of all rows share.
    rows = [(i, [0.5, 0.25, -1.0] if i % 3 == 0 else [rnd.choice([-1.0, 0.0, 0.5, 0.3]) for _ in range(3)]) for i in range(300)]
    rows += [(1000, None), (1050, [None, 1.0, 1.0]), (1100, [float("nan"), 1.0, 1.0]), (1150, [float("inf"), 0.0, 0.0]),
             (1200, [1.0, 2.0]), (1250, [3.0, 4.0]), (1300, []), (1301, []), (None, [9.0, 9.0, 9.0]), (50, rows[50][1]), (7, rows[7][1]),
             (1350, [1e12, 1.0, 0.0]), (1351, [1e3, 1.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, 1) for i, v in rows], "vec_id long, embedding array<float>, length int, part int").repartition(4)
    got = sorted((tuple(r) for r in topk.search(df).collect()), key=repr)
    assert got == best(rows, 5, 50)


def test_copies_of_the_queries_are_never_broadcast(spark):
    """Statistics see the queries, not their copies for the groups of tiles."""
    df = spark.range(400).selectExpr("id AS vec_id", "transform(sequence(1, 8), x -> float((id * x) % 5)) AS embedding").repartition(4)
    found = topk.search(df, every=10)
    assert found.count() == 200
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_blocks_are_as_narrow_as_their_numbers():
    for high, width in ((127, 1), (128, 2), (-129, 2), (1 << 15, 4), (1 << 40, 8), (-(1 << 63), 8)):
        matrix = np.array([[high, 1, 2], [3, 4, 5]], np.int64)
        packed = topk._bytes(matrix)
        assert len(packed) == 6 * width and topk._matrix(packed, 2, 3).tolist() == matrix.tolist()
    assert topk._matrix(topk._bytes(np.zeros((2, 0), np.int64)), 2, 0).shape == (2, 0)


@pytest.mark.parametrize("parts", ["1", "300"])
def test_search_in_a_grid_of_any_size(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    rnd = random.Random(5)
    rows = [(i % 90, [rnd.choice([-1.0, 0.5, 0.3]) for _ in range(rnd.choice([2, 3]))]) for i in range(180)]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
        assert sorted((tuple(r) for r in topk.search(df, 4, 5).collect()), key=repr) == best(rows, 4, 5)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_search_with_few_or_no_rows(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.search(empty).collect() == []
    one = spark.createDataFrame([(0, [1.0]), (3, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.search(one).collect()] == [(0, 1, 3, 256 * 512)]


def test_numbers_beyond_double_precision():
    q, t = np.array([[1 << 40, 1]]), np.array([[1 << 20, 1], [1 << 20, 2], [1 << 62, 0]])
    assert topk._products(q, t).tolist() == [[(1 << 60) + 1, (1 << 60) + 2, topk.LONG]]


def test_search_on_the_smallest_data(spark):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    want = best([(r.vec_id, r.embedding) for r in df.collect()], 5, 50)
    assert sorted((tuple(r) for r in topk.search(df).collect()), key=repr) == want
