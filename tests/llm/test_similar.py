"""Near-duplicates by Jaccard index against all pairs."""

from __future__ import annotations

import random
from collections import Counter

import pytest

import corpus_pipeline
from stallmark.llm import bpe, similar
from stallmark.llm.queries import vocabulary_path
from tests.conftest import SMALL


def shingles(text: str | None) -> frozenset:
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def firsts(rows: list[tuple], threshold: float = 0.8) -> Counter:
    """The first (id, text) of each group by all pairs."""
    sets = [shingles(t) for _, t in rows]
    above = list(range(len(rows)))

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or (a and b and len(a & b) >= threshold * len(a | b)):
                above[max(root(i), root(j))] = min(root(i), root(j))
    groups: dict = {}
    for i, r in enumerate(rows):
        groups.setdefault(root(i), []).append(r)
    return Counter(min(g) for g in groups.values())


def test_stage_keeps_one_of_all_pairs(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = corpus_pipeline.one_of_each_group(spark, docs, SMALL)
    assert got.dtypes == docs.dtypes
    assert Counter((r.doc_id, r.text) for r in got.collect()) == firsts([(r.doc_id, r.text) for r in docs.collect()])


def chained(seed: int) -> list[tuple]:
    """Groups of texts, each a few edits from the one before: chains whose ends are under the threshold."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(30):
        text = [rnd.choice(words) for _ in range(rnd.randint(60, 300))]
        for _ in range(6):
            texts.append(" ".join(text))
            for _ in range(rnd.randint(1, 3)):
                text[rnd.randrange(len(text))] = rnd.choice(words)
    return list(enumerate(texts))


@pytest.mark.parametrize("tile", [similar.TILE, 2])
def test_edited_copies_and_chains(spark, tile, monkeypatch):
    monkeypatch.setattr(similar, "TILE", tile)
    rows = chained(4)
    want = firsts(rows)
    assert len(want) < 120
    assert Counter(map(tuple, similar.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect())) == want


def test_copies_of_one_text_that_differ_among_themselves(spark, monkeypatch):
    """Many texts of one key that no single text is near to."""
    monkeypatch.setattr(similar, "TILE", 16)
    rnd = random.Random(6)
    base = [f"b{i}" for i in range(150)]
    texts = [" ".join(w if rnd.random() > 0.035 else f"x{rnd.random()}" for w in base) for _ in range(150)]
    rows = list(enumerate(texts))
    want = firsts(rows)
    assert 3 < len(want) < 150
    assert Counter(map(tuple, similar.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == want


@pytest.mark.parametrize("threshold", [0.5, 0.65, 1.0])
def test_keys_follow_the_threshold(spark, threshold):
    rows = chained(8)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert Counter(map(tuple, similar.keep_one(docs, threshold=threshold).collect())) == firsts(rows, threshold)


def test_banding():
    for threshold in (0.3, 0.5, 0.7, 0.8, 0.9, 0.99):
        bands, rows = similar.banding(threshold)
        assert 1 - (1 - threshold ** rows) ** bands >= similar.RECALL
    assert similar.banding(0.8) == (31, 6)
    for wrong in ({"threshold": 0}, {"threshold": 1.1}, {"recall": 1}):
        with pytest.raises(ValueError):
            similar.banding(**wrong)


def test_odd_documents(odd, none):
    rows = odd.collect()
    got = similar.keep_one(odd)
    assert got.columns == odd.columns
    last = lambda d: (1 << 63) - 1 if d is None else d
    want = firsts([(last(r.doc_id), r.text or "") for r in rows])
    assert Counter(last(r.doc_id) for r in got.collect()) == Counter(d for d, _ in want.elements())
    assert similar.keep_one(none).collect() == []


def test_near_fingerprints_are_candidates(spark, monkeypatch):
    """Without any key, sets whose fingerprints differ in few bits are still compared, and linked if their index allows it."""
    monkeypatch.setattr(similar, "band_keys", lambda found, *shape: [])
    rnd = random.Random(3)
    rows = []
    for i in range(30):
        text = [f"w{rnd.randrange(4000)}" for _ in range(400)]
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join([*text[:-1], "other"]))]
    found = [similar.shingles(t) for _, t in rows]
    prints = [similar.set_fingerprint(f) for f in found]
    near = {i for i in range(0, 60, 2) if (prints[i] ^ prints[i + 1]).bit_count() <= similar.DISTANCE}
    assert len(near) > 10
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in similar.keep_one(docs).collect()} == set(range(60)) - {i + 1 for i in near}
    # Fingerprints may be as far as they like: texts that are not alike stay.
    apart = spark.createDataFrame([(1, "a b c d e f g h"), (2, "a b c d e x y z")], "doc_id long, text string")
    assert similar.keep_one(apart, distance=20).count() == 2


def test_what_is_remembered_changes_no_ids(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    little = bpe.encode(docs, vocabulary_path(), decoded=True, remembered=1 << 10, pairs=50)
    assert sorted(little.collect()) == sorted(bpe.encode(docs, vocabulary_path(), decoded=True).collect())


def test_other_tasks_drop_what_was_built():
    from stallmark.llm import chunks
    chunks.BUILT["x",] = object()
    assert list(chunks.frugal(iter, built=True)([1])) == [1] and ("x",) in chunks.BUILT
    assert list(chunks.frugal(iter)([1])) == [1] and not chunks.BUILT
