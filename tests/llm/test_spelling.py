"""Spelling variants against all pairs of words."""

from __future__ import annotations

import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stallmark.llm import kdtree, queries, spelling
from tests.conftest import SMALL


def counted(rows, drop_every=97):
    out = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if doc is None else doc}:{run}".encode())
            if drop_every and h % drop_every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def grouped(n):
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in n}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def got(df):
    rows = list(map(tuple, df.collect()))
    assert len(set(rows)) == len(rows)
    return set(rows)


def test_query_on_the_smallest_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    df = queries.queries()["op12_spelling"](spark, SMALL)
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = grouped(counted(map(tuple, docs)))
    assert any(r[1] and r[2] != r[1] for r in want)
    assert got(df) == want


@pytest.mark.parametrize("tile, sample", [(spelling.TILE, spelling.SAMPLE), (400, 300), (200, 1)])
def test_many_close_words(spark, tile, sample):
    rnd = random.Random(tile)
    words = {"".join(rnd.choice("abcd" if rnd.random() < 0.9 else "éÿxyz") for _ in range(rnd.randint(5, 7))) for _ in range(400)}
    words |= {"aaaaa" + "b" * k for k in range(40)} | {"x" * 300 + "y", "x" * 300} | {"".join(rnd.sample("abcdef", 6)) for _ in range(99)}
    n = {w: int(3 ** rnd.uniform(1, 9)) for w in words}
    df = spelling.group_variants(spark.createDataFrame(list(n.items()), "word string, n int").repartition(3), sample=sample, tile=tile)
    assert got(df) == grouped(n)


def test_long_chains(spark):
    n = {"abcde" + "z" * k: 3 * 2 ** k for k in range(20)}
    df = spelling.group_variants(spark.createDataFrame(list(n.items()), "word string, n long"))
    assert got(df) == grouped(n) and {r.root for r in df.collect()} == {"abcde" + "z" * 19}


def test_odd_documents(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    for every in (None, 1, 7):
        assert got(spelling.spelling_variants(odd, drop_every=every)) == grouped(counted(rows, every))
    assert spelling.spelling_variants(none).collect() == []


def test_letters_beyond_ascii(spark):
    texts = ["ÉCOLE École école ecole ECOLE", "naïve×÷ straße STRASSE", "x" * 50_000 + " İstanbul ıstanbul", "αβγδεζ abcdeαfghij"] * 3
    rows = [(i % 5 or None, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(spelling.spelling_variants(df, drop_every=3)) == grouped(counted(rows, 3))


WORD = st.text("abé", min_size=1, max_size=7)


@settings(max_examples=300, deadline=None)
@given(st.lists(WORD, min_size=1, max_size=30), st.lists(WORD, min_size=1, max_size=30))
def test_pairs_of_two_lengths(a, b):
    for m in {len(w) for w in a}:
        for n in {len(w) for w in b} & {m - 1, m, m + 1}:
            x, y = [w for w in a if len(w) == m], [w for w in b if len(w) == n]
            found = [(i, j) for p, q in spelling.near_pairs(spelling.letters(x), spelling.letters(y)) for i, j in zip(p.tolist(), q.tolist())]
            assert sorted(found) == [(i, j) for i, v in enumerate(x) for j, w in enumerate(y) if one_edit(v, w)]


def test_boxes_are_pruned_and_none_is_missed():
    rnd = np.random.default_rng(3)
    points = rnd.poisson(1, (4000, 8)).astype(np.int32)
    for tight in (True, False):
        tree = kdtree.KdTree(points, 20, tight)
        assert sorted(np.concatenate(tree.leaves).tolist()) == list(range(4000))
        place = tree.place(points)
        assert all((place[own] == k).all() for k, own in enumerate(tree.leaves))
        seen = dict(tree.reached(points[:50], 2))
        for q in range(50):
            near = np.flatnonzero(np.abs(points - points[q]).sum(axis=1) <= 2)
            assert all(q in seen[place[i]] for i in near)
        assert sum(map(len, seen.values())) < 50 * len(tree.leaves) / 2
