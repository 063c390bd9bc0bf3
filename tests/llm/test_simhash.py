"""SimHash groups against all pairs."""

from __future__ import annotations

import itertools
import random

import pytest
import xxhash

from stallmark.llm import components, fingerprint64, pigeonhole, simhash


def by_hand(text: str | None) -> int:
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def roots(values: list[int], distance: int) -> dict[int, int]:
    above = {v: v for v in values}

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    for a, b in itertools.combinations(above, 2):
        if (a ^ b).bit_count() <= distance:
            above[max(root(a), root(b))] = min(root(a), root(b))
    return {v: root(v) for v in above}


def test_fingerprint(odd, monkeypatch):
    texts = [r.text for r in odd.collect()]
    assert [fingerprint64.fingerprint(t) for t in texts] == [by_hand(t) for t in texts]
    monkeypatch.setattr(fingerprint64, "BLOCK", 3)
    assert [fingerprint64.fingerprint(t) for t in texts[:40]] == [by_hand(t) for t in texts[:40]]


def test_the_hash_is_spark_s(spark):
    row = spark.sql("SELECT xxhash64('red green blue') AS h").first()
    assert row.h % (1 << 64) == xxhash.xxh64_intdigest(b"red green blue", 42)


@pytest.mark.parametrize("distance", [0, 1, 3, 5])
@pytest.mark.parametrize("size", [60, 900])
def test_links_connect_what_all_pairs_connect(spark, monkeypatch, distance, size):
    monkeypatch.setattr(pigeonhole, "TILE", 8)
    rnd = random.Random(size + distance)
    # Clusters around a few centres, many within a flip or two: keys that many share.
    centres = [rnd.getrandbits(64) for _ in range(6)]
    values = {0, (1 << 64) - 1}
    while len(values) < size:
        v = rnd.choice(centres) if rnd.random() < 0.7 else rnd.getrandbits(64)
        for _ in range(rnd.randint(0, 5)):
            v ^= 1 << rnd.randrange(64)
        values.add(v)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    fps = spark.createDataFrame([(v,) for v in signed] + [(None,)], "fp long").repartition(5)
    edges = pigeonhole.links(fps, distance)
    got = {r.node: r.component for r in components.components(edges).collect()}
    want = roots(list(values), distance)
    groups = lambda pairs: {frozenset(v for v, _ in g) for _, g in itertools.groupby(
        sorted(pairs, key=lambda p: (p[1], p[0])), key=lambda p: p[1])}
    own = [(v, got.get(v, v)) for v in signed]
    assert groups(own) == groups([(v - (1 << 64) if v >> 63 else v, r) for v, r in want.items()])


def test_components_of_chains_stars_and_loops(spark):
    chain = [(i, i + 1) for i in range(100)]
    edges = chain + [(1000, i) for i in range(1001, 1200)] + [(5, 5), (None, 3), (7, 8), (2000, 2001)]
    rnd = random.Random(2)
    rnd.shuffle(edges)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {n: c for n, c in got.items() if n <= 100} == {n: 0 for n in range(101)}
    assert all(got[n] == 1000 for n in range(1000, 1200)) and got[2001] == 2000
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_odd_documents(odd):
    rows = odd.collect()
    prints = [by_hand(r.text) for r in rows]
    root = roots(prints, 3)
    least: dict[int, int | None] = {}
    for r, f in zip(rows, prints):
        ids = [x for x in (least.get(root[f]), r.doc_id) if x is not None]
        least[root[f]] = min(ids) if ids else None
    key = lambda x: tuple(-1 if v is None else v for v in x)
    want = sorted(((r.doc_id, f"{f:016x}", least[root[f]]) for r, f in zip(rows, prints)), key=key)
    assert sorted(map(tuple, simhash.near_duplicates(odd).collect()), key=key) == want
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    got = kept.collect()
    assert len(got) == len(set(root.values()))
    assert {root[by_hand(r.text)] for r in got} == set(root.values())
    assert all(r.doc_id == least[root[by_hand(r.text)]] for r in got)


def test_empty_table(none):
    assert simhash.near_duplicates(none).collect() == []
    assert simhash.keep_one(none).collect() == []
