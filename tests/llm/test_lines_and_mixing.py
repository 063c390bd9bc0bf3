"""Line windows and source mixing against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from stallmark.llm import line_dedup, mixing

BIG = 1 << 62


def without_repeats(rows: list[tuple]) -> list[tuple]:
    """(doc_id, text) to (doc_id, text, lines, removed)."""
    first: dict[tuple, tuple] = {}
    every = []
    for doc_id, text in rows:
        lines, place = (text.split("\n") if text is not None else []), BIG if doc_id is None else doc_id
        for i in range(len(lines) - 2):
            w = tuple(lines[i:i + 3])
            if "".join(w).strip(" \t\r\f\v"):
                first[w] = min(first.get(w, (BIG + 1, 0)), (place, i))
        every.append((doc_id, place, text, lines))
    out = []
    for doc_id, place, text, lines in every:
        gone = {i + k for i in range(len(lines) - 2) for k in range(3)
                if (w := tuple(lines[i:i + 3])) in first and (place, i) > first[w]}
        kept = [x for i, x in enumerate(lines) if i not in gone]
        out.append((doc_id, None if text is None else "\n".join(kept), len(lines), len(gone)))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


def test_lines_of_odd_documents(odd):
    want = without_repeats([(r.doc_id, r.text) for r in odd.collect()])
    assert sum(r[3] for r in want) > 20
    assert ordered(line_dedup.dedup_lines(odd).collect()) == ordered(want)
    kept = line_dedup.clean_documents(odd)
    assert kept.columns == odd.columns
    rows = kept.collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r[0], r[1]) for r in want)
    # The length follows a text that was cut, and stays as it was otherwise.
    cut = {r[0] for r in want if r[3]}
    assert all(r.n_chars == len(r.text) for r in rows if r.doc_id in cut - {0, 3, 5, None})


def test_passages_that_many_documents_share(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefg") for _ in range(6))
    passage = [" ".join(word() for _ in range(20)) for _ in range(4)]
    rows = []
    for i in range(120):
        own = [word() for _ in range(rnd.randint(0, 6))]
        at = rnd.randint(0, len(own))
        rows.append((i, "\n".join(own[:at] + (passage if i % 3 == 0 else []) + own[at:])))
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    assert ordered(got) == ordered(without_repeats(rows))
    assert sum(passage[1] in (r.text or "") for r in got) == 1
    assert all(r.n_removed == 0 for r in got if r.doc_id % 3)


def mixed(rows: list[tuple], weights=(5, 2, 1), share=1.5, most=2) -> dict:
    """Targets by sharing again and again, as the rule says."""
    sizes: dict = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, target = share * sum(sizes.values()), set(names), {}
    while free:
        each = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if each[s] > most * sizes[s]}
        if not over:
            target |= each
            break
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
        free -= over
    return {s: (sizes[s], target[s]) for s in names}


def check_mix(rows: list[tuple], got: list) -> None:
    want = mixed(rows)
    taken: dict = defaultdict(int)
    by_row = {(r.doc_id, r.size): r for r in got}
    for doc_id, text, source in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        r = by_row[doc_id, n]
        assert (r.source_size, r.target) == (want[source][0], pytest.approx(want[source][1]))
        assert r.taken <= 2 * n and (n == 0 or r.taken % n == 0)
        taken[source] += r.taken
    for source, (_, target) in want.items():
        largest = max(len((t or "").split()) for _, t, s in rows if s == source)
        assert abs(taken[source] - target) <= max(largest, 0.01 * target)


def test_mix_of_odd_documents(odd):
    rows = [(r.doc_id, r.text, r.source) for r in odd.collect() if r.doc_id not in (None, 0, 3, 5)]
    some = odd.filter("doc_id not in (0, 3, 5)")
    got = mixing.mix(some).collect()
    assert len(got) == len(rows)
    check_mix(rows, got)
    assert ordered(got) == ordered(mixing.mix(some.repartition(5)).collect())
    copies = mixing.mixed_documents(odd)
    assert copies.columns == odd.columns
    taken = Counter()
    for r in copies.collect():
        taken[r.doc_id] += len((r.text or "").split())
    every: Counter = Counter()
    for r in mixing.mix(odd).collect():
        every[r.doc_id] += r.taken
    assert {k: v for k, v in taken.items() if v} == {k: v for k, v in every.items() if v}


def test_many_sources_and_one_hot_source(spark):
    rnd = random.Random(9)
    rows = [(i, " ".join("w" for _ in range(rnd.randint(0, 400))), "hot" if i % 3 == 0 else f"s{i % 29:02d}") for i in range(3000)]
    check_mix(rows, mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect())


def test_the_draw_is_near_its_fraction_over_seeds(spark):
    rows = [(i, "w " * 10, "a" if i < 200 else "b") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    total: Counter = Counter()
    for seed in range(6):
        for r in mixing.mix(docs, seed=seed, weights=(2, 3)).collect():
            total[r.doc_id] += r.taken // 10
    # Documents differ between seeds: the draw does not always take the same ones.
    assert len(set(total.values())) > 2


def test_empty_tables(none):
    assert line_dedup.dedup_lines(none).collect() == []
    assert line_dedup.clean_documents(none).collect() == []
    assert mixing.mix(none).collect() == []
    assert mixing.mixed_documents(none).collect() == []


def test_steps_are_the_digest(spark):
    r = mixing.mix(spark.createDataFrame([(3, "a b", "s")], "doc_id long, text string, source string")).first()
    assert r.size == 2 and 0 <= int(hashlib.md5(b"42:3:a b").hexdigest()[:3], 16) < mixing.GRID
