"""Alignment of two tokenizers against plain loops over whole texts."""

from __future__ import annotations

import random
from bisect import bisect_left
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from stallmark.llm import alignment, queries, sparse
from tests.conftest import SMALL

FIRST, SECOND = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def by_hand():
    first, second = Tokenizer.from_file(FIRST), SentencePieceProcessor(model_file=SECOND)
    first.encode_special_tokens = True
    printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printed)}

    def tokens(text):
        """(id, start, end) on both sides."""
        a = [(i, bytes(table[c] for c in first.id_to_token(i))) for i in first.encode(" " + text, add_special_tokens=False).ids]
        piece = lambda i: bytes([int(second.id_to_piece(i)[3:-1], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode()
        b = [(i, piece(i)) for i in second.encode(text)]
        if not text or not b"".join(t for _, t in a) == b"".join(t for _, t in b) == (" " + text).encode():
            return [], []
        out = []
        for side in (a, b):
            at, placed = 0, []
            for i, t in side:
                placed.append((i, at, at + len(t)))
                at += len(t)
            out.append(placed)
        return out

    return tokens


def groups(a, b):
    ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
    out = [([], []) for _ in ends]
    for side, tokens in enumerate((a, b)):
        for i, _, end in tokens:
            out[bisect_left(ends, end)][side].append(i)
    return out


def report(rows, tokens):
    found = [(doc, *tokens(text or "")) for doc, text in rows]
    grouped = [(doc, a, b, groups(a, b)) for doc, a, b in found]
    counts = Counter(p for *_, g in grouped for p in {(x, y) for xs, ys in g for x in xs for y in ys})
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = Counter()
    for doc, a, b, g in grouped:
        links = [(x, y) for xs, ys in g for x in xs for y in ys]
        text = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in g)
        out[doc, len(a), len(b), len(g), len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links),
            sha256(text.encode()).hexdigest() if g else ""] += 1
    return out


@pytest.mark.parametrize("frequent", [alignment.FREQUENT, 500, 0])
def test_odd_documents(odd, by_hand, frequent):
    want = report([(r.doc_id, r.text) for r in odd.collect()], by_hand)
    assert Counter(map(tuple, alignment.alignment_counts(odd, FIRST, SECOND, frequent=frequent).collect())) == want


def test_query_on_the_smallest_documents(spark, by_hand):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert Counter(map(tuple, queries.queries()["op11_alignment"](spark, SMALL).collect())) == report(map(tuple, docs), by_hand)


def test_empty_table(none):
    assert alignment.alignment_counts(none, FIRST, SECOND).collect() == []
    assert alignment.align(none, FIRST, SECOND).collect() == []


def strange(seed: int) -> list[str]:
    rnd = random.Random(seed)
    parts = [" ", "  ", "\n", "\t", " \n ", " ", " ", "\u0085", "\x1c", "​", "a", "B", "word", "'s", "12", "345", "...", "é", "é",
             "ß", "漢字", "😀", "👩‍👩‍👧", "ال", "<s>", "</s>", "<unk>", "<|endoftext|>", "<0x41>", "ﬁ", "Ⅷ", "\u0000", "=" * 40, "ab" * 50]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 40))) for _ in range(400)] + ["▁", "a▁b", " ", "﻿x"]


def test_strange_texts_and_outputs(spark, by_hand):
    rows = list(enumerate(strange(3)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in alignment.align(docs, FIRST, SECOND).collect()}
    assert sum(bool(r.a_ids) for r in got.values()) > 300
    for doc, text in rows:
        a, b = by_hand(text)
        g = groups(a, b)
        overlaps = [(i, j, min(x[2], y[2]) - max(x[1], y[1])) for i, x in enumerate(a) for j, y in enumerate(b) if x[1] < y[2] and y[1] < x[2]]
        r = got[doc]
        assert (r.a_ids, r.b_ids) == ([i for i, *_ in a], [i for i, *_ in b]), text
        assert [tuple(x) for x in r.groups] == [(len(x), len(y)) for x, y in g]
        assert [tuple(x) for x in r.overlaps] == overlaps
    assert Counter(map(tuple, alignment.alignment_counts(docs, FIRST, SECOND).collect())) == report(rows, by_hand)


def test_products_of_sparse_matrices(monkeypatch):
    monkeypatch.setattr(sparse, "AT_ONCE", 7)
    rnd = np.random.default_rng(1)
    for _ in range(30):
        n, m, k = rnd.integers(1, 12, 3)
        a, b = (rnd.integers(0, 3, s) * (rnd.random(s) < 0.4) for s in ((n, m), (m, k)))
        of = lambda x: sparse.Csr.of(*np.nonzero(x), x[np.nonzero(x)], x.shape)
        out = of(a).times(of(b))
        dense = np.zeros((n, k), np.int64)
        dense[out.rows(), out.indices] = out.data
        assert (dense == a @ b).all()
        back = of(a).transposed()
        assert back.height == m and (back.indices < n).all()


def test_pre_tokens_are_encoded_together():
    with open(FIRST, encoding="utf-8") as a, open(SECOND, "rb") as b:
        aligner = alignment.Aligner(a.read(), b.read())
    pieces = [" a", " ÿÀé", "!?", " Straße", " " + "x" * 300]
    assert [np.frombuffer(i, np.int32).tolist() for i in aligner._first(pieces)] == [
        aligner.first.encode(p, add_special_tokens=False).ids for p in pieces]


def test_chunks_of_odd_spaces_and_marks_are_those_of_whole_texts(by_hand):
    with open(FIRST, encoding="utf-8") as a, open(SECOND, "rb") as b:
        aligner = alignment.Aligner(a.read(), b.read())
    rnd = random.Random(6)
    pool = [" ", " ", "\n", "\t", "\u00a0", "\u2003", "the", "Été", "a,", "word.", "x--", "'s", "12", "漢", "\x00", "<|endoftext|>"]
    texts = ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 9))) for _ in range(1500)] + ["", " ", "a b", " a", "a ", "a \n b", "the the, the"]
    for at in range(0, len(texts), 400):
        own = texts[at:at + 400]
        found = aligner.align([t.encode() for t in own])
        n_a, n_b, n_groups, _ = found.totals()
        written = found.written()
        for k, text in enumerate(own):
            a, b = by_hand(text)
            grouped = groups(a, b)
            assert (n_a[k], n_b[k], n_groups[k]) == (len(a), len(b), len(grouped)), repr(text)
            assert written[k] == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in grouped)
    assert not hasattr(aligner, "words")  # a word is remembered once, as a chunk
