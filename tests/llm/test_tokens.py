"""Token counts, BPE encoding and decoding against the library they follow."""

from __future__ import annotations

import hashlib
import random
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from stallmark.llm import bpe, prefixes, token_counts, vocabulary

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def samples() -> list[str]:
    rnd = random.Random(7)
    pool = [chr(c) for c in [*range(1, 0x600), 0x85, 0x2028, 0x3000, 0x200B, 0x4E00, 0x1F600, 0x10940, 0x323AF, 0xB2]]
    pool += ["<|endoftext|>", " ", "  ", "\n", "'s", "don't", "hello", "123"] * 40
    return ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 60))) for _ in range(1500)] + [
        "", "a" * 5000, "ab" * 3000, " " * 3000, "é" * 999, "=-" * 700, "<|endoftext|>" * 3]


def test_ids_counts_and_texts_are_those_of_the_library(library):
    v = vocabulary.load(PATH)
    codec, count = bpe.Codec(v), token_counts.TokenCounter(v)
    for text in samples():
        want = library.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == want
        assert count(text) == len(want)
        assert codec.decode(want) == library.decode(want, skip_special_tokens=False)


def test_every_code_point_is_cut_as_the_library_cuts_it(library):
    cutter = vocabulary.Cutter(vocabulary.load(PATH))
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 4096):
        text = "".join(f"a{chr(c)}1{chr(c)}!{chr(c)} {chr(c)}x" for c in points[at:at + 4096])
        assert cutter.pieces(text) == [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]


def test_both_merges_agree():
    v = vocabulary.load(PATH)
    rnd = random.Random(3)
    for _ in range(300):
        piece = bytes(rnd.choice(b"abcdefgh the") for _ in range(rnd.randint(1, 64)))
        ids = [v.tokens[piece[i:i + 1]] for i in range(len(piece))]
        assert vocabulary.merge(piece, v.tokens, v.merges) == vocabulary._merge_long(ids, v.merges)


def test_pairs_fit_as_merging_says():
    v = vocabulary.load(PATH)
    codec, rnd = bpe.Codec(v), random.Random(5)
    assert codec.made is not None
    text = "the quick aaaaaaaa hahahahaha  ---- ==== 1234 therein of in the".split(" ")
    tokens = [i for i in v.whole if rnd.random() < 0.02] + [i for t, i in v.tokens.items() if i in v.whole and any(w and w in t.decode("latin-1") for w in text)]
    pairs = [(rnd.choice(tokens), rnd.choice(tokens)) for _ in range(20_000)] + [(t, t) for t in tokens]
    # Cuts of tokens are close to merging.
    for t in rnd.sample(sorted(v.whole), 4000):
        raw = codec.bytes[t]
        for k in range(1, len(raw)):
            if (a := v.tokens.get(raw[:k])) in v.whole and (b := v.tokens.get(raw[k:])) in v.whole:
                pairs.append((a, b))
    got = [codec.fits(a << 32 | b) for a, b in pairs]
    codec.made = None
    assert got == [codec.fits(a << 32 | b) for a, b in pairs] and 0 < sum(got) < len(got)


def test_memories_start_anew(monkeypatch, library):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    monkeypatch.setattr(bpe, "PAIRS", 5)
    monkeypatch.setattr(token_counts, "REMEMBERED", 5)
    v = vocabulary.load(PATH)
    codec, count = bpe.Codec(v), token_counts.TokenCounter(v)
    for text in samples()[:100]:
        want = library.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == want and count(text) == len(want)


def test_pre_tokens_together_are_as_merged_one_by_one(library):
    v, rnd = vocabulary.load(PATH), random.Random(7)
    some = [bytes(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) for letters in (b" aeinthor", b"=- \n", bytes(range(256)), "é漢ïa".encode())
            for _ in range(800)] + [b"the" * 60, b"", b"a" * 300, *rnd.sample(sorted(v.tokens), 500)]
    want = [array("i", vocabulary.merge(x, v.tokens, v.merges)).tobytes() for x in some]
    for bits in (2, 18):  # pairs that drive each other out change nothing
        made = prefixes.Prefixes(v.tokens, v.merges, v.whole, bits)
        assert made.encode(some) == want and made.encode(some[::-1]) == want[::-1] and made.encode([]) == []
    codec = bpe.Codec(v)
    assert "automaton" not in vars(codec) and not hasattr(codec, "pieces")  # what a worker keeps is small
    pairs = [(rnd.choice(sorted(v.whole)), rnd.choice(sorted(v.whole))) for _ in range(3000)]
    got = codec.prefixes.fits(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    assert got.tolist() == [codec.fits(a << 32 | b) for a, b in pairs]


def test_spaces_beside_other_white_space(library):
    v, rnd = vocabulary.load(PATH), random.Random(8)
    pool = [" ", " ", "\n", "\t", "\x1c", "\u00a0", "\u2003", "the", "Été", "a,", "x--", "'s", "12", "<|endoftext|>", "漢"]
    texts = ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 12))) for _ in range(4000)] + ["", " ", "  ", " a", "a ", "a b", "a \n b"]
    for codec in (bpe.Codec(v), bpe.Codec(v, 50, 50)):
        for at in range(0, len(texts), 300):
            own = texts[at:at + 300]
            assert [array("i", x).tolist() for x in codec.encode_all(own)] == [library.encode(t, add_special_tokens=False).ids for t in own]


def test_rows_decode_as_one_by_one():
    codec, rnd = bpe.Codec(vocabulary.load(PATH)), random.Random(9)
    halves = codec.encode("漢字é")  # rows that end inside characters
    rows = [[rnd.choice(halves) for _ in range(rnd.randint(0, 5))] for _ in range(200)] + [[], codec.encode("the end"), halves[:1], halves[1:]]
    for own in (rows, rows[-4:], [halves, [], halves], [], [[]], [halves[:1], halves[1:]]):
        coded = pa.array(own, pa.list_(pa.int32()))
        assert codec.decode_all(coded).to_pylist() == [codec.decode(ids) for ids in own]
        assert codec.decode_all(coded.slice(1)).to_pylist() == [codec.decode(ids) for ids in own[1:]]


def test_odd_documents(odd, library):
    want = sorted((r.doc_id if r.doc_id is not None else -1, len((r.text or "").encode()),
                   len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in odd.collect())
    got = token_counts.count_tokens(odd, PATH).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    coded = bpe.encode(odd, PATH, decoded=True)
    assert sorted((r.decoded or "") for r in coded.collect()) == sorted((r.text or "") for r in odd.collect())
    back = bpe.decode(coded.drop("decoded"), PATH)
    assert sorted(r.text for r in back.collect()) == sorted((r.text or "") for r in odd.collect())
    text = next(r for r in odd.collect() if r.doc_id == 7).text
    ids = library.encode(text, add_special_tokens=False).ids
    digest = next(r for r in bpe.digests(coded).collect() if r.doc_id == 7)
    assert digest.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert (digest.n_tokens, digest.decoded_sha256) == (len(ids), hashlib.sha256(text.encode()).hexdigest())


def test_empty_table(none):
    assert token_counts.count_tokens(none, PATH).collect() == []
    assert bpe.digests(bpe.encode(none, PATH, decoded=True)).collect() == []
