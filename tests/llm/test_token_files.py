"""Simple-8b blocks and token files against the tokenizer library and plain Python."""

from __future__ import annotations

import sys
import unicodedata
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stallmark.llm import queries, simple8b, token_files
from tests.conftest import SMALL
from tests.llm.test_alignment import strange

WORDS = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 50_000), st.integers(0, 2**64 - 1)), max_size=300), st.data())
def test_round_trip(found, data):
    block = simple8b.pack(np.array(found, np.uint64))
    assert simple8b.unpack(block).tolist() == found
    start = data.draw(st.integers(0, len(found)))
    stop = data.draw(st.integers(start, len(found) + 2))
    assert simple8b.unpack(block, start, stop).tolist() == found[start:stop]


def test_parts_across_frames():
    rnd = np.random.default_rng(2)
    found = rnd.integers(0, 2**rnd.integers(1, 63, 20_000), dtype=np.uint64)
    block = simple8b.pack(found)
    for start, stop in ((0, 1), (511, 513), (4_000, 4_001), (19_999, 20_000), (1_000, 15_000), (7, 7)):
        assert (simple8b.unpack(block, start, stop) == found[start:stop]).all()
    with pytest.raises(ValueError):
        simple8b.unpack(b"x" * 100)


def test_words_hold_as_many_as_fit():
    sizes = lambda x: len(simple8b.words(np.array(x, np.uint64))[0])
    assert sizes([1] * 60) == 1 and sizes([1] * 61) == 2 and sizes([40_000] * 9) == 3 and sizes([30_000] * 8) == 2
    assert simple8b.words(np.array([2**60, 5], np.uint64))[1].tolist() == [2**60]


@pytest.fixture(scope="module")
def encode():
    tokenizer = Tokenizer.from_file(WORDS)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def by_hand(rows, encode):
    at, out = 0, []
    for doc, text in rows:
        ids = encode(text)
        out.append((doc, at, len(ids), crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_query_on_the_smallest_documents(spark, encode):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = queries.queries()["op13_token_files"](spark, SMALL)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect())) == by_hand(sorted(map(tuple, docs)), encode)


def test_chunks_do_not_change_ids(spark, tmp_path, encode):
    every = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF and unicodedata.category(chr(c)) != "Cn"]
    texts = ["".join(f"a{c}b {c}1" for c in every[at:at + 500]) for at in range(0, len(every), 500)]
    texts += strange(5) + ["<|startoftext|> <|endoftext|>x", "Σ ΟΔΟΣ ΟΔΟΣ.", "a ́b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    token_files.write_tokens(docs, str(tmp_path / "all"), WORDS, 2)
    assert sorted(map(tuple, token_files.checksums(spark, str(tmp_path / "all")).collect())) == by_hand(enumerate(texts), encode)


def test_odd_documents(spark, odd, none, tmp_path, encode, monkeypatch):
    path = str(tmp_path / "odd")
    token_files.write_tokens(odd, path, WORDS, 2)
    got = sorted(token_files.read_tokens(spark, path).collect(), key=lambda r: r.start)
    last = lambda d: (1 << 63) - 1 if d is None else d
    rows = odd.collect()
    assert [last(r.doc_id) for r in got] == sorted(last(r.doc_id) for r in rows)
    assert sorted((last(r.doc_id), r.ids) for r in got) == sorted((last(r.doc_id), encode(r.text)) for r in rows)
    assert [r.start for r in got] == np.append(0, np.cumsum([len(r.ids) for r in got]))[:-1].tolist()
    assert [r.n_tokens for r in got] == [len(r.ids) for r in got]
    token_files.write_tokens(none, str(tmp_path / "none"), WORDS, 2)
    assert token_files.read_tokens(spark, str(tmp_path / "none")).collect() == []
    names = odd.selectExpr("string(doc_id) AS doc_id", "text")
    token_files.write_tokens(names, str(tmp_path / "names"), WORDS)
    assert token_files.checksums(spark, str(tmp_path / "names")).schema["doc_id"].dataType.simpleString() == "string"
    assert token_files.checksums(spark, str(tmp_path / "names")).count() == len(rows)


def test_equal_rows_are_split(spark, tmp_path, encode):
    rows = [(None if i % 3 else i, "same text") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    token_files.write_tokens(docs, str(tmp_path / "f"), WORDS, 2)
    n = len(encode("same text"))
    assert sorted(r.start for r in token_files.checksums(spark, str(tmp_path / "f")).collect()) == list(range(0, 3000 * n, n))
