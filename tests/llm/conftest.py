"""Documents with every odd case: nulls, empty and long texts, repeated rows and ids, clashing extra columns."""

from __future__ import annotations

import random

import pytest

WORDS = "the of red green blue house tree and river stone walks slowly under a bright winter sky with its old friends".split()
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, _id long, hash string, _kept string, "
          "row string, size long, step long, component string, place string, v string")


def sentence(rnd: random.Random, n: int) -> str:
    return " ".join(rnd.choice(WORDS) + rnd.choice(["", "", "x", "ly", "."]) for _ in range(n))


def odd_rows(seed: int = 1) -> list[tuple]:
    rnd = random.Random(seed)
    texts = ["\n".join(sentence(rnd, rnd.randint(1, 30)) for _ in range(rnd.randint(1, 8))) for _ in range(40)]
    texts += [texts[0], texts[0] + " more", texts[1], None, "", " \n\t ", "one", "one two", "Ünï çödé ß\n\n\nß", "\n\n\n\n",
              sentence(rnd, 4000), "x" * 30_000, "a\nb\nc\na\nb\nc\na", "same\n" * 9, "<|endoftext|>a<|endoftext|>"]
    rows = [(i, t, "en", f"src{i % 4}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[0], rows[3], (None, texts[2], None, None, None), (None, None, None, "src1", None), (5, "other text", "de", "src2", 0)]
    return [(*r, 1, "h", "k", "r", 2, 3, "c", "p", "v") for r in rows]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
