"""Token counts of texts without building the tokens.

When the vocabulary is loaded, each of its strings is merged alone. Those that come out as one token are proven to
count 1 wherever they make up a whole pre-token; such pre-tokens need a look-up only. The rest is merged, once for
each distinct pre-token that a worker meets (its memory of them starts anew at REMEMBERED entries).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .vocabulary import Cutter, Vocabulary, map_texts, merge, once, share

REMEMBERED = 400_000


class _Lengths(dict):
    """Pre-token to its number of tokens."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.tokens, self.merges = vocabulary.tokens, vocabulary.merges
        self.proven = {}
        for token, i in vocabulary.tokens.items():
            if i in vocabulary.whole:
                try:
                    self.proven[token.decode()] = 1
                except UnicodeDecodeError:  # a part of a character is never a pre-token
                    pass
        self.update(self.proven)

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(merge(piece.encode(), self.tokens, self.merges))
        return n

    def trim(self) -> None:
        if len(self) > REMEMBERED + len(self.proven):
            self.clear()
            self.update(self.proven)


class TokenCounter:
    def __init__(self, vocabulary: Vocabulary):
        self.cutter, self.lengths = Cutter(vocabulary), _Lengths(vocabulary)

    def __call__(self, text: str) -> int:
        total = 0
        for plain, special in self.cutter.parts(text):
            total += sum(map(self.lengths.__getitem__, self.cutter.pieces(plain))) + (special is not None)
        self.lengths.trim()
        return total


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512, doc_id: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > ``limit``) of each row, in order of no kind.

    ``vocabulary`` is the path of a byte-level BPE file. Special strings inside texts count as their special token,
    nothing is added at the ends. Null and empty texts have no bytes and no tokens. Repeated rows stay repeated,
    other columns are not read, an empty table gives an empty result.
    """
    shared = share(docs.sparkSession, vocabulary)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
                       F.col(text).alias("_text"))
    outputs = pa.schema([("n_tokens", pa.int64())])
    schema = T.StructType([rows.schema["doc_id"], T.StructField("n_bytes", T.LongType()),
                           T.StructField("n_tokens", T.LongType())])

    def make():
        counter = once(TokenCounter, shared)
        return lambda value: (counter(value),)

    counted = map_texts(rows, "_text", make, outputs, schema)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
