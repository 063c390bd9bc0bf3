"""BPE encoding by a dynamic programme over prefixes, and decoding.

The encoding of a prefix ends in exactly one token: the one whose start is the end of a shorter prefix and that is
compatible with that prefix's own last token. An automaton over the vocabulary gives the tokens that end at each
position, longest first; the first compatible one is stored. Going back from the end emits the ids. Time follows the
length of a pre-token, however long it is. Pre-tokens of up to TOGETHER bytes are taken many at once (``prefixes``).

Two tokens are compatible if merging their joined bytes gives the same two tokens back. Texts are cut before spaces between
two characters that are no white space, where a pre-token begins in any case. Results of the test and of such chunks are
remembered in the worker, up to a fixed size.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import WORD, Memory, frugal, slices
from .prefixes import Prefixes
from .vocabulary import LOW, NEVER, Cutter, Vocabulary, merge, once, share

#: Units of one generation of remembered chunks, and entries of one of pairs.
REMEMBERED = 20 << 20
PAIRS = 200_000
#: Bytes of text encoded at once.
AT_ONCE = 2 << 20
#: Longer pre-tokens are encoded one by one.
TOGETHER = 128
#: Where a space follows a character that is no white space and precedes another.
CUT = re.compile(r"(?<=\S)(?= \S)")


class Recent(dict):
    """Values computed when first asked for. Of those, two generations of at most ``most`` entries stay: what is asked for
    again moves on to the younger one, so frequent keys are never lost."""

    def __init__(self, compute, most: int):
        super().__init__()
        self.compute, self.most, self.before = compute, most, {}

    def __missing__(self, key):
        value = self.before.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.most:
            self.before = dict(self)
            self.clear()
        self[key] = value
        return value


class Codec:
    def __init__(self, vocabulary: Vocabulary, remembered: int = REMEMBERED, pairs: int = PAIRS):
        self.tokens, self.merges, self.special = vocabulary.tokens, vocabulary.merges, vocabulary.special
        self.whole = vocabulary.whole
        self.bytes = {i: t for t, i in vocabulary.tokens.items()} | {i: t.encode() for t, i in self.special.items()}
        self.cutter = Cutter(vocabulary)
        self.table = [self.bytes.get(i, b"") for i in range(max(self.bytes) + 1)]
        self.binary = pa.array(self.table, pa.binary())
        self.chunks = Memory(self._chunks, remembered)
        self.compatible = Recent(self.fits, pairs)
        # Rank of the merge that makes each token; none if a token comes of several merges.
        ranks = {found & LOW: found >> 32 for found in self.merges.values()}
        self.made = [ranks.get(i, -1) for i in range(len(self.table))] if len(ranks) == len(self.merges) else None
        self.prefixes = None if self.made is None else Prefixes(vocabulary.tokens, vocabulary.merges, self.whole, pairs.bit_length())

    @cached_property
    def halves(self) -> dict[int, tuple[int, int]]:
        """What the merge that makes a token merges."""
        return {found & LOW: (pair >> 32, pair & LOW) for pair, found in self.merges.items()}

    @cached_property
    def automaton(self):
        import ahocorasick

        out = ahocorasick.Automaton()
        for token, i in self.tokens.items():
            if i in self.whole:  # others are in no encoding
                out.add_word(token.decode("latin-1"), (i, len(token)))
        out.make_automaton()
        return out

    def fits(self, pair: int) -> bool:
        """Whether two tokens side by side stay apart.

        Going back in time, the one made later is undone. What then lies at the border must not have a merge that comes before
        the one undone; of equal merges the left one comes first.
        """
        left, right = pair >> 32, pair & LOW
        if self.made is None:
            return merge(self.bytes[left] + self.bytes[right], self.tokens, self.merges) == [left, right]
        made, halves, limit = self.made, self.halves, NEVER
        while self.merges.get(left << 32 | right, NEVER) >> 32 >= limit >> 32:
            before, after = made[left], made[right]
            if before > after:
                limit, left = before << 32, halves[left][1]
            elif after >= 0:
                limit, right = after + 1 << 32, halves[right][0]
            else:
                return True
        return False

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        n, compatible = len(piece), self.compatible
        last, size = [-1] * (n + 1), [0] * (n + 1)
        for at, (token, length) in self.automaton.iter(piece.decode("latin-1")):
            end = at + 1
            if size[end]:
                continue
            start = end - length
            if not start or compatible[last[start] << 32 | token]:
                last[end], size[end] = token, length
        ids, at = [], n
        while at:
            ids.append(last[at])
            at -= size[at]
        return tuple(reversed(ids))

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """32-bit ids of pre-tokens."""
        raw = [piece.encode() for piece in pieces]
        longest = -1 if self.prefixes is None else TOGETHER
        together = [piece for piece in raw if len(piece) <= longest]
        found = iter(self.prefixes.encode(together) if together else ())
        return [next(found) if len(piece) <= longest else array("i", self.encode_piece(piece)).tobytes() for piece in raw]

    def _cut(self, chunk: str) -> list[str | int]:
        """The pre-tokens of a chunk, and the ids of special strings in it."""
        return [x for plain, special in self.cutter.parts(chunk)
                for x in (*self.cutter.pieces(plain), *([] if special is None else [self.special[special]]))]

    def _chunks(self, keys: list[str]) -> list[bytes | None]:
        """32-bit ids of chunks by their keys; none for a key that comes of a cut beside white space."""
        known, known_before = self.chunks.young.get, self.chunks.old.get
        cut: list[str | list[str | int | bytes] | None] = []
        for key in keys:
            if key.isascii() and key.isalpha():
                cut.append(" " + key)
                continue
            space, body = (" ", key) if key[:1] != " " else ("", key[1:]) if key[:2] != "  " else ("", key[2:])
            if key[:2] != "  " and body.strip() != body or not body:
                cut.append(None)
            # A word with the space before it and the marks after it are two; an apostrophe may belong to either.
            elif not (found := WORD.fullmatch(body)):
                cut.append(self._cut(space + body))
            elif found[2]:
                word = found[1]
                cut.append([(space and (known(word) or known_before(word))) or space + word, found[2]])
            else:
                cut.append(space + body)
        new = list({x for parts in cut if parts for x in ((parts,) if isinstance(parts, str) else parts) if isinstance(x, str)})
        ids = dict(zip(new, self._pieces(new)))
        return [ids[parts] if isinstance(parts, str) else None if parts is None else
                b"".join([ids[x] if isinstance(x, str) else x if isinstance(x, bytes) else array("i", [x]).tobytes() for x in parts])
                for parts in cut]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as 32-bit integers.

        Keys of chunks are what stands between two spaces; after one space is the first chunk of a text, after two any chunk as
        it is. Texts with a space beside other white space are cut by the exact rule.
        """
        split = [t.split(" ") for t in texts]
        for parts in split:
            parts[0] = " " + parts[0]
        known = self.chunks.ready(set().union(*split)).__getitem__
        out: list[bytes] = []
        odd: list[tuple[int, list[str]]] = []
        for at, parts in enumerate(split):
            try:
                out.append(b"".join(map(known, parts)))
            except TypeError:  # a chunk without ids
                out.append(b"")
                if texts[at]:
                    odd.append((at, [c[1:] if k and c[-1:].strip() else "  " + c for k, c in enumerate(CUT.split(texts[at]))]))
        known = self.chunks.ready(set().union(*(parts for _, parts in odd))).__getitem__
        for at, parts in odd:
            out[at] = b"".join(map(known, parts))
        return out

    def encode(self, text: str) -> list[int]:
        return array("i", self.encode_all([text])[0]).tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.table.__getitem__, ids)).decode("utf-8", "replace")

    def decode_all(self, coded: pa.ListArray) -> pa.StringArray:
        """The text of each row of ids."""
        joined = self.binary.take(coded.flatten())
        of_tokens = np.frombuffer(joined.buffers()[1], np.int32)[:len(joined) + 1] if len(joined) else np.zeros(1, np.int32)
        edges = of_tokens[coded.offsets.to_numpy() - coded.offsets[0].as_py()]
        data = joined.buffers()[2] if len(joined) else pa.py_buffer(b"")
        raw = np.frombuffer(data, np.uint8)[:edges[-1]]
        out = pa.BinaryArray.from_buffers(pa.binary(), len(coded), [None, pa.py_buffer(edges.tobytes()), data])
        try:
            str(memoryview(raw), "utf-8")
            if not (raw[edges[edges < len(raw)]] & 0xC0 == 0x80).any():  # no text begins inside a character
                return out.cast(pa.string())
        except UnicodeDecodeError:
            pass
        return pa.array([text.decode("utf-8", "replace") for text in out.to_pylist()], pa.string())


def encode(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text",
           decoded: bool = False, remembered: int = REMEMBERED, pairs: int = PAIRS) -> DataFrame:
    """doc_id and ids (array<int>) of each row; with ``decoded`` also the text that the ids decode to.

    Special strings inside texts become their special id, nothing is added at the ends. Null and empty texts have no
    ids. Repeated rows stay repeated, other columns are not read, an empty table gives an empty result. ``remembered``
    and ``pairs`` bound what a worker keeps in memory and change no result.
    """
    shared = share(docs.sparkSession, vocabulary)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType()))]
                          + [T.StructField("decoded", T.StringType())] * decoded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = once(Codec, shared, remembered, pairs)
        for part, texts in slices(batches, "_text", AT_ONCE):
            coded = codec.encode_all([t.decode() for t in texts])
            offsets = pa.array(np.append(0, np.cumsum([len(c) // 4 for c in coded])).astype(np.int32))
            ids = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(coded), np.int32)))
            yield pa.RecordBatch.from_arrays([part["doc_id"], ids, *([codec.decode_all(ids)] if decoded else [])], schema.names)

    return rows.mapInArrow(frugal(run, built=True), schema)


def decode(encoded: DataFrame, vocabulary: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id and text of each row of ids; null arrays and null ids in them count as nothing, unknown ids fail."""
    shared = share(encoded.sparkSession, vocabulary)
    rows = encoded.select(F.col(doc_id).alias("doc_id"), F.col(ids).cast("array<int>").alias("_ids"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("text", T.StringType())])

    def run(batches):
        codec = once(Codec, shared)
        for batch in batches:
            texts = [codec.decode([i for i in row.as_py() or () if i is not None]) for row in batch["_ids"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.mapInArrow(run, schema)


def digests(coded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the comma-joined ids and of the decoded text, from ``encode(..., decoded=True)``.

    No ids give the digests of the empty text. Repeated rows stay repeated; further columns are not read.
    """
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))
