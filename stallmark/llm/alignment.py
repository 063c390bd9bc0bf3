"""Alignment of two tokenizers over the same bytes, and how often their ids meet in a corpus.

A matrix has a row for each token and a column for each byte of the text: A for the first tokenizer, B for the second.
The product of A and B transposed holds the bytes that a token of each shares: the overlap links. Where both steps of
that staircase go on at once, tokens of both end at the same byte; these places cut the tokens into groups. The product of
the two incidences of ids with groups holds the links of tokens that share a group, by pair of ids.

Texts are cut at spaces between two characters that are no white space. There tokens of both end, and what each side is
cut into depends on nothing beyond, so chunks are aligned once and remembered (tests hold this against whole texts).

Each document's pairs are kept in the shared folder. A first pass over them counts the documents of each pair, combined in tasks
before the shuffle. A second one meets the counts: at most FREQUENT of the most frequent pairs are broadcast, the others go
through a join of what is left of each document.
"""

from __future__ import annotations

import re
import uuid
from array import array
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stallmark.operators.durable import settle, shared_folder

from .chunks import WORD, Memory, slices
from .sparse import Csr, spread, summed

#: Most pairs that are broadcast, of 17 bytes each.
FREQUENT = 1 << 18
#: Bytes of text aligned at once.
AT_ONCE = 2 << 20
#: Units of one generation of remembered chunks.
REMEMBERED = 40 << 20
#: Bits of an id in a pair.
BITS = 21
#: A space between two characters that are no white space.
CUT = re.compile(r"(?<=\S) (?=\S)")


def _edges(sizes) -> np.ndarray:
    return np.append(0, np.cumsum(np.asarray(sizes, np.int64)))


def _coded(first: bytes, second: list[int]) -> bytes:
    """Ids of both sides in 32 bits, those of the second inverted; two of them joined are the ids of both, side by side."""
    return first + array("i", [~i for i in second]).tobytes()


class Aligner:
    """Token ids of chunks on both sides, remembered."""

    def __init__(self, spec: str, model: bytes):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        from .vocabulary import _alphabet

        self.first = Tokenizer.from_str(spec)
        self.first.encode_special_tokens = True
        self.first.no_truncation()
        self.first.no_padding()
        self.second = SentencePieceProcessor(model_proto=model)
        alphabet, names = _alphabet(), self.first.get_vocab()
        self.bytes_a = [b""] * (max(names.values()) + 1)
        for token, i in names.items():
            self.bytes_a[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        piece = self.second.id_to_piece
        self.bytes_b = [bytes([int(piece(i)[3:-1], 16)]) if self.second.is_byte(i) else piece(i).replace("▁", " ").encode()
                        for i in range(self.second.get_piece_size())]
        if max(len(self.bytes_a), len(self.bytes_b)) > 1 << BITS:
            raise ValueError(f"ids of more than {BITS} bits")
        self.size_a = np.array([len(t) for t in self.bytes_a])
        self.size_b = np.array([len(t) for t in self.bytes_b])
        #: Ids in writing with what follows: another token, the other side, the next group, the next chunk.
        self.names = [str(i) + end for end in ",|;\n" for i in range(max(len(self.bytes_a), len(self.bytes_b)))]
        letters = {b: c for c, b in alphabet.items()}
        self.letters = "".join(letters[b] for b in range(256))
        # Marks that no piece of the second side has after a letter: nothing is merged across. The first side cuts there.
        joined = "\n".join(map(piece, range(self.second.get_piece_size())))
        self.apart = {m for m in map(chr, range(0x21, 0x7F)) if not re.search(f"[A-Za-zÀ-ÿ]{re.escape(m)}", joined)}
        self.before = len(self.second.encode("z"))
        self.marks, self.memory = Memory(self._marks), Memory(self._chunks, REMEMBERED)

    def _first(self, pieces: list[str]) -> Iterator[bytes]:
        """Ids of pre-tokens without line breaks on the first side; their bytes become letters in one go."""
        letters = "\n".join(pieces).encode().decode("latin-1").translate(self.letters).split(self.letters[10])
        tokenize = self.first.model.tokenize
        return (array("i", [t.id for t in tokenize(piece)]).tobytes() for piece in letters)

    def _words(self, words: list[str]) -> list[bytes]:
        if not words:
            return []
        return [_coded(a, b) for a, b in zip(self._first([" " + w for w in words]), self.second.encode(words, num_threads=1))]

    def _marks(self, marks: list[str]) -> list[bytes]:
        if not marks:
            return []
        second = self.second.encode(["z" + m for m in marks], num_threads=1)
        return [_coded(a, b[self.before:]) for a, b in zip(self._first(marks), second)]

    def _chunks(self, keys: list[str]) -> list[bytes | None | bool]:
        """Ids on both sides of chunks by their keys, as of ``_coded``; none if a side does not give the chunk's bytes back, false for a key
        that comes of a cut beside white space. Marks apart from the word before them."""
        known, known_before, apart = self.memory.young.get, self.memory.old.get, self.apart
        out: list = [None] * len(keys)
        words: dict[str, bytes | None] = {}
        plain: list[tuple[int, str]] = []
        marked: list[tuple[int, str, str]] = []
        others: list[tuple[int, str]] = []
        for at, key in enumerate(keys):
            if key.isascii() and key.isalpha():
                words[key] = None
                plain.append((at, key))
                continue
            text = key[2:] if key[:2] == "  " else key
            if not text or text is key and text.strip() != text:
                out[at] = False
            elif not (m := WORD.fullmatch(text)) or m[2] and m[2][0] not in apart:
                others.append((at, text))
            elif m[2]:
                words.setdefault(m[1], known(m[1]) or known_before(m[1]))
                marked.append((at, m[1], m[2]))
            else:
                words[text] = None
                plain.append((at, text))
        new = [w for w, ids in words.items() if ids is None]
        words.update(zip(new, self._words(new)))
        for at, word in plain:
            out[at] = words[word]
        marks = self.marks.ready({m for _, _, m in marked})
        for at, word, mark in marked:
            out[at] = words[word] + marks[mark]
        texts = [text for _, text in others]
        first = self.first.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        join = lambda ids, table: b"".join(map(table.__getitem__, ids))
        for (at, text), a, b in zip(others, first, self.second.encode(texts, num_threads=1)):
            if join(a.ids, self.bytes_a) == join(b, self.bytes_b) == b" " + text.encode():
                out[at] = _coded(array("i", a.ids).tobytes(), b)
        return out

    def align(self, texts: list[bytes]) -> Alignment:
        """Keys of chunks are what stands between two spaces, after two spaces any chunk. Texts with a space beside other white
        space are cut by the exact rule."""
        split = [t.decode().split(" ") if t else [] for t in texts]
        every, coded = self._known(split)
        if False in coded:
            odd = {c for c, ids in zip(every, coded) if ids is False}
            for at, chunks in enumerate(split):
                if not odd.isdisjoint(chunks):
                    split[at] = [c if c.strip() == c else "  " + c for c in CUT.split(texts[at].decode())]
            every, coded = self._known(split)
        if None in coded:
            lost = {c for c, ids in zip(every, coded) if ids is None}
            split = [chunks if lost.isdisjoint(chunks) else [] for chunks in split]
            every, coded = self._known(split)
        place = dict(zip(every, range(len(every))))
        flat = np.fromiter(map(place.__getitem__, chain.from_iterable(split)), np.int64)
        return Alignment(self, coded, flat, _edges([len(chunks) for chunks in split]))

    def _known(self, split: list[list[str]]) -> tuple[list[str], list[bytes | None | bool]]:
        """The distinct keys of chunks, and what is remembered of each."""
        every = set().union(*split)
        known = self.memory.ready(every)
        listed = list(every)
        return listed, list(map(known.__getitem__, listed))


class Alignment:
    """Some texts aligned: arrays over their distinct chunks, one after the other, with edges of the chunks' parts.

    ``chunk`` names the chunks of the texts in order, ``edge`` where each text's begin. ``ids_a``, ``ids_b`` are tokens; ``many_a``,
    ``many_b`` the tokens of each group; ``overlaps`` have the place of a token on both sides and the bytes they share;
    ``pair`` (first id << BITS | second id, ascending in a chunk) and ``links`` are the links by ids.
    """

    def __init__(self, aligner: Aligner, coded: list[bytes], chunk: np.ndarray, edge: np.ndarray):
        self.aligner, self.chunk, self.edge = aligner, chunk, edge
        both = np.frombuffer(b"".join(coded), np.int32).astype(np.int64)
        edge, first = _edges(list(map(len, coded))) // 4, both >= 0
        self.ids_a, self.ids_b = both[first], ~both[~first]
        self.edge_a = _edges(first)[edge]
        self.edge_b = edge - self.edge_a
        size_a, size_b = aligner.size_a[self.ids_a], aligner.size_b[self.ids_b]
        n = int(size_a.sum())
        ones = np.ones(n, np.int64)
        bytes_of = lambda sizes: Csr(_edges(sizes), np.arange(n), ones, n)
        overlap = bytes_of(size_a).times(bytes_of(size_b).transposed())
        i, j = overlap.rows(), overlap.indices
        self.overlaps = np.stack([i, j, overlap.data])
        self.edge_o = np.searchsorted(i, self.edge_a)
        # Overlaps go up one token of either side at a time, or both: then a group ends.
        group = np.cumsum(np.append(False, (np.diff(i) > 0) & (np.diff(j) > 0))[:len(i)])
        groups = int(group[-1]) + 1 if len(group) else 0
        self.group_a, self.group_b = np.zeros(len(self.ids_a), np.int64), np.zeros(len(self.ids_b), np.int64)
        self.group_a[i], self.group_b[j] = group, group
        self.many_a, self.many_b = (np.bincount(g, minlength=groups) for g in (self.group_a, self.group_b))
        # Distinct ids of a group stand for their tokens, so a long group costs its ids, not its tokens.
        held = lambda group, ids: summed(group << BITS | ids, np.ones(len(ids), np.int64))
        (key_a, times_a), (key_b, times_b) = held(self.group_a, self.ids_a), held(self.group_b, self.ids_b)
        rows = lambda key, times: Csr(np.arange(len(key) + 1), key >> BITS, times, groups)
        linked = rows(key_a, times_a).times(rows(key_b, times_b).transposed())
        a, mask = key_a[linked.rows()], (1 << BITS) - 1
        of_group = np.zeros(groups, np.int64)
        of_group[self.group_a] = np.repeat(np.arange(len(coded)), np.diff(self.edge_a))
        self.edge_g = np.searchsorted(of_group, np.arange(len(coded) + 1))
        distinct, index = np.unique((a & mask) << BITS | (key_b & mask)[linked.indices], return_inverse=True)
        keys, self.links = summed(of_group[a >> BITS] * max(1, len(distinct)) + index, linked.data)
        self.pair, self.distinct = keys % max(1, len(distinct)), distinct
        self.edge_l = np.searchsorted(keys // max(1, len(distinct)), np.arange(len(coded) + 1))

    def written(self) -> list[str]:
        """The groups of each text: ids of the first side, ids of the second."""
        step, a, b = len(self.aligner.names) // 4, self.many_a, self.many_b
        last = lambda group: np.append(np.diff(group) > 0, True)[:len(group)]
        before = _edges(a + b)[:-1]
        place_a = before[self.group_a] + np.arange(len(self.ids_a)) - _edges(a)[:-1][self.group_a]
        place_b = (before + a)[self.group_b] + np.arange(len(self.ids_b)) - _edges(b)[:-1][self.group_b]
        code = np.zeros(len(self.ids_a) + len(self.ids_b), np.int64)
        code[place_a] = self.ids_a + step * last(self.group_a)
        code[place_b] = self.ids_b + 2 * step * last(self.group_b)
        code[place_b[self.edge_b[1:] - 1]] += step
        chunks = "".join(map(self.aligner.names.__getitem__, code.tolist())).split("\n")
        names = list(map(chunks.__getitem__, self.chunk.tolist()))
        return [";".join(names[x:y]) for x, y in zip(self.edge[:-1].tolist(), self.edge[1:].tolist())]

    def totals(self) -> list[np.ndarray]:
        """Tokens on both sides, groups and links of each text."""
        links = np.append(0, np.cumsum(self.links))[self.edge_l]
        each = [np.diff(x)[self.chunk] for x in (self.edge_a, self.edge_b, self.edge_g, links)]
        return [np.diff(_edges(x)[self.edge]) for x in each]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, pair and links: the distinct pairs of each text, sorted by text."""
        n = max(1, len(self.edge_a) - 1)
        text = np.repeat(np.arange(len(self.edge) - 1), np.diff(self.edge))
        held, times = summed(text * n + self.chunk, np.ones(len(text), np.int64))
        chunk, sizes = held % n, np.diff(self.edge_l)
        at, each = spread(self.edge_l[chunk], sizes[chunk]), sizes[chunk]
        width = max(1, len(self.distinct))
        keys, links = summed(np.repeat(held // n, each) * width + self.pair[at], self.links[at] * np.repeat(times, each))
        return keys // width, self.distinct[keys % width], links


_ALIGNERS: dict[tuple[int, int], Aligner] = {}


def _aligner(shared: Broadcast) -> Aligner:
    """One aligner for each pair of vocabularies and Python worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
    key = tuple(map(hash, shared.value))
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(*shared.value)
    return _ALIGNERS[key]


def _shared(docs: DataFrame, first: str, second: str) -> Broadcast:
    """Both vocabularies, as large as their files whatever the data."""
    with open(first, encoding="utf-8") as a, open(second, "rb") as b:
        return docs.sparkSession.sparkContext.broadcast((a.read(), b.read()))


def align(docs: DataFrame, first: str, second: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, a_ids, b_ids, groups and overlaps of each row.

    ``first`` is a byte-level vocabulary of the tokenizers library and encodes a space and the text; ``second`` is a model of
    the sentencepiece library that adds this space itself. ``groups`` are structs of the number of tokens ``a`` and ``b``;
    ``overlaps`` are structs of positions ``a`` and ``b`` from 0 and of the ``bytes`` that both tokens share.

    Special strings inside texts are plain text. Null and empty texts have no tokens, nor have texts of which a side does not
    give the bytes back. Repeated rows stay repeated, other columns are not read, an empty table gives an empty result.
    """
    shared = _shared(docs, first, second)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    ints = T.ArrayType(T.IntegerType())
    kinds = {"a_ids": ints, "b_ids": ints, "groups": T.ArrayType(T.StructType().add("a", "integer").add("b", "integer")),
             "overlaps": T.ArrayType(T.StructType().add("a", "integer").add("b", "integer").add("bytes", "integer"))}
    schema = T.StructType([rows.schema["doc_id"], *(T.StructField(n, k) for n, k in kinds.items())])

    def lists(arrays: list[np.ndarray], names: list[str] = []) -> pa.Array:
        """Lists of integers, or of structs of the rows of two-dimensional arrays."""
        offsets = pa.array(np.append(0, np.cumsum([a.shape[-1] for a in arrays])).astype(np.int32))
        flat = np.concatenate(arrays, axis=-1).astype(np.int32)
        return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(map(pa.array, flat), names) if names else pa.array(flat))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(shared)
        for part, texts in slices(batches, "text", AT_ONCE):
            found = aligner.align(texts)
            groups, a_ids, b_ids, many, overlaps = np.stack([found.many_a, found.many_b]), [], [], [], []
            for own in np.split(found.chunk, found.edge[1:-1]):
                of = lambda edge: spread(edge[own], np.diff(edge)[own])  # noqa: E731,B023
                a_ids.append(found.ids_a[of(found.edge_a)])
                b_ids.append(found.ids_b[of(found.edge_b)])
                many.append(groups[:, of(found.edge_g)])
                each = found.overlaps[:, of(found.edge_o)]
                for side, edge in enumerate((found.edge_a, found.edge_b)):  # from places among chunks to places in the text
                    each[side] += np.repeat(_edges(np.diff(edge)[own])[:-1] - edge[own], np.diff(found.edge_o)[own])
                overlaps.append(each)
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], lists(a_ids), lists(b_ids), lists(many, ["a", "b"]), lists(overlaps, ["a", "b", "bytes"])],
                schema.names)

    return rows.mapInArrow(run, schema)


NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]


def _linked(docs: DataFrame, shared: Broadcast, doc_id: str, text: str) -> DataFrame:
    """A row's number, doc_id, NUMBERS, groups_sha256, and its distinct pairs with the links of each, in the shared folder."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = T.StructType([T.StructField("row", T.LongType()), rows.schema["doc_id"], *(T.StructField(n, T.LongType()) for n in NUMBERS),
                           T.StructField("groups_sha256", T.StringType()), T.StructField("pairs", T.ArrayType(T.LongType())),
                           T.StructField("links", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(shared)
        for part, texts in slices(batches, "text", AT_ONCE):
            found = aligner.align(texts)
            owner, pair, links = found.pairs()
            offsets = pa.array(_edges(np.bincount(owner, minlength=len(texts))).astype(np.int32))
            digests = [sha256(t.encode()).hexdigest() if t else "" for t in found.written()]
            yield pa.RecordBatch.from_arrays(
                [part["row"], part["doc_id"], *(pa.array(c, pa.int64()) for c in found.totals()), pa.array(digests, pa.string()),
                 pa.ListArray.from_arrays(offsets, pa.array(pair)), pa.ListArray.from_arrays(offsets, pa.array(links.astype(np.int32)))],
                schema.names)

    path = f"{shared_folder(docs.sparkSession)}/{uuid.uuid4().hex}"
    rows.mapInArrow(run, schema).write.parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def _counted(linked: DataFrame) -> DataFrame:
    """pair, docs and best: how many rows hold a pair of ids linked, and whether no pair of its first id is in more.

    Rows are counted within a batch before the shuffle. What is broadcast has one row for each id of the first vocabulary at most.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair, docs = np.unique(batch["pairs"].flatten().to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair, pa.int64()), pa.array(docs, pa.int64())], ["pair", "docs"])

    counts = settle(linked.select("pairs").mapInArrow(run, "pair long, docs long").groupBy("pair").agg(F.sum("docs").alias("docs")))
    a = F.shiftright("pair", BITS)
    most = counts.groupBy(a.alias("a")).agg(F.max("docs").alias("most"))
    return settle(counts.join(F.broadcast(most), a == F.col("a")).select("pair", "docs", (F.col("docs") == F.col("most")).alias("best")))


def _frequent(counts: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """At most ``most`` pairs in more documents than any of the others, and the others."""
    step = F.floor(F.log2("docs") * 16)
    bins = sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True)  # 16 for each doubling
    least, total = None, 0
    for r in bins:
        total += r["count"]
        if total > most:
            break
        least = r["step"]
    inside = F.lit(False) if least is None else step >= least
    return counts.filter(inside), counts.filter(~inside)


def alignment_counts(docs: DataFrame, first: str, second: str, doc_id: str = "doc_id", text: str = "text",
                     frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row; texts as in ``align``.

    Links are pairs of tokens in a group. The count of a link is the number of rows that hold its pair of ids linked;
    ``n_best`` counts the links of which no pair of their first id has a higher one. ``frequent`` bounds the pairs that are
    broadcast and changes no result. Repeated rows and null ids count as rows of their own.
    """
    linked = _linked(docs, _shared(docs, first, second), doc_id, text)
    top, others = _frequent(_counted(linked), frequent)
    table = top.orderBy("pair").toArrow()
    known = docs.sparkSession.sparkContext.broadcast(tuple(table[c].to_numpy() for c in ("pair", "docs", "best")))
    rest = T.ArrayType(T.StructType().add("pair", "long").add("links", "integer"))
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType()),
                           T.StructField("rest", rest)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, docs, best = known.value
        for batch in batches:
            n, pair, links = batch.num_rows, batch["pairs"].flatten().to_numpy(), batch["links"].flatten().to_numpy().astype(np.int64)
            owner = np.repeat(np.arange(n), batch["pairs"].value_lengths().to_numpy())
            at = np.minimum(np.searchsorted(pairs, pair), max(0, len(pairs) - 1))
            hit = pairs[at] == pair if len(pairs) else np.zeros(len(at), bool)
            add = lambda values: pa.array(np.bincount(owner[hit], values, n).astype(np.int64))  # noqa: E731,B023
            at, left = at[hit], ~hit
            offsets = pa.array(_edges(np.bincount(owner[left], minlength=n)).astype(np.int32))
            rest = pa.StructArray.from_arrays([pa.array(pair[left]), pa.array(links[left].astype(np.int32))], ["pair", "links"])
            yield pa.RecordBatch.from_arrays([batch["row"], add(links[hit] * best[at]), add(links[hit] * docs[at]),
                                              pa.ListArray.from_arrays(offsets, rest)], schema.names)

    met = settle(linked.select("row", "pairs", "links").mapInArrow(run, schema))
    more = met.select("row", F.inline("rest")).join(others, "pair").select(
        "row", F.when(F.col("best"), F.col("links")).otherwise(0).cast("long").alias("n_best"), (F.col("links") * F.col("docs")).alias("count_sum"))
    sums = met.select("row", "n_best", "count_sum").union(more).groupBy("row").agg(
        F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return linked.join(sums, "row").select("doc_id", *NUMBERS, "n_best", "count_sum", "groups_sha256")
