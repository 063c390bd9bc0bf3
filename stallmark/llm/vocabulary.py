"""A byte-level BPE vocabulary, and how its tokenizer cuts a text before merging.

``load`` runs on the driver. What it returns is as large as the vocabulary, whatever the data, and goes to the tasks
as a broadcast; executors need no file. Python workers keep what they build from it for later tasks.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from .chunks import BUILT

# The pattern of pre-tokens and the byte alphabet of this kind of vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?[^{S}{L}{N}]+|{S}+(?!{R})|{S}+"
PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: Code points below this have the same class for every Unicode version in use.
SETTLED = 0x0530
#: Later than every merge.
NEVER = 1 << 62
LOW = (1 << 32) - 1
#: Bytes of text in one batch of results.
BATCH_BYTES = 4 << 20


def _alphabet() -> dict[str, int]:
    """Characters that stand for bytes in the file: printed ones themselves, the others from U+0100 on."""
    rest = [b for b in range(256) if b not in PRINTED]
    return {chr(b): b for b in PRINTED} | {chr(256 + i): b for i, b in enumerate(rest)}


def _classes(cut: Callable[[str], int]) -> dict[str, str]:
    """Classes of letters, numbers and white space as the tokenizer's own tables have them.

    Its Unicode version may be another than that of ``regex``. ``cut`` gives the number of pieces of a string: a
    letter is one that joins a letter. Only classes of characters that ``regex`` counts as one of the three are asked for.
    """
    every = "".join(chr(c) for c in range(SETTLED, 0x110000) if not 0xD800 <= c < 0xE000)
    out = {}
    for name, kind, beside in (("L", r"\p{L}", "a"), ("N", r"\p{N}", "1"), ("S", r"\s", "\n")):
        points = [ord(c) for c in regex.findall(kind, every) if cut(beside + c) != 1]
        runs = [[p for _, p in run] for _, run in groupby(enumerate(points), lambda x: x[1] - x[0])]
        listed = "".join(f"\\U{run[0]:08x}-\\U{run[-1]:08x}" for run in runs)
        out[name] = f"[{kind}--[{listed}]]" if listed else f"[{kind}]"
    return out


def _filled(classes: dict[str, str]) -> str:
    return PATTERN.format(**classes, R=f"[^{classes['S']}]")


@dataclass(frozen=True)
class Vocabulary:
    tokens: dict[bytes, int]
    #: left id << 32 | right id to rank << 32 | merged id
    merges: dict[int, int]
    special: dict[str, int]
    pattern: str
    #: Tokens that encode as themselves when they stand alone.
    whole: frozenset[int]
    digest: str = field(default="", compare=False)


def merge(piece: bytes, tokens: dict[bytes, int], merges: dict[int, int]) -> list[int]:
    """Ids of one pre-token by the rule of the merges: the earliest merge first, the leftmost of equal ones."""
    ids = [tokens[piece[i:i + 1]] for i in range(len(piece))]
    if len(ids) > 64:
        return _merge_long(ids, merges)
    known = merges.get
    steps = [known(left << 32 | right, NEVER) for left, right in zip(ids, ids[1:])]
    while steps and (best := min(steps)) != NEVER:
        at = steps.index(best)
        new = ids[at] = best & LOW
        del steps[at], ids[at + 1]
        if at:
            steps[at - 1] = known(ids[at - 1] << 32 | new, NEVER)
        if at < len(steps):
            steps[at] = known(new << 32 | ids[at + 1], NEVER)
    return ids


def _merge_long(ids: list[int], merges: dict[int, int]) -> list[int]:
    """The same with a heap, for pieces of any length."""
    n = len(ids)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    heap: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j >= 0 and (found := merges.get(ids[i] << 32 | ids[j])) is not None:
            heapq.heappush(heap, (found, i, ids[i], ids[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        found, i, left, right = heapq.heappop(heap)
        j = after[i]
        if ids[i] != left or j < 0 or ids[j] != right:
            continue
        ids[i], ids[j], after[i] = found & LOW, -1, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    return [x for x in ids if x >= 0]


_LOADED: dict[str, Vocabulary] = {}


def load(path: str) -> Vocabulary:
    """Read the vocabulary at ``path`` (a byte-level BPE in the JSON form of the tokenizers library)."""
    with open(path, encoding="utf-8") as file:
        text = file.read()
    digest = hashlib.sha256(text.encode()).hexdigest()
    if digest not in _LOADED:
        from tokenizers import Tokenizer

        spec, alphabet = json.loads(text), _alphabet()
        raw = lambda token: bytes(alphabet[c] for c in token)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = map(raw, pair if isinstance(pair, list) else pair.split(" "))
            merges[tokens[left] << 32 | tokens[right]] = rank << 32 | tokens[left + right]
        whole = frozenset(i for t, i in tokens.items() if merge(t, tokens, merges) == [i])
        cutter = Tokenizer.from_str(text).pre_tokenizer
        pattern = _filled(_classes(lambda s: len(cutter.pre_tokenize_str(s))))
        _LOADED[digest] = Vocabulary(tokens, merges, special, pattern, whole, digest)
    return _LOADED[digest]


def share(spark: SparkSession, path: str) -> Broadcast:
    return spark.sparkContext.broadcast(load(path))


class Cutter:
    """Cuts texts into special tokens and pre-tokens."""

    def __init__(self, vocabulary: Vocabulary):
        # Long before short: of special tokens that begin together the longest counts.
        names = sorted(vocabulary.special, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.names = names
        self.late = regex.compile(f"[^\\x00-\\u{SETTLED - 1:04x}]")
        self.fast = regex.compile(_filled({"L": r"\p{L}", "N": r"\p{N}", "S": r"\s"}).replace(r"[^\s]", r"\S")).findall
        self.exact = regex.compile(vocabulary.pattern, regex.V1).findall

    def pieces(self, text: str) -> list[str]:
        return (self.exact if self.late.search(text) else self.fast)(text)

    def parts(self, text: str) -> Iterator[tuple[str, str | None]]:
        """Plain stretches, each with the special token that follows it."""
        if self.special is None or not any(n in text for n in self.names):
            yield text, None
            return
        at = 0
        for found in self.special.finditer(text):
            yield text[at:found.start()], found.group()
            at = found.end()
        yield text[at:], None


def once(kind: Callable, shared: Broadcast, *limits: int):
    """One ``kind(vocabulary, *limits)`` for each vocabulary, limits and Python worker."""
    vocabulary = shared.value
    key = (kind.__name__, vocabulary.digest, *limits)
    if key not in BUILT:
        BUILT[key] = kind(vocabulary, *limits)
    return BUILT[key]


def map_texts(rows: DataFrame, text: str, make: Callable, outputs: pa.Schema, schema) -> DataFrame:
    """Replace the column ``text`` by what ``make()`` returns for each text, one value for each output."""
    kept = [c for c in rows.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            texts, at = batch[text], 0
            while at < len(texts):
                out: list[tuple] = []
                size = 0
                while at + len(out) < len(texts) and size < BATCH_BYTES:
                    value = texts[at + len(out)].as_py() or ""
                    size += len(value)
                    out.append(each(value))
                arrays = [pa.array(column, kind.type) for column, kind in zip(zip(*out), outputs)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch[c].slice(at, len(out)) for c in kept), *arrays], [*kept, *outputs.names])
                at += len(out)

    return rows.mapInArrow(run, schema)
