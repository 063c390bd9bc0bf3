"""Spelling variants: words that one inserted, deleted or replaced letter turns into each other, and their main form.

1. Words are counted by built-in expressions, combined before the shuffle.
2. A word is a vector of letter counts. One edit changes it by an L1 distance of two at most, of one if the lengths differ.
   Words of length n are compared with those of lengths n - 1, n and n + 1, each pair of lengths by itself.
3. Words of one length are dealt to cells, the leaves of a k-d tree built of a sample of about SAMPLE words. (The sample
   only decides how even the cells are.) A word looks into the cells whose box is within the distance. Cells and the words
   that look into them are cut into tiles of at most about TILE letters a side, so no word or length makes a task large.
4. In a tile a k-d tree of its words leaves out boxes out of reach; the rest is compared by its letter counts, then letter
   by letter.
5. Each tile gives one row for a word that looked in: how many are near, and the best. Forms are followed by doubling steps.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from stallmark.operators.durable import settle

from .kdtree import KdTree

# What a word is made of, and the letters that become small.
RUN = "[A-Za-zÀ-ÿ]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SAMPLE = 20_000
TILE = 1 << 17
LEAF = 256
#: Dimensions: 26 letters, and what else there is by its number.
DIMS = 32
#: Letters compared at once.
AT_ONCE = 1 << 21


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = 5, least_count: int = 3,
                drop_every: int | None = None) -> DataFrame:
    """(word, n): runs of letters in small letters (A-Z only), of some length and number.

    ``drop_every`` plants slips: where it divides the CRC-32 of ``doc_id:run``, the letter at that number modulo the
    length is left out. A null id counts as an empty one, a null text has no words.
    """
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, CAPITALS, SMALL))
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("doc"),
                       F.explode(F.regexp_extract_all(low, F.lit(RUN), F.lit(0))).alias("word"))
    if drop_every is not None:
        h = F.crc32(F.concat("doc", F.lit(":"), "word"))
        at = (h % F.char_length("word")).cast("int")
        slip = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.char_length("word")))
        runs = runs.select(F.when(h % drop_every == 0, slip).otherwise(F.col("word")).alias("word"))
    return (runs.filter(F.char_length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") >= least_count))


def letters(words: list[str]) -> np.ndarray:
    """Code points of words of one length."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)


def vectors(codes: np.ndarray) -> np.ndarray:
    """Letter counts."""
    axis = np.where((codes >= 97) & (codes < 123), codes.astype(np.int64) - 97, 26 + codes.astype(np.int64) % (DIMS - 26))
    keys = np.arange(len(codes))[:, None] * DIMS + axis
    return np.bincount(keys.ravel(), minlength=len(codes) * DIMS).reshape(-1, DIMS).astype(np.int32)


def _unary(counts: np.ndarray) -> np.ndarray:
    """Counts up to 2 as bits: no more bits differ than the counts do."""
    bits = np.concatenate([counts >= 1, counts >= 2], axis=1)
    return np.packbits(bits, axis=1).view(np.uint64).ravel()


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows differ by exactly one edit; ``b`` is as long as ``a`` or one longer."""
    n = a.shape[1]
    if b.shape[1] == n:
        return (a != b).sum(axis=1) == 1
    before, after = a != b[:, :n], a != b[:, 1:]
    first = np.where(before.any(axis=1), before.argmax(axis=1), n)
    last = np.where(after.any(axis=1), n - 1 - after[:, ::-1].argmax(axis=1), -1)
    return last < first


def near_pairs(queries: np.ndarray, stored: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of words, given by their letters, that are one edit apart, in parts."""
    radius = 2 if queries.shape[1] == stored.shape[1] else 1
    points, wanted = vectors(stored), vectors(queries)
    tree, bits, own_bits = KdTree(points, LEAF), _unary(points), _unary(wanted)
    step = max(1, AT_ONCE // max(queries.shape[1], stored.shape[1]))

    def verified(q: np.ndarray, s: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for at in range(0, len(q), step):
            x, y = q[at:at + step], s[at:at + step]
            a, b = queries[x], stored[y]
            hit = one_edit(a, b) if a.shape[1] <= b.shape[1] else one_edit(b, a)
            yield x[hit], y[hit]

    for leaf, own in tree.reached(wanted, radius):
        there = tree.leaves[leaf]
        for at in range(0, len(there), AT_ONCE):
            part = there[at:at + AT_ONCE]
            for k in range(0, len(own), rows := max(1, AT_ONCE // len(part))):
                asking = own[k:k + rows]
                x, y = np.nonzero(np.bitwise_count(own_bits[asking][:, None] ^ bits[part][None, :]) <= radius)
                yield from verified(asking[x], part[y])


class Cells:
    """Cells of words by length, from a sample and the number of letters of all words of each length."""

    def __init__(self, sample: list[str], loads: dict[int, int], tile: int):
        by: dict[int, list[str]] = defaultdict(list)
        for word in sample:
            by[len(word)].append(word)
        self.lengths, self.trees = loads, {}
        for length, load in loads.items():
            found = by.get(length, [])
            points = vectors(letters(found)) if found else np.zeros((0, DIMS), np.int32)
            self.trees[length] = KdTree(points, max(1, -(-len(found) * tile // max(load, 1))), tight=False)

    def routes(self, words: list[str]) -> Iterator[tuple[int, int, bool, np.ndarray]]:
        """(length, cell, whether the words are those looked for, positions of words)."""
        by: dict[int, list[int]] = defaultdict(list)
        for i, word in enumerate(words):
            by[len(word)].append(i)
        for length, own in by.items():
            at, points = np.array(own), vectors(letters([words[i] for i in own]))
            cells = self.trees[length].place(points)
            for cell in np.unique(cells):
                yield length, int(cell), True, at[cells == cell]
            for other in (length - 1, length, length + 1):
                if other in self.trees:
                    for cell, reached in self.trees[other].reached(points, 2 if other == length else 1):
                        yield other, cell, False, at[reached]


def _tiles(words: DataFrame, sample: int, tile: int) -> DataFrame:
    """(tile, stored, word, n): every word in its cell's tiles and in those it looks into."""
    length = F.char_length("word")
    lengths = words.groupBy(length.alias("length")).agg(F.sum(length).alias("letters"), F.count(F.lit(1)).alias("words")).collect()
    # A share of the words by their hash, about ``sample`` of them in all.
    share = int(min(1, sample / max(1, sum(r["words"] for r in lengths))) * (1 << 40))
    drawn = [r.word for r in words.select("word").filter(F.pmod(F.xxhash64("word"), F.lit(1 << 40)) < share).collect()]
    loads = {r["length"]: r["letters"] for r in lengths}
    shared = words.sparkSession.sparkContext.broadcast(Cells(drawn, loads, tile))

    def loaded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = shared.value
        for batch in batches:
            found = batch["word"].to_pylist()
            rows = [(n, cell, stored, sum(len(found[i]) for i in at)) for n, cell, stored, at in cells.routes(found)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(
                zip(*rows) if rows else [()] * 4, (pa.int32(), pa.int32(), pa.bool_(), pa.int64()))], ["length", "cell", "stored", "letters"])

    counted = words.select("word").mapInArrow(loaded, "length int, cell int, stored boolean, letters long")
    parts = {(r["length"], r["cell"], r["stored"]): -(-r["letters"] // tile)
             for r in counted.groupBy("length", "cell", "stored").agg(F.sum("letters").alias("letters")).collect()}
    cut = words.sparkSession.sparkContext.broadcast(parts)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, many = shared.value, cut.value
        for batch in batches:
            found, n = batch["word"].to_pylist(), batch["n"].to_numpy()
            hashes = np.array([xxh64_intdigest(w) for w in found], np.uint64)
            for length, cell, stored, at in cells.routes(found):
                own, other = many[length, cell, stored], many.get((length, cell, not stored), 0)
                for k in range(other):  # each of the other side's parts meets all of these words
                    part = (hashes[at] % np.uint64(own)).astype(np.int64)
                    names = [f"{length} {cell} {p if stored else k} {k if stored else p}" for p in range(own)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names).take(pa.array(part)), pa.array(np.full(len(at), stored)), batch["word"].take(pa.array(at)),
                         pa.array(n[at])], ["tile", "stored", "word", "n"])

    return words.mapInArrow(dealt, "tile string, stored boolean, word string, n long")


def _best(table: pa.Table) -> pa.Table:
    """For each word that looks into a tile: the number of near words in it and the best of them."""
    stored = table["stored"].to_numpy()
    looking = table["word"].filter(pa.array(~stored)).to_pylist()
    there, n = table["word"].filter(pa.array(stored)).to_pylist(), table["n"].to_numpy()[stored]
    order = sorted(range(len(there)), key=lambda i: (-n[i], there[i]))
    words = [there[i] for i in order]
    count, best = np.zeros(len(looking), np.int64), np.full(len(looking), len(words))
    by: dict[int, list[int]] = defaultdict(list)
    for i, word in enumerate(looking):
        by[len(word)].append(i)
    for own in by.values() if words else ():
        at = np.array(own)
        for x, y in near_pairs(letters([looking[i] for i in own]), letters(words)):
            count += np.bincount(at[x], minlength=len(looking))
            np.minimum.at(best, at[x], y)
    found = np.flatnonzero(count).tolist()
    return pa.table({"word": pa.array([looking[i] for i in found], pa.string()), "n_near": pa.array(count[found], pa.int64()),
                     "form": pa.array([words[best[i]] for i in found], pa.string()),
                     "form_n": pa.array([int(n[order[best[i]]]) for i in found], pa.int64())})


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the last of the forms that follow each other, by doubling steps."""
    steps = settle(forms.select("word", F.col("form").alias("root")))
    while True:
        far = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = settle(steps.join(far, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        steps = longer.select("word", "root")
        if longer.filter("moved").isEmpty():
            return steps


def group_variants(words: DataFrame, ratio: int = 2, sample: int = SAMPLE, tile: int = TILE) -> DataFrame:
    """word, form, root, n, n_near and form_n of each row of distinct (word, n).

    Near words differ by exactly one inserted, deleted or replaced code point. A word's form is its near word of largest n,
    of equal ones the smallest, if that n is at least ``ratio`` (over 1) times its own. ``sample`` and ``tile`` change no result.
    Null and empty words are left out; an empty table gives an empty result.
    """
    words = settle(words.filter("word <> ''").select("word", F.col("n").cast("long").alias("n")))
    found = _tiles(words, sample, tile).groupBy("tile").applyInArrow(_best, "word string, n_near long, form string, form_n long")
    best = settle(found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct(
        (-F.col("form_n")).alias("less"), "form")).alias("best")))
    much = -F.col("best.less") >= F.col("n") * ratio
    each = settle(words.join(best, "word", "left").select(
        "word", F.when(much, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(much, -F.col("best.less")).alias("form_n")))
    roots = _roots(each.filter("form is not null"))
    return each.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", drop_every: int | None = None) -> DataFrame:
    """``group_variants`` of the ``word_counts`` of documents. Repeated rows count again, other columns are not read."""
    return group_variants(word_counts(docs, doc_id, text, drop_every=drop_every))
