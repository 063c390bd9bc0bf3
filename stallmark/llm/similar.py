"""Near-duplicates by the Jaccard index of word shingles: candidates by SimHash and by MinHash bands, every link checked exactly.

1. A text is its set of hashed shingles (words as in ``fingerprint64``). Equal sets collapse first, so exact copies cost one row.
2. The SimHash of a set is the majority of its hashes, bit by bit. ``pigeonhole`` connects fingerprints of at most DISTANCE
   bits; its edges, and sets of one fingerprint, are candidates. At an index of 0.8 about 10 bits differ, so further ones are needed:
3. ``bands`` keys are made of ``rows`` minima of the set each: two texts at index J share one with a chance of
   1 - (1 - J^rows)^bands. ``banding`` chooses both for a threshold and a recall. In each key all texts are compared with the
   one that shares most keys with others. That is near the text that copies were made of, so a group of near copies mostly
   hangs together after as many comparisons as it has texts.
4. Keys whose texts are not connected by then are cut into tiles of TILE texts a side. A task compares the sets of a tile by a
   matrix product and gives back a spanning forest of its links, so no pair becomes a row. Connectivity is exact for
   the texts that share a key.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from stallmark.operators.durable import settle

from .chunks import frugal, slices
from .components import components
from .fingerprint64 import SEED, set_fingerprint
from .pigeonhole import Forest
from .pigeonhole import links as fingerprint_links
from .spotsigs import likeness
from .vocabulary import BATCH_BYTES

SHINGLE, THRESHOLD = 5, 0.8
#: Bits in which fingerprints of candidates differ at most.
DISTANCE = 3
#: Chance that two texts at the threshold share a key, and most keys, unless keys of two minima need more.
RECALL, BANDS = 0.9999, 32
#: Hashes whose minima are taken at once.
BLOCK = 1 << 12
#: Texts, and hashes of them, on a side of a tile; columns of a matrix at once.
TILE, TILE_HASHES, COLUMNS = 256, 1 << 21, 1 << 14


def banding(threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(bands, rows): the longest keys of which at most BANDS give the recall."""
    if not 0 < threshold <= 1 or not 0 < recall < 1:
        raise ValueError("threshold and recall are shares")
    bands = lambda rows: 1 if threshold == 1 else math.ceil(math.log(1 - recall) / math.log1p(-threshold ** rows))
    rows = max((r for r in range(2, 17) if bands(r) <= BANDS), default=2)
    return bands(rows), rows


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(SEED)
    return random.integers(0, 1 << 32, (n, 1), np.uint32), random.integers(0, 1 << 32, (n, 1), np.uint32) | np.uint32(1)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The ascending distinct hashes of a text's shingles: the whole text if it is shorter than one, none if it is blank."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    n = max(1, len(words) - shingle + 1)
    return np.unique(np.fromiter((xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[-n:].tolist())),
                                 np.uint64, n))


def band_keys(found: np.ndarray, bands: int, rows: int, permutations: tuple[np.ndarray, np.ndarray]) -> list[int]:
    """Keys of a set that is not empty."""
    short, least, (flip, times) = (found >> np.uint64(32)).astype(np.uint32), None, permutations
    for at in range(0, len(short), BLOCK):
        own = ((short[at:at + BLOCK] ^ flip) * times).min(axis=1)
        least = own if least is None else np.minimum(least, own)
    return [xxh64_intdigest(minima.tobytes(), band) for band, minima in enumerate(least.reshape(bands, rows))]


def _name(found: np.ndarray) -> int:
    return xxh64_intdigest(found.tobytes(), SEED)


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _lists(values: list, sizes: list[int]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), _signed(values))


def _sketches(docs: DataFrame, key: Column, text: str, shingle: int, shape: tuple[int, int]) -> DataFrame:
    """(key, fp, n, simhash, bands): the name of the text's set, its size, fingerprint and band keys."""
    rows = docs.select(key.alias("key"), F.col(text).alias("text"))
    long = F.lit(0).cast("long")
    schema = rows.select("key", long.alias("fp"), F.lit(0).alias("n"), long.alias("simhash"),
                         F.array().cast("array<long>").alias("bands")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        permutations = _permutations(math.prod(shape))
        for part, texts in slices(batches, "text", BATCH_BYTES):
            names, sizes, prints, bands, many = [], [], [], [], []
            for t in texts:
                found = shingles(t.decode(), shingle)
                own = band_keys(found, *shape, permutations) if len(found) else []
                names.append(_name(found))
                sizes.append(len(found))
                prints.append(set_fingerprint(found))
                bands.extend(own)
                many.append(len(own))
            yield pa.RecordBatch.from_arrays(
                [part["key"], _signed(names), pa.array(sizes, pa.int32()), _signed(prints), _lists(bands, many)], schema.names)

    return rows.mapInArrow(frugal(run), schema)


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(fp, found): the sets of ``text``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in slices(batches, "text", BATCH_BYTES):
            found = [shingles(t.decode(), shingle) for t in own]
            yield pa.RecordBatch.from_arrays(
                [_signed([_name(f) for f in found]), _lists(np.concatenate(found), [len(f) for f in found])], ["fp", "found"])

    return texts.select("text").mapInArrow(frugal(run), "fp long, found array<long>")


def _near_fingerprints(each: DataFrame, distance: int) -> DataFrame:
    """Pairs (a, b) of sets: those of one fingerprint with one of them, and those that stand for fingerprints with an edge."""
    marked = each.filter("n > 0").select("fp", "simhash")
    marks = settle(marked.groupBy("simhash").agg(F.min("fp").alias("hub"), F.count(F.lit(1)).alias("many")))
    edges = settle(fingerprint_links(marks.select(F.col("simhash").alias("fp")), distance))
    end = lambda c: marks.select(F.col("simhash").alias(c), F.col("hub").alias(f"hub_{c}"))
    same = (marked.join(marks.filter("many > 1"), "simhash").filter("fp <> hub")
            .select(F.col("hub").alias("a"), F.col("fp").alias("b")))
    return same.union(edges.join(end("a"), "a").join(end("b"), "b").select("hub_a", "hub_b"))


def _linked(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sets are at the threshold."""
    side = lambda c: sets.select(F.col("fp").alias(c), F.col("found").alias(f"set_{c}"))
    return (pairs.join(side("b"), "b").join(side("a"), "a")
            .filter(likeness(F.col("set_a"), F.col("set_b")) >= threshold - 1e-12).select("a", "b"))


def _rows(docs: DataFrame, doc_id: str, text: str, *more: Column) -> DataFrame:
    return docs.select(F.coalesce(doc_id, F.lit(0)).alias("_id"), F.col(doc_id).isNull().alias("last"),
                       F.xxhash64(text).alias("hash"), *more)


def _joined(chosen: DataFrame, rows: DataFrame) -> DataFrame:
    """One row for each key in ``chosen``."""
    keys = chosen.select(F.coalesce("key.id", F.lit(0)).alias("_id"), "key.last", "key.hash")
    return rows.join(keys, ["_id", "last", "hash"]).dropDuplicates(["_id", "last", "hash"])


def _linked_in_tile(tile: pa.Table, threshold: float) -> list[tuple[int, int]]:
    """A spanning forest of the links between texts of different roots. Counts of common hashes are a matrix product."""
    fp, root, sizes = (tile[c].to_numpy() for c in ("fp", "root", "n"))
    first = tile["first"].to_numpy()
    hashes = tile["found"].combine_chunks().flatten().to_numpy()
    owner = np.repeat(np.arange(len(fp)), sizes)
    order = np.argsort(hashes, kind="stable")
    column = np.cumsum(np.append(0, np.diff(hashes[order].view(np.uint64)) != 0))
    owner = owner[order]
    rows, columns = np.flatnonzero(first), np.flatnonzero(~first) if not first.all() else np.arange(len(fp))
    common = np.zeros((len(rows), len(columns)), np.float32)
    for at in range(0, int(column[-1]) + 1, COLUMNS):
        own = slice(*np.searchsorted(column, [at, at + COLUMNS]))
        held = np.zeros((len(fp), COLUMNS), np.float32)
        held[owner[own], column[own] - at] = 1
        common += held[rows] @ held[columns].T
    union = sizes[rows][:, None] + sizes[columns][None, :] - common
    forest, edges = Forest(), []
    for i, j in zip(*np.nonzero((common >= (threshold - 1e-12) * union) & (root[rows][:, None] != root[columns][None, :]))):
        a, b = rows[i], columns[j]
        if forest.root(int(root[a])) != forest.root(int(root[b])):
            forest.link(int(root[a]), int(root[b]))
            edges.append((int(fp[a]), int(fp[b])))
    return edges


def _across(placed: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b) that connect the texts of a key as its links do, from (band, fp, n, root) of keys with several roots."""
    blocks = placed.groupBy("band").agg(F.ceil(F.greatest(F.count(F.lit(1)) / TILE, F.sum("n") / TILE_HASHES)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = (placed.join(blocks, "band").withColumn("own", own)
             .select("band", "fp", "root", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
             .select("fp", "root", (F.col("own") <= F.col("other")).alias("first"),
                     F.concat_ws(" ", "band", F.least("own", "other"), F.greatest("own", "other")).alias("tile")))
    tiles = dealt.join(sets.select("fp", "found", F.size("found").alias("n")), "fp")

    def run(tile: pa.Table) -> pa.Table:
        edges = _linked_in_tile(tile, threshold)
        return pa.table({"a": pa.array([a for a, _ in edges], pa.int64()), "b": pa.array([b for _, b in edges], pa.int64())})

    return tiles.groupBy("tile").applyInArrow(run, "a long, b long")


def similar_sets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                 threshold: float = THRESHOLD, recall: float = RECALL, distance: int = DISTANCE) -> DataFrame:
    """(key, root): the first row (last, id, hash) of each set of shingles, and the name of its group.

    ``recall`` is the chance of a pair at the threshold to share a key, so to be compared at all; pairs above it have a higher
    one, and fingerprints of at most ``distance`` bits add to it. Null and blank texts have one and the same empty set. Extra columns are not read; an empty table gives an empty result.
    """
    key = F.struct(F.col(doc_id).isNull().alias("last"), F.col(doc_id).alias("id"), F.xxhash64(text).alias("hash"))
    each = settle(_sketches(docs, key, text, shingle, banding(threshold, recall)).groupBy("fp").agg(
        F.min("key").alias("key"), F.first("n").alias("n"), F.first("simhash").alias("simhash"), F.first("bands").alias("bands")))
    near = settle(_near_fingerprints(each, distance))
    banded = each.select("fp", "n", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count(F.lit(1)).alias("many")).filter("many > 1")
    met = settle(banded.join(shared, "band"))
    scores = met.groupBy("fp").agg(F.sum("many").alias("score"))
    met = settle(met.select("band", "fp", "n").join(scores, "fp"))
    hubs = met.groupBy("band").agg(F.max(F.struct("score", "fp", "n")).alias("hub"))
    alike = F.least("n", "hub.n") >= F.greatest("n", "hub.n") * threshold - 1e-9
    stars = (met.join(hubs, "band").filter(F.col("fp") != F.col("hub.fp")).filter(alike)
             .select(F.col("hub.fp").alias("a"), F.col("fp").alias("b")).union(near)
             .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    ends = near.select(F.explode(F.array("a", "b")).alias("fp"))
    wanted = each.join(scores.select("fp").union(ends).distinct(), "fp", "left_semi")
    sets = settle(_sets(_joined(wanted, _rows(docs, doc_id, text, F.col(text).alias("text"))), shingle))
    links = settle(_linked(stars, sets, threshold))
    roots = components(links)
    placed = settle(met.join(roots, F.col("fp") == F.col("node"), "left").select(
        "band", "fp", "n", F.coalesce("component", "fp").alias("root")))
    open_ = placed.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("band")
    across = settle(_across(placed.join(open_, "band", "left_semi"), sets, threshold))
    if not across.isEmpty():
        roots = components(links.union(across))
    return each.join(roots, F.col("fp") == F.col("node"), "left").select("key", F.coalesce("component", "fp").alias("root"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
             threshold: float = THRESHOLD, recall: float = RECALL, distance: int = DISTANCE) -> DataFrame:
    """Rows of ``docs`` with one document of each group: the smallest id, null ids last, ties by a hash of the text.

    Documents whose sets of shingles have a Jaccard index of ``threshold`` or more are linked; groups are what links
    connect. Blank and null texts are one group. All columns stay. Of repeated rows one stays.
    """
    chosen = similar_sets(docs, doc_id, text, shingle, threshold, recall, distance).groupBy("root").agg(F.min("key").alias("key"))
    return _joined(settle(chosen), _rows(docs, doc_id, text, F.expr("struct(*)").alias("row"))).select("row.*")
