"""Links between 64-bit fingerprints at a Hamming distance, by the generalised pigeonhole principle.

1. Correlated bits are grouped: two passes over the fingerprints add up 64 x 64 co-occurrences and the histograms of
   8-bit blocks (a fixed number of figures, whatever the input), and bits go greedily to the part they correlate with.
2. A pair within distance r lies within t_i in some part i whenever the thresholds t_i >= -1 add up to r - parts + 1.
   Each fingerprint gets its own thresholds: a dynamic programme over the parts picks those with the fewest probes
   and estimated candidates, the estimate coming from the block histograms.
3. Each fingerprint probes the values within t_i of its part i. Values are counted first; probes that meet nothing
   but themselves go. Met keys are cut into tiles of at most TILE by TILE fingerprints, so that a key many
   fingerprints share is spread over many tasks.
4. A task verifies its tiles with exclusive-or and popcount, and emits a spanning forest of the links it has found
   rather than the links: as many edges as nodes at most. Every link is checked, so connectivity is exact.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallmark.operators.durable import settle

BITS, BLOCK = 64, 8
TILE = 128
#: Pairs and probes held at once in a task.
AT_ONCE = 1 << 20


def _bit(values: np.ndarray, at: int) -> np.ndarray:
    return (values >> np.uint64(at)) & np.uint64(1)


def _gather(values: np.ndarray, bits: list[int]) -> np.ndarray:
    """The listed bits of each value, packed."""
    out = np.zeros(len(values), np.uint64)
    for j, at in enumerate(bits):
        out |= _bit(values, at) << np.uint64(j)
    return out


@dataclass
class Layout:
    """Parts of the bits, and for each block of each part the share of fingerprints at each distance of a value."""
    distance: int
    parts: list[list[int]]
    near: list[list[np.ndarray]]
    n: int

    def blocks(self, i: int) -> list[list[int]]:
        return [self.parts[i][at:at + BLOCK] for at in range(0, len(self.parts[i]), BLOCK)]

    def expected(self, values: np.ndarray, i: int) -> np.ndarray:
        """Estimated fingerprints within 0, 1, ... ``distance`` of each value in part i."""
        total = None
        for bits, near in zip(self.blocks(i), self.near[i], strict=True):
            own = near[_gather(values, bits).astype(np.int64)]
            if total is None:
                total = own
                continue
            mixed = np.zeros_like(total)
            for k in range(self.distance + 1):
                for j in range(k + 1):
                    mixed[:, k] += total[:, j] * own[:, k - j]
            total = mixed
        return self.n * np.cumsum(total, axis=1)

    def thresholds(self, values: np.ndarray) -> np.ndarray:
        """The cheapest thresholds of each value, one column for each part."""
        r, m = self.distance, len(self.parts)
        # A sum is kept as the number of steps above -1 in every part.
        goal = r + 1
        best = np.full((len(values), goal + 1), np.inf)
        best[:, 0] = 0
        chosen = np.zeros((m, len(values), goal + 1), np.int8)
        for i in range(m):
            expected, w = self.expected(values, i), len(self.parts[i])
            cost = [np.zeros(len(values))] + [
                expected[:, t] + sum(math.comb(w, k) for k in range(t + 1)) for t in range(r + 1)]
            after = np.full_like(best, np.inf)
            for total, step in itertools.product(range(goal + 1), range(goal + 1)):
                if step <= total:
                    price = best[:, total - step] + cost[step]
                    better = price < after[:, total]
                    after[better, total], chosen[i, better, total] = price[better], step
            best = after
        out, left, rows = np.zeros((len(values), m), np.int8), np.full(len(values), goal), np.arange(len(values))
        for i in reversed(range(m)):
            out[:, i] = chosen[i, rows, left] - 1
            left = left - chosen[i, rows, left]
        return out


def _columns(batch: pa.RecordBatch) -> np.ndarray:
    return batch["fp"].to_numpy(zero_copy_only=False).view(np.uint64)


def _totals(fps: DataFrame, count) -> np.ndarray:
    """Element-wise sum over all batches of the array ``count`` gives for one; its length does not follow the data."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            own = count(_columns(batch))
            total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["at", "total"])

    rows = fps.mapInArrow(run, "at long, total long").groupBy("at").agg(F.sum("total").alias("total")).toArrow()
    out = np.zeros(len(count(np.zeros(0, np.uint64))), np.int64)
    out[rows["at"].to_numpy()] = rows["total"].to_numpy()
    return out


def _together(values: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(values.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, ::-1].astype(np.float64)
    return np.append((bits.T @ bits).astype(np.int64).ravel(), len(values))


def layout(fps: DataFrame, distance: int) -> Layout:
    """Parts for distinct fingerprints ``fp``: as wide as the logarithm of their number plus 3, 16 to 32 bits."""
    sums = _totals(fps, _together)
    n, both = int(sums[-1]), sums[:-1].reshape(BITS, BITS) / max(1, sums[-1])
    mean = np.diag(both)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    like = np.abs((both - np.outer(mean, mean)) / np.outer(spread, spread))
    np.fill_diagonal(like, 0)
    m = min(4, max(2, BITS // max(16, math.ceil(math.log2(max(2, n))) + 3)))
    left, parts = set(range(BITS)), []
    for i in range(m):
        size = len(left) // (m - i)
        part = [max(sorted(left), key=lambda b: like[b, sorted(left)].sum())]
        while len(part) < size:
            part.append(max(sorted(left - set(part)), key=lambda b: like[b, part].sum()))
        left -= set(part)
        parts.append(part)
    plan = Layout(distance, parts, [], n)
    blocks = [b for i in range(m) for b in plan.blocks(i)]
    width = 1 << BLOCK
    counts = _totals(fps, lambda v: np.concatenate(
        [np.bincount(_gather(v, b).astype(np.int64), minlength=width) for b in blocks])).reshape(len(blocks), width)
    apart = np.bitwise_count(np.arange(width)[:, None] ^ np.arange(width)[None, :])
    near = [np.stack([(apart == k) @ c for k in range(distance + 1)], axis=1) / max(1, n) for c in counts]
    for i in range(m):
        plan.near.append([near.pop(0) for _ in plan.blocks(i)])
    return plan


def _masks(width: int, most: int) -> np.ndarray:
    return np.array([sum(1 << b for b in chosen) for k in range(most + 1)
                     for chosen in itertools.combinations(range(width), k)], np.uint64)


def _key(i: int, value: np.ndarray) -> np.ndarray:
    return (value | np.uint64(i << 32)).view(np.int64)


def _indexed(fps: DataFrame, plan: Layout) -> DataFrame:
    """(key, fp): each fingerprint under its value of each part."""
    def run(batches):
        for batch in batches:
            v = _columns(batch)
            for i, bits in enumerate(plan.parts):
                yield pa.RecordBatch.from_arrays([pa.array(_key(i, _gather(v, bits))), batch["fp"]], ["key", "fp"])

    return fps.mapInArrow(run, "key long, fp long")


def _probed(fps: DataFrame, plan: Layout) -> DataFrame:
    """(key, fp, own): each fingerprint under all values within its thresholds; ``own`` marks its own value."""
    def run(batches):
        for batch in batches:
            every = _columns(batch)
            limits = plan.thresholds(every)
            for i, bits in enumerate(plan.parts):
                for t in range(plan.distance + 1):
                    v, masks = every[limits[:, i] == t], _masks(len(bits), t)
                    step = max(1, AT_ONCE // len(masks))
                    for at in range(0, len(v), step):
                        part = v[at:at + step]
                        keys = _gather(part, bits)[:, None] ^ masks[None, :]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(_key(i, keys.ravel())), pa.array(np.repeat(part.view(np.int64), len(masks))),
                             pa.array(np.tile(masks == 0, len(part)))], ["key", "fp", "own"])

    return fps.mapInArrow(run, "key long, fp long, own boolean")


class Forest:
    """Union-find over the nodes of one task."""

    def __init__(self):
        self.above: dict[int, int] = {}

    def root(self, x: int) -> int:
        above = self.above
        while (up := above.setdefault(x, x)) != x:
            above[x] = x = above[up]
        return x

    def link(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.above[max(x, y)] = min(x, y)

    def edges(self) -> Iterator[tuple[int, int]]:
        return ((x, r) for x in list(self.above) if (r := self.root(x)) != x)


def _pairs(group: np.ndarray, probe: np.ndarray, fp: np.ndarray, distance: int) -> Iterator[tuple[int, int]]:
    """Links of rows sorted by group, stored fingerprints before probing ones."""
    first = np.searchsorted(group, group[probe], "left")
    stored = np.flatnonzero(~probe)
    count = np.searchsorted(group[stored], group[probe], "right") - np.searchsorted(group[stored], group[probe], "left")
    probes = fp[probe]
    ends = np.cumsum(count)
    at = 0
    while at < len(probes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
        c = count[at:to]
        inside = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        x, y = np.repeat(probes[at:to], c), fp[np.repeat(first[at:to], c) + inside]
        hit = (np.bitwise_count(x ^ y) <= distance) & (x != y)
        yield from zip(x[hit].view(np.int64).tolist(), y[hit].view(np.int64).tolist())
        at = to


def _verified(tiles: DataFrame, distance: int) -> DataFrame:
    """(a, b): a spanning forest of the links within each task's tiles, which arrive sorted."""
    def run(batches):
        forest, left = Forest(), None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                rows = [batch[c].to_numpy(zero_copy_only=False) for c in ("key", "i", "j", "probe", "fp")]
                left = rows if left is None else [np.concatenate(x) for x in zip(left, rows)]
            if left is None or not len(left[0]):
                continue
            new = np.any([np.diff(x) != 0 for x in left[:3]], axis=0)
            group = np.append(0, np.cumsum(new))
            # The last tile may go on in the next batch.
            cut = len(group) if batch is None else int(np.searchsorted(group, group[-1], "left"))
            for x, y in _pairs(group[:cut], left[3][:cut].astype(bool), left[4][:cut].view(np.uint64), distance):
                forest.link(x, y)
            left = [x[cut:] for x in left]
        edges = list(forest.edges())
        for at in range(0, len(edges), AT_ONCE):
            a, b = zip(*edges[at:at + AT_ONCE])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return tiles.mapInArrow(run, "a long, b long")


def links(fps: DataFrame, distance: int = 3) -> DataFrame:
    """Edges (a, b) that connect exactly the fingerprints which links of at most ``distance`` bits connect.

    ``fps`` has one long column ``fp`` of distinct values and should be stored (it is read several times). Every
    edge is a spanning edge of a task's links, so a and b are connected, though perhaps over others. An empty table
    gives no edges; null fingerprints are ignored.
    """
    fps = fps.filter("fp is not null")
    plan = layout(fps, distance)
    indexed = _indexed(fps, plan)
    stored = settle(indexed.groupBy("key").agg(F.count(F.lit(1)).alias("stored")))
    # A probe of the own value meets at least itself.
    met = settle(_probed(fps, plan).join(stored, "key").filter("stored > 1 or not own").drop("own"))
    shape = settle(met.groupBy("key").agg(
        F.ceil(F.max("stored") / TILE).cast("int").alias("wide"), F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("high")))
    rows = met.select("key", "fp", F.lit(True).alias("probe")).union(indexed.select("key", "fp", F.lit(False)))
    place = lambda n: F.pmod(F.xxhash64("fp"), F.col(n)).cast("int")
    i = F.when(F.col("probe"), F.sequence(F.lit(0), F.col("wide") - 1)).otherwise(F.array(place("wide")))
    j = F.when(F.col("probe"), F.array(place("high"))).otherwise(F.sequence(F.lit(0), F.col("high") - 1))
    tiles = (rows.join(shape, "key").select("key", "fp", "probe", F.explode(i).alias("i"), j.alias("js"))
             .select("key", "fp", "probe", "i", F.explode("js").alias("j")))
    sorted_tiles = tiles.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "probe")
    return _verified(sorted_tiles, distance)
