"""Exact top-k search by inner product of integer vectors.

Vectors are packed into blocks of up to BLOCK rows, in the narrowest integers that hold them: queries into blocks, candidates
into tiles, both within tasks. Every tile meets every block of queries once, in a grid of about twice as many cells as there are shuffle
partitions: a tile goes to the cells of its row, a block to those of its column, and the sides of the grid are chosen so that
both kinds of copies take about as much room. Both sides are shuffled: copies are many times the rows they are made of, which
statistics do not show, so none may be broadcast. A task multiplies a tile with a block, keeps the k best of each
query, and merges what it has by query before it passes them on. The lists of the tasks are merged in a tree: a node takes about FAN lists
of a query, which its number of tasks does not change. Nothing but one tile, one block and k results a query is in a search at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1024
#: Lists of a query that meet in a node of the tree.
FAN = 64
#: Results of a task that are merged before they leave it.
HELD = 1 << 18
#: Products below this are exact in double precision.
EXACT = 1 << 53
LONG = (1 << 63) - 1


def whole(vector: Column) -> Column:
    """floor(256 x) of each component; null for vectors that are null or have null or non-finite components."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(wide, lambda x: F.floor(x.cast("double") * 256)))


def _bytes(matrix: np.ndarray) -> bytes:
    """Whole numbers in the narrowest type that holds them all."""
    low, high = int(matrix.min(initial=0)), int(matrix.max(initial=0))
    kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
    return matrix.astype(kind).tobytes()


def _matrix(packed: bytes, rows: int, length: int) -> np.ndarray:
    """What ``_bytes`` was made of; the width shows its type."""
    if not length:
        return np.zeros((rows, 0), np.int64)
    return np.frombuffer(packed, f"i{len(packed) // (rows * length)}").reshape(rows, length).astype(np.int64)


def _pack(rows: DataFrame) -> DataFrame:
    """(length, part, ids, nths, vectors): blocks of up to BLOCK rows of one length and part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[tuple[int, int], list[tuple]] = {}

        def block(n: int, part: int) -> pa.RecordBatch:
            ids, nths, vectors = zip(*waiting.pop((n, part)))
            return pa.RecordBatch.from_arrays(
                [pa.array([n]), pa.array([part]), pa.array([list(ids)], pa.list_(pa.int64())), pa.array([list(nths)], pa.list_(pa.int32())),
                 pa.array([_bytes(np.concatenate(vectors))])],
                ["length", "part", "ids", "nths", "vectors"])

        for batch in batches:
            offsets = batch["v"].offsets.to_numpy()
            values = batch["v"].values.to_numpy(zero_copy_only=False)
            for i, (vec_id, nth, part) in enumerate(zip(*(batch[c].to_pylist() for c in ("vec_id", "nth", "part")))):
                key = (int(offsets[i + 1] - offsets[i]), part)
                own = waiting.setdefault(key, [])
                own.append((vec_id, nth, values[offsets[i]:offsets[i + 1]]))
                if len(own) == BLOCK:
                    yield block(*key)
        for key in list(waiting):
            yield block(*key)

    return rows.select("vec_id", "nth", "part", "v").mapInArrow(
        run, "length long, part long, ids array<long>, nths array<int>, vectors binary")


def _order(ids: np.ndarray) -> np.ndarray:
    """Ids as they order ties: null (stored as the largest) last."""
    return np.array([LONG if i is None else i for i in ids], np.int64)


def _products(queries: np.ndarray, tile: np.ndarray) -> np.ndarray:
    """Inner products, exact; those beyond a long stay at its end."""
    bound = int(np.abs(queries).max(initial=0)) * int(np.abs(tile).max(initial=0)) * max(1, queries.shape[1])
    if bound < EXACT:
        return (queries.astype(np.float64) @ tile.astype(np.float64).T).astype(np.int64)
    exact = queries.astype(object) @ tile.astype(object).T
    return np.minimum(np.maximum(exact, -LONG - 1), LONG).astype(np.int64)


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k best of each row, ties to the smaller id; the columns come in ascending order of ids."""
    n = score.shape[1]
    if n <= k:
        return np.argsort(-score, axis=1, kind="stable")
    # Everything at or above the k-th score, then the first k by (score, id).
    floor = np.partition(score, n - k, axis=1)[:, n - k]
    out = np.empty((len(score), k), np.int64)
    for r, row in enumerate(score):
        at = np.flatnonzero(row >= floor[r])
        out[r] = at[np.argsort(-row[at], kind="stable")[:k]]
    return out


def _searched(pairs: DataFrame, k: int) -> DataFrame:
    """(query_id, nth, vec_id, score): the k best of each query over the tiles of a task, or of a stretch of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], list[tuple[int, int]]] = {}

        def merged() -> pa.RecordBatch:
            rows = [(q, v, -s, i) for (q, v), found in best.items() for s, i in found]
            best.clear()
            q, v, s, i = zip(*rows) if rows else ((), (), (), ())
            return pa.RecordBatch.from_arrays(
                [pa.array(q, pa.int64()), pa.array(v, pa.int32()), pa.array([None if x == LONG else x for x in i], pa.int64()),
                 pa.array(s, pa.int64())], ["query_id", "nth", "vec_id", "score"])

        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(len(batch))):
                query = _matrix(row["q_vectors"], len(row["q_ids"]), row["length"])
                tile = _matrix(row["vectors"], len(row["ids"]), row["length"])
                ids = _order(row["ids"])
                by_id = np.argsort(ids, kind="stable")
                ids, scores = ids[by_id], _products(query, tile[by_id])
                names = np.array(row["q_ids"], np.int64)
                # A row is no candidate of its own; lists are one longer for each own row that must go.
                own = np.searchsorted(ids, names, "right") - np.searchsorted(ids, names, "left")
                chosen = _best(scores, ids, min(len(ids), k + int(own.max(initial=0))))
                for r, key in enumerate(zip(names.tolist(), row["q_nths"])):
                    found = [(-int(scores[r, c]), int(ids[c])) for c in chosen[r] if ids[c] != key[0]][:k]
                    best[key] = sorted(best.get(key, []) + found)[:k]
                if len(best) * k > HELD:
                    yield merged()
        yield merged()

    return pairs.mapInArrow(run, "query_id long, nth int, vec_id long, score long")


def search(vectors: DataFrame, k: int = 5, every: int = 50, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` best candidates of each row whose id is divisible by ``every``.

    Components become floor(256 x); the score is the integer inner product, ties go to the smaller id, null ids last.
    Vectors that are null or hold null or non-finite components take no part; vectors meet only those of their own
    length; empty ones have score 0. Candidates are all rows with another id than the query's; repeated rows are
    several candidates, while a query that repeats with the same vector is answered once. Scores beyond a long stay at
    its end. Other columns are not read. An empty table gives an empty result.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), whole(F.col(vector)).alias("v")).filter("v is not null")
    cells = 2 * int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # There are about 1 / every as many queries as candidates.
    wide = max(1, round(math.sqrt(cells / every)))
    high = -(-cells // wide)
    # An id may come with several vectors; nth tells them apart, whatever the partitions.
    asked = rows.filter(F.col("vec_id") % every == 0).distinct().withColumn("nth", F.row_number().over(Window.partitionBy("vec_id").orderBy("v")))
    blocks = _pack(asked.withColumn("part", F.pmod(F.xxhash64("vec_id", "nth"), F.lit(wide)))).select(
        "length", F.col("ids").alias("q_ids"), F.col("nths").alias("q_nths"), F.col("vectors").alias("q_vectors"),
        F.col("part").alias("column"), _all(high).alias("row"))
    tiles = _pack(rows.withColumns({"nth": F.lit(0), "part": F.lit(0).cast("long")})).select(
        "length", "ids", "vectors", F.pmod(F.xxhash64("vectors", "ids"), F.lit(high)).alias("row"), _all(wide).alias("column"))
    found = _searched(tiles.join(blocks.hint("merge"), ["length", "row", "column"]).select(
        "length", "ids", "vectors", "q_ids", "q_nths", "q_vectors"), k)
    lists = high
    while lists > FAN:
        lists = -(-lists // FAN)
        node = F.pmod(F.xxhash64("vec_id", "score"), F.lit(lists)).alias("node")
        found = _top(found, k, "query_id", "nth", node).select("query_id", "nth", F.inline("top")).drop("s", "n")
    return _top(found, k, "query_id", "nth").select("query_id", F.posexplode("top")).select(
        "query_id", (F.col("pos") + 1).alias("rank"), "col.vec_id", "col.score")


def _all(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def _top(found: DataFrame, k: int, *keys) -> DataFrame:
    """``top``, the k best of each group."""
    one = F.struct((-F.col("score")).alias("s"), F.col("vec_id").isNull().alias("n"), "vec_id", "score")
    return found.groupBy(*keys).agg(F.slice(F.sort_array(F.collect_list(one)), 1, k).alias("top"))


ORACLE = """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (
        SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
        FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""
