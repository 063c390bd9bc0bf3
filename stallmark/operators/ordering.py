"""Row numbers and exact samples in the order of a seeded hash, without one global sort.

The hash of the key decides the order. Its first hexadecimal digits cut the rows into buckets of even size;
rows are numbered within their bucket, and the bucket sizes, at most ``16 ** digits`` rows however large the
data, give the offsets. No task sees more than its buckets, and the result does not depend on the
partitioning. Keys must be unique: equal keys share a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 4
_HASH, _BUCKET, _BEFORE = "_hash", "_bucket", "_before"


def seeded_hash(keys: list[str], seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def _hashed(df: DataFrame, keys: list[str], seed: int, digits: int) -> DataFrame:
    return (df.withColumn(_HASH, seeded_hash(keys, seed))
            .withColumn(_BUCKET, F.substring(_HASH, 1, digits)))


def _offsets(hashed: DataFrame) -> DataFrame:
    """Rows before each bucket. The window runs over the bucket counts only."""
    before = Window.orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    return (hashed.groupBy(_BUCKET).agg(F.count(F.lit(1)).alias("_n"))
            .select(_BUCKET, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(_BEFORE)))


def _placed(hashed: DataFrame, offsets: DataFrame) -> DataFrame:
    # At most 16 ** digits rows of two short columns, whatever the size of the data.
    return hashed.join(F.broadcast(offsets), _BUCKET)


def number_rows(
    df: DataFrame, keys: list[str], seed: int = 0, name: str = "row_no", digits: int = DIGITS,
) -> DataFrame:
    """Add the position (from 0) of each row in hash order."""
    hashed = _hashed(df, keys, seed, digits)
    within = F.row_number().over(Window.partitionBy(_BUCKET).orderBy(_HASH))
    return (_placed(hashed, _offsets(hashed))
            .withColumn(name, (F.col(_BEFORE) + within - 1).cast("bigint"))
            .drop(_HASH, _BUCKET, _BEFORE))


def exact_sample(
    df: DataFrame, n: int, keys: list[str], seed: int = 0, digits: int = DIGITS,
) -> DataFrame:
    """Exactly ``n`` rows, the first in hash order; all rows when ``n`` is 0 or not below their number.

    Buckets that start at ``n`` or later are dropped before the shuffle, so it moves about ``n`` rows.
    """
    if not n:
        return df
    hashed = _hashed(df, keys, seed, digits)
    near = _placed(hashed, _offsets(hashed).filter(F.col(_BEFORE) < n))
    within = F.row_number().over(Window.partitionBy(_BUCKET).orderBy(_HASH))
    return (near.withColumn("_within", within)
            .filter(F.col(_BEFORE) + F.col("_within") <= n)
            .drop(_HASH, _BUCKET, _BEFORE, "_within"))
