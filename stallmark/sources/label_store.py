"""Labels kept between runs: append once per key, read, choose the best source.

Files are split by source and by the month of the review, where it is known (rows may carry ``review_date``; labels
without one share a part of their own). A batch is checked against the months it has reviews of, so what an append reads
and writes follows the batch and not the store. A review keeps its date, so its key is always looked for in one month.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from .. import taxonomy as tx
from ..functions.time import year_month
from ..operators.durable import settle
from ..schemas import LABEL_COLUMNS, REVIEW_KEY

DATE = "review_date"
_MONTH = "month"
#: The part of labels without a date.
_UNDATED = "none"

_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in LABEL_COLUMNS] + [T.StructField(_MONTH, T.StringType())])


def with_month(df: DataFrame) -> DataFrame:
    """Rows with the month of their review."""
    if _MONTH in df.columns:
        return df
    dated = year_month(F.col(DATE)) if DATE in df.columns else F.lit(None).cast("string")
    return df.withColumn(_MONTH, F.coalesce(dated, F.lit(_UNDATED)))


def _stored(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(_SCHEMA).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _SCHEMA)


def load_labels(spark: SparkSession, path: str, provider: str | None = None) -> DataFrame:
    labels = _stored(spark, path)
    if provider is not None:
        labels = labels.filter(F.col("provider") == provider)
    return labels.select(*LABEL_COLUMNS)


def first_per_key(labels: DataFrame) -> DataFrame:
    """One label per source and key; combined before the shuffle."""
    dated = with_month(labels)
    rest = [c for c in (*LABEL_COLUMNS, _MONTH) if c not in (*REVIEW_KEY, "provider")]
    return (dated.groupBy("provider", *REVIEW_KEY).agg(F.min(F.struct(*rest)).alias("one"))
            .select(*REVIEW_KEY, "one.*", "provider").select(*LABEL_COLUMNS, _MONTH))


def touched_months(df: DataFrame) -> list[str]:
    """The months of some rows: twelve a year at most."""
    return [row[_MONTH] for row in with_month(df).select(_MONTH).distinct().collect()]


def not_stored(df: DataFrame, path: str, months: list[str] | None = None) -> DataFrame:
    """Rows of ``df`` (with ``provider``) that have no label of that source yet.

    With ``months``, those of the rows, only their files are read; without, those of the rows are looked up first.
    """
    dated = with_month(df)
    months = touched_months(dated) if months is None else months
    stored = _stored(df.sparkSession, path)
    stored = stored.filter(F.col(_MONTH).isin(*months)) if months else stored.filter(F.lit(False))
    key = ["provider", _MONTH, *REVIEW_KEY]
    left = dated.join(stored.select(*key), key, "left_anti")
    return left if _MONTH in df.columns else left.drop(_MONTH)


def append_labels(labels: DataFrame, path: str, months: list[str] | None = None) -> None:
    """Append the labels whose source and key are not stored yet."""
    if months is None and not {DATE, _MONTH} & set(labels.columns):
        months = [_UNDATED]
    write_new(not_stored(first_per_key(labels), path, months), path)


def write_new(labels: DataFrame, path: str, width: int | None = None) -> None:
    """Append labels whose keys are known to be new: about one file for each source and month among them.

    With ``width`` the months of a small batch are written by so many tasks, each month by one."""
    _write(with_month(labels), path, "append", width)


def replace_labels(labels: DataFrame, path: str) -> None:
    """Write the store anew with one label per source and key."""
    _write(first_per_key(labels), path, "overwrite")


def compact(spark: SparkSession, path: str, files: int = 8) -> list[tuple[str, str]]:
    """Rewrite the parts (source, month) that have more than ``files`` files, and return them.

    A part is kept in the checkpoint folder before it is replaced. Run it while nothing is appended.
    """
    stored = _stored(spark, path)
    crowded = [(r["provider"], r[_MONTH]) for r in stored.select("provider", _MONTH, F.input_file_name().alias("file")).distinct()
               .groupBy("provider", _MONTH).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > files).collect()]
    for provider, month in crowded:
        kept = settle(stored.filter((F.col("provider") == provider) & (F.col(_MONTH) == month)))
        (kept.select(*LABEL_COLUMNS, _MONTH).hint("rebalance", "provider", _MONTH).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("provider", _MONTH).parquet(path))
    return crowded


def _write(labels: DataFrame, path: str, mode: str, width: int | None = None) -> None:
    rows, parts = labels.select(*LABEL_COLUMNS, _MONTH), ["provider", _MONTH]
    ((rows.repartition(width, *parts) if width else rows.hint("rebalance", *parts))
     .write.mode(mode).partitionBy("provider", _MONTH).parquet(path))


def best_labels(labels: DataFrame, priority: list[str] = tx.PROVIDER_PRIORITY) -> DataFrame:
    """The labels of the first source in ``priority`` that has any."""
    place = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("provider"))
    best = (labels.filter(place > 0).agg(F.min(F.struct(place.alias("place"), "provider")).alias("best"))
            .select(F.col("best.provider").alias("provider")))
    # One row by construction.
    return labels.join(F.broadcast(best), "provider", "left_semi")
