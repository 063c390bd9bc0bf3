"""Raw CSV files of the marketplace and the human labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import GOLD_COLUMNS, MULTILINE_FILES, RAW_FILES, RAW_SCHEMAS
from .records import read_quoted


def _csv(spark: SparkSession, path: str, multiline: bool) -> DataFrame:
    """Columns by the names in the header, as text."""
    return (spark.read.option("header", True).option("multiLine", multiline)
            .option("quote", '"').option("escape", '"').option("encoding", "UTF-8").csv(path))


def _typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The declared columns with their types; what does not fit becomes null."""
    return df.select(*[
        F.col(field.name) if isinstance(field.dataType, T.StringType)
        else F.col(field.name).try_cast(field.dataType).alias(field.name) for field in schema.fields])


def read_raw(spark: SparkSession, folder: str, files: dict[str, str] = RAW_FILES) -> dict[str, DataFrame]:
    """The raw tables of a folder. Columns are found by name, so further columns and their order do not matter.

    A value may be a file, a folder of files or a pattern. Files are read in splits, those with line breaks inside quotes too.
    """
    return {
        name: _typed(read_quoted(spark, f"{folder}/{file}") if name in MULTILINE_FILES else _csv(spark, f"{folder}/{file}", False),
                     RAW_SCHEMAS[name])
        for name, file in files.items()}


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Human labels; ``gold_no`` follows the order of the rows in the file."""
    schema = T.StructType([
        T.StructField(c, T.IntegerType() if c == "review_score" else T.StringType()) for c in GOLD_COLUMNS])
    return _typed(_csv(spark, path, True), schema).withColumn("gold_no", F.monotonically_increasing_id())
