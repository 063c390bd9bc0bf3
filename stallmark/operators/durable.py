"""Keep an intermediate result where it survives the loss of executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def keep(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet beside the checkpoints and go on from there: later steps read the columns they need, and with ``by``
    only the rows of the values they ask for. Column names must differ."""
    path, schema = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}", df.schema
    if by is None:
        df.write.parquet(path)
    else:
        df.hint("rebalance", by).write.partitionBy(by).parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path).select(*df.columns)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session.

    It comes from ``spark.checkpoint.dir``; only a local session may fall back to its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
            folder = tempfile.mkdtemp(prefix="stallmark-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()
