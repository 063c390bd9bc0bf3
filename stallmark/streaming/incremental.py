"""Label new review files as they arrive, once per review and order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.labelling import label_reviews
from ..operators.picking import with_text
from ..schemas import REVIEW_KEY
from ..sources import label_store

PROVIDER = "rules"
REVIEW_SCHEMA = T.StructType([
    T.StructField("review_id", T.StringType()), T.StructField("order_id", T.StringType()),
    T.StructField("comment_message", T.StringType()), T.StructField("review_date", T.DateType())])


def label_batch(batch: DataFrame, store: str) -> None:
    """Label the reviews of a batch that have no label yet and append them.

    Keys are checked against the stored labels of the batch's months before the text is searched. A batch that is run
    again after a failure finds its keys stored and adds nothing. The batch is read twice, for its months and for
    its rows, which costs less than keeping it in memory.
    """
    batch = label_store.with_month(batch)
    texts = (with_text(batch).groupBy(*REVIEW_KEY)
             .agg(F.min("comment_message").alias("comment_message"), F.min("month").alias("month"))
             .withColumn("provider", F.lit(PROVIDER)))
    new = label_store.not_stored(texts, store, label_store.touched_months(batch))
    label_store.write_new(label_reviews(new.drop("provider"), provider=PROVIDER), store)


def label_stream(
    spark: SparkSession, source: str, store: str, checkpoint: str, files_per_batch: int = 1000,
    schema: T.StructType = REVIEW_SCHEMA,
) -> StreamingQuery:
    """Work through the review files that are there and stop; the next start goes on from the checkpoint."""
    reviews = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source))
    return (reviews.writeStream
            .foreachBatch(lambda batch, _: label_batch(batch, store))
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start())
