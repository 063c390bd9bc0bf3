"""Scores of labels kept as counts: an append adds its own, scores and matrices merge them and read no labels or reviews.

A store has one row for each delivery, source, month of the review and combination of truth and label: a few hundred rows a
delivery, whatever it holds. Each delivery has a name and is one part of the store; giving it again replaces its part, so a
repeated run counts nothing twice. Counts of labels against human labels add up over both sides: new labels are counted against
the human labels there are (``add_labels``), new human labels against the labels there are (``add_gold``). Every label and every
human label must come in one delivery only, and deliveries must come one after another.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import taxonomy as tx
from ..functions.time import year_month
from ..operators import evaluate as ev
from ..operators.labelling import stars_to_sentiment
from ..schemas import REVIEW_KEY

DELIVERY = "delivery"
#: The month of labels without a dated review.
UNDATED = "none"
_KEYS = ["provider", "month", "task", "truth_sentiment", "sentiment", "truth_topic", "topic"]
_SCHEMA = T.StructType([*(T.StructField(c, T.StringType()) for c in _KEYS), T.StructField("n", T.LongType()),
                        T.StructField(DELIVERY, T.StringType())])


def _dated(labels: DataFrame, reviews: DataFrame) -> DataFrame:
    """Labels with the month and the stars of their review; all labels stay. Reviews have one row for each key."""
    known = reviews.select(*REVIEW_KEY, year_month(F.col("review_date")).alias("month"),
                           stars_to_sentiment(F.col("review_score")).alias("stars"), F.lit(True).alias("reviewed"))
    return (labels.select(*REVIEW_KEY, "provider", "sentiment", "topic").join(known, REVIEW_KEY, "left")
            .withColumn("month", F.coalesce("month", F.lit(UNDATED))))


def _counted(rows: DataFrame, task: Column, **columns: Column) -> DataFrame:
    given = {"provider": F.col("provider"), "month": F.col("month"), "task": task, **columns}
    keys = [given.get(c, F.lit(None).cast("string")).alias(c) for c in _KEYS]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def star_counts(labels: DataFrame, reviews: DataFrame) -> DataFrame:
    """Labels by source, month, sentiment of the stars and of the label; those without a review have the task "alone"."""
    return _counted(_dated(labels, reviews), F.when(F.col("reviewed"), "stars").otherwise("alone"),
                    truth_sentiment=F.col("stars"), sentiment=F.col("sentiment"))


def gold_counts(gold: DataFrame, labels: DataFrame, reviews: DataFrame) -> DataFrame:
    """Labels that have a human label, by source, month and both sides' sentiment and topic."""
    # Only labels and reviews with a human label meet each other.
    judged = labels.join(gold.select(*REVIEW_KEY).distinct(), REVIEW_KEY, "left_semi")
    pairs = ev.gold_pairs(gold.select(*REVIEW_KEY, F.lit(0).alias("review_score"), "gold_sentiment", "gold_topic"), judged)
    months = (reviews.join(gold.select(*REVIEW_KEY), REVIEW_KEY, "left_semi")
              .select(*REVIEW_KEY, year_month(F.col("review_date")).alias("month")))
    dated = pairs.join(months, REVIEW_KEY, "left").withColumn("month", F.coalesce("month", F.lit(UNDATED)))
    return _counted(dated, F.lit("gold"), truth_sentiment=F.col("gold_sentiment"), sentiment=F.col("sentiment"),
                    truth_topic=F.col("gold_topic"), topic=F.col("topic"))


def _put(counts: DataFrame, path: str, delivery: str) -> None:
    # One file: rows are bounded by sources, months and pairs of labels.
    (counts.withColumn(DELIVERY, F.lit(delivery)).coalesce(1).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(DELIVERY).parquet(path))


def add_labels(labels: DataFrame, reviews: DataFrame, gold: DataFrame, path: str, delivery: str) -> None:
    """Count new labels against the stars and the human labels there are."""
    _put(star_counts(labels, reviews).unionByName(gold_counts(gold, labels, reviews)), path, delivery)


def add_gold(gold: DataFrame, labels: DataFrame, reviews: DataFrame, path: str, delivery: str) -> None:
    """Count all labels there are against new human labels."""
    _put(gold_counts(gold, labels, reviews), path, delivery)


def read_counts(spark: SparkSession, path: str, months: Sequence[str] | None = None) -> DataFrame:
    """The counts of all deliveries together, of all months or of some."""
    stored = spark.read.schema(_SCHEMA).parquet(path)
    if months is not None:
        stored = stored.filter(F.col("month").isin(*months)) if months else stored.filter(F.lit(False))
    return stored.groupBy(*_KEYS).agg(F.sum("n").alias("n"))


def summary_of(counts: DataFrame, by_month: bool = False) -> DataFrame:
    """``evaluate.summary`` from counts: one row for each source, or for each source and month."""
    by = ["provider", "month"] if by_month else ["provider"]
    n, gold = F.col("n"), F.col("task") == "gold"
    zero = F.lit(0).cast("bigint")
    complaints = F.when(F.col("truth_sentiment") == "negative", n).otherwise(zero)
    size = F.struct(F.lit("labelled").alias("task"), F.lit("").alias("name"), zero.alias("tp"), zero.alias("missed"), n.alias("n"))
    sentiment, topic = (F.col("truth_sentiment"), F.col("sentiment")), (F.col("truth_topic"), F.col("topic"))
    sides = F.when(gold, F.array(*ev._sides("sentiment", *sentiment, n), *ev._sides("topic", *topic, n),
                                 *ev._sides("complaint", *topic, complaints)))
    sides = sides.when(F.col("task") == "stars", F.array(size, *ev._sides("stars", *sentiment, n))).otherwise(F.array(size))
    scored = ev._scored(counts.select(*by, F.inline(sides)), by)
    columns = {"labelled": ("labelled", "n"), **ev.STAR_SCORES, "gold_n": ("topic", "n"),
               "gold_sentiment_acc": ("sentiment", "accuracy"), "gold_topic_acc": ("topic", "accuracy"),
               "gold_topic_macro_f1": ("topic", "macro_f1"), "complaint_topic_acc": ("complaint", "accuracy")}
    wide = scored.groupBy(*by).agg(*[
        F.max(F.when(F.col("task") == task, F.col(score))).alias(name) for name, (task, score) in columns.items()])
    return wide.withColumn("gold_n", F.coalesce("gold_n", F.lit(0)))


def topic_matrix_of(counts: DataFrame, topics: list[str] = tx.TOPICS) -> DataFrame:
    """``evaluate.topic_matrix`` from counts."""
    cells = counts.filter(F.col("task") == "gold").groupBy("provider", "truth_topic", "topic").agg(F.sum("n").alias("n"))
    zero = F.lit(0).cast("bigint")
    sides = cells.select("provider", F.inline(F.array(
        F.struct(F.col("truth_topic").alias("gold_topic"), "topic", "n"),
        F.struct(F.col("topic").alias("gold_topic"), "topic", zero.alias("n")))))
    return (sides.filter(F.col("gold_topic").isin(*topics)).groupBy("provider", "gold_topic")
            .agg(*(F.sum(F.when(F.col("topic") == t, F.col("n")).otherwise(zero)).alias(t) for t in topics))
            .withColumn("total", sum((F.col(t) for t in topics), zero)))
