"""Review text -> sentiment, topic and urgency, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import taxonomy as tx
from ..functions.fence import compute_once
from ..functions.patterns import found, hits
from ..functions.text import normalise


def topic_of(text: Column, patterns: list[tuple[str, str]] = tx.TOPIC_PATTERNS) -> Column:
    """The first topic whose pattern occurs in the normalised text, else null."""
    chosen = F
    for name, pattern in patterns:
        chosen = chosen.when(found(text, pattern), F.lit(name))
    return chosen.otherwise(F.lit(None).cast("string"))


def sentiment_of(positive: Column, negative: Column, topic: Column, retracted: Column) -> Column:
    """Which side has more words; a topic counts as two against, a retraction takes one off the praise."""
    praise = F.when(retracted, F.greatest(positive - 1, F.lit(0))).otherwise(positive)
    blame = negative + F.when(topic.isNotNull(), 2).otherwise(0)
    return (F.when(praise > blame, F.lit("positive"))
            .when(blame > praise, F.lit("negative"))
            .otherwise(F.lit("neutral")))


def label_reviews(
    reviews: DataFrame,
    text: str = "comment_message",
    patterns: list[tuple[str, str]] = tx.TOPIC_PATTERNS,
    positive: str = tx.POSITIVE_WORDS,
    negative: str = tx.NEGATIVE_WORDS,
    provider: str = "rules",
) -> DataFrame:
    """Add sentiment, topic, urgency, summary_en and provider.

    The text is folded in a projection of its own and searched once: a later filter on the sentiment reads
    the result of the search and does not search again.
    """
    folded = reviews.withColumn("_text", normalise(F.coalesce(F.col(text), F.lit(""))))
    searched = compute_once(
        folded,
        topic_of(F.col("_text"), patterns).alias("_found"),
        hits(F.col("_text"), positive).alias("_pos"),
        hits(F.col("_text"), negative).alias("_neg"),
        F.contains("_text", F.lit(tx.RETRACTION)).alias("_retracted"),
        _any_of(F.col("_text"), tx.REFUND_WORDS).alias("_refund"))
    scored = searched.select(
        *reviews.columns, "_found", "_refund",
        sentiment_of(F.col("_pos"), F.col("_neg"), F.col("_found"), F.col("_retracted")).alias("_sentiment"))

    topic = F.coalesce("_found", F.when(F.col("_sentiment") == "positive", "praise").otherwise("other"))
    mixed = (F.col("_sentiment") == "positive") & ~topic.isin("praise", "other")
    decided = scored.select(
        *reviews.columns, "_refund",
        F.when(mixed, "neutral").otherwise(F.col("_sentiment")).alias("sentiment"),
        topic.alias("topic"))
    urgency = (F.when(F.col("topic").isin(*tx.HIGH_URGENCY_TOPICS) | F.col("_refund"), "high")
               .when(F.col("sentiment") == "negative", "medium")
               .otherwise("low"))
    return decided.select(
        *reviews.columns, "sentiment", "topic", urgency.alias("urgency"),
        F.lit("").alias("summary_en"), F.lit(provider).alias("provider"))


def _any_of(text: Column, words: list[str]) -> Column:
    condition = F.lit(False)
    for word in words:
        condition = condition | F.contains(text, F.lit(word))
    return condition


def stars_to_sentiment(score: Column) -> Column:
    return F.when(score <= 2, "negative").when(score == 3, "neutral").otherwise("positive")
