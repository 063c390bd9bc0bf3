"""Which reviews to label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import REVIEW_KEY
from .ordering import exact_sample

MIN_LENGTH = 5  # fixed value: shortest text worth a label


def with_text(reviews: DataFrame, min_length: int | None = MIN_LENGTH) -> DataFrame:
    """Reviews with a text of at least ``min_length`` characters; with None any text."""
    return reviews.filter(F.col("comment_message").isNotNull() & (F.length("comment_message") >= (min_length or 0)))


def pick_reviews(reviews: DataFrame, gold: DataFrame, n: int = 2000, seed: int = 42,
                 min_length: int | None = MIN_LENGTH) -> DataFrame:
    """All reviews with a human label, and ``n`` of the others (0: all of them)."""
    texts = with_text(reviews, min_length).select(*REVIEW_KEY, "review_score", "comment_message")
    keys = gold.select(*REVIEW_KEY)
    rest = texts.join(keys, REVIEW_KEY, "left_anti")
    return texts.join(keys, REVIEW_KEY, "left_semi").unionByName(exact_sample(rest, n, REVIEW_KEY, seed))


def todo(picked: DataFrame, done: DataFrame, key: list[str] | str = tuple(REVIEW_KEY)) -> DataFrame:
    """Rows not labelled yet. With ``key='review_id'`` a review id that covers two orders counts as done
    when one of them is labelled."""
    columns = [key] if isinstance(key, str) else list(key)
    return picked.join(done.select(*columns), columns, "left_anti")
