"""How good are the labels: accuracy, macro F1, confusion matrix, disagreements.

The large inputs are reduced to counts per (source, truth, label) before anything else; all scores come from
these few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import taxonomy as tx
from ..functions.numbers import half_even_tenths, ratio
from ..schemas import REVIEW_KEY
from .labelling import stars_to_sentiment

ACCURACIES = ["sentiment_vs_stars_acc", "gold_sentiment_acc", "gold_topic_acc", "complaint_topic_acc"]
PERCENTS = ["sentiment_vs_stars_acc", "sentiment_vs_stars_f1", "gold_sentiment_acc", "gold_topic_acc",
            "gold_topic_macro_f1", "complaint_topic_acc"]


def confusion(pairs: DataFrame, truth: str, label: str, by: list[str]) -> DataFrame:
    """Counts per (by, truth, label); combined before the shuffle."""
    return (pairs.groupBy(*by, F.col(truth).alias("truth"), F.col(label).alias("label"))
            .agg(F.count(F.lit(1)).alias("n")))


def _sides(task: str, truth: Column, label: Column, n: Column) -> list[Column]:
    """What a count adds to its truth and to its label: hits, misses, and (once) its size."""
    hit, zero = truth == label, F.lit(0).cast("bigint")
    missed = F.when(hit, zero).otherwise(n).alias("missed")
    return [
        F.struct(F.lit(task).alias("task"), truth.alias("name"), F.when(hit, n).otherwise(zero).alias("tp"),
                 missed, n.alias("n")),
        F.struct(F.lit(task).alias("task"), label.alias("name"), zero.alias("tp"), missed, zero.alias("n"))]


def _scored(sides: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy and macro F1 per (by, task).

    The mean runs over the labels that occur as truth or as label; they are added in sorted order so that
    the sum does not depend on the partitions.
    """
    per_label = sides.groupBy(*by, "task", "name").agg(*[F.sum(c).alias(c) for c in ("tp", "missed", "n")])
    f1 = F.coalesce(ratio(F.col("tp") * 2, F.col("tp") * 2 + F.col("missed")), F.lit(0.0))
    listed = per_label.groupBy(*by, "task").agg(
        F.sum("n").alias("n"), ratio(F.sum("tp"), F.sum("n")).alias("accuracy"),
        F.array_sort(F.collect_list(F.struct("name", f1.alias("f1")))).alias("list"))
    added = F.aggregate("list", F.lit(0.0), lambda total, entry: total + entry["f1"])
    return listed.select(*by, "task", "n", "accuracy", (added / F.size("list")).alias("macro_f1"))


def scores(counts: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy and macro F1 of confusion counts (by, truth, label, n)."""
    sides = counts.select(*by, F.inline(F.array(*_sides("", F.col("truth"), F.col("label"), F.col("n")))))
    return _scored(sides, by).select(*by, "n", "accuracy", "macro_f1")


def _star_sides(labels: DataFrame, reviews: DataFrame) -> DataFrame:
    pairs = (labels.select(*REVIEW_KEY, "provider", "sentiment")
             .join(reviews.select(*REVIEW_KEY, "review_score"), REVIEW_KEY)
             .withColumn("stars", stars_to_sentiment(F.col("review_score"))))
    counts = confusion(pairs, "stars", "sentiment", ["provider"])
    return counts.select("provider", F.inline(F.array(
        *_sides("stars", F.col("truth"), F.col("label"), F.col("n")))))


def gold_pairs(gold: DataFrame, labels: DataFrame) -> DataFrame:
    return gold.drop("review_score").join(
        labels.select(*REVIEW_KEY, "provider", "sentiment", "topic"), REVIEW_KEY)


def gold_counts(gold: DataFrame, labels: DataFrame) -> DataFrame:
    """All that the gold scores need: one row per source and combination of truth and label."""
    return (gold_pairs(gold, labels)
            .groupBy("provider", "gold_sentiment", "sentiment", "gold_topic", "topic")
            .agg(F.count(F.lit(1)).alias("n")))


def _gold_sides(gold: DataFrame, labels: DataFrame) -> DataFrame:
    n = F.col("n")
    complaints = F.when(F.col("gold_sentiment") == "negative", n).otherwise(F.lit(0).cast("bigint"))
    return gold_counts(gold, labels).select("provider", F.inline(F.array(
        *_sides("sentiment", F.col("gold_sentiment"), F.col("sentiment"), n),
        *_sides("topic", F.col("gold_topic"), F.col("topic"), n),
        *_sides("complaint", F.col("gold_topic"), F.col("topic"), complaints))))


def _wide(scored: DataFrame, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """One row per source with the chosen (task, score) pairs as columns."""
    return scored.groupBy("provider").agg(*[
        F.max(F.when(F.col("task") == task, F.col(score))).alias(name) for name, (task, score) in columns.items()])


STAR_SCORES = {"sentiment_vs_stars_acc": ("stars", "accuracy"), "sentiment_vs_stars_f1": ("stars", "macro_f1")}


def sentiment_vs_stars(labels: DataFrame, reviews: DataFrame) -> DataFrame:
    return _wide(_scored(_star_sides(labels, reviews), ["provider"]), STAR_SCORES)


def gold_scores(gold: DataFrame, labels: DataFrame) -> DataFrame:
    """Sentiment and topic against the human labels; complaint accuracy is null without complaints."""
    return _wide(_scored(_gold_sides(gold, labels), ["provider"]), {
        "gold_n": ("topic", "n"),
        "gold_sentiment_acc": ("sentiment", "accuracy"), "gold_sentiment_macro_f1": ("sentiment", "macro_f1"),
        "gold_topic_acc": ("topic", "accuracy"), "gold_topic_macro_f1": ("topic", "macro_f1"),
        "complaint_topic_acc": ("complaint", "accuracy")})


def summary(labels: DataFrame, reviews: DataFrame, gold: DataFrame) -> DataFrame:
    """One row per label source. The counts of all tasks are stacked and scored together, without joins."""
    zero = F.lit(0).cast("bigint")
    sizes = labels.groupBy("provider").agg(F.count(F.lit(1)).alias("n")).select(
        "provider", F.lit("labelled").alias("task"), F.lit("").alias("name"), zero.alias("tp"),
        zero.alias("missed"), "n")
    stacked = _star_sides(labels, reviews).unionByName(_gold_sides(gold, labels)).unionByName(sizes)
    wide = _wide(_scored(stacked, ["provider"]), {
        "labelled": ("labelled", "n"), **STAR_SCORES, "gold_n": ("topic", "n"),
        "gold_sentiment_acc": ("sentiment", "accuracy"), "gold_topic_acc": ("topic", "accuracy"),
        "gold_topic_macro_f1": ("topic", "macro_f1"), "complaint_topic_acc": ("complaint", "accuracy")})
    return wide.withColumn("gold_n", F.coalesce("gold_n", F.lit(0)))


def _percent(value: Column) -> Column:
    return half_even_tenths(value * F.lit(100.0))


def as_percent(table: DataFrame) -> DataFrame:
    """The summary with its shares as percentages with one decimal."""
    return table.withColumns({c: _percent(F.col(c)) for c in PERCENTS})


def improvement(table: DataFrame, baseline: str = "rules") -> DataFrame:
    """Points by which each source is better than the baseline: the difference of the shown percentages."""
    shown = as_percent(table).unpivot("provider", ACCURACIES, "metric", "pct")
    # One row per source and metric.
    base = F.max(F.when(F.col("provider") == baseline, F.col("pct"))).over(Window.partitionBy("metric"))
    return (shown.withColumn("baseline_pct", base)
            .filter(F.col("provider") != baseline)
            .select("provider", F.lit(baseline).alias("baseline"), "metric", "pct", "baseline_pct",
                    half_even_tenths(F.col("pct") - F.col("baseline_pct")).alias("points")))


def topic_matrix(gold: DataFrame, labels: DataFrame, topics: list[str] = tx.TOPICS) -> DataFrame:
    """Confusion matrix per source: rows are human topics, columns label topics.

    A topic that occurs on neither side has no row; one that occurs only as label has a row of zeros.
    """
    counts = confusion(gold_pairs(gold, labels), "gold_topic", "topic", ["provider"])
    zero = F.lit(0).cast("bigint")
    cells = counts.select("provider", F.inline(F.array(
        F.struct(F.col("truth").alias("gold_topic"), "label", "n"),
        F.struct(F.col("label").alias("gold_topic"), "label", zero.alias("n")))))
    return (cells.filter(F.col("gold_topic").isin(*topics))
            .groupBy("provider", "gold_topic").pivot("label", topics).agg(F.sum("n"))
            .na.fill(0, topics)
            .withColumn("total", sum((F.col(t) for t in topics), F.lit(0).cast("bigint"))))


def disagreements(gold: DataFrame, labels: DataFrame, rows: int | None = 8, width: int | None = 90) -> DataFrame:
    """The first disagreements on the topic per source, in the order of the human labels.

    The row limit per source is applied before the shuffle as well, so no task gets all of a source's rows; without a
    limit (None) one task numbers all disagreements of a source, which human labels bound.
    """
    order = Window.partitionBy("provider").orderBy("gold_no", *REVIEW_KEY)
    message = F.col("comment_message") if width is None else F.substring("comment_message", 1, width)
    return (gold_pairs(gold, labels).filter(F.col("gold_topic") != F.col("topic"))
            .withColumn("place", F.row_number().over(order))
            .filter(F.lit(True) if rows is None else F.col("place") <= rows)
            .select("provider", "place", message.alias("comment_message"),
                    "gold_topic", "topic"))
