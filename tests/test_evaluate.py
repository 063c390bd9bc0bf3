from __future__ import annotations

import pytest

from stallmark import taxonomy as tx
from stallmark.operators import evaluate as ev
from tests import fixtures as fx

# Two published confusion matrices, rows human topic, columns label topic, in taxonomy order.
MODEL = [
    [7, 0, 0, 1, 0, 1, 0, 0], [5, 13, 0, 0, 0, 1, 0, 1], [0, 1, 19, 0, 1, 1, 0, 0], [0, 0, 0, 8, 0, 0, 0, 0],
    [0, 0, 1, 2, 11, 1, 0, 0], [0, 1, 0, 0, 0, 3, 0, 0], [6, 0, 0, 0, 7, 6, 30, 9], [2, 1, 2, 3, 0, 3, 0, 3],
]
RULES = [
    [5, 0, 0, 0, 1, 1, 0, 2], [0, 16, 0, 0, 0, 2, 0, 2], [1, 4, 10, 0, 1, 2, 0, 4], [0, 0, 0, 4, 0, 0, 0, 4],
    [0, 0, 0, 0, 4, 0, 1, 10], [0, 0, 0, 0, 0, 2, 0, 2], [1, 0, 0, 1, 0, 4, 33, 19], [0, 2, 0, 0, 1, 0, 2, 9],
]


@pytest.fixture(scope="module")
def judged(spark):
    """Human and source labels that expand the two matrices."""
    gold, labels = [], []
    for provider, matrix in (("ollama", MODEL), ("rules", RULES)):
        no = 0
        for i, row in enumerate(matrix):
            for j, n in enumerate(row):
                for _ in range(n):
                    key = f"{provider}{no}"
                    gold.append((key, key, 1, "t" * 100, "negative" if i % 2 else "positive", tx.TOPICS[i], no))
                    labels.append((key, key, "negative", tx.TOPICS[j], "low", "", provider))
                    no += 1
    return (spark.createDataFrame(gold, "review_id string, order_id string, review_score int, comment_message string, "
                                        "gold_sentiment string, gold_topic string, gold_no bigint"),
            spark.createDataFrame(labels, "review_id string, order_id string, sentiment string, topic string, "
                                          "urgency string, summary_en string, provider string"))


def test_published_scores(judged):
    got = {r[0]: r[1:] for r in fx.rows(ev.gold_scores(*judged), "provider", "gold_n", "gold_topic_acc", "gold_topic_macro_f1")}
    assert got["ollama"] == (150, 94 / 150, pytest.approx(0.580873645173848, abs=1e-15))
    assert got["rules"] == (150, 83 / 150, pytest.approx(0.5290559174867686, abs=1e-15))


def test_published_matrix(judged):
    got = {(r[0], r[1]): list(r[2:]) for r in fx.rows(ev.topic_matrix(*judged), "provider", "gold_topic", *tx.TOPICS)}
    assert got == {(p, t): row for p, m in (("ollama", MODEL), ("rules", RULES)) for t, row in zip(tx.TOPICS, m)}


def test_disagreements_keep_the_order_and_the_width(judged):
    got = fx.rows(ev.disagreements(*judged), "provider", "place", "comment_message", "gold_topic", "topic")
    mine = sorted(r[1:] for r in got if r[0] == "ollama")
    assert len(got) == 16 and [r[0] for r in mine] == list(range(1, 9))
    assert mine[0] == (1, "t" * 90, "late_delivery", "damaged_or_defective")


def test_disagreements_are_limited_before_the_shuffle(judged):
    plan = ev.disagreements(*judged)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def _counts(spark, *rows):
    return spark.createDataFrame(list(rows), "truth string, label string, n bigint")


def test_labels_on_one_side_count_as_zero(spark):
    got = ev.scores(_counts(spark, ("a", "a", 2), ("b", "c", 2)), []).first()
    assert (got["accuracy"], got["macro_f1"]) == (0.5, pytest.approx(1 / 3))


def test_no_complaints_give_null(spark):
    gold = spark.createDataFrame([("r", "o", 1, "t", "positive", "praise", 0)],
                                 "review_id string, order_id string, review_score int, comment_message string, "
                                 "gold_sentiment string, gold_topic string, gold_no int")
    labels = fx.labels(spark, ("r", "o", "positive", "praise", "low"), ("s", "o", "neutral", "other", "low"))
    reviews = spark.createDataFrame([("r", "o", 5), ("s", "o", 3)], "review_id string, order_id string, review_score int")
    got = ev.summary(labels, reviews, gold).first().asDict()
    assert got == {"provider": "rules", "labelled": 2, "sentiment_vs_stars_acc": 1.0, "sentiment_vs_stars_f1": 1.0,
                   "gold_n": 1, "gold_sentiment_acc": 1.0, "gold_topic_acc": 1.0, "gold_topic_macro_f1": 1.0,
                   "complaint_topic_acc": None}


def test_improvement_is_the_difference_of_shown_percentages(spark):
    shares = [("ollama", 0.7631456491391345, 0.6328, 0.8466666666666667, 0.6266666666666667, 0.5809, 0.7333333333333333),
              ("rules", 0.6216533466533467, 0.54, 0.6533333333333333, 0.5533333333333333, 0.5291, 0.5466666666666666)]
    table = spark.createDataFrame(shares, ["provider", *ev.PERCENTS])
    got = dict(fx.rows(ev.improvement(table), "metric", "points"))
    assert got == {"sentiment_vs_stars_acc": 14.1, "gold_sentiment_acc": 19.4, "gold_topic_acc": 7.4,
                   "complaint_topic_acc": 18.6}
