from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from harness import derived
from stallmark.operators import evaluate as ev
from stallmark.plans import stored_evaluation as se
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def given(spark):
    reviews = derived.derive_star(spark, SMALL, labels=False)["fact_reviews"]
    labels = derived.derive_labels(reviews).cache()
    # Labels of reviews that are gone count as labelled only.
    alone = labels.limit(3).withColumn("review_id", F.concat(F.lit("gone"), "review_id"))
    return labels.unionByName(alone).cache(), reviews.cache(), derived.derive_gold(spark, SMALL, reviews).cache()


def _part(df, i, n):
    return df.filter(F.pmod(F.xxhash64("review_id", "order_id"), F.lit(n)) == i)


def _rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


def test_deliveries_add_up_to_the_whole(spark, given, tmp_path):
    labels, reviews, gold = given
    path, old, new = str(tmp_path / "counts"), _part(gold, 0, 2), _part(gold, 1, 2)
    se.add_labels(_part(labels, 0, 3), reviews, old, path, "first")
    se.add_labels(_part(labels, 1, 3), reviews, old, path, "second")
    se.add_labels(_part(labels, 1, 3), reviews, old, path, "second")
    se.add_gold(new, _part(labels, 0, 3).unionByName(_part(labels, 1, 3)), reviews, path, "human")
    so_far = _part(labels, 0, 3).unionByName(_part(labels, 1, 3))
    assert _rows(se.summary_of(se.read_counts(spark, path))) == _rows(ev.summary(so_far, reviews, gold))
    se.add_labels(_part(labels, 2, 3), reviews, gold, path, "third")
    counts = se.read_counts(spark, path)
    assert _rows(se.summary_of(counts)) == _rows(ev.summary(labels, reviews, gold))
    assert _rows(se.topic_matrix_of(counts)) == _rows(ev.topic_matrix(gold, labels))
    plan = se.summary_of(counts)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan


def test_months_are_those_of_the_reviews(spark, given, tmp_path):
    labels, reviews, gold = given
    path = str(tmp_path / "counts")
    se.add_labels(labels, reviews, gold, path, "all")
    monthly = {(r.provider, r.month): r for r in se.summary_of(se.read_counts(spark, path), by_month=True).collect()}
    month = sorted(m for _, m in monthly if m != se.UNDATED)[0]
    own = reviews.filter(F.date_format("review_date", "yyyy-MM") == month)
    keys = own.select("review_id", "order_id")
    want = ev.summary(labels.join(keys, ["review_id", "order_id"], "left_semi"), own, gold.join(keys, ["review_id", "order_id"], "left_semi"))
    got = se.summary_of(se.read_counts(spark, path, [month]))
    assert _rows(got) == _rows(want)
    assert {p: monthly[p, month].labelled for p in {p for p, m in monthly if m == month}} == {r.provider: r.labelled for r in want.collect()}
    assert sum(r.labelled for (_, m), r in monthly.items() if m == se.UNDATED) >= 3
    assert se.summary_of(se.read_counts(spark, path, [])).collect() == []
