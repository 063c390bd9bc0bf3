"""What is read several times is derived once."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from harness import derived, registry
from stallmark.operators import replies
from stallmark.plans import stored_measures
from stallmark.sources import label_store
from tests.conftest import SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _texts(spark, numbers):
    return spark.createDataFrame([(f"r{n}", f"o{n}", f"texto {n}") for n in numbers],
                                 "review_id string, order_id string, comment_message string")


@pytest.mark.parametrize("numbers", [range(60), [*range(30), *[7] * 30]], ids=["unique", "repeated"])
def test_a_wave_does_not_read_the_labels_before_it(spark, tmp_path, monkeypatch, numbers):
    looked = []
    not_stored = label_store.not_stored
    monkeypatch.setattr(label_store, "not_stored", lambda *a: looked.append(a) or not_stored(*a))
    path = str(tmp_path / "s")
    replies.label_into(_texts(spark, numbers), registry.second_labeller, "x", path, size=5, per_wave=3)
    stored = [tuple(r) for r in label_store.load_labels(spark, path).select("review_id", "order_id").collect()]
    assert sorted(stored) == sorted((f"r{n}", f"o{n}") for n in set(numbers))
    if len(set(numbers)) == len(numbers):
        assert len(looked) == 1


def test_a_wave_is_numbered_and_kept_once(spark, tmp_path, monkeypatch):
    """Four results of a wave are kept, its replies and what they say, and nothing is numbered or counted in it."""
    kept, numbered = [], []
    keep, number = replies.keep, replies.number_rows
    monkeypatch.setattr(replies, "keep", lambda df, *a: kept.append(df.columns) or keep(df, *a))
    monkeypatch.setattr(replies, "number_rows", lambda *a: numbered.append(a) or number(*a))
    path = str(tmp_path / "s")
    assert replies.label_into(_texts(spark, range(95)), registry.second_labeller, "x", path, per_wave=4) == {
        "calls": 19, "failed": 0, "labels": 95}
    assert len(numbered) == 1 and len(kept) == 3 + 3 * 4
    assert label_store.load_labels(spark, path).select("review_id").distinct().count() == 95


def test_a_review_without_a_whole_key_is_asked_for_and_not_stored(spark, tmp_path):
    texts = spark.createDataFrame([("r1", None, "a"), (None, "o1", "b"), ("r2", "o2", "c")], "review_id string, order_id string, comment_message string")
    path = str(tmp_path / "s")
    assert replies.label_into(texts, registry.second_labeller, "x", path) == {"calls": 1, "failed": 0, "labels": 1}
    assert [r[0] for r in label_store.load_labels(spark, path).select("order_id").collect()] == ["o2"]


@pytest.mark.parametrize("name", ["v04_summary", "v07_improvement", "s06_best_labels"])
def test_texts_are_not_searched_again_for_scores(spark, name):
    plan = _plan(registry.queries()[name](spark, SMALL))
    assert "lineitem" not in plan and "hashed" not in plan and "comment_message" not in plan


def test_buyers_are_kept_in_short_words(spark, stored_star, tmp_path):
    path = str(tmp_path / "m")
    stored_measures.store_measures(stored_star, path, ["state"])
    buyers = spark.read.parquet(f"{path}/buyers")
    assert buyers.schema["bits"].dataType.typeName() == "long"
    people = spark.read.parquet(f"{path}/people").agg(F.max("person")).first()[0]
    assert people > 64 and buyers.agg(F.max("word")).first()[0] <= people // 64
    delivered = stored_star["fact_orders"].filter("order_status = 'delivered'").join(stored_star["dim_customer"], "customer_id")
    want = delivered.agg(F.count_distinct("customer_unique_id")).first()[0]
    assert stored_measures.stored_measures(spark, path).first()["customers"] == want


def test_tables_of_the_catalogue_are_derived_once(spark):
    tables = derived.kept_star(spark, SMALL)
    assert not [name for name, df in tables.items() if "lineitem" in _plan(df) or "orders.parquet" in _plan(df)]


@pytest.mark.parametrize("name", ["r07_pick_reviews", "r08_todo", "r09_pack_prompts", "r10_parse_replies", "r12_retry_set"])
def test_reviews_are_derived_once(spark, name):
    assert "o_orderkey" not in _plan(registry.queries()[name](spark, SMALL))


def test_prompts_are_packed_where_they_are_asked(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(replies, "keep", lambda df: plans.append(_plan(df)) or derived.keep(df))
    replies.label_with(_texts(spark, range(40)), registry.stand_in_labeller, "x", parallelism=3)
    asked = [p for p in plans if "MapInPandas" in p]
    assert len(asked) == 2 and all(p.count("Exchange hashpartitioning(batch") == 1 for p in asked)


def test_replies_are_parsed_once_for_each_form(spark):
    said = spark.createDataFrame([(1, 2, '{"results": null}'), (2, 2, '[{"id": "r1"}, {"id": "r0"}]'), (3, 1, '{"id": "r0"}'), (4, 1, '"x"'),
                                  (5, 1, "x {} y"), (6, 1, "none"), (7, 2, '{"results": {"id": "r1"}}'), (8, 1, "[] []")],
                                 "batch long, n int, reply string")
    read = replies.read_replies(said)
    assert {r.batch: r.n_items for r in read.selectExpr("batch", "array_size(items) as n_items").collect()} == {
        1: 0, 2: 2, 3: 1, 4: 0, 5: 1, 6: None, 7: 1, 8: None}
    assert read._jdf.queryExecution().optimizedPlan().toString().lower().count("parsejson") == 2
