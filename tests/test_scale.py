"""Plans and hot keys: what must hold when the data is large and a key holds a large part of it."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from harness import registry
from stallmark.plans import queries as Q

SMALL = "/root/testdata/sf0.001"
LAZY = {name: query for name, query in registry.queries().items() if name not in registry.stores()}


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(LAZY))
def test_no_cross_joins_and_no_row_functions(spark, from_store, name):
    plan = physical(LAZY[name](spark, SMALL))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas"):
        assert bad not in plan, f"{bad} in {name}"


@pytest.mark.parametrize("name", ["q05_category_scorecard", "k03_categories", "q02_monthly_revenue_growth", "k04_category_shares"])
def test_windows_over_everything_come_after_the_grouping(spark, from_store, name):
    plan = physical(LAZY[name](spark, SMALL)).split("\n")
    single = [i for i, line in enumerate(plan) if "SinglePartition" in line]
    below = [next((line for line in plan[i + 1:] if "Aggregate" in line), "") for i in single]
    assert all(below), "an unpartitioned step without an aggregation below it"


def test_a_scan_reads_only_its_columns(spark):
    plan = LAZY["q03_late_delivery_vs_rating"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_comment" not in plan
    physical_plan = physical(LAZY["q11_worst_states"](spark, SMALL))
    assert "l_extendedprice" not in physical_plan and "PushedFilters" in physical_plan


@pytest.fixture
def hot(spark):
    """60,000 items: a third in one order, another third of one product; the hot order has 1,000 reviews."""
    n = 60_000
    ids = spark.range(n)
    in_order, of_product = F.col("id") % 3 == 0, F.col("id") % 3 == 1
    items = ids.select(
        F.when(in_order, "o0").otherwise(F.concat(F.lit("o"), F.col("id"))).alias("order_id"),
        F.lit(1).alias("order_item_id"),
        F.when(of_product, "p0").otherwise(F.concat(F.lit("p"), F.col("id") % 500)).alias("product_id"),
        F.lit("s0").alias("seller_id"), F.lit(Decimal("2.50")).cast("decimal(18,2)").alias("price"))
    orders = ids.select(
        F.concat(F.lit("o"), F.col("id")).alias("order_id"), F.concat(F.lit("c"), F.col("id")).alias("customer_id"),
        F.lit("delivered").alias("order_status"), F.lit(1).alias("is_late"), F.lit(1.0).alias("days_late"),
        F.lit(2.0).alias("delivery_days"), F.lit(date(2018, 1, 1)).alias("purchase_date"),
        F.timestamp_seconds(F.col("id")).alias("purchase_ts"))
    reviews = spark.range(1000).select(
        F.concat(F.lit("r"), F.col("id")).alias("review_id"), F.lit("o0").alias("order_id"), F.lit(2).alias("review_score"))
    tables = {
        "fact_order_items": items, "fact_orders": orders, "fact_reviews": reviews,
        "dim_product": spark.range(500).select(F.concat(F.lit("p"), F.col("id")).alias("product_id"), F.lit("all").alias("category")),
        "dim_seller": spark.createDataFrame([("s0", "x", "SP")], "seller_id string, city string, state string"),
        "dim_customer": ids.select(
            F.concat(F.lit("c"), F.col("id")).alias("customer_id"),
            F.when(F.col("id") % 3 == 0, "u0").otherwise(F.concat(F.lit("u"), F.col("id"))).alias("customer_unique_id"),
            F.lit("SP").alias("state")),
    }
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield tables
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_hot_order_and_product_are_exact_without_multiplied_rows(hot):
    """As joined rows this would be 20 million for the hot order alone."""
    result = Q.category_scorecard(hot, min_orders=1)
    row = result.first()
    hot_rows, others = 20_000 * 1000, 40_000
    assert (row["orders"], row["revenue"], row["avg_score"], row["late_pct"]) == (
        40_001, 2.5 * (hot_rows + others), 2.0, 100.0)


def test_hot_product_is_split_at_run_time(hot):
    df = Q.category_rows(hot, 1)
    df.collect()
    assert "skew=true" in physical(df)


def test_hot_seller_and_hot_person(hot):
    assert Q.sellers_with_problems(hot, min_orders=1).first()["orders"] == 1  # only the hot order has reviews
    repeat = Q.repeat_purchase_after_bad_review(hot).first()
    assert (repeat["first_order_rating"], repeat["customers"], repeat["repeat_rate_pct"]) == ("1-2 stars", 1000, 100.0)


def test_grouping_a_hot_key_is_combined_before_the_shuffle(hot):
    from stallmark.operators import star
    copies = hot["fact_reviews"].withColumn("review_id", F.lit("r")).withColumns({
        "review_comment_title": F.lit("t"), "review_comment_message": F.lit("m"), "review_creation_date": F.lit("2018-01-01")})
    unique = star.dedup_reviews(copies)
    plan = physical(unique)
    assert "Window" not in plan and "partial_min" in plan
    assert unique.count() == 1
