"""Stored measures against those computed from the orders."""

from __future__ import annotations

import glob
import math

import pytest
from pyspark.sql import functions as F

from stallmark.operators.durable import keep
from stallmark.plans import measures as M
from stallmark.plans import stored_measures as S

BY = ["category", "seller_id", "lateness_bucket", "state"]


def rounded(df):
    def plain(v):
        return None if v is None else float(f"{v:.9g}") if isinstance(v, float) and math.isfinite(v) else v
    return sorted((tuple(map(plain, r)) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def store(spark, stored_star, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("measures"))
    S.store_measures(stored_star, path, BY)
    return path


@pytest.mark.parametrize("arguments", [
    {}, {"by": ["year_month"]}, {"by": ["category"]}, {"by": ["seller_id", "year"]}, {"by": ["category", "seller_id"]},
    {"by": ["lateness_bucket", "category"], "totals": "cube"}, {"by": ["year", "quarter"], "totals": "rollup"},
    {"by": ["state"], "filters": {"year": 1995, "category": "category_3"}}, {"filters": {"quarter": [1, 2], "seller_id": "s1"}},
    {"by": ["category"], "filters": {"category": ["category_1", "category_2"], "state": ["NATION_1", "NATION_2"]}},
    {"by": ["category"], "filters": {"year_month": ["1995-03", "1996-01"]}, "totals": "rollup"}, {"filters": {"year": 1800}},
], ids=str)
def test_same_as_from_the_orders(spark, stored_star, store, arguments):
    got, want = S.stored_measures(spark, store, **arguments), M.measures(stored_star, **arguments)
    assert got.columns == want.columns
    assert rounded(got) == rounded(want)


def test_orders_are_not_read(spark, store):
    plan = S.stored_measures(spark, store, ["category"])._jdf.queryExecution().executedPlan().toString()
    assert "fact_orders" not in plan and "PythonUDF" not in plan
    pruned = S.stored_measures(spark, store, ["category"], {"year_month": "1995-03"})._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year_month" in pruned


def test_orders_are_joined_once_for_both_tables(spark, stored_star, tmp_path, monkeypatch):
    """Rows are kept before they are grouped, with numbers for customers; choices and orders meet without another shuffle."""
    kept = []
    monkeypatch.setattr(S, "keep", lambda df: kept.append(df) or keep(df), raising=False)
    S.store_measures(stored_star, str(tmp_path / "m"), ["category", "state"])
    assert len(kept) == 1 and dict(kept[0].dtypes)["customer_unique_id"] == "bigint"
    plan = kept[0]._jdf.queryExecution().executedPlan().toString()
    assert "choice" in plan and "Exchange hashpartitioning(order_id" in plan
    assert not [line for line in plan.split("\n") if "Exchange hashpartitioning(" in line and "choice" in line]


def test_what_cannot_be_merged_is_refused(spark, store):
    with pytest.raises(ValueError, match="not stored: payment_type"):
        S.stored_measures(spark, store, ["payment_type"])
    with pytest.raises(ValueError, match="one value at a time: category"):
        S.stored_measures(spark, store, ["state"], {"category": ["category_1", "category_2"]})


def test_months_made_anew(spark, stored_star, tmp_path):
    """Orders come late and change; only their months are written."""
    path, orders = str(tmp_path / "m"), stored_star["fact_orders"]
    month = F.col("year_month").cast("string")
    late = sorted(r[0] for r in orders.select(month).distinct().collect() if r[0])[3::20][:2]
    only = orders.filter(month.isin(*late)).select("customer_id").subtract(orders.filter(~month.isin(*late)).select("customer_id"))
    people = stored_star["dim_customer"].join(only.withColumn("new", F.lit("new ")), "customer_id", "left").withColumn(
        "customer_unique_id", F.concat(F.coalesce("new", F.lit("")), "customer_unique_id")).drop("new")
    tables = {**stored_star, "dim_customer": people}
    some = orders.filter(~month.isin(*late) | (F.crc32("order_id") % 3 == 0))
    S.store_measures({**tables, "fact_orders": some}, path, ["category", "state"])
    before = {f for f in glob.glob(f"{path}/*/year_month=*/*.parquet")}
    numbers = {r.customer_unique_id: r.person for r in spark.read.parquet(f"{path}/people").collect()}
    changed = orders.withColumn("order_status", F.when(month == late[0], "delivered").otherwise(F.col("order_status")))
    S.refresh_months({**tables, "fact_orders": changed}, path, late)
    after = {f for f in glob.glob(f"{path}/*/year_month=*/*.parquet")}
    assert {f.split("year_month=")[1][:7] for f in before ^ after} == set(late)
    for arguments in ({}, {"by": ["category"], "totals": "rollup"}, {"by": ["year_month", "state"]}):
        assert rounded(S.stored_measures(spark, path, **arguments)) == rounded(M.measures({**tables, "fact_orders": changed}, **arguments))
    now = [(r.customer_unique_id, r.person) for r in spark.read.parquet(f"{path}/people").collect()]
    assert len(now) > len(numbers) and sorted(p for _, p in now) == list(range(len(now)))
    assert numbers.items() <= dict(now).items()
