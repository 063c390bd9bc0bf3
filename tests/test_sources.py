from __future__ import annotations

import csv
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from stallmark.operators.picking import with_text
from stallmark.operators.star import build_star
from stallmark.plans import measures as M
from stallmark.plans import queries as Q
from stallmark.plans.catalog import CATALOG, run_catalog
from stallmark.schemas import RAW_SCHEMAS, STAR_TABLES
from stallmark.sources import label_store, raw, store
from harness.derived import derive_star
from stallmark.streaming.incremental import label_stream
from tests import fixtures as fx

SMALL = "/root/testdata/sf0.001"

FILES = {
    "shop_orders_dataset.csv": "order_id,customer_id,order_status,order_purchase_timestamp,order_approved_at,"
                               "order_delivered_customer_date,order_estimated_delivery_date\n"
                               "o1,c1,delivered,2018-01-01 10:00:00,x,2018-01-02 10:00:00,2018-01-09 00:00:00\n"
                               "o2,c2,shipped,not a date,x,,2018-01-09 00:00:00\n",
    "shop_order_items_dataset.csv": "order_id,order_item_id,product_id,seller_id,shipping_limit_date,price,freight_value\n"
                                    "o1,1,p1,s1,x,10.50,1.25\n",
    "shop_order_payments_dataset.csv": "order_id,payment_sequential,payment_type,payment_installments,payment_value\no1,1,card,2,11.75\n",
    "shop_order_reviews_dataset.csv": 'review_id,order_id,review_score,review_comment_title,review_comment_message,'
                                      'review_creation_date,review_answer_timestamp\n'
                                      'r1,o1,5,,"bom, ""muito"" bom\nmesmo ",2018-01-03 00:00:00,x\n',
    "shop_customers_dataset.csv": "customer_id,customer_unique_id,customer_zip_code_prefix,customer_city,customer_state\n"
                                  "c1,u1,01,x,SP\nc2,u2,02,y,RJ\n",
    "shop_products_dataset.csv": "product_id,product_category_name,product_name_lenght,product_photos_qty,product_weight_g\np1,casa,1,3,250\n",
    "shop_sellers_dataset.csv": "seller_id,seller_zip_code_prefix,seller_city,seller_state\ns1,01,x,SP\n",
    "product_category_name_translation.csv": "product_category_name,product_category_name_english\ncasa,home\n",
}


@pytest.fixture(scope="module")
def from_files(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("raw")
    for name, text in FILES.items():
        (folder / name).write_text(text, encoding="utf-8")
    return raw.read_raw(spark, str(folder))


def test_raw_files(from_files):
    assert {n: df.columns for n, df in from_files.items()} == {n: s.fieldNames() for n, s in RAW_SCHEMAS.items()}
    tables = build_star(from_files)
    assert fx.rows(tables["fact_reviews"], "comment_message") == [('bom, "muito" bom\nmesmo',)]
    assert sorted(fx.rows(tables["fact_orders"], "order_id", "purchase_ts", "order_value")) == [
        ("o1", fx.ts("2018-01-01 10:00:00"), Decimal("10.50")), ("o2", None, None)]
    assert fx.rows(tables["dim_product"]) == [("p1", "home", 250.0, 3)]


def test_gold_file_keeps_its_order(spark, tmp_path):
    path = tmp_path / "gold.csv"
    path.write_text('review_id,order_id,review_score,comment_message,gold_sentiment,gold_topic\n'
                    'b,o1,1,"two\nlines",negative,other\na,o2,5,one,positive,praise\n', encoding="utf-8")
    got = raw.read_gold(spark, str(path)).orderBy("gold_no")
    assert fx.rows(got, "review_id", "comment_message", "review_score") == [("b", "two\nlines", 1), ("a", "one", 5)]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("star"))
    counts = dict(fx.rows(store.write_star(derive_star(spark, SMALL), path)))
    return path, counts, store.read_star(spark, path, STAR_TABLES)


def test_star_is_written_anew_with_counts(spark, stored):
    path, counts, tables = stored
    assert set(counts) == set(STAR_TABLES) and counts["fact_orders"] == 1500
    again = dict(fx.rows(store.write_star({"dim_seller": fx.star(spark, sellers=[("s", "x", "SP")])["dim_seller"]}, path + "/sub")))
    assert again == {"dim_seller": 1}


def test_month_filter_prunes_stored_orders(stored):
    from stallmark.plans import queries as Q
    plan = Q.monthly_revenue(stored[2], "1996-01", "1996-03")._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "year_month" in filters and "1996-03" in filters


def test_export(spark, stored, tmp_path):
    counts = dict(fx.rows(store.export_csv(stored[2], str(tmp_path))))
    assert counts == stored[1]
    lines = [row for part in (Path(tmp_path) / "fact_reviews").glob("*.csv")
             for row in csv.DictReader(part.open(encoding="utf-8", newline=""))]
    assert len(lines) == counts["fact_reviews"] and max(len(r["comment_message"]) for r in lines) == 300
    assert "comment_title" not in lines[0]
    orders = spark.read.option("header", True).csv(f"{tmp_path}/fact_orders")
    assert "year_month" not in orders.columns
    assert orders.filter(r"purchase_ts rlike '^\\d{4}-\\d\\d-\\d\\d \\d\\d:\\d\\d:\\d\\d$'").count() == 1500


def test_catalogue_skips_label_queries_without_labels(spark, stored, tmp_path):
    tables = dict(stored[2])
    small = {"q02_monthly_revenue_growth": {"first_month": "1996-01", "last_month": "1996-12"},
             "q05_category_scorecard": {"min_orders": 1}}
    assert run_catalog(tables, str(tmp_path / "a"), **small) == list(CATALOG)
    assert spark.read.option("header", True).csv(f"{tmp_path}/a/q05_category_scorecard").count() == 15
    tables["review_ai_labels"] = tables["review_ai_labels"].filter("false")
    assert len(run_catalog(tables, str(tmp_path / "b"), **small)) == len(CATALOG) - 2


def test_label_store_appends_once_per_key(spark, tmp_path):
    path = str(tmp_path / "labels")
    assert label_store.load_labels(spark, path).count() == 0
    first = fx.labels(spark, ("r", "o", "negative", "other", "low"), ("r", "o", "negative", "other", "low"))
    label_store.append_labels(first, path)
    label_store.append_labels(first, path)
    more = fx.labels(spark, ("r", "o", "positive", "praise", "low"), ("r", "o2", "neutral", "other", "low"))
    label_store.append_labels(more, path, label_store.touched_months(more))
    got = sorted(fx.rows(label_store.load_labels(spark, path, "rules"), "order_id", "sentiment"))
    assert got == [("o", "negative"), ("o2", "neutral")]
    label_store.replace_labels(more, path + "2")
    assert label_store.load_labels(spark, path + "2").count() == 2


def test_best_source(spark):
    labels = fx.labels(spark, ("r", "o", "negative", "other", "low"))
    both = labels.unionByName(labels.withColumn("provider", F.lit("gemini"))).unionByName(
        labels.withColumn("provider", F.lit("somebody")))
    assert fx.rows(label_store.best_labels(both), "provider") == [("gemini",)]
    assert fx.rows(label_store.best_labels(both, ["rules", "gemini"]), "provider") == [("rules",)]


def _month_filters(df) -> dict[str, str]:
    """Partition filters of the scans of the facts, by folder."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    out = {}
    for scan in plan.split("FileScan parquet ")[1:]:
        for name in ("fact_orders", "fact_order_items", "fact_reviews"):
            if f"/{name}]" in scan.split("PartitionFilters")[0] or f"/{name}," in scan.split("PartitionFilters")[0]:
                out[name] = scan.split("PartitionFilters: [")[1].split("]")[0]
    return out


@pytest.mark.parametrize("plan, facts", [
    (lambda t: Q.monthly_orders(t, 1998), ["fact_orders"]),
    (lambda t: Q.top_categories_in_year(t, 1998), ["fact_orders", "fact_order_items"]),
    (lambda t: M.measures(t, ["category"], {"year": 1998}), ["fact_orders", "fact_order_items", "fact_reviews"]),
    (lambda t: M.measures(t, ["year"], {"year_month": ["1998-03", "1998-05"]}), ["fact_orders", "fact_reviews"]),
    (lambda t: M.measures(t, ["category", "is_late"], {"year": [1998]}, "cube"), ["fact_orders", "fact_order_items", "fact_reviews"]),
    (lambda t: M.revenue_over_time(t, ["category"], {"year": 1998}), ["fact_orders", "fact_order_items"]),
    (lambda t: M.label_measures(t, ["topic"], {"year": 1998}), ["fact_orders"]),
])
def test_periods_reach_the_scans(stored_star, plan, facts):
    found = _month_filters(plan(stored_star))
    for name in facts:
        assert "month" in found.get(name, "") and ("1998" in found[name] or "1997" in found[name]), (name, found)


def test_the_cube_reads_each_table_once(stored_star):
    plan = M.measures(stored_star, ["category", "lateness_bucket"], totals="cube")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 6


def _dated(spark, *rows):
    return fx.labels(spark, *[r[:5] for r in rows]).join(
        spark.createDataFrame([(r[1], r[5]) for r in rows], "order_id string, day string"), "order_id").select(
        "*", F.to_date("day").alias("review_date")).drop("day")


def test_a_batch_reads_and_writes_its_own_months_only(spark, tmp_path):
    path = str(tmp_path / "labels")
    january = _dated(spark, *[(f"r{i}", f"o{i}", "negative", "other", "low", "2018-01-05") for i in range(50)])
    march = _dated(spark, *[(f"r{i}", f"o{i}", "neutral", "other", "low", "2018-03-05") for i in range(50, 90)])
    label_store.append_labels(january, path)
    label_store.append_labels(march.unionByName(january.limit(5)), path)
    label_store.append_labels(march, path)
    assert label_store.load_labels(spark, path).count() == 90
    parts = sorted(p.relative_to(path).as_posix() for p in (tmp_path / "labels").glob("*/*") if p.is_dir())
    assert parts == ["provider=rules/month=2018-01", "provider=rules/month=2018-03"]
    assert len(list((tmp_path / "labels").glob("*/*/*.parquet"))) <= 3
    plan = label_store.not_stored(march, path)._jdf.queryExecution().executedPlan().toString()
    filters = [f.split("]")[0] for f in plan.split("PartitionFilters: [")[1:]]
    assert any("2018-03" in f and "month" in f for f in filters)


def test_crowded_parts_are_compacted(spark, tmp_path):
    path = str(tmp_path / "labels")
    for i in range(6):
        label_store.append_labels(_dated(spark, (f"r{i}", f"o{i}", "negative", "other", "low", "2018-01-05")), path)
    label_store.append_labels(_dated(spark, ("x", "x", "negative", "other", "low", "2018-02-05")), path)
    before = sorted(map(tuple, label_store.load_labels(spark, path).collect()))
    assert label_store.compact(spark, path, files=5) == [("rules", "2018-01")]
    assert len(list((tmp_path / "labels").glob("*/month=2018-01/*.parquet"))) == 1
    assert sorted(map(tuple, label_store.load_labels(spark, path).collect())) == before
    assert label_store.compact(spark, path, files=5) == []


def test_incremental_labels(spark, tmp_path):
    source, path, point = (str(tmp_path / n) for n in ("in", "store", "point"))
    reviews = derive_star(spark, SMALL)["fact_reviews"].select("review_id", "order_id", "comment_message")
    expected = with_text(reviews).count()

    def run(checkpoint=point):
        label_stream(spark, source, path, checkpoint, files_per_batch=2).awaitTermination()
        return label_store.load_labels(spark, path)

    reviews.filter("order_id < 'o5'").repartition(3).write.parquet(source)
    part = run().count()
    assert 0 < part < expected
    assert run().count() == part
    reviews.filter("order_id >= 'o4'").repartition(2).write.mode("append").parquet(source)
    everything = run()
    assert everything.count() == expected == everything.select("review_id", "order_id").distinct().count()
    assert run(point + "-lost").count() == expected
