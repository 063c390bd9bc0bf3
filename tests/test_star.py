from __future__ import annotations

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from stallmark.functions.numbers import half_even_tenths, round_money, round_ratio
from stallmark.functions.time import parse_ts
from stallmark.operators import quality, star
from tests import fixtures as fx


def test_rounding_of_queries_is_half_up_and_of_durations_half_even(spark):
    row = spark.range(1).select(
        half_even_tenths(F.lit(21600) / 86400).alias("even"),
        half_even_tenths(F.lit(30240) / 86400).alias("odd"),
        round_ratio(F.lit(1005), F.lit(1000), 2).alias("up"),
        round_ratio(F.lit(-5), F.lit(2), 0).alias("negative"),
        round_ratio(F.lit(1), F.lit(0), 2).alias("none"),
        round_money(F.lit(Decimal("2.50"))).alias("money")).first()
    assert tuple(row) == (0.2, 0.4, 1.01, -3.0, None, 3.0)


def test_timestamps_that_cannot_be_read_are_null(spark):
    df = spark.createDataFrame([("2018-01-02 03:04:05",), ("soon",), (None,)], "t string")
    got = fx.rows(df.select(parse_ts(F.col("t"))))
    assert got == [(fx.ts("2018-01-02 03:04:05"),), (None,), (None,)]


@pytest.fixture(scope="module")
def tables(spark):
    return fx.star(
        spark,
        orders=[
            fx.order(1, arrived="2018-01-10 01:00:00"),
            fx.order(2, arrived="2018-01-03 00:00:00"),
            fx.order(3, arrived="2018-01-05 00:00:00", promised=None),
            fx.order(4, arrived=None, status="shipped"),
        ],
        items=[fx.item(1), fx.item(1, 2, "5.25"), fx.item(2)],
        payments=[("o1", "voucher", 2, "7.00"), ("o1", "boleto", 1, "7.00"), ("o1", "card", 9, "1.25"),
                  ("o2", "card", 1, None), ("o2", "boleto", 3, "0.01")],
        reviews=[fx.review(1, 5, text="\n ok\t"), fx.review(1, 5, text="\n ok\t"), fx.review(2, 1, text=" \n ", title=" ")],
        products=[("p1", "casa", 1.0, 1), ("p2", "livros", 2.0, 2), ("p3", None, None, None)],
        translation=[("casa", "home")])


def test_lateness_compares_times_and_days_are_rounded_apart(tables):
    got = {r[0]: r[1:] for r in fx.rows(tables["fact_orders"], "order_id", "is_late", "days_late", "delivery_days")}
    assert got == {"o1": (1, 0.0, 9.0), "o2": (0, -7.0, 2.0), "o3": (0, None, 4.0), "o4": (None, None, None)}


def test_order_without_items_has_no_value(tables):
    got = dict(fx.rows(tables["fact_orders"], "order_id", "order_value"))
    assert got == {"o1": Decimal("15.25"), "o2": Decimal("10.00"), "o3": None, "o4": None}


def test_main_payment_is_the_largest_with_fixed_ties(tables):
    got = {r[0]: r[1:] for r in fx.rows(tables["fact_orders"], "order_id", "payment_type", "installments")}
    assert got["o1"] == ("boleto", 1) and got["o2"] == ("boleto", 3) and got["o3"] == (None, None)


def test_reviews_are_unique_and_clean(tables):
    got = sorted(fx.rows(tables["fact_reviews"], "review_id", "comment_title", "comment_message", "review_date"))
    assert got == [("r1-5", None, "ok", date(2018, 1, 6)), ("r2-1", None, None, date(2018, 1, 6))]


def test_category_falls_back(tables):
    assert dict(fx.rows(tables["dim_product"], "product_id", "category")) == {
        "p1": "home", "p2": "livros", "p3": "unknown"}


def test_calendar_has_no_gaps(spark):
    raw = fx.raw(spark, orders=[fx.order(1, bought="2018-02-27 23:59:59"), fx.order(2, bought="2018-03-02 00:00:00")])
    got = sorted(fx.rows(star.dim_date(raw["orders"]), "date_key", "year_month", "month_name", "weekday", "quarter"))
    assert [str(r[0]) for r in got] == ["2018-02-27", "2018-02-28", "2018-03-01", "2018-03-02"]
    assert got[0][1:] == ("2018-02", "Feb", "Tue", 1)


def test_calendar_of_no_orders_is_empty(spark):
    assert star.dim_date(fx.raw(spark)["orders"]).count() == 0


def test_quality_checks_find_flaws(spark, tables):
    keyless = {**tables, "fact_reviews": fx.raw(spark, reviews=[
        fx.review(1, 5), fx.review(1, 5), fx.review(9, 5), (None, "o1", 1, None, None, None)])["reviews"]}
    keys = {r[0]: r[1:] for r in fx.rows(quality.check_pk(keyless), "table", "dup_keys", "null_keys")}
    assert keys["fact_reviews"] == (1, 1) and keys["fact_orders"] == (0, 0)
    orphans = dict(fx.rows(quality.check_fk(keyless), "child", "orphans"))
    assert orphans["fact_reviews.order_id"] == 1 and orphans["fact_orders.customer_id"] == 0
    bad = fx.labels(spark, ("r", "o", "negative", "aliens", "low"), ("s", "o", None, "other", "low"))
    assert sorted(fx.rows(quality.check_domain(bad)), key=str) == [("sentiment", None, 1), ("topic", "aliens", 1)]
