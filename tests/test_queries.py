from __future__ import annotations

import re

import pytest

from stallmark.plans import measures as M
from stallmark.plans import pack
from stallmark.plans import queries as Q
from tests import fixtures as fx


def test_reviews_multiply_rows_where_queries_join_them(spark):
    """One order with one item of 10 and two reviews."""
    tables = fx.star(spark, orders=[fx.order(1)], items=[fx.item(1)],
                     reviews=[fx.review(1, 1), fx.review(1, 5)])
    assert fx.rows(Q.category_scorecard(tables, min_orders=1), "revenue", "orders", "avg_score") == [(20.0, 1, 3.0)]
    assert fx.rows(Q.top_categories(tables), "revenue") == [(10.0,)]
    assert fx.rows(Q.state_delivery_performance(tables, min_orders=1), "orders") == [(2,)]
    monthly = pack.monthly(tables, "2018-01", "2018-01")
    assert fx.rows(monthly, "reviews", "review_points") == [(1, 3.0)]
    assert fx.rows(Q.sellers_with_problems(tables, min_orders=1), "orders", "avg_score") == [(1, 3.0)]


def _months(spark, *months):
    orders = [fx.order(i, bought=f"{m}-03 00:00:00") for i, (m, _) in enumerate(months)]
    items = [fx.item(i, price=str(p)) for i, (_, p) in enumerate(months) if p is not None]
    return fx.star(spark, orders=orders, items=items)


def test_previous_row_against_previous_calendar_month(spark):
    tables = _months(spark, ("2018-01", 10), ("2018-03", 15))
    growth = fx.rows(Q.monthly_revenue_growth(tables), "year_month", "mom_growth_pct")
    assert growth == [("2018-01", None), ("2018-03", 50.0)]
    time = sorted(fx.rows(M.revenue_over_time(tables), "year_month", "revenue_pm", "revenue_mom", "revenue_ytd"))
    assert time == [("2018-01", None, None, 10.0), ("2018-02", 10.0, None, 10.0), ("2018-03", None, None, 25.0)]


def test_date_filters_choose_months_and_not_their_values(spark):
    tables = _months(spark, ("2017-11", 4), ("2017-12", 8), ("2018-01", 10), ("2018-02", 5), ("2018-03", 7))
    every = {r[0]: r for r in fx.rows(M.revenue_over_time(tables), "year_month", "revenue", "revenue_pm", "revenue_ytd",
                                      "revenue_3m_rolling_avg")}
    for filters, months in [({"year": 2018}, ["2018-01", "2018-02", "2018-03"]), ({"year_month": ["2018-02"]}, ["2018-02"]),
                            ({"quarter": 4}, ["2017-11", "2017-12"]), ({"year": [2018], "year_month": "2018-03"}, ["2018-03"])]:
        got = fx.rows(M.revenue_over_time(tables, filters=filters), "year_month", "revenue", "revenue_pm", "revenue_ytd",
                      "revenue_3m_rolling_avg")
        assert sorted(got) == [every[m] for m in months]
    with pytest.raises(ValueError):
        M.revenue_over_time(tables, filters={"planet": 1})


def test_a_category_without_scores_is_not_the_lowest_rated(spark):
    orders = [fx.order(i, bought="2018-01-01 00:00:00") for i in (1, 2)]
    tables = fx.star(spark, orders=orders, items=[fx.item(1, price=10), fx.item(2, price=20)])
    tables["review_ai_labels"] = fx.labels(spark)
    assert pack.facts(tables, min_orders=0).first()["lowest_rated_big_category"] is None


def test_growth_starts_anew_at_the_first_chosen_month(spark):
    tables = _months(spark, ("2017-12", 4), ("2018-01", 10), ("2018-02", 5))
    growth = fx.rows(Q.monthly_revenue_growth(tables, "2018-01", "2018-02"), "mom_growth_pct")
    assert growth == [(None,), (-50.0,)]


def test_growth_on_nothing_is_null_but_zero_in_the_pack(spark):
    tables = _months(spark, ("2018-01", 0), ("2018-02", 5))
    assert fx.rows(Q.monthly_revenue_growth(tables), "mom_growth_pct") == [(None,), (None,)]
    derived = pack.monthly_derived(pack.monthly(tables))
    assert fx.rows(derived, "revenue_mom") == [(None,), (0.0,)]


def test_rolling_mean_is_over_days(spark):
    orders = [fx.order(1, bought="2018-01-01 00:00:00"), fx.order(2, bought="2018-01-02 00:00:00"),
              fx.order(3, bought="2018-02-01 00:00:00"), fx.order(4, bought="2018-02-02 00:00:00")]
    tables = fx.star(spark, orders=orders, items=[fx.item(1, price=10), fx.item(2, price=20), fx.item(3, price=60)])
    got = dict(fx.rows(M.revenue_over_time(tables), "year_month", "revenue_3m_rolling_avg"))
    assert got == {"2018-01": 15.0, "2018-02": 30.0}  # the day without items has no revenue and does not count


def test_bucket_edges(spark):
    days = {"2018-01-03": 1, "2018-01-10": 2, "2018-01-13": 3, "2018-01-17": 4, "2018-01-18": 5}
    orders = [fx.order(i, arrived=f"{day} 00:00:00") for day, i in days.items()]
    tables = fx.star(spark, orders=orders, reviews=[fx.review(i, i) for i in days.values()])
    got = fx.rows(Q.rating_by_days_late(tables), "lateness_bucket", "avg_score")
    assert [(int(b[0]), s) for b, s in got] == [(1, 1.0), (2, 2.0), (3, 3.0), (4, 4.0), (5, 5.0)]


def test_late_orders_of_any_status_count_in_the_measures_only(spark):
    orders = [fx.order(1), fx.order(2, arrived="2018-02-01 00:00:00", status="canceled")]
    tables = fx.star(spark, orders=orders)
    tables["review_ai_labels"] = fx.labels(spark)
    assert fx.rows(Q.kpi_overview(tables), "delivered_orders", "late_delivery_pct") == [(1, 0.0)]
    assert fx.rows(M.measures(tables), "delivered_orders", "late_orders", "late_delivery_pct", "customers") == [
        (1, 1, 0.5, 1)]


def test_totals_are_evaluated_over_their_rows(spark):
    orders = [fx.order(1), fx.order(2, bought="2017-05-01 00:00:00")]
    tables = fx.star(spark, orders=orders, customers=[fx.customer(1, "u"), fx.customer(2, "u")])
    tables["review_ai_labels"] = fx.labels(spark)
    got = sorted(fx.rows(M.measures(tables, ["year"], totals="rollup"), "level", "year", "customers"), key=str)
    assert got == [(0, 2017, 1), (0, 2018, 1), (1, None, 1)]


def test_repeat_rate_counts_a_person_per_review_of_the_first_order(spark):
    orders = [fx.order(1, bought="2018-01-01 00:00:00"), fx.order(2, bought="2018-01-02 00:00:00"), fx.order(3)]
    tables = fx.star(
        spark, orders=orders, customers=[fx.customer(1, "u"), fx.customer(2, "u"), fx.customer(3, "v")],
        reviews=[fx.review(1, 1), fx.review(1, 2), fx.review(2, 5), fx.review(3, None), fx.review(3, 2)])
    assert fx.rows(Q.repeat_purchase_after_bad_review(tables)) == [
        ("1-2 stars", 3, 66.67), ("4-5 stars", 1, 0.0)]


def test_first_month_has_no_month_before_it(spark):
    table = pack.monthly(_months(spark, ("2018-01", 10), ("2018-02", 30)))
    first = {r[0]: r[1:] for r in fx.rows(pack.kpi_summary(table, "2018-01"))}
    assert first["Orders"] == (1.0, 0.0, 0.0, 2.0)
    assert first["Late delivery %"] == (0.0, 0.0, 0.0, 0.0)
    second = {r[0]: r[1:] for r in fx.rows(pack.kpi_summary(table, "2018-02"))}
    assert second["Revenue (BRL)"] == (30.0, 10.0, 2.0, 40.0)


def test_missing_filter_does_not_filter(spark):
    tables = fx.star(spark, orders=[fx.order(1)], reviews=[fx.review(1, 1), fx.review(1, 5)])
    tables["review_ai_labels"] = fx.labels(
        spark, ("r1-1", "o1", "negative", "other", "low"), ("r1-5", "o1", "positive", "praise", "high"))
    assert Q.browse_reviews(tables).count() == 2
    assert fx.rows(Q.browse_reviews(tables, urgencies=["high"]), "stars") == [(5,)]
    assert Q.browse_reviews(tables, topics=["seller_service"]).count() == 0


def test_topic_counts_distinct_reviews_of_the_first_item(spark):
    tables = fx.star(spark, orders=[fx.order(1), fx.order(2)], items=[fx.item(1), fx.item(2), fx.item(2, 2, product="p2")],
                     products=[("p1", "a", 1.0, 1), ("p2", "b", 1.0, 1)], reviews=[])
    tables["review_ai_labels"] = fx.labels(
        spark, ("r", "o1", "negative", "other", "low"), ("r", "o2", "negative", "other", "low"))
    assert fx.rows(Q.topic_by_category(tables, min_reviews=1)) == [("a", "other", 1)]
    assert fx.rows(Q.complaint_heat_map(tables)) == [("a", "other", 2)]


def test_an_order_of_several_categories_counts_once_in_a_total(spark):
    tables = fx.star(spark, orders=[fx.order(1)], items=[fx.item(1), fx.item(1, 2, product="p2", seller="s2")],
                     products=[("p1", "a", 1.0, 1), ("p2", "b", 1.0, 1)])
    tables["review_ai_labels"] = fx.labels(spark)
    rollup = M.measures(tables, ["category"], totals="rollup")
    assert sorted(fx.rows(rollup, "level", "category", "delivered_orders", "revenue"), key=str) == [
        (0, "a", 1, 20.0), (0, "b", 1, 20.0), (1, None, 1, 20.0)]
    both = M.measures(tables, filters={"category": ["a", "b"]})
    assert fx.rows(both, "delivered_orders") == [(1,)]
    pairs = M.measures(tables, ["category", "seller_id"])
    assert sorted(fx.rows(pairs, "category", "seller_id", "delivered_orders")) == [("a", "s1", 1), ("b", "s2", 1)]


def _item_cube(spark):
    """Orders with two categories and sellers, with one of each twice, without items, not delivered, and a person with two orders."""
    orders = [fx.order(1), fx.order(2, arrived="2018-02-01 00:00:00"), fx.order(3, status="shipped", arrived=None), fx.order(4),
              fx.order(5, arrived="2018-01-25 00:00:00")]
    items = [fx.item(1), fx.item(1, 2, product="p2", seller="s2"), fx.item(1, 3, product="p2"), fx.item(2), fx.item(2, 2),
             fx.item(3), fx.item(3, 2, product="p2"), fx.item(5, product="p3", seller=None)]
    tables = fx.star(spark, orders=orders, items=items, products=[("p1", "a", 1.0, 1), ("p2", "b", 1.0, 1), ("p3", None, 1.0, 1)],
                     customers=[fx.customer(1, "u"), fx.customer(2, "u"), fx.customer(3, "v"), fx.customer(4, "w"),
                                ("c5", None, "x", "SP")],
                     reviews=[fx.review(1, 1), fx.review(1, 5), fx.review(3, 2), fx.review(4, None)])
    tables["review_ai_labels"] = fx.labels(
        spark, ("r1-1", "o1", "negative", "other", "high"), ("r3-2", "o3", "negative", "other", "low"))
    return tables


@pytest.mark.parametrize("by, totals, filters", [
    (["category", "lateness_bucket"], "cube", {}), (["category", "lateness_bucket"], "rollup", {"seller_id": ["s1", "s2"]}),
    (["order_status", "seller_id", "category"], "cube", {})], ids=str)
def test_each_level_of_item_totals_is_that_grouping_alone(spark, by, totals, filters):
    tables = _item_cube(spark)
    every = M.measures(tables, by, filters, totals=totals)
    values = [c for c in every.columns if c not in {*by, "level"}]
    got = sorted(fx.rows(every, *by, "level", *values), key=str)
    want = []
    for kept in M._grouping_sets(by, totals):
        for row in M.measures(tables, kept, filters).collect():
            alone = row.asDict()
            want.append((*(alone.get(c) for c in by), M._level(by, kept), *(alone[v] for v in values)))
    assert got == sorted(want, key=str)


def test_items_of_an_order_are_not_shuffled_per_grouping_set(spark, stored_star):
    """Orders meet (order, category) rows; the total takes the first of them and is no row of its own before the join."""
    plan = M.measures(stored_star, ["category", "lateness_bucket"], totals="cube")._jdf.queryExecution().executedPlan().toString()
    keys = [re.sub(r"#\d+", "", k) for k in re.findall(r"hashpartitioning\(([^)]*)\)", plan)]
    assert any(k.startswith("order_id, category") for k in keys)
    assert not any(k.startswith("order_id") and "_choice" in k for k in keys)
