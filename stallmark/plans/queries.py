"""Named business queries. Each takes the star tables and returns a DataFrame.

Thresholds and periods are keyword arguments. Where a sort key can repeat, the group key decides.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import cents, ratio, round_money, round_ratio
from ..schemas import REVIEW_KEY
from . import frames as fr
from .frames import Tables, fan, known, tenths, weighted

# The months with complete data in the published dataset.
FIRST_MONTH, LAST_MONTH = "2017-01", "2018-08"


def _customers(tables: Tables, *columns: str) -> DataFrame:
    return tables["dim_customer"].select("customer_id", *columns)


def kpi_overview(tables: Tables) -> DataFrame:
    """Headline numbers of delivered orders."""
    orders = fr.delivered_orders(tables).join(_customers(tables, "customer_unique_id"), "customer_id")
    return orders.agg(
        F.count(F.lit(1)).alias("delivered_orders"),
        F.count_distinct("customer_unique_id").alias("customers"),
        F.sum("order_value").alias("value"),
        F.count("order_value").alias("valued"),
        F.sum(tenths(F.col("delivery_days"))).alias("days"),
        F.count("delivery_days").alias("timed"),
        F.sum("is_late").alias("late"),
        F.count("is_late").alias("known"),
    ).select(
        "delivered_orders", "customers",
        round_money(F.col("value")).alias("revenue_brl"),
        round_ratio(cents(F.col("value")), F.col("valued") * 100, 2).alias("avg_order_value"),
        round_ratio(F.col("days"), F.col("timed") * 10, 1).alias("avg_delivery_days"),
        round_ratio(F.col("late"), F.col("known"), 1, 100).alias("late_delivery_pct"))


def _monthly(tables: Tables, first_month: str, last_month: str) -> DataFrame:
    return (fr.with_month(fr.delivered_orders(tables))
            .filter(F.col("year_month").between(first_month, last_month))
            .groupBy("year_month")
            .agg(F.count(F.lit(1)).alias("orders"), F.sum("order_value").alias("value")))


def monthly_revenue_growth(
    tables: Tables, first_month: str = FIRST_MONTH, last_month: str = LAST_MONTH,
) -> DataFrame:
    """Revenue per month and its change against the row before; the first month has none."""
    # One row per month here, so a window over all of them is small.
    before = F.lag("value").over(Window.orderBy("year_month"))
    return (_monthly(tables, first_month, last_month)
            .withColumn("before", before)
            .select(
                "year_month", "orders",
                round_money(F.col("value")).alias("revenue"),
                round_ratio(cents(F.col("value")) - cents(F.col("before")), cents(F.col("before")), 1, 100)
                .alias("mom_growth_pct"))
            .orderBy("year_month"))


def _reviewed_orders(tables: Tables) -> DataFrame:
    return fr.delivered_orders(tables).join(fr.review_totals(tables), "order_id")


def late_delivery_vs_rating(tables: Tables) -> DataFrame:
    return (_reviewed_orders(tables).filter(F.col("is_late").isNotNull())
            .groupBy(fr.delivery_word(F.col("is_late")).alias("delivery"))
            .agg(F.sum("reviews").alias("reviews"), *_score_sums())
            .select(
                "delivery", "reviews", _avg_score(),
                round_ratio(F.col("low"), F.col("scored"), 1, 100).alias("pct_1_2_stars")))


def _score_sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in ("scored", "points", "low")]


def _avg_score(digits: int = 2) -> Column:
    return round_ratio(F.col("points"), F.col("scored"), digits).alias("avg_score")


def rating_by_days_late(tables: Tables) -> DataFrame:
    return (_reviewed_orders(tables).filter(F.col("days_late").isNotNull())
            .groupBy(fr.lateness_bucket(F.col("days_late")).alias("lateness_bucket"))
            .agg(F.sum("reviews").alias("reviews"), *_score_sums())
            .select("lateness_bucket", "reviews", _avg_score())
            .orderBy("lateness_bucket"))


def category_rows(tables: Tables, min_orders: int) -> DataFrame:
    """Unrounded category sums with one count per item and review."""
    late = F.col("is_late").cast("bigint")
    rows = (fr.items_by_order(tables, "category")
            .join(fr.delivered_orders(tables).select("order_id", "is_late"), "order_id")
            .join(fr.review_totals(tables), "order_id", "left"))
    return (rows.groupBy("category")
            .agg(
                F.count(F.lit(1)).alias("orders"),
                weighted(F.col("amount"), fan().cast("decimal(10,0)")).alias("value"),
                weighted(F.col("points"), F.col("items")).alias("points"),
                weighted(F.col("scored"), F.col("items")).alias("scored"),
                weighted(late * F.col("items"), fan()).alias("late"),
                weighted(known(late) * F.col("items"), fan()).alias("known"))
            .filter(F.col("orders") >= min_orders))


def category_scorecard(tables: Tables, min_orders: int = 500, top: int | None = 15) -> DataFrame:
    """Categories by revenue. Ranked after the grouping: one row per category."""
    return (category_rows(tables, min_orders)
            .select(
                F.rank().over(Window.orderBy(F.desc("value"))).cast("bigint").alias("revenue_rank"),
                "category", "orders",
                round_money(F.col("value")).alias("revenue"),
                _avg_score(),
                round_ratio(F.col("late"), F.col("known"), 1, 100).alias("late_pct"))
            .orderBy("revenue_rank", "category").transform(fr.first_rows, top))


def state_delivery_performance(tables: Tables, min_orders: int = 300) -> DataFrame:
    """Waiting time and lateness per customer state, one count per order and review."""
    late = F.col("is_late").cast("bigint")
    days = tenths(F.col("delivery_days"))
    rows = (fr.delivered_orders(tables)
            .join(_customers(tables, "state"), "customer_id")
            .join(fr.review_totals(tables), "order_id", "left"))
    return (rows.groupBy("state")
            .agg(
                F.sum(fan()).alias("orders"),
                weighted(days, fan()).alias("days"), weighted(known(days), fan()).alias("timed"),
                weighted(late, fan()).alias("late"), weighted(known(late), fan()).alias("known"),
                F.sum("points").alias("points"), F.sum("scored").alias("scored"))
            .filter(F.col("orders") >= min_orders)
            .select(
                "state", "orders",
                round_ratio(F.col("days"), F.col("timed") * 10, 1).alias("avg_delivery_days"),
                round_ratio(F.col("late"), F.col("known"), 1, 100).alias("late_pct"),
                _avg_score())
            .orderBy(F.desc("late_pct"), "state"))


def repeat_purchase_after_bad_review(tables: Tables) -> DataFrame:
    """Share of persons who came back, by the rating of their first order.

    Grouped per person instead of windowed, so a person with very many orders is combined before the
    shuffle. A review without a score counts with the best ones.
    """
    orders = fr.delivered_orders(tables).join(_customers(tables, "customer_unique_id"), "customer_id")
    persons = (orders.groupBy("customer_unique_id")
               .agg(F.min(F.struct("purchase_ts", "order_id")).alias("first"),
                    F.count(F.lit(1)).alias("total"))
               .select(F.col("first.order_id").alias("order_id"), (F.col("total") > 1).alias("back")))
    rated = persons.join(fr.review_totals(tables), "order_id").withColumn(
        "top", F.col("reviews") - F.col("low") - F.col("middle"))
    stars = {"low": "1-2 stars", "middle": "3 stars", "top": "4-5 stars"}
    sums = rated.agg(
        *[F.sum(c).alias(c) for c in stars],
        *[F.coalesce(F.sum(F.when(F.col("back"), F.col(c))), F.lit(0)).alias(f"{c}_back") for c in stars])
    return (sums.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("first_order_rating"), F.col(c).alias("customers"),
                 F.col(f"{c}_back").alias("back")) for c, name in stars.items()])))
        .filter(F.col("customers") > 0)
        .select(
            "first_order_rating", "customers",
            round_ratio(F.col("back"), F.col("customers"), 2, 100).alias("repeat_rate_pct"))
        .orderBy("first_order_rating"))


def sellers_with_problems(tables: Tables, min_orders: int = 100, worst: int | None = 10) -> DataFrame:
    """Large sellers with the lowest ratings. The seller table is joined to the grouped rows."""
    late = F.col("is_late").cast("bigint")
    per_row = F.col("items") * F.col("reviews")
    rows = fr.items_by_order(tables, "seller_id").join(_reviewed_orders(tables), "order_id")
    sellers = (rows.groupBy("seller_id")
               .agg(
                   F.count(F.lit(1)).alias("orders"),
                   weighted(F.col("points"), F.col("items")).alias("points"),
                   weighted(F.col("scored"), F.col("items")).alias("scored"),
                   weighted(late, per_row).alias("late"), weighted(known(late), per_row).alias("known"))
               .filter(F.col("orders") >= min_orders))
    return (sellers.join(tables["dim_seller"].select("seller_id", F.col("state").alias("seller_state")), "seller_id")
            .select(
                "seller_id", "seller_state", "orders", _avg_score(),
                round_ratio(F.col("late"), F.col("known"), 1, 100).alias("late_pct"))
            .orderBy("avg_score", "seller_id").transform(fr.first_rows, worst))


def _complaints(tables: Tables) -> DataFrame:
    return tables["review_ai_labels"].filter(F.col("sentiment") == "negative")


def _rated_complaints(tables: Tables) -> DataFrame:
    """Complaints per topic with the star sums of their reviews."""
    return (_complaints(tables).select(*REVIEW_KEY, "topic")
            .join(tables["fact_reviews"].select(*REVIEW_KEY, "review_score"), REVIEW_KEY)
            .groupBy("topic")
            .agg(F.count(F.lit(1)).alias("reviews"), F.sum("review_score").alias("points"),
                 F.count("review_score").alias("scored")))


def topic_breakdown(tables: Tables) -> DataFrame:
    total = F.sum("reviews").over(Window.partitionBy())  # over one row per topic
    return (_rated_complaints(tables)
            .select("topic", "reviews", round_ratio(F.col("reviews"), total, 1, 100).alias("share_pct"), _avg_score())
            .orderBy(F.desc("reviews"), "topic"))


def topic_by_category(tables: Tables, min_reviews: int = 5, top: int | None = 20) -> DataFrame:
    return (_complaints(tables).select("review_id", "order_id", "topic")
            .transform(fr.with_first_category, tables)
            .groupBy("category", "topic")
            .agg(F.count_distinct("review_id").alias("negative_reviews"))
            .filter(F.col("negative_reviews") >= min_reviews)
            .orderBy(F.desc("negative_reviews"), "category", "topic").transform(fr.first_rows, top))


def _late_by_state(tables: Tables, min_orders: int) -> DataFrame:
    return (fr.delivered_orders(tables).join(_customers(tables, "state"), "customer_id")
            .groupBy("state")
            .agg(F.count(F.lit(1)).alias("orders"), F.sum("is_late").alias("late"),
                 F.count("is_late").alias("known"))
            .filter(F.col("orders") >= min_orders))


def worst_states(tables: Tables, min_orders: int = 300, worst: int | None = 5) -> DataFrame:
    return (_late_by_state(tables, min_orders)
            .select("state", "orders", round_ratio(F.col("late"), F.col("known"), 1, 100).alias("late_pct"))
            .orderBy(F.desc("late_pct"), "state").transform(fr.first_rows, worst))


def complaint_topics(tables: Tables) -> DataFrame:
    return (_complaints(tables).groupBy("topic").agg(F.count(F.lit(1)).alias("negative_reviews"))
            .orderBy(F.desc("negative_reviews"), "topic"))


def _category_revenue(tables: Tables, orders: DataFrame, months: tuple[str, str] | None = None) -> DataFrame:
    """Revenue per category without reviews: summed per product first, then per category."""
    by_product = (fr.of_months(tables["fact_order_items"], months).join(orders.select("order_id"), "order_id")
                  .groupBy("product_id").agg(F.sum("price").alias("value")))
    return (by_product.join(tables["dim_product"].select("product_id", "category"), "product_id")
            .groupBy("category").agg(F.sum("value").alias("value")))


def top_categories(tables: Tables, top: int | None = 10) -> DataFrame:
    return (_category_revenue(tables, fr.delivered_orders(tables))
            .select("category", round_money(F.col("value")).alias("revenue"))
            .orderBy(F.desc("revenue"), "category").transform(fr.first_rows, top))


def monthly_orders(tables: Tables, year: int = 2018) -> DataFrame:
    return (_in_year(fr.with_month(fr.delivered_orders(tables)), year)
            .groupBy("year_month").agg(F.count(F.lit(1)).alias("orders"))
            .orderBy("year_month"))


def _months_of(year: int) -> tuple[str, str]:
    return f"{year:04d}-01", f"{year:04d}-12"


def _in_year(orders: DataFrame, year: int) -> DataFrame:
    """A range on the date and on the month that stored orders are partitioned by, which reach the file scan; a function
    of the date would not."""
    day = F.col("purchase_date")
    orders = fr.with_month(orders).filter(F.col("year_month").between(*_months_of(year)))
    return orders.filter((day >= F.lit(date(year, 1, 1))) & (day < F.lit(date(year + 1, 1, 1))))


def overview_cards(tables: Tables) -> DataFrame:
    """Dashboard cards; the average score is over all reviews, not only those of delivered orders."""
    none = F.lit(None)
    orders = fr.delivered_orders(tables).agg(
        F.count(F.lit(1)).alias("orders"),
        F.sum("order_value").cast("double").alias("revenue"),
        ratio(F.sum("order_value"), F.count("order_value")).alias("aov"),
        ratio(F.sum(tenths(F.col("delivery_days"))), F.count("delivery_days") * 10).alias("days"),
        ratio(F.sum("is_late"), F.count("is_late")).alias("late"),
        none.cast("double").alias("avg_score"))
    score = tables["fact_reviews"].agg(
        ratio(F.sum("review_score"), F.count("review_score")).alias("avg_score"))
    # Two single rows become one.
    return (orders.unionByName(score, allowMissingColumns=True)
            .agg(*[F.max(c).alias(c) for c in orders.columns]))


def monthly_revenue(tables: Tables, first_month: str = FIRST_MONTH, last_month: str = LAST_MONTH) -> DataFrame:
    return (_monthly(tables, first_month, last_month)
            .select("year_month", F.col("value").cast("double").alias("revenue"))
            .orderBy("year_month"))


def lateness_series(tables: Tables) -> DataFrame:
    """Average score per bucket, in the order of the smallest lateness in it."""
    name = F.regexp_replace(fr.lateness_bucket(F.col("days_late")), r"^\d\. ", "")
    return (_reviewed_orders(tables).filter(F.col("days_late").isNotNull())
            .groupBy(name.alias("bucket"))
            .agg(*_score_sums(), F.min("days_late").alias("o"))
            .select("bucket", ratio(F.col("points"), F.col("scored")).alias("avg_score"), "o")
            .orderBy("o"))


def late_share_by_state(tables: Tables, min_orders: int = 300) -> DataFrame:
    return (_late_by_state(tables, min_orders)
            .select("state", (ratio(F.col("late"), F.col("known")) * 100).alias("late_pct"),
                    F.col("orders").alias("n"))
            .orderBy(F.desc("late_pct"), "state"))


def labels_by_provider(tables: Tables) -> DataFrame:
    return tables["review_ai_labels"].groupBy("provider").agg(F.count(F.lit(1)).alias("n"))


def urgency_distribution(tables: Tables) -> DataFrame:
    return tables["review_ai_labels"].groupBy("urgency").agg(F.count(F.lit(1)).alias("reviews"))


def complaint_heat_map(tables: Tables, top: int | None = 10) -> DataFrame:
    """Complaints per category and topic for the categories with most of them.

    The windows run over the grouped rows, at most one per category and topic.
    """
    pairs = (_complaints(tables).select("order_id", "topic")
             .transform(fr.with_first_category, tables)
             .groupBy("category", "topic").agg(F.count(F.lit(1)).alias("n")))
    total = F.sum("n").over(Window.partitionBy("category"))
    place = F.dense_rank().over(Window.orderBy(F.desc("total"), "category"))
    return (pairs.withColumn("total", total).withColumn("place", place)
            .filter(F.lit(True) if top is None else F.col("place") <= top)
            .select("category", "topic", "n"))


def heat_map_matrix(tables: Tables, topics: list[str], top: int | None = 10) -> DataFrame:
    """The heat map with one column per topic."""
    return (complaint_heat_map(tables, top).groupBy("category").pivot("topic", topics)
            .agg(F.sum("n")).na.fill(0, topics))


def browse_reviews(
    tables: Tables, topics: list[str] | None = None, urgencies: list[str] | None = None, rows: int | None = 300,
) -> DataFrame:
    """Labelled reviews with their text; a filter that is not given does not filter."""
    labels = tables["review_ai_labels"]
    if topics:
        labels = labels.filter(F.col("topic").isin(*topics))
    if urgencies:
        labels = labels.filter(F.col("urgency").isin(*urgencies))
    reviews = tables["fact_reviews"].select(*REVIEW_KEY, "review_score", "comment_message")
    return (labels.join(reviews, REVIEW_KEY)
            .orderBy(*REVIEW_KEY).transform(fr.first_rows, rows)
            .select(F.col("review_score").alias("stars"), "sentiment", "topic", "urgency", "summary_en",
                    "comment_message"))


def score_by_payment_type(tables: Tables) -> DataFrame:
    return (tables["fact_orders"].select("order_id", "payment_type")
            .join(fr.review_totals(tables), "order_id")
            .groupBy("payment_type")
            .agg(F.sum("reviews").alias("reviews"), *_score_sums())
            .select("payment_type", _avg_score(), "reviews")
            .orderBy(F.desc("avg_score"), "payment_type"))


def top_categories_in_year(tables: Tables, year: int = 2018, top: int | None = 5) -> DataFrame:
    return (_category_revenue(tables, _in_year(fr.delivered_orders(tables), year), _months_of(year))
            .select("category", round_money(F.col("value")).alias("revenue"))
            .orderBy(F.desc("revenue"), "category").transform(fr.first_rows, top))


def late_vs_on_time_score(tables: Tables) -> DataFrame:
    return late_delivery_vs_rating(tables).select("delivery", "avg_score", "reviews")


def topic_insight(tables: Tables) -> DataFrame:
    return (_rated_complaints(tables)
            .select("topic", "reviews", ratio(F.col("points"), F.col("scored")).alias("avg_score"))
            .orderBy(F.desc("reviews"), "topic"))
