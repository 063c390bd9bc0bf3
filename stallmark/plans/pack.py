"""The monthly KPI pack: tables, derived columns, one-month summary, facts and sentences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import cents, ratio, ratio_or_zero, round_ratio
from . import frames as fr
from . import queries as Q
from .frames import Tables
from .measures import measures

# Parts of a star that a mean review score of one order is counted in, so that sums are exact.
_SCALE = 10**12


def _mean_parts() -> Column:
    """The mean score of an order as whole parts, half away from zero."""
    points, scored = F.col("points").cast("decimal(20,0)"), F.col("scored").cast("decimal(10,0)")
    return F.when(F.col("scored") > 0, F.call_function(
        "div", points * F.lit(2 * _SCALE).cast("decimal(14,0)") + scored, scored * F.lit(2).cast("decimal(1,0)")))


def monthly(tables: Tables, first_month: str = Q.FIRST_MONTH, last_month: str = Q.LAST_MONTH) -> DataFrame:
    """Per month: orders, revenue, lateness, orders with a review and the sum of their mean scores."""
    reviewed = fr.review_totals(tables).select("order_id", _mean_parts().alias("parts"))
    orders = (fr.with_month(fr.delivered_orders(tables))
              .filter(F.col("year_month").between(first_month, last_month)))
    return (orders.join(reviewed, "order_id", "left")
            .groupBy(F.col("year_month").alias("month"))
            .agg(
                F.count(F.lit(1)).alias("orders"),
                F.sum("order_value").cast("double").alias("revenue"),
                F.sum("is_late").alias("late_orders"),
                F.count("is_late").alias("orders_with_delivery_date"),
                F.count("parts").alias("reviews"),
                (F.sum(F.col("parts").cast("decimal(20,0)")).cast("double") / F.lit(float(_SCALE))).alias("review_points"))
            .orderBy("month"))


def monthly_derived(table: DataFrame) -> DataFrame:
    """The monthly table with ratios; a ratio that cannot be computed is 0, the first month has no change."""
    by_month = Window.orderBy("month")  # one row per month
    before = F.lag("revenue").over(by_month)
    first = F.row_number().over(by_month) == 1
    return (table.withColumn("_before", before).withColumn("_first", first)
            .select(
                *table.columns,
                ratio_or_zero(F.col("revenue"), F.col("orders")).alias("aov"),
                ratio_or_zero(F.col("late_orders"), F.col("orders_with_delivery_date")).alias("late_pct"),
                ratio_or_zero(F.col("review_points"), F.col("reviews")).alias("avg_score"),
                F.when(~F.col("_first"), F.coalesce(ratio(F.col("revenue"), F.col("_before")) - 1, F.lit(0.0)))
                .alias("revenue_mom"))
            .orderBy("month"))


def categories(tables: Tables, min_orders: int = 300) -> DataFrame:
    return (Q.category_rows(tables, min_orders)
            .select("category", "orders", F.col("value").cast("double").alias("revenue"),
                    round_ratio(F.col("points"), F.col("scored"), 2).alias("avg_score"))
            .orderBy(F.desc("revenue"), "category"))


def category_shares(table: DataFrame) -> DataFrame:
    """Revenue share and rank. The windows run over one row per category; the total is a sum of whole cents."""
    total = F.sum(F.col("revenue").cast("decimal(28,2)")).over(Window.partitionBy()).cast("double")
    return table.select(
        *table.columns, ratio(F.col("revenue"), total).alias("revenue_share"),
        F.rank().over(Window.orderBy(F.desc("revenue"))).cast("bigint").alias("revenue_rank"))


def complaints(tables: Tables) -> DataFrame:
    return (tables["review_ai_labels"].filter(F.col("sentiment") == "negative").groupBy("topic")
            .agg(F.count(F.lit(1)).alias("negative_reviews"),
                 F.count_if(F.col("urgency") == "high").alias("high_urgency"))
            .orderBy(F.desc("negative_reviews"), "topic"))


def complaint_shares(table: DataFrame) -> DataFrame:
    total = F.sum("negative_reviews").over(Window.partitionBy())  # over one row per topic
    return table.select(*table.columns, ratio(F.col("negative_reviews"), total).alias("share_of_complaints"))


# KPI names, and whether the change is a ratio or a difference.
KPIS = [
    ("Orders", "ratio"),
    ("Revenue (BRL)", "ratio"),
    ("Avg order value (BRL)", "ratio"),
    ("Late delivery %", "difference"),
    ("Avg review score", "difference"),
]


def kpi_summary(table: DataFrame, month: str) -> DataFrame:
    """Five KPIs of one month, of the month before it in the table, their change, and of all months.

    Without a month before, its values are 0.
    """
    parts = ["orders", "revenue", "late_orders", "orders_with_delivery_date", "reviews", "review_points"]
    numbered = table.select("month", *parts, F.lag("month").over(Window.orderBy("month")).alias("_before"))
    chosen = numbered.select("month", *parts, F.max(F.when(F.col("month") == month, F.col("_before")))
                             .over(Window.partitionBy()).alias("_previous"))
    picks = {"selected": F.col("month") == month, "previous": F.col("month") == F.col("_previous"),
             "all": F.lit(True)}
    exact = {p: F.col(p).cast("decimal(38,12)") if p == "review_points"
             else F.col(p).cast("decimal(28,2)") if p == "revenue" else F.col(p) for p in parts}
    wide = chosen.agg(*[
        F.sum(F.when(condition, exact[p])).cast("double").alias(f"{pick}_{p}")
        for pick, condition in picks.items() for p in parts])

    def value(kpi: str, pick: str) -> Column:
        get = {p: F.col(f"{pick}_{p}") for p in parts}
        return {
            "Orders": F.coalesce(get["orders"], F.lit(0.0)),
            "Revenue (BRL)": F.coalesce(get["revenue"], F.lit(0.0)),
            "Avg order value (BRL)": ratio_or_zero(get["revenue"], get["orders"]),
            "Late delivery %": ratio_or_zero(get["late_orders"], get["orders_with_delivery_date"]),
            "Avg review score": ratio_or_zero(get["review_points"], get["reviews"]),
        }[kpi]

    rows = F.array(*[
        F.struct(F.lit(kpi).alias("kpi"), F.lit(kind).alias("kind"), value(kpi, "selected").alias("selected"),
                 value(kpi, "previous").alias("previous"), value(kpi, "all").alias("all_months"))
        for kpi, kind in KPIS])
    change = (F.when(F.col("kind") == "difference", F.col("selected") - F.col("previous"))
              .otherwise(F.coalesce(ratio(F.col("selected"), F.col("previous")) - 1, F.lit(0.0))))
    return wide.select(F.inline(rows)).select("kpi", "selected", "previous", change.alias("change"), "all_months")


def facts(tables: Tables, first_month: str = Q.FIRST_MONTH, last_month: str = Q.LAST_MONTH,
          min_orders: int = 300, topics: int | None = 3) -> DataFrame:
    """One row with the facts of the pack; the three small tables are each reduced to one row and combined."""
    months = monthly(tables, first_month, last_month)
    money = F.col("revenue").cast("decimal(28,2)")
    latest = F.row_number().over(Window.orderBy(F.desc("month")))  # one row per month
    totals = months.withColumn("_place", latest).agg(
        F.concat(F.min("month"), F.lit(" to "), F.max("month")).alias("period"),
        F.sum("orders").alias("total_orders"),
        F.bround(F.sum(money), 0).cast("bigint").alias("total_revenue_brl"),
        F.max("month").alias("latest_month"),
        F.max(F.when(F.col("_place") == 1, money)).alias("_last"),
        F.max(F.when(F.col("_place") == 2, money)).alias("_before"),
        F.sum("late_orders").alias("_late"), F.sum("orders_with_delivery_date").alias("_known"),
        F.sum(F.col("review_points").cast("decimal(38,12)")).alias("_points"), F.sum("reviews").alias("_reviews"))
    points = (F.col("_points") * F.lit(10**6)).cast("decimal(30,0)")
    totals = totals.select(
        "period", "total_orders", "total_revenue_brl", "latest_month",
        F.bround("_last", 0).cast("bigint").alias("latest_month_revenue"),
        round_ratio(cents(F.col("_last")) - cents(F.col("_before")), cents(F.col("_before")), 1, 100)
        .alias("mom_revenue_change_pct"),
        round_ratio(F.col("_late"), F.col("_known"), 1, 100).alias("late_delivery_rate_pct"),
        round_ratio(points, F.col("_reviews") * 10**6, 2).alias("avg_review_score"))
    groups = categories(tables, min_orders).agg(
        F.min(F.struct((-F.col("revenue")).alias("r"), "category"))["category"].alias("top_category"),
        # A category without any score is no lowest one.
        F.min(F.when(F.col("avg_score").isNotNull(), F.struct("avg_score", (-F.col("revenue")).alias("r"), "category")))
        ["category"].alias("lowest_rated_big_category"))
    worst = (complaints(tables).orderBy(F.desc("negative_reviews"), "topic").transform(fr.first_rows, topics)
             .agg(F.transform(
                 F.array_sort(F.collect_list(F.struct((-F.col("negative_reviews")).alias("o"), "topic"))),
                 lambda t: F.concat(t["topic"], F.lit("="), (-t["o"]).cast("string"))).alias("top_complaint_topics")))
    parts = (totals.unionByName(groups, allowMissingColumns=True)
             .unionByName(worst, allowMissingColumns=True))
    return parts.agg(*[F.max(c).alias(c) for c in parts.columns])


# The sentences of the summary, in their order.
HEADLINE = "%,d delivered orders worth R$ %,d (%s)."
LATEST = "%s revenue was R$ %,d, %+.1f%% vs the previous month."
LATENESS = "%s%% of orders arrived late; average review score is %s / 5."
CATEGORY = "Top revenue category: %s. Lowest-rated large category: %s."
COMPLAINTS = "Most common complaint topics: %s."
ACTION = ("Recommended action: prioritise on-time delivery in the worst-performing states, "
          "since late orders score ~{} stars lower.")
STARS_LOWER = "1.7"  # as published; ``stars_lower`` measures it


def _say(template: str, *facts: Column) -> Column:
    """The filled sentence, null when one of its facts is missing."""
    given = reduce(Column.__and__, (fact.isNotNull() for fact in facts))
    return F.when(given, F.format_string(template, *facts))


def stars_lower(tables: Tables) -> DataFrame:
    """(stars_lower): by how much the average score of late orders is below that of the others, one decimal."""
    gap = F.round(F.col("score_gap_late_vs_on_time").cast("decimal(20,15)"), 1)
    return measures(tables).select(F.format_number(gap, 1).alias("stars_lower"))


def sentences(record: DataFrame, lower: DataFrame | None = None) -> DataFrame:
    """One row per sentence of the executive summary. ``lower``, from ``stars_lower``, takes the place of the
    published distance between late and other orders."""
    if lower is not None:
        # One row each.
        record = record.withColumn("_one", F.lit(1)).join(F.broadcast(lower.withColumn("_one", F.lit(1))), "_one", "left").drop("_one")
    words = F.replace(F.array_join(F.transform(
        "top_complaint_topics", lambda t: F.split_part(t, F.lit("="), F.lit(1))), ", "), F.lit("_"), F.lit(" "))
    fact = {c: F.col(c) for c in record.columns}
    bullets = [
        _say(HEADLINE, fact["total_orders"], fact["total_revenue_brl"], fact["period"]),
        _say(LATEST, fact["latest_month"], fact["latest_month_revenue"], fact["mom_revenue_change_pct"]),
        _say(LATENESS, fact["late_delivery_rate_pct"].cast("string"), fact["avg_review_score"].cast("string")),
        _say(CATEGORY, fact["top_category"], fact["lowest_rated_big_category"]),
        _say(COMPLAINTS, words),
        F.lit(ACTION.format(STARS_LOWER)) if lower is None else F.replace(
            F.lit(ACTION), F.lit("{}"), F.coalesce("stars_lower", F.lit(STARS_LOWER))),
    ]
    return record.select(F.posexplode(F.array(*bullets)).alias("position", "sentence"))
