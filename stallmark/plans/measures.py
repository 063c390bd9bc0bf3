"""BI measures, evaluated per group and under filters.

Every measure is a sum of per-order parts, so one row per order carries them all: lateness, revenue, review
and label sums. Grouping and totals are then a single aggregation, and a total is evaluated over its rows and
not added up from its groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import ratio
from ..functions.time import month_index
from . import frames as fr
from .frames import Tables

ORDER_ATTRIBUTES = ["year", "quarter", "year_month", "order_status", "payment_type", "is_late", "lateness_bucket"]
CUSTOMER_ATTRIBUTES = ["state", "city"]
ITEM_ATTRIBUTES = ["category", "seller_id"]
LABEL_ATTRIBUTES = ["topic", "sentiment", "urgency", "provider"]

DATE_ATTRIBUTES = ["year", "quarter", "year_month"]

Filters = dict[str, object]


def _values(value: object) -> list:
    return list(value) if isinstance(value, (list, tuple, set)) else [value]


def _keep(df: DataFrame, filters: Filters) -> DataFrame:
    for name, value in filters.items():
        df = df.filter(F.col(name).isin(*_values(value)))
    return df


def _only(filters: Filters, names: Sequence[str]) -> Filters:
    return {k: v for k, v in filters.items() if k in names}


def _months_between(filters: Filters, before: int = 0, from_january: bool = False) -> tuple[str, str] | None:
    """The first and last month of a range that holds all months the date filters allow, and as many before as are needed.

    Stored orders are partitioned by the month, which this range reaches; a function of the date would not.
    """
    spans = []
    if "year" in filters:
        years = [int(y) for y in _values(filters["year"])]
        spans.append((min(years) * 12, max(years) * 12 + 11))
    if "year_month" in filters:
        months = [int(m[:4]) * 12 + int(m[5:7]) - 1 for m in _values(filters["year_month"])]
        spans.append((min(months), max(months)))
    if not spans:
        return None
    low, high = max(a for a, _ in spans), min(b for _, b in spans)
    low = min(low - before, low // 12 * 12) if from_january else low - before
    label = lambda n: f"{n // 12:04d}-{n % 12 + 1:02d}"
    return label(low), label(high)


def _in_range(orders: DataFrame, months: tuple[str, str] | None) -> DataFrame:
    return orders if months is None else orders.filter(F.col("year_month").between(*months))


def order_parts(tables: Tables, by: Sequence[str] = (), filters: Filters | None = None) -> DataFrame:
    """One row per order (per order and attribute value for item attributes) with all measure parts.

    An order counts once for each category or seller it has an item of, and once in a total.
    """
    filters = filters or {}
    used = list(dict.fromkeys([*by, *filters]))
    unknown = set(used) - {*ORDER_ATTRIBUTES, *CUSTOMER_ATTRIBUTES, *ITEM_ATTRIBUTES}
    if unknown:
        raise ValueError(f"no such attribute: {', '.join(sorted(unknown))}")

    orders = tables["fact_orders"]
    month = F.col("year_month") if "year_month" in orders.columns else F.date_format("purchase_date", "yyyy-MM")
    orders = orders.withColumns({
        "year_month": month, "year": F.year("purchase_date"), "quarter": F.quarter("purchase_date"),
        "lateness_bucket": fr.lateness_bucket(F.col("days_late"), fr.NOT_DELIVERED)})
    months = _months_between(filters)
    orders = _keep(_in_range(orders, months), _only(filters, ORDER_ATTRIBUTES))
    people = tables["dim_customer"].select("customer_id", "customer_unique_id", *CUSTOMER_ATTRIBUTES)
    orders = orders.join(people, "customer_id", "left")
    orders = _keep(orders, _only(filters, CUSTOMER_ATTRIBUTES))
    if set(used) & set(ITEM_ATTRIBUTES):
        orders = orders.join(_bridge(tables, by, filters, months), "order_id")

    orders = orders.join(fr.review_totals(tables, months), "order_id", "left")
    labels = tables["review_ai_labels"].groupBy("order_id").agg(
        F.count(F.lit(1)).alias("labelled"),
        F.count_if(F.col("sentiment") == "negative").alias("negative"),
        F.count_if(F.col("urgency") == "high").alias("urgent"))
    return orders.join(labels, "order_id", "left")


def _bridge(tables: Tables, by: Sequence[str], filters: Filters, months: tuple[str, str] | None = None) -> DataFrame:
    """Orders with an item that passes the filters, once per combination of the grouped attributes of its items."""
    items = fr.of_months(tables["fact_order_items"], months).select("order_id", "product_id", "seller_id")
    if "category" in {*by, *filters}:
        items = items.join(tables["dim_product"].select("product_id", "category"), "product_id")
    items = _keep(items, _only(filters, ITEM_ATTRIBUTES))
    return items.select("order_id", *[a for a in by if a in ITEM_ATTRIBUTES]).distinct()


def _grouping_sets(by: list[str], totals: str) -> list[list[str]]:
    if totals == "rollup":
        return [by[:n] for n in range(len(by), -1, -1)]
    return [[c for i, c in enumerate(by) if not level >> (len(by) - 1 - i) & 1] for level in range(2 ** len(by))]


def _level(by: list[str], kept: list[str]) -> int:
    """The grouping number: one bit per column, set where it is totalled."""
    return sum(1 << (len(by) - 1 - i) for i, c in enumerate(by) if c not in kept)


def _with_item_totals(tables: Tables, by: list[str], filters: Filters, totals: str) -> DataFrame:
    """Sums of order parts and customers per grouping set, marked by ``level``: everything is read and joined once.

    A total over categories or sellers counts an order once. So orders meet one row per kept combination of their items'
    attributes for each choice of kept item attributes, and the first of these rows stands for the total over all. An order has
    one value of each order attribute, so sums are made for the finest set of each choice only and added up for its other
    sets from the grouped rows. Distinct customers do not add up: those of a delivered order get rows of their own, without
    parts, for each set.
    """
    sets = _grouping_sets(by, totals)
    of_items, of_orders = ([c for c in by if (c in ITEM_ATTRIBUTES) == wanted] for wanted in (True, False))
    choices = list(dict.fromkeys(tuple(c for c in kept if c in of_items) for kept in sets))
    sets_of = [[kept for kept in sets if tuple(c for c in kept if c in of_items) == choice] for choice in choices]
    pick = lambda names, kept, name="{}": [F.when(F.lit(c in kept), F.col(c)).alias(name.format(c)) for c in names]

    reduced = _bridge(tables, of_items, filters, _months_between(filters))
    told = [(i, kept) for i, kept in enumerate(choices) if kept]
    if len(told) == 1:
        reduced = reduced.withColumn("_choice", F.lit(told[0][0]))
    else:
        chosen = F.array(*(F.struct(*pick(of_items, kept), F.lit(i).alias("_choice")) for i, kept in told))
        reduced = reduced.select("order_id", F.inline(chosen)).distinct()
    place = F.row_number().over(Window.partitionBy("order_id").orderBy("_choice", *of_items))
    reduced = reduced.withColumn("_first", place == 1)
    rows = order_parts(tables, of_orders, {k: v for k, v in filters.items() if k not in ITEM_ATTRIBUTES})
    # An order without items counts in the totals, unless items are filtered.
    rows = rows.join(reduced, "order_id", "inner" if set(filters) & set(ITEM_ATTRIBUTES) else "left")

    counted = (F.col("order_status") == fr.DELIVERED) & F.col("customer_unique_id").isNotNull()

    def repeated(choice: int) -> Column:
        finest = {c for kept in sets_of[choice] for c in kept}
        one = F.struct(*pick(by, finest, "_{}"), F.lit(choice).alias("_of"), F.lit(None).cast("bigint").alias("level"),
                       F.lit(None).cast("string").alias("_person"))
        of_person = [F.struct(*pick(by, kept, "_{}"), F.lit(None).cast("int").alias("_of"),
                              F.lit(_level(by, kept)).cast("bigint").alias("level"),
                              F.col("customer_unique_id").cast("string").alias("_person")) for kept in sets_of[choice]]
        return F.when(counted, F.array(one, *of_person)).otherwise(F.array(one))

    own = F
    for i, _ in told:
        own = own.when(F.col("_choice") == i, repeated(i))
    total = repeated(choices.index(()))
    each = F.when(F.col("_choice").isNull(), total).when(F.col("_first"), F.concat(own, total)).otherwise(own)
    parts = ["order_status", "is_late", "order_value", "delivery_days", "reviews", "scored", "points", "low",
             "labelled", "negative", "urgent"]
    spread = rows.select(*parts, "customer_unique_id", *by, "_choice", "_first").select(*parts, F.inline(each)).select(
        *(F.when(F.col("_of").isNotNull(), F.col(c)).alias(c) for c in parts), *(f"_{c}" for c in by), "_of", "level", "_person")
    grouped = spread.groupBy(*(f"_{c}" for c in by), "_of", "level").agg(
        *_sums(), F.count_distinct("_person").alias("customers"))
    sums = [c for c in grouped.columns if c not in {"_of", "level", *(f"_{c}" for c in by)}]

    def added(choice: int) -> Column:
        return F.array(*(F.struct(*(F.when(F.lit(c in kept), F.col(f"_{c}")).alias(c) for c in by),
                                  F.lit(_level(by, kept)).cast("bigint").alias("level")) for kept in sets_of[choice]))

    wanted = F.when(F.col("level").isNotNull(), F.array(F.struct(*(F.col(f"_{c}").alias(c) for c in by), "level")))
    for i in range(len(choices)):
        wanted = wanted.when(F.col("_of") == i, added(i))
    return grouped.select(*sums, F.inline(wanted)).groupBy(*by, "level").agg(*(F.sum(c).alias(c) for c in sums))


def _measures() -> list[Column]:
    """Sums of order parts, and the customers with a delivered order."""
    delivered = F.col("order_status") == fr.DELIVERED
    return [*_sums(), F.count_distinct(F.when(delivered, F.col("customer_unique_id"))).alias("customers")]


def _sums() -> list[Column]:
    """Sums of order parts."""
    status, is_late = F.col("order_status"), F.col("is_late")
    delivered = status == fr.DELIVERED
    return [
        F.count_if(delivered).alias("delivered_orders"),
        F.sum(F.when(delivered, F.col("order_value"))).alias("_revenue"),
        F.count_if(is_late == 1).alias("late_orders"),
        F.count(is_late).alias("_known"),
        F.sum(F.when(delivered, fr.tenths(F.col("delivery_days")))).alias("_days"),
        F.count(F.when(delivered, F.col("delivery_days"))).alias("_timed"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(f"_{c}") for c in ("reviews", "scored", "points", "low")],
        *[F.sum(F.when(is_late == flag, F.col(c))).alias(f"_{c}_{flag}")
          for c in ("scored", "points") for flag in (0, 1)],
        F.coalesce(F.sum("labelled"), F.lit(0)).alias("labelled_reviews"),
        F.coalesce(F.sum("negative"), F.lit(0)).alias("negative_reviews"),
        F.coalesce(F.sum("urgent"), F.lit(0)).alias("high_urgency_reviews"),
    ]


def measures(tables: Tables, by: Sequence[str] = (), filters: Filters | None = None,
             totals: str | None = None) -> DataFrame:
    """All measures per group. ``totals`` is ``rollup`` or ``cube`` for total rows, marked by ``level``,
    the grouping number (0 for a full group)."""
    by = list(by)
    if totals and set(by) & set(ITEM_ATTRIBUTES):
        grouped, keys = _with_item_totals(tables, by, filters or {}, totals), [*by, "level"]
    else:
        parts = order_parts(tables, by, filters)
        if totals:
            grouped = getattr(parts, totals)(*by).agg(F.grouping_id().cast("bigint").alias("level"), *_measures())
            keys = [*by, "level"]
        else:
            grouped, keys = parts.groupBy(*by).agg(*_measures()), by
    return _finished(grouped, keys)


def _finished(grouped: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Measures from their sums."""
    score = {flag: ratio(F.col(f"_points_{flag}"), F.col(f"_scored_{flag}")) for flag in (0, 1)}
    return grouped.select(
        *keys,
        "delivered_orders",
        F.col("_revenue").cast("double").alias("revenue"),
        ratio(F.col("_revenue"), F.col("delivered_orders")).alias("avg_order_value"),
        "customers",
        "late_orders",
        ratio(F.col("late_orders"), F.col("_known")).alias("late_delivery_pct"),
        ratio(F.col("_days"), F.col("_timed") * 10).alias("avg_delivery_days"),
        ratio(F.col("_points"), F.col("_scored")).alias("avg_review_score"),
        ratio(F.col("_low"), F.col("_reviews")).alias("pct_1_2_star_reviews"),
        (score[0] - score[1]).alias("score_gap_late_vs_on_time"),
        "labelled_reviews", "negative_reviews",
        ratio(F.col("negative_reviews"), F.col("labelled_reviews")).alias("negative_share"),
        "high_urgency_reviews")


def _daily(tables: Tables, by: list[str], filters: Filters, months: tuple[str, str] | None) -> DataFrame:
    """Revenue per group and day with delivered orders. Item attributes count an order once per kept value."""
    orders = fr.with_month(fr.delivered_orders(tables))
    orders = _in_range(orders, months)
    if {*by, *filters} & set(CUSTOMER_ATTRIBUTES):
        people = tables["dim_customer"].select("customer_id", *CUSTOMER_ATTRIBUTES)
        orders = orders.join(people, "customer_id", "left")
    orders = _keep(orders, {k: v for k, v in filters.items() if k not in ITEM_ATTRIBUTES})
    if {*by, *filters} & set(ITEM_ATTRIBUTES):
        orders = orders.join(_bridge(tables, by, filters, months), "order_id")
    return orders.groupBy(*by, "purchase_date", "year_month").agg(F.sum("order_value").alias("value"))


def revenue_over_time(tables: Tables, by: Sequence[str] = (), filters: Filters | None = None) -> DataFrame:
    """Per month: revenue, previous calendar month, change, year to date, and the three-month day mean.

    Months come from the calendar, so a month without a delivered order still has a year to date; a month without any
    value is left out. The previous month is the calendar month before, null when it has no revenue. The rolling mean
    is the mean of the revenue of days that have any, over the month and the two calendar months before it. Date
    filters (year, quarter, year_month) choose the months shown and leave their values as they are; all
    other filters choose the orders. All windows run over one row per group and month.
    """
    by, filters = list(by), filters or {}
    shown = _only(filters, DATE_ATTRIBUTES)
    unknown = {*by, *filters} - {*ORDER_ATTRIBUTES, *CUSTOMER_ATTRIBUTES, *ITEM_ATTRIBUTES}
    if unknown or set(by) & set(DATE_ATTRIBUTES):
        raise ValueError(f"cannot group or filter by {', '.join(sorted(unknown or set(by) & set(DATE_ATTRIBUTES)))}")
    needed = _months_between(shown, before=2, from_january=True)
    chosen = {k: v for k, v in filters.items() if k not in shown}
    monthly = _daily(tables, by, chosen, needed).groupBy(*by, "year_month").agg(
        F.sum("value").alias("value"), F.count("value").alias("days"))
    calendar = tables["dim_date"].select("year_month").distinct()
    axis = _in_range(calendar, needed)
    if by:
        # The months of the calendar are few, twelve a year; each group of the result gets them all.
        months = sorted(row["year_month"] for row in axis.collect())
        listed = F.array(*map(F.lit, months)).cast("array<string>")
        axis = monthly.select(*by).distinct().select(*by, F.explode(listed).alias("year_month"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"m.{c}")) for c in [*by, "year_month"]]
    monthly = (axis.alias("a").join(monthly.alias("m"), same, "left")
               .select(*(F.col(f"a.{c}").alias(c) for c in [*by, "year_month"]), "value", "days")
               .withColumn("_month", month_index(F.col("year_month"))))
    months = Window.partitionBy(*by).orderBy("_month")
    year = Window.partitionBy(*by, F.substring("year_month", 1, 4)).orderBy("_month")
    wide = monthly.select(
        *by, "year_month", "value",
        F.sum("value").over(months.rangeBetween(-1, -1)).alias("before"),
        F.sum("value").over(year.rowsBetween(Window.unboundedPreceding, 0)).alias("to_date"),
        F.sum("value").over(months.rangeBetween(-2, 0)).alias("near"),
        F.sum("days").over(months.rangeBetween(-2, 0)).alias("near_days"))
    wide = wide.filter(F.coalesce("value", "before", "to_date", "near").isNotNull())
    if shown:
        month = F.substring("year_month", 6, 2).cast("int")
        wide = _keep(wide.withColumns({"year": F.substring("year_month", 1, 4).cast("int"),
                                       "quarter": F.ceil(month / 3).cast("int")}), shown)
    return wide.select(
        *by, "year_month",
        F.col("value").cast("double").alias("revenue"),
        F.col("before").cast("double").alias("revenue_pm"),
        ratio(F.col("value") - F.col("before"), F.col("before")).alias("revenue_mom"),
        F.col("to_date").cast("double").alias("revenue_ytd"),
        ratio(F.col("near"), F.col("near_days")).alias("revenue_3m_rolling_avg"))


def _labelled_rows(tables: Tables, used: set[str], filters: Filters) -> DataFrame:
    """Labels with the attributes in use. The category of an order is that of its first item; an order counts once for each
    seller it has an item of."""
    labels = _keep(tables["review_ai_labels"], _only(filters, LABEL_ATTRIBUTES))
    if used & {*ORDER_ATTRIBUTES, *CUSTOMER_ATTRIBUTES}:
        orders = tables["fact_orders"]
        if "year_month" not in orders.columns:
            orders = orders.withColumn("year_month", F.date_format("purchase_date", "yyyy-MM"))
        orders = orders.withColumns({
            "year": F.year("purchase_date"), "quarter": F.quarter("purchase_date"),
            "lateness_bucket": fr.lateness_bucket(F.col("days_late"), fr.NOT_DELIVERED)})
        months = _months_between(filters)
        orders = _keep(_in_range(orders, months), _only(filters, ORDER_ATTRIBUTES))
        if used & set(CUSTOMER_ATTRIBUTES):
            people = tables["dim_customer"].select("customer_id", *CUSTOMER_ATTRIBUTES)
            orders = _keep(orders.join(people, "customer_id", "left"), _only(filters, CUSTOMER_ATTRIBUTES))
        wanted = [c for c in (*ORDER_ATTRIBUTES, *CUSTOMER_ATTRIBUTES) if c in used]
        labels = labels.join(orders.select("order_id", *wanted), "order_id")
    if "category" in used:
        labels = _keep(fr.with_first_category(labels, tables), _only(filters, ["category"]))
    if "seller_id" in used:
        sellers = tables["fact_order_items"].select("order_id", "seller_id").distinct()
        labels = labels.join(_keep(sellers, _only(filters, ["seller_id"])), "order_id")
    return labels


def label_measures(tables: Tables, by: Sequence[str] = ("topic",), filters: Filters | None = None) -> DataFrame:
    """Label counts per group; ``topic_share`` is the share of the complaints of a group in those of the same group over
    all topics.

    Groups and filters may be label, order, customer and item attributes. A topic filter chooses what is counted and
    is left out of the whole that the share is taken of.
    """
    by, filters = list(by), filters or {}
    used = {*by, *filters}
    unknown = used - {*LABEL_ATTRIBUTES, *ORDER_ATTRIBUTES, *CUSTOMER_ATTRIBUTES, *ITEM_ATTRIBUTES}
    if unknown:
        raise ValueError(f"no such attribute: {', '.join(sorted(unknown))}")
    labels = _labelled_rows(tables, used, {k: v for k, v in filters.items() if k != "topic"})
    wanted = F.col("topic").isin(*_values(filters["topic"])) if "topic" in filters else F.lit(True)
    negative = F.col("sentiment") == "negative"
    grouped = labels.groupBy(*by).agg(
        F.count_if(wanted).alias("labelled_reviews"),
        F.count_if(wanted & negative).alias("negative_reviews"),
        F.count_if(wanted & (F.col("urgency") == "high")).alias("high_urgency_reviews"),
        F.count_if(negative).alias("_complaints"))
    # Over the grouped rows: one per group and topic.
    all_topics = F.sum("_complaints").over(Window.partitionBy(*[c for c in by if c != "topic"]))
    return grouped.select(
        *by, "labelled_reviews", "negative_reviews",
        ratio(F.col("negative_reviews"), F.col("labelled_reviews")).alias("negative_share"),
        "high_urgency_reviews",
        ratio(F.col("negative_reviews"), all_topics).alias("topic_share")).filter("labelled_reviews > 0")


def overview_title(tables: Tables, filters: Filters | None = None) -> DataFrame:
    """The headline of the overview page as text."""
    one = measures(tables, (), filters)
    revenue = F.format_number(F.round(F.col("revenue").cast("decimal(28,2)"), 0), 0)
    late = F.format_number(F.round(F.col("late_delivery_pct").cast("decimal(20,15)") * 100, 1), 1)
    return one.select(F.concat(F.lit("Revenue R$ "), revenue, F.lit(" · Late deliveries "), late, F.lit("%")).alias("title"))


def seller_watch_list(tables: Tables, min_orders: int = 100) -> DataFrame:
    """Sellers with enough delivered orders, lowest score first."""
    return (measures(tables, ["seller_id"]).filter(F.col("delivered_orders") >= min_orders)
            .select("seller_id", "delivered_orders", "avg_review_score", "late_delivery_pct")
            .orderBy("avg_review_score", "seller_id"))


def state_table(tables: Tables) -> DataFrame:
    return measures(tables, ["state"]).select(
        "state", "late_delivery_pct", "avg_delivery_days", "avg_review_score")


def score_by_bucket(tables: Tables) -> DataFrame:
    """Average score per lateness bucket with the orders that were not delivered."""
    return measures(tables, ["lateness_bucket"]).select("lateness_bucket", "avg_review_score", "late_orders")
