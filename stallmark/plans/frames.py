"""Building blocks shared by the queries, the BI measures and the KPI pack.

Joins between the facts multiply rows on purpose: an order with two reviews counts twice wherever a query
joins orders or items with reviews. Here that is computed with multiplicities: reviews are first reduced to
one row per order with their number and sums, and each measure is weighted. The results are those of the
multiplied rows, but no join ever emits more rows than its larger input, distinct counts of orders become
plain counts, and an order with very many reviews or items is combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.time import year_month

Tables = dict[str, DataFrame]

DELIVERED = "delivered"

# Names of the lateness buckets.
LATENESS_BUCKETS = [
    "1. 7+ days early",
    "2. 0-7 days early",
    "3. 1-3 days late",
    "4. 4-7 days late",
    "5. 8+ days late",
]
NOT_DELIVERED = "Not delivered"


def lateness_bucket(days_late: Column, missing: str | None = None) -> Column:
    """Buckets (-inf, -7], (-7, 0], (0, 3], (3, 7], (7, inf); ``missing`` names the null ones."""
    early, soon, late, later, latest = LATENESS_BUCKETS
    bucket = (F.when(days_late <= -7, early).when(days_late <= 0, soon)
              .when(days_late <= 3, late).when(days_late <= 7, later))
    if missing is None:
        return bucket.otherwise(latest)
    return bucket.when(days_late.isNotNull(), latest).otherwise(missing)


def delivery_word(is_late: Column) -> Column:
    return F.when(is_late == 1, "Late").otherwise("On time")


def delivered_orders(tables: Tables) -> DataFrame:
    return tables["fact_orders"].filter(F.col("order_status") == DELIVERED)


def with_month(orders: DataFrame) -> DataFrame:
    """Orders with ``year_month``; stored orders are partitioned by it, so filters on it prune files.

    The calendar has every day between the first and the last purchase, so joining it would neither drop
    nor add an order that has a purchase date.
    """
    if "year_month" not in orders.columns:
        orders = orders.withColumn("year_month", year_month(F.col("purchase_date")))
    return orders.filter(F.col("purchase_date").isNotNull())


def of_months(table: DataFrame, months: tuple[str, str] | None) -> DataFrame:
    """Items or reviews of orders bought from the first to the last month given; a stored table reads only those files.
    Tables that do not carry the month stay as they are, to be joined with the orders chosen."""
    if months is None or "purchase_month" not in table.columns:
        return table
    return table.filter(F.col("purchase_month").between(*months))


def review_totals(tables: Tables, months: tuple[str, str] | None = None) -> DataFrame:
    """One row per order with reviews: how many, how many with a score, and the score sums."""
    score = F.col("review_score")
    return of_months(tables["fact_reviews"], months).groupBy("order_id").agg(
        F.count(F.lit(1)).alias("reviews"),
        F.count(score).alias("scored"),
        F.coalesce(F.sum(score), F.lit(0).cast("bigint")).alias("points"),
        F.count_if(score <= 2).alias("low"),
        F.count_if(score == 3).alias("middle"))


def fan() -> Column:
    """Rows a left join with the reviews gives per order."""
    return F.greatest(F.coalesce(F.col("reviews"), F.lit(0)), F.lit(1))


def known(value: Column) -> Column:
    return value.isNotNull().cast("bigint")


def weighted(value: Column, weight: Column) -> Column:
    return F.sum(value * weight)


def tenths(days: Column) -> Column:
    """Days with one decimal as whole tenths."""
    return F.round(days * 10).cast("bigint")


def items_by_order(tables: Tables, attribute: str) -> DataFrame:
    """Items per (order, attribute): number and price sum. Distinct orders become rows."""
    items = tables["fact_order_items"]
    if attribute == "category":
        items = items.join(tables["dim_product"].select("product_id", "category"), "product_id")
    return items.groupBy("order_id", attribute).agg(
        F.count(F.lit(1)).alias("items"), F.sum("price").alias("amount"))


def with_first_category(rows: DataFrame, tables: Tables) -> DataFrame:
    """Rows with ``category``, that of item number 1 of their order. The rows, few beside all items, meet the items before
    the items meet the products."""
    first = tables["fact_order_items"].filter(F.col("order_item_id") == 1).select("order_id", "product_id")
    return (rows.join(first, "order_id")
            .join(tables["dim_product"].select("product_id", "category"), "product_id").drop("product_id"))


def first_rows(rows: DataFrame, n: int | None) -> DataFrame:
    """The first ``n`` rows; all with None."""
    return rows if n is None else rows.limit(n)
