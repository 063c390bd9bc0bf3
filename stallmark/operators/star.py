"""Raw tables -> star schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import half_even_tenths
from ..functions.text import clean_text
from ..functions.time import coerce_ts
from ..schemas import MONEY, REVIEW_KEY


def dim_customer(customers: DataFrame) -> DataFrame:
    return customers.select(
        "customer_id", "customer_unique_id",
        F.col("customer_city").alias("city"), F.col("customer_state").alias("state"))


def dim_seller(sellers: DataFrame) -> DataFrame:
    return sellers.select(
        "seller_id", F.col("seller_city").alias("city"), F.col("seller_state").alias("state"))


def dim_product(products: DataFrame, translation: DataFrame) -> DataFrame:
    """Category in English where translated, else as it is, else ``unknown``.

    No broadcast hint: the size of the translation table decides.
    """
    return (products.join(translation, "product_category_name", "left")
            .select(
                "product_id",
                F.coalesce("product_category_name_english", "product_category_name",
                           F.lit("unknown")).alias("category"),
                F.col("product_weight_g").cast("double").alias("weight_g"),
                F.col("product_photos_qty").cast("int").alias("photos_qty")))


def dim_date(orders: DataFrame) -> DataFrame:
    """Every day between the first and the last purchase: one row per calendar day."""
    day = F.to_date(coerce_ts(orders, "order_purchase_timestamp"))
    span = orders.agg(F.min(day).alias("first"), F.max(day).alias("last"))
    days = span.filter(F.col("first").isNotNull()).select(
        F.explode(F.sequence("first", "last", F.expr("interval 1 day"))).alias("date_key"))
    return days.select(
        "date_key",
        F.year("date_key").alias("year"),
        F.quarter("date_key").alias("quarter"),
        F.month("date_key").alias("month"),
        F.date_format("date_key", "MMM").alias("month_name"),
        F.date_format("date_key", "yyyy-MM").alias("year_month"),
        F.date_format("date_key", "EEE").alias("weekday"))


def order_totals(items: DataFrame) -> DataFrame:
    return items.groupBy("order_id").agg(
        F.sum("price").cast(MONEY).alias("order_value"),
        F.sum("freight_value").cast(MONEY).alias("freight_value"))


def main_payment(payments: DataFrame) -> DataFrame:
    """Type and instalments of the largest payment of each order.

    A minimum over a struct is combined before the shuffle, so an order with very many payments is no
    burden on one task. Equal values are decided by type, then by instalments.
    """
    best = F.min(F.struct(
        F.col("payment_value").isNull().alias("missing"),
        (-F.col("payment_value")).alias("descending"),
        F.col("payment_type").alias("payment_type"),
        F.col("payment_installments").alias("installments")))
    return (payments.groupBy("order_id").agg(best.alias("best"))
            .select("order_id", "best.payment_type", "best.installments"))


def days_between(start: Column, end: Column) -> Column:
    return half_even_tenths(F.timestamp_diff("SECOND", start, end) / F.lit(86400.0))


def fact_orders(orders: DataFrame, items: DataFrame, payments: DataFrame) -> DataFrame:
    """One row per order. All three inputs meet on ``order_id``; totals and payments are aggregated first."""
    timed = orders.select(
        "order_id", "customer_id", "order_status",
        coerce_ts(orders, "order_purchase_timestamp").alias("purchase_ts"),
        coerce_ts(orders, "order_delivered_customer_date").alias("delivered_ts"),
        coerce_ts(orders, "order_estimated_delivery_date").alias("estimated_delivery_ts"))
    purchase, delivered, estimated = (
        F.col(c) for c in ("purchase_ts", "delivered_ts", "estimated_delivery_ts"))
    return (timed
            .join(order_totals(items), "order_id", "left")
            .join(main_payment(payments), "order_id", "left")
            .select(
                "order_id", "customer_id", "order_status", "purchase_ts",
                F.to_date(purchase).alias("purchase_date"),
                "delivered_ts", "estimated_delivery_ts",
                days_between(purchase, delivered).alias("delivery_days"),
                days_between(estimated, delivered).alias("days_late"),
                F.when(delivered.isNotNull(), F.coalesce(delivered > estimated, F.lit(False)).cast("int"))
                .alias("is_late"),
                "order_value", "freight_value", "payment_type", "installments"))


def fact_order_items(items: DataFrame) -> DataFrame:
    return items.select("order_id", "order_item_id", "product_id", "seller_id", "price", "freight_value")


def dedup_reviews(reviews: DataFrame) -> DataFrame:
    """One row per (review, order): the earliest created, further ties by the other columns.

    Combined before the shuffle, so a key with very many copies costs one row per map task.
    """
    rest = [c for c in ("review_creation_date", "review_score", "review_comment_title",
                        "review_comment_message") if c in reviews.columns]
    return (reviews.groupBy(*REVIEW_KEY)
            .agg(F.min(F.struct(*rest)).alias("first"))
            .select(*REVIEW_KEY, "first.*"))


def fact_reviews(reviews: DataFrame) -> DataFrame:
    unique = dedup_reviews(reviews)
    return unique.select(
        *REVIEW_KEY, "review_score",
        clean_text(F.col("review_comment_title")).alias("comment_title"),
        clean_text(F.col("review_comment_message")).alias("comment_message"),
        F.to_date(coerce_ts(unique, "review_creation_date")).alias("review_date"))


def review_key(reviews: DataFrame) -> DataFrame:
    """Add ``review_key``, the single-column form of the two-column key."""
    return reviews.withColumn("review_key", F.concat_ws("|", *REVIEW_KEY))


def build_star(raw: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {
        "dim_customer": dim_customer(raw["customers"]),
        "dim_product": dim_product(raw["products"], raw["translation"]),
        "dim_seller": dim_seller(raw["sellers"]),
        "dim_date": dim_date(raw["orders"]),
        "fact_orders": fact_orders(raw["orders"], raw["items"], raw["payments"]),
        "fact_order_items": fact_order_items(raw["items"]),
        "fact_reviews": fact_reviews(raw["reviews"]),
    }
