"""Tables, keys and relations of the star schema, and the raw files it is built from."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


_S, _I, _D = T.StringType(), T.IntegerType(), T.DoubleType()

# ---- Fixed values: column names of the raw marketplace files. --------------------------------
RAW_SCHEMAS: dict[str, T.StructType] = {
    "orders": _struct(
        order_id=_S, customer_id=_S, order_status=_S, order_purchase_timestamp=_S,
        order_delivered_customer_date=_S, order_estimated_delivery_date=_S),
    "items": _struct(
        order_id=_S, order_item_id=_I, product_id=_S, seller_id=_S, price=MONEY, freight_value=MONEY),
    "payments": _struct(
        order_id=_S, payment_type=_S, payment_installments=_I, payment_value=MONEY),
    "reviews": _struct(
        review_id=_S, order_id=_S, review_score=_I, review_comment_title=_S,
        review_comment_message=_S, review_creation_date=_S),
    "customers": _struct(
        customer_id=_S, customer_unique_id=_S, customer_city=_S, customer_state=_S),
    "products": _struct(
        product_id=_S, product_category_name=_S, product_weight_g=_D, product_photos_qty=_I),
    "sellers": _struct(seller_id=_S, seller_city=_S, seller_state=_S),
    "translation": _struct(product_category_name=_S, product_category_name_english=_S),
}

# The files keep their published names; the leading part differs per publisher, hence the globs.
RAW_FILES: dict[str, str] = {
    "orders": "*_orders_dataset.csv",
    "items": "*_order_items_dataset.csv",
    "payments": "*_order_payments_dataset.csv",
    "reviews": "*_order_reviews_dataset.csv",
    "customers": "*_customers_dataset.csv",
    "products": "*_products_dataset.csv",
    "sellers": "*_sellers_dataset.csv",
    "translation": "product_category_name_translation.csv",
}
# Only these hold line breaks inside quotes; the other files are read line by line.
MULTILINE_FILES = {"reviews"}

LABEL_COLUMNS = ["review_id", "order_id", "sentiment", "topic", "urgency", "summary_en", "provider"]
GOLD_COLUMNS = ["review_id", "order_id", "review_score", "comment_message", "gold_sentiment", "gold_topic"]
REVIEW_KEY = ["review_id", "order_id"]

STAR_TABLES = [
    "dim_customer", "dim_product", "dim_seller", "dim_date",
    "fact_orders", "fact_order_items", "fact_reviews", "review_ai_labels",
]

PRIMARY_KEYS: dict[str, list[str]] = {
    "dim_customer": ["customer_id"],
    "dim_product": ["product_id"],
    "dim_seller": ["seller_id"],
    "dim_date": ["date_key"],
    "fact_orders": ["order_id"],
    "fact_order_items": ["order_id", "order_item_id"],
    "fact_reviews": ["review_id", "order_id"],
    "review_ai_labels": ["review_id", "order_id"],
}

# (child, child columns, parent, parent columns)
FOREIGN_KEYS: list[tuple[str, list[str], str, list[str]]] = [
    ("fact_orders", ["customer_id"], "dim_customer", ["customer_id"]),
    ("fact_orders", ["purchase_date"], "dim_date", ["date_key"]),
    ("fact_order_items", ["order_id"], "fact_orders", ["order_id"]),
    ("fact_order_items", ["product_id"], "dim_product", ["product_id"]),
    ("fact_order_items", ["seller_id"], "dim_seller", ["seller_id"]),
    ("fact_reviews", ["order_id"], "fact_orders", ["order_id"]),
    ("review_ai_labels", ["review_id", "order_id"], "fact_reviews", ["review_id", "order_id"]),
]

NOT_NULL: list[tuple[str, str]] = [("dim_customer", "customer_unique_id")]
