"""A log of replies with SQL statements, one per event: the text follows from the event's number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .derived import read_input

TEMPLATES = [
    "SELECT state FROM dim_customer WHERE city = '{type}'",
    "This counts them:\n```sql\nSELECT count(*) AS n FROM fact_orders WHERE order_value > {user};\n```\nAnything else?",
    "WITH big AS (SELECT order_id FROM fact_orders) SELECT max(order_id) FROM big LIMIT {user}",
    "TRUNCATE TABLE dim_seller -- {user}",
    "SELECT 2 AS two; SELECT city FROM dim_seller",
    "SELECT * FROM fact_reviews WHERE comment_message LIKE '%insert; {type}%'",
    "SELECT * FROM hidden_{type} JOIN dim_seller ON true",
    "Sure. select a.state /* drop everything */ from dim_customer a join dim_date d on true -- update later\n where a.city = 'x;y'",
    "I cannot answer that, {type}",
    "   \n ",
    "```\nSELECT category FROM dim_product ORDER BY category limit 5\n```",
    "SELECT order_id FROM fact_orders WHERE note = 'it''s {props}' LIMIT 10 OFFSET {user}",
    "update dim_product set category = '{type}'",
    "WITH a AS (SELECT 1 AS x), b AS (SELECT * FROM a) SELECT * FROM b JOIN c{user} ON true",
    "SELECT created_at FROM fact_orders WHERE id = {user};;",
    "SELECT CREATE FROM dim_date WHERE v = {value}",
]


def replies(spark: SparkSession, path: str) -> DataFrame:
    events = read_input(spark, path, "events")
    text = F.element_at(F.array(*[F.lit(t) for t in TEMPLATES]), (F.col("event_id") % len(TEMPLATES) + 1).cast("int"))
    for name, value in {"{user}": F.col("user_id").cast("string"), "{type}": F.col("event_type"),
                        "{props}": F.col("props"), "{value}": F.col("value").cast("string")}.items():
        text = F.replace(text, F.lit(name), value)
    return events.select("event_id", text.alias("reply"))


def sql_text() -> str:
    items = ", ".join("'" + t.replace("'", "''") + "'" for t in TEMPLATES)
    text = f"([{items}])[(event_id % {len(TEMPLATES)} + 1)::INT]"
    for name, value in {"{user}": "user_id::VARCHAR", "{type}": "event_type", "{props}": "props",
                        "{value}": "value::VARCHAR"}.items():
        text = f"replace({text}, '{name}', {value})"
    return text
