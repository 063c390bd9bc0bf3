"""The star schema as Parquet, and its export as CSV."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import year_month
from ..operators.quality import table_counts

PURCHASE_MONTH = "purchase_month"
BY_ORDER = ("fact_order_items", "fact_reviews")
EXPORT_TEXT = 300  # fixed value: review text in the export is cut to this length


def write_star(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Write every table anew and return (name, rows).

    Orders are partitioned by month, items and reviews by the month their order was bought in (``purchase_month``), so
    that a period of orders is a period of all three. The rebalance hint gives each month files of the advised size: small
    months share a task, a month with a large part of the rows is spread over many. The tables are written
    side by side, so that the last tasks of one do not leave the executors idle.
    """
    spark = next(iter(tables.values())).sparkSession

    def by_month(df: DataFrame, month: str, name: str) -> None:
        df.hint("rebalance", month).write.mode("overwrite").partitionBy(month).parquet(f"{path}/{name}")

    def write(name: str) -> None:
        if name == "fact_orders":
            by_month(tables[name].withColumn("year_month", year_month(F.col("purchase_date"))), "year_month", name)
        else:
            tables[name].write.mode("overwrite").parquet(f"{path}/{name}")

    def write_with_orders(name: str) -> None:
        """After the orders: their month is read back, not computed again."""
        months = spark.read.parquet(f"{path}/fact_orders").select(
            "order_id", F.col("year_month").cast("string").alias(PURCHASE_MONTH))
        rows = tables[name].drop(PURCHASE_MONTH)
        by_month(rows.join(months, "order_id", "left").select(*rows.columns, PURCHASE_MONTH), PURCHASE_MONTH, name)

    after = [name for name in BY_ORDER if name in tables and "fact_orders" in tables]
    with ThreadPoolExecutor(len(tables)) as pool:
        first = {name: pool.submit(write, name) for name in tables if name not in after}
        if after:
            first["fact_orders"].result()
        for job in [*first.values(), *[pool.submit(write_with_orders, name) for name in after]]:
            job.result()
    return table_counts(read_star(spark, path, list(tables)))


def read_star(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    """Stored tables. Month labels stay text."""
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in names}
    for name, df in tables.items():
        for month in {"year_month", PURCHASE_MONTH} & set(df.columns) if name.startswith("fact_") else ():
            df = df.withColumn(month, F.col(month).cast("string"))
        tables[name] = df
    return tables


def export_columns(tables: dict[str, DataFrame], max_text: int | None = EXPORT_TEXT) -> dict[str, DataFrame]:
    """What the export holds: all tables, review text cut to ``max_text`` characters (whole with None), no titles."""
    message = F.col("comment_message") if max_text is None else F.substring("comment_message", 1, max_text)
    out = {name: df.drop(PURCHASE_MONTH) for name, df in tables.items()}
    if "fact_orders" in out:
        out["fact_orders"] = out["fact_orders"].drop("year_month")
    if "fact_reviews" in out:
        out["fact_reviews"] = out["fact_reviews"].select(
            "review_id", "order_id", "review_score", "review_date",
            message.alias("comment_message"))
    return out


def export_csv(tables: dict[str, DataFrame], path: str, max_text: int | None = EXPORT_TEXT) -> DataFrame:
    """One CSV folder per table, written side by side; returns (name, rows)."""
    chosen = export_columns(tables, max_text)

    def write(name: str) -> None:
        (chosen[name].write.mode("overwrite").option("header", True).option("escape", '"')
         .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").option("dateFormat", "yyyy-MM-dd")
         .csv(f"{path}/{name}"))

    with ThreadPoolExecutor(max(1, len(chosen))) as pool:
        for job in [pool.submit(write, name) for name in chosen]:
            job.result()
    return table_counts(chosen)
