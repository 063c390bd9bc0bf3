"""BI measures kept by month: totals, cubes and slicers merge stored rows and read no orders.

A store has three tables. ``cells`` holds the sums of all measures for each month and combination of the attributes it was made
for. ``people`` gives each customer a number, in the order of their first month, so that those of a month lie close
together. ``buyers`` holds, for the same combinations, bitmaps of the numbers of customers with a delivered order: words
of 64 numbers each, merged by OR, so distinct customers stay exact under any merging, and few customers take little room.

An order counts once for each category or seller it has an item of and once in a total, which sums of categories would not
give. So rows are stored for each choice of item attributes that are told apart (``choice``), and a query reads those of
its own choice.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain, combinations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.durable import keep, settle
from . import frames as fr
from . import measures as M
from .frames import Tables

PERSON = "customer_unique_id"
#: Numbers of customers in a word of bits.
WORD = 64
_COUNTS = ["delivered_orders", "late_orders", "_known", "_timed", "_reviews", "_scored", "_points", "_low",
           "labelled_reviews", "negative_reviews", "high_urgency_reviews"]
_PARTS = ["order_status", "is_late", "order_value", "delivery_days", "reviews", "scored", "points", "low", "labelled", "negative", "urgent"]
_SUMS = ["_revenue", "_days", "_scored_0", "_scored_1", "_points_0", "_points_1"]


def _choices(items: list[str]) -> list[tuple[str, ...]]:
    return list(chain.from_iterable(combinations(items, n) for n in range(len(items) + 1)))


def _parts(tables: Tables, by: list[str], months: Sequence[str] | None) -> DataFrame:
    """Order parts for each choice of item attributes, with the attributes of that choice."""
    items, others = ([c for c in by if (c in M.ITEM_ATTRIBUTES) == wanted] for wanted in (True, False))
    filters = {} if months is None else {"year_month": list(months)}
    rows = M.order_parts(tables, others, filters)
    if not items:
        return rows.withColumn("choice", F.lit(0))
    kept = _choices(items)
    span = M._months_between(filters)
    chosen = F.array(*(F.struct(*(F.when(F.lit(c in own), F.col(c)).alias(c) for c in items), F.lit(i).alias("choice"))
                       for i, own in enumerate(kept)))
    # Dealt out by order before they multiply: neither the choices nor the join with the orders move them again.
    reduced = M._bridge(tables, items, {}, span).repartition("order_id").select("order_id", F.inline(chosen)).distinct()
    # An order without items counts where none of their attributes is told apart.
    return rows.join(reduced, "order_id", "left").withColumn("choice", F.coalesce("choice", F.lit(0)))


def _numbered(people: DataFrame, after: int) -> DataFrame:
    """(customer_unique_id, person): numbers from ``after`` on in the order of ``since``; offsets come from small counts."""
    hashed = people.withColumn("_part", F.substring(F.md5(F.col(PERSON)), 1, 2))
    before = Window.orderBy("since", "_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (hashed.groupBy("since", "_part").agg(F.count(F.lit(1)).alias("_n"))
               .select("since", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    within = F.row_number().over(Window.partitionBy("since", "_part").orderBy(PERSON))
    # 256 rows for each month.
    return (hashed.join(F.broadcast(offsets), ["since", "_part"])
            .select(PERSON, (F.col("_before") + within - 1 + after).cast("long").alias("person")))


def _write(tables: Tables, path: str, by: list[str], months: Sequence[str] | None, people: DataFrame) -> None:
    # Customers go by their numbers from here on.
    numbered = tables["dim_customer"].join(people, PERSON, "left").drop(PERSON).withColumnRenamed("person", PERSON)
    keys = ["choice", *by]
    # Both tables are made of these rows, which come of joins of all facts.
    rows = keep(_parts({**tables, "dim_customer": numbered}, by, months).select(*dict.fromkeys(["year_month", *keys, *_PARTS, PERSON])))
    mode = {} if months is None else {"partitionOverwriteMode": "dynamic"}

    def store(df: DataFrame, name: str) -> None:
        (df.hint("rebalance", "year_month").write.mode("overwrite").options(**mode).partitionBy("year_month").parquet(f"{path}/{name}"))

    store(rows.groupBy("year_month", *keys).agg(*M._sums()), "cells")
    delivered = rows.filter((F.col("order_status") == fr.DELIVERED) & F.col(PERSON).isNotNull())
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col(PERSON) % WORD).cast("int"))
    store(delivered.groupBy("year_month", *keys, F.call_function("div", F.col(PERSON), F.lit(WORD).cast("bigint")).alias("word"))
          .agg(F.bit_or(one).alias("bits")), "buyers")


def _customers(tables: Tables, months: Sequence[str] | None) -> DataFrame:
    """Customers with an order, and the first month of one."""
    orders = tables["fact_orders"]
    month = F.col("year_month") if "year_month" in orders.columns else F.date_format("purchase_date", "yyyy-MM")
    orders = orders.select("customer_id", month.cast("string").alias("since"))
    if months is not None:
        orders = orders.filter(F.col("since").isin(*months))
    who = tables["dim_customer"].select("customer_id", PERSON).filter(F.col(PERSON).isNotNull())
    return orders.join(who, "customer_id").groupBy(PERSON).agg(F.coalesce(F.min("since"), F.lit("")).alias("since"))


def store_measures(tables: Tables, path: str, by: Sequence[str]) -> None:
    """Write a store anew for the attributes ``by`` (of ``measures``, other than year, quarter and month, which it has)."""
    by = [c for c in by if c not in M.DATE_ATTRIBUTES]
    people = _numbered(_customers(tables, None), 0)
    people.write.mode("overwrite").parquet(f"{path}/people")
    _write(tables, path, by, None, people.sparkSession.read.parquet(f"{path}/people"))


def refresh_months(tables: Tables, path: str, months: Sequence[str]) -> None:
    """Make the given months anew from ``tables``; the rows of other months are not read and their files stay.

    Customers keep their numbers, new ones get the next. A month that no order is left in must be given with others, or
    its rows stay. Nothing else may write to the store meanwhile.
    """
    spark = next(iter(tables.values())).sparkSession
    known = spark.read.parquet(f"{path}/people")
    new = _customers(tables, months).join(known, PERSON, "left_anti")
    after = known.agg(F.max("person")).first()[0]
    settle(_numbered(new, 0 if after is None else after + 1)).write.mode("append").parquet(f"{path}/people")
    stored = spark.read.parquet(f"{path}/cells").columns
    by = [c for c in stored if c in {*M.ORDER_ATTRIBUTES, *M.CUSTOMER_ATTRIBUTES, *M.ITEM_ATTRIBUTES} - {*M.DATE_ATTRIBUTES}]
    _write(tables, path, by, months, spark.read.parquet(f"{path}/people"))


def _table(spark: SparkSession, path: str, name: str, filters: M.Filters) -> DataFrame:
    rows = spark.read.parquet(f"{path}/{name}").withColumn("year_month", F.col("year_month").cast("string"))
    rows = M._in_range(rows, M._months_between(filters))
    month = F.substring("year_month", 6, 2).cast("int")
    rows = rows.withColumns({"year": F.substring("year_month", 1, 4).cast("int"), "quarter": F.ceil(month / 3).cast("int")})
    return M._keep(rows, filters)


def stored_measures(spark: SparkSession, path: str, by: Sequence[str] = (), filters: M.Filters | None = None,
                    totals: str | None = None) -> DataFrame:
    """What ``measures`` gives for the star that the store was made of.

    A filter with several values of an item attribute needs this attribute among the groups without totals: an order may have several of
    them, and its sums are stored once for each.
    """
    by, filters = list(by), filters or {}
    stored = spark.read.parquet(f"{path}/cells").columns
    items = [c for c in stored if c in M.ITEM_ATTRIBUTES]
    if unknown := {*by, *filters} - {*stored, *M.DATE_ATTRIBUTES}:
        raise ValueError(f"not stored: {', '.join(sorted(unknown))}")
    several = [c for c in filters if c in items and len(M._values(filters[c])) > 1 and (totals or c not in by)]
    if several:
        raise ValueError(f"one value at a time: {', '.join(several)}")
    choices = _choices(items)
    sets = M._grouping_sets(by, totals) if totals else [by]

    def of_sets(df: DataFrame) -> DataFrame:
        """A row for each grouping set whose choice it is stored for; columns that a set totals are null."""
        each = F.array(*(F.struct(
            F.lit(M._level(by, kept)).cast("long").alias("level"),
            F.lit(choices.index(tuple(c for c in items if c in kept or c in filters))).alias("_choice"),
            *(F.when(F.lit(c in kept), F.col(c)).alias(f"_{c}") for c in by)) for kept in sets))
        rest = [c for c in df.columns if c not in by]
        spread = df.select(*rest, F.inline(each)).filter(F.col("choice") == F.col("_choice"))
        return spread.select("level", *(F.col(f"_{c}").alias(c) for c in by), *(c for c in rest if c not in ("year_month", "year", "quarter")))

    keys = [*by, "level"]
    sums = of_sets(_table(spark, path, "cells", filters))
    merged = of_sets(_table(spark, path, "buyers", filters)).groupBy(*keys, "word").agg(F.bit_or("bits").alias("bits"))
    people = merged.select(*keys, F.bit_count("bits").cast("long").alias("customers"))
    rows = sums.select(*keys, *_COUNTS, *_SUMS).unionByName(people, allowMissingColumns=True)
    grouped = rows.groupBy(*keys) if by or totals else rows.groupBy()
    done = grouped.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (*_COUNTS, "customers")), *(F.sum(c).alias(c) for c in _SUMS))
    return M._finished(done, keys if totals else by)
