"""Checks of keys, references, required values and label sets. Each result is one small table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import taxonomy as tx
from ..schemas import FOREIGN_KEYS, NOT_NULL, PRIMARY_KEYS


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _any_null(columns: list[str]) -> Column:
    return reduce(Column.__or__, (F.col(c).isNull() for c in columns))


def check_pk(tables: dict[str, DataFrame]) -> DataFrame:
    """Keys that occur more than once, and rows whose key has a null. Repeats are combined before the shuffle."""
    parts = []
    for table, key in PRIMARY_KEYS.items():
        if table not in tables:
            continue
        counts = tables[table].groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
        parts.append(counts.agg(
            F.count_if((F.col("n") > 1) & ~_any_null(key)).alias("dup_keys"),
            F.coalesce(F.sum(F.when(_any_null(key), F.col("n"))), F.lit(0)).alias("null_keys"),
        ).select(F.lit(table).alias("table"), F.lit(",".join(key)).alias("key"), "dup_keys", "null_keys"))
    return _union(parts)


def check_fk(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows whose reference has no parent. References are counted per value first, so a value that very
    many rows share is one row in the join. A null reference is no orphan."""
    parts = []
    for child, columns, parent, key in FOREIGN_KEYS:
        if child not in tables or parent not in tables:
            continue
        used = (tables[child].filter(~_any_null(columns))
                .groupBy(*columns).agg(F.count(F.lit(1)).alias("n")))
        parents = tables[parent].select(*[F.col(k).alias(c) for k, c in zip(key, columns)])
        orphans = used.join(parents, columns, "left_anti")
        parts.append(orphans.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("orphans")).select(
            F.lit(f"{child}.{','.join(columns)}").alias("child"),
            F.lit(f"{parent}.{','.join(key)}").alias("parent"), "orphans"))
    return _union(parts)


def check_not_null(tables: dict[str, DataFrame]) -> DataFrame:
    return _union([
        tables[table].agg(F.count_if(F.col(column).isNull()).alias("nulls")).select(
            F.lit(table).alias("table"), F.lit(column).alias("column"), "nulls")
        for table, column in NOT_NULL if table in tables])


def check_domain(labels: DataFrame) -> DataFrame:
    """Label values outside their set, with the number of rows; no rows when all is well."""
    sets = {"sentiment": tx.SENTIMENTS, "topic": tx.TOPICS, "urgency": tx.URGENCY}
    used = labels.select(*sets).unpivot([], list(sets), "field", "value")
    outside = reduce(Column.__or__, (
        (F.col("field") == name) & ~F.coalesce(F.col("value").isin(*values), F.lit(False))
        for name, values in sets.items()))
    return used.filter(outside).groupBy("field", "value").agg(F.count(F.lit(1)).alias("rows"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return _union([
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows")
        for name, df in tables.items()])
