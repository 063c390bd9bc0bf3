"""Timestamps and calendar months."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parse_ts(text: Column) -> Column:
    """Text to a zone-free timestamp; what cannot be read becomes null."""
    return text.try_cast("timestamp_ntz")


def coerce_ts(df: DataFrame, name: str) -> Column:
    """``parse_ts`` for a column of ``df``; a column that is a timestamp already is kept."""
    if isinstance(df.schema[name].dataType, T.StringType):
        return parse_ts(F.col(name))
    return F.col(name).cast("timestamp_ntz")


def year_month(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def month_index(label: Column) -> Column:
    """Months since year 0 of a ``yyyy-MM`` label, so that neighbouring months differ by one."""
    return F.substring(label, 1, 4).cast("int") * 12 + F.substring(label, 6, 2).cast("int")
