"""Compute columns once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(df: DataFrame, *columns: Column) -> DataFrame:
    """Add named columns as a generator of one row.

    The optimizer moves filters below projections by repeating the projected expressions. It does not move
    them below a generator, so costly columns stay computed once per row whatever is filtered on later.
    """
    return df.select(*df.columns, F.inline(F.array(F.struct(*columns))))
