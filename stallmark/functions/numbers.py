"""Exact rounding and ratios.

Averages are kept as (sum, count) pairs of whole numbers until the last step, so results do not depend
on the order in which partitions arrive, and rounding is exact instead of going through a double.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _whole(value: Column) -> Column:
    return value.cast("decimal(30,0)")


def cents(amount: Column) -> Column:
    """A money sum as a whole number of hundredths."""
    return (amount * F.lit(100)).cast("decimal(30,0)")


def round_ratio(num: Column, den: Column, digits: int, factor: int = 1) -> Column:
    """``factor * num / den`` rounded half away from zero to ``digits``; null when ``den`` is 0.

    ``num`` and ``den`` are whole numbers.
    """
    scale = F.lit(2 * factor * 10**digits).cast("decimal(7,0)")
    size, den = F.abs(_whole(num)), F.nullif(_whole(den), F.lit(0).cast("decimal(30,0)"))
    magnitude = F.call_function(
        "div",
        size * scale + F.abs(den),
        F.abs(den) * F.lit(2).cast("decimal(1,0)"),
    )
    signed = F.when((num < 0) != (den < 0), -magnitude).otherwise(magnitude)
    return signed.cast("double") / F.lit(float(10**digits))


def round_money(amount: Column, digits: int = 0) -> Column:
    """A decimal sum rounded half away from zero, as a double."""
    return F.round(amount, digits).cast("double")


def ratio(num: Column, den: Column) -> Column:
    """Plain quotient as a double; null when ``den`` is 0 or null."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def ratio_or_zero(num: Column, den: Column) -> Column:
    return F.coalesce(ratio(num, den), F.lit(0.0))


def half_even_tenths(value: Column) -> Column:
    """A double rounded half to even at one decimal, on the scaled double as numeric libraries do."""
    return F.rint(value * F.lit(10.0)) / F.lit(10.0)
