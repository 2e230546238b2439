"""Number expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 2.220446049250313e-16  # fixed value: spacing of doubles at 1.0


def clip(x: Column, low: float, high: float) -> Column:
    """Bound a value; null stays null (``greatest`` and ``least`` skip nulls)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def percent_text(ratio: Column, digits: int = 2) -> Column:
    """0.0139 -> '1.39%'."""
    return F.format_string(f"%.{digits}f%%", ratio.cast("double") * 100)


def absolute_percentage_error(actual: Column, predicted: Column) -> Column:
    """|y - p| / max(|y|, eps)."""
    return F.abs(actual - predicted) / F.greatest(F.abs(actual), F.lit(EPSILON))


def mape(actual: Column, predicted: Column) -> Column:
    """Aggregate: mean absolute percentage error, as a ratio."""
    return F.avg(absolute_percentage_error(actual, predicted))


def rmse(actual: Column, predicted: Column) -> Column:
    """Aggregate: root of the mean squared error."""
    return F.sqrt(F.avg((actual - predicted) * (actual - predicted)))


def short_percent(x: Column) -> Column:
    """Two digits, ties to even."""
    return F.bround(x, 2)


def ten_thousands(x: Column) -> Column:
    """Value in units of ten thousand, one digit, ties to even."""
    return F.bround(x / 10000, 1)
