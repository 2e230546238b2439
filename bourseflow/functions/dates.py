"""Date expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def date_array(start: Column, end: Column) -> Column:
    """All days from start to end, inclusive; an empty array when reversed."""
    return F.when(start <= end, F.sequence(start, end, F.expr("interval 1 day"))).otherwise(
        F.array().cast("array<date>")
    )


def month_label(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def strict_date(text: Column) -> Column:
    """``yyyy-MM-dd`` to a date; any other text is an error in ANSI mode."""
    return F.to_date(text, "yyyy-MM-dd")
