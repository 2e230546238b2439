"""Price features over daily rows.

Every window here is one symbol in date order. The daily table holds one row
per symbol and day, so a window partition never exceeds the number of days in
the history, however many trades went into a day.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from bourseflow.functions.dates import date_array


def by_day() -> WindowSpec:
    """One symbol in date order."""
    return Window.partitionBy("symbol").orderBy("ds")


def previous(column: str, rows: int = 1) -> Column:
    return F.lag(column, rows).over(by_day())


def with_change(daily: DataFrame) -> DataFrame:
    """First difference of the close."""
    return daily.withColumn("change", F.col("y") - previous("y"))


def with_price_features(daily: DataFrame, ma_window: int = 5) -> DataFrame:
    """Spread and moving average; rows with a null in any column are dropped."""
    frame = by_day().rowsBetween(1 - ma_window, Window.currentRow)
    full = F.count("y").over(frame) == ma_window
    return daily.withColumns(
        {
            "high_low_diff": F.col("high_price") - F.col("low_price"),
            "MA": F.when(full, F.avg("y").over(frame)),
        }
    ).na.drop("any")


def in_range(daily: DataFrame, start: str, end: str) -> DataFrame:
    """Inclusive date range."""
    return daily.where(F.col("ds").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def with_day_moves(daily: DataFrame) -> DataFrame:
    """Percent change and volume change, every null filled with 0.

    Apply ``in_range`` first: the first day of the range is meant to be 0.
    """
    moved = daily.withColumns(
        {
            "pct_change": (F.col("y") / previous("y") - 1) * 100,
            "volume_change": F.col("volume") - previous("volume"),
        }
    )
    return moved.na.fill(0)


def with_lags(daily: DataFrame, variables: Sequence[str], max_lag: int = 3) -> DataFrame:
    """``<variable>_lag_<k>`` columns for k = 1..max_lag, in one window pass."""
    lags = {f"{v}_lag_{k}": previous(v, k) for v in variables for k in range(1, max_lag + 1)}
    return daily.withColumns(lags)


def next_day_label(daily: DataFrame) -> DataFrame:
    """Does the next trading day close strictly higher? The last day has no label."""
    following = F.lead("y").over(by_day())
    return daily.select("symbol", "ds", "y", (following > F.col("y")).alias("increase")).where(
        F.col("increase").isNotNull()
    )


def with_percent_forecast(daily: DataFrame) -> DataFrame:
    """Forecast of day t from the close and factor of the trading day before."""
    return daily.withColumn("pred", F.lag(F.col("y") * (1 + F.col("factor") / 100)).over(by_day()))


def without_last_day(daily: DataFrame, keys: Sequence[str] = ("symbol",), order: str = "ds") -> DataFrame:
    """Drop the last row of each ordered group."""
    last = F.max(order).over(Window.partitionBy(*keys))
    return daily.withColumn("_last", last).where(F.col(order) < F.col("_last")).drop("_last")


def on_calendar(daily: DataFrame, columns: Sequence[str] = ("y",)) -> DataFrame:
    """One row per calendar day, gaps filled with the last known values and flagged."""
    spans = daily.groupBy("symbol").agg(F.min("ds").alias("first_day"), F.max("ds").alias("last_day"))
    calendar = spans.select("symbol", F.explode(date_array(F.col("first_day"), F.col("last_day"))).alias("ds"))
    joined = calendar.join(daily.select("symbol", "ds", *columns), ["symbol", "ds"], "left")
    so_far = by_day().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    missing = F.lit(False)
    for c in columns:
        missing = missing | F.col(c).isNull()
    filled = {c: F.last(c, ignorenulls=True).over(so_far) for c in columns}
    return joined.withColumn("was_filled", missing.cast("int")).withColumns(filled)


def chronological_split(daily: DataFrame, validation_share: float = 0.2) -> DataFrame:
    """Mark the last share of each symbol's rows (at least one) as validation."""
    total = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    held_out = F.greatest(F.lit(1), F.floor(total * F.lit(validation_share))).cast("int")
    return daily.withColumn("is_validation", F.row_number().over(by_day()) > total - held_out)
