"""Factors joined to prices, forecast errors, direction metrics and summary tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bourseflow.functions.numbers import clip, mape, rmse
from bourseflow.operators.grid import ranked
from bourseflow.operators.prices import by_day, with_percent_forecast, with_price_features
from bourseflow.operators.scoring import keep_first

NEUTRAL_FACTOR = 0.5  # fixed values
VALIDATION_START = "2024-12-18"


def with_factor(daily: DataFrame, factors: DataFrame, order: str = "seq") -> DataFrame:
    """Prices with the first factor of each symbol and day; days without one stay null."""
    first = keep_first(factors, order).select("symbol", "ds", "factor")
    return daily.join(first, ["symbol", "ds"], "left")


def sentiment_training_rows(daily: DataFrame, factors: DataFrame, order: str = "seq") -> DataFrame:
    """Price features with the 0-1 factor: neutral where missing, bounded, complete rows only."""
    joined = with_factor(with_price_features(daily), factors, order).na.fill({"factor": NEUTRAL_FACTOR})
    return joined.withColumn("factor", clip(F.col("factor"), 0.0, 1.0)).na.drop("any")


def percent_forecast_rows(
    daily: DataFrame, factors: DataFrame, start: str = VALIDATION_START, order: str = "seq"
) -> DataFrame:
    """Close and one-step forecast of each day from ``start`` on.

    The forecast comes from the row before, so the date filter stays above the window.
    """
    joined = with_factor(with_price_features(daily), factors, order).na.fill({"factor": 0.0})
    return with_percent_forecast(joined).na.drop("any").where(F.col("ds") >= F.lit(start).cast("date"))


def percent_forecast_error(
    daily: DataFrame, factors: DataFrame, start: str = VALIDATION_START, order: str = "seq"
) -> DataFrame:
    """MAPE in percent per symbol, two digits."""
    rows = percent_forecast_rows(daily, factors, start, order)
    return rows.groupBy("symbol").agg(F.round(mape(F.col("y"), F.col("pred")) * 100, 2).alias("mape"))


def forecast_errors(forecasts: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """RMSE and MAPE (percent) of ``y`` against ``pred`` per key."""
    y, p = F.col("y"), F.col("pred")
    return forecasts.groupBy(*keys).agg(rmse(y, p).alias("rmse"), (mape(y, p) * 100).alias("mape"))


def validation_pairs(forecasts: DataFrame, validation: DataFrame) -> DataFrame:
    """Forecasts of the validation days, paired with y by symbol and day, never by position."""
    return validation.select("symbol", "ds", "y").join(forecasts.select("symbol", "ds", "pred"), ["symbol", "ds"])


def directions(rows: DataFrame) -> DataFrame:
    """``mode, symbol, ds, pred_b, test_b``: predicted and actual direction per row.

    Mode ``reference`` compares the factor with the move of the same row, although
    the factor speaks of the next day; ``aligned`` takes the factor of the row
    before. A first row has no move and counts as down.
    """
    moved = rows.select(
        "symbol",
        "ds",
        F.col("factor"),
        F.lag("factor").over(by_day()).alias("before"),
        (F.col("y") - F.lag("y").over(by_day())).alias("move"),
    )
    modes = F.array(
        *[
            F.struct(F.lit(mode).alias("mode"), F.coalesce(F.col(factor) >= 0, F.lit(False)).alias("pred_b"))
            for mode, factor in (("reference", "factor"), ("aligned", "before"))
        ]
    )
    return moved.select("symbol", "ds", F.coalesce(F.col("move") >= 0, F.lit(False)).alias("test_b"), F.inline(modes))


def confusion(rows: DataFrame, keys: Sequence[str] = ("mode", "symbol")) -> DataFrame:
    """True/false positives and negatives, positive = up."""
    actual, predicted = F.col("test_b").cast("int"), F.col("pred_b").cast("int")
    cell = lambda a, p: F.count_if((actual == a) & (predicted == p))
    return rows.groupBy(*keys).agg(
        cell(1, 1).alias("tp"), cell(1, 0).alias("fn"), cell(0, 1).alias("fp"), cell(0, 0).alias("tn")
    )


def direction_metrics(cells: DataFrame) -> DataFrame:
    """Precision, recall and accuracy; an empty denominator gives 0."""
    tp, fn, fp, tn = (F.col(c) for c in ("tp", "fn", "fp", "tn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return cells.withColumns(
        {
            "precision": ratio(tp, tp + fp),
            "recall": ratio(tp, tp + fn),
            "accuracy": ratio(tp + tn, tp + fn + fp + tn),
        }
    )


def best_per_stage(results: DataFrame, by: str = "mape") -> DataFrame:
    """Lowest error per symbol and stage.

    ``results``: stage, symbol, grid_idx, mape, ...; a key holds one grid.
    """
    return results.groupBy("symbol", "stage").agg(
        F.round(F.min(by), 2).alias("mape"), F.min_by("grid_idx", F.struct(by, "grid_idx")).alias("grid_idx")
    )


def stage_summary(
    results: DataFrame, stages: Sequence[str], compare: tuple[str, str] = ("with_future", "lag_share")
) -> DataFrame:
    """Symbol x stage matrix of the best errors, and whether the first of two stages is lower."""
    matrix = best_per_stage(results).groupBy("symbol").pivot("stage", list(stages)).agg(F.first("mape"))
    return matrix.withColumn("is_lower", F.col(compare[0]) < F.col(compare[1]))


def melt(matrix: DataFrame, columns: Sequence[str], ids: Sequence[str] = ("symbol",)) -> DataFrame:
    """Wide to long: ``Category``, ``Value``."""
    return matrix.unpivot(list(ids), list(columns), "Category", "Value")


def relative_to(matrix: DataFrame, columns: Sequence[str], base: str) -> DataFrame:
    """Columns divided by a base column."""
    return matrix.withColumns({c: F.try_divide(F.col(c), F.col(base)) for c in columns})


def improved(matrix: DataFrame, better: str, base: str) -> DataFrame:
    """Rows in which one column is below another."""
    return matrix.where(F.col(better) < F.col(base))


def compare_variants(errors: DataFrame, variants: Sequence[str]) -> DataFrame:
    """One column of errors per variant (``symbol, variant, mape``)."""
    return errors.groupBy("symbol").pivot("variant", list(variants)).agg(F.first("mape"))


def variant_errors(rows: DataFrame, variants: Mapping[str, Column], start: str = VALIDATION_START) -> DataFrame:
    """``symbol, variant, mape`` of the percent forecast under several factors.

    ``rows``: symbol, ds, y and what the variants' factor columns need. All
    variants are judged in one pass over the prices.
    """
    factors = F.array(
        *[
            F.struct(F.lit(name).alias("variant"), F.coalesce(factor, F.lit(0.0)).alias("factor"))
            for name, factor in variants.items()
        ]
    )
    long = rows.select("symbol", "ds", "y", F.inline(factors))
    path = Window.partitionBy("symbol", "variant").orderBy("ds")
    judged = long.withColumn("pred", F.lag(F.col("y") * (1 + F.col("factor") / 100)).over(path)).where(
        F.col("pred").isNotNull()
    )
    late = judged.where(F.col("ds") >= F.lit(start).cast("date"))
    return late.groupBy("symbol", "variant").agg(F.round(mape(F.col("y"), F.col("pred")) * 100, 2).alias("mape"))


def ranked_rows(results: DataFrame, n: int, by: str = "mape") -> DataFrame:
    """Top-n table of a tuning result, per symbol."""
    return ranked(results, by).where(F.col("rank") <= n)
