"""Additive linear forecasts: trend, season, holiday, own lags, lagged and known regressors.

All parameter rows of a grid share one wide design (every lag any row may use).
Per symbol the cross products of the wide design are summed once; each parameter
row then solves a sub-block of that small matrix, so a grid of any size reads
the data once to fit and once to score.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bourseflow.functions.numbers import EPSILON
from bourseflow.operators.prices import chronological_split, previous

# The regressors that may enter with lags.
LAG_REGRESSORS = [
    "volume",
    "high_low_diff",
    "MA",
    "foreign",
    "investment",
    "dealer",
    "ratio_over_400_shares",
    "shareholders_400_to_600",
    "shareholders_600_to_800",
    "shareholders_800_to_1000",
    "ratio_over_1000_shares",
]
YEAR_DAYS, YEAR_WAVES, WEEK_WAVES = 365.25, 6, 3
RIDGE = 1e-6


@dataclass(frozen=True)
class Layout:
    """Names and positions of the wide design's columns."""

    max_lags: Mapping[str, int]  # "y" and regressors -> largest lag
    factor: bool = False
    names: list[str] = field(init=False)

    def __post_init__(self):
        names = ["intercept", "trend"]
        names += [f"year_{f}{w}" for w in range(1, YEAR_WAVES + 1) for f in ("sin", "cos")]
        names += [f"week_{f}{w}" for w in range(1, WEEK_WAVES + 1) for f in ("sin", "cos")]
        names += ["holiday"]
        names += ["factor"] if self.factor else []
        names += [f"{v}_lag_{k}" for v, n in self.max_lags.items() for k in range(1, n + 1)]
        object.__setattr__(self, "names", names)

    def active(self, params: Mapping[str, str]) -> list[int]:
        """Positions a parameter row uses. Unset seasons are on, as in the default model."""
        on = {"intercept", "trend"}
        if params.get("yearly_seasonality", "true") == "true":
            on |= {n for n in self.names if n.startswith("year_")}
        if params.get("weekly_seasonality", "true") == "true":
            on |= {n for n in self.names if n.startswith("week_")}
        if params.get("use_holidays", "false") == "true":
            on.add("holiday")
        if params.get("factor", "false") == "true":
            on.add("factor")
        for variable in self.max_lags:
            count = int(params.get("n_lags" if variable == "y" else variable, 0))
            on |= {f"{variable}_lag_{k}" for k in range(1, count + 1)}
        return [i for i, n in enumerate(self.names) if n in on]


def time_columns(day: Column) -> dict[str, Column]:
    """Trend and season columns of a day."""
    columns = {
        "intercept": F.lit(1.0),
        "trend": F.datediff(day, F.lit("2000-01-01").cast("date")) / (10 * YEAR_DAYS),
    }
    for waves, phase, label in (
        (YEAR_WAVES, F.dayofyear(day) / YEAR_DAYS, "year"),
        (WEEK_WAVES, F.dayofweek(day) / 7.0, "week"),
    ):
        for w in range(1, waves + 1):
            angle = phase * (2 * np.pi * w)
            columns[f"{label}_sin{w}"] = F.sin(angle)
            columns[f"{label}_cos{w}"] = F.cos(angle)
    return columns


def design(daily: DataFrame, layout: Layout, holidays: Sequence[str] = (), validation_share: float = 0.2) -> DataFrame:
    """``symbol, ds, y, is_validation, x, regressors``: the wide design of every day that has all lags.

    ``regressors`` are the day's own values of the lagged variables other than ``y``.

    ``holidays``: month-day texts (``01-01``). The split is made before rows
    without full lags are left out, so validation rows keep their history.
    """
    marked = chronological_split(daily, validation_share)
    columns = time_columns(F.col("ds"))
    columns["holiday"] = F.date_format("ds", "MM-dd").isin(list(holidays)).cast("double") if holidays else F.lit(0.0)
    if layout.factor:
        columns["factor"] = F.col("factor")
    for variable, n in layout.max_lags.items():
        for k in range(1, n + 1):
            columns[f"{variable}_lag_{k}"] = previous(variable, k)
    wide = F.array(*[columns[n].cast("double") for n in layout.names])
    own = [F.col(v).cast("double") for v in layout.max_lags if v != "y"]
    regressors = F.array(*own).cast("array<double>").alias("regressors")
    rows = marked.select("symbol", "ds", "y", "is_validation", wide.alias("x"), regressors)
    return rows.where(F.col("y").isNotNull() & ~F.exists("x", lambda v: v.isNull()))


def cross_products(rows: DataFrame) -> DataFrame:
    """Per symbol (and task) the sums of products of the columns (x, y), flattened."""

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for symbol, part in batch.groupby("symbol", sort=False):
                block = np.column_stack([np.stack(part["x"].to_numpy()), part["y"].to_numpy()])
                product = block.T @ block
                sums[symbol] = sums[symbol] + product if symbol in sums else product
        if sums:
            yield pd.DataFrame({"symbol": list(sums), "products": [m.ravel() for m in sums.values()]})

    return rows.select("symbol", "x", "y").mapInPandas(add_up, "symbol string, products array<double>")


def solve(products: np.ndarray, active: Sequence[int]) -> np.ndarray:
    """Ridge coefficients at the active positions, 0 elsewhere.

    Columns are scaled by their own size first, so one penalty fits prices and shares.
    """
    width = products.shape[0] - 1
    picked = np.asarray(active)
    gram = products[np.ix_(picked, picked)]
    scale = np.sqrt(np.diag(gram))
    scale[scale == 0] = 1.0
    scaled = gram / np.outer(scale, scale) + RIDGE * np.eye(len(picked))
    coefficients = np.zeros(width)
    coefficients[picked] = np.linalg.solve(scaled, products[picked, width] / scale) / scale
    return coefficients


def fit(products: DataFrame, grid: DataFrame, layout: Layout) -> DataFrame:
    """``symbol, grid_idx, coefficients`` of each grid row (symbol, grid_idx, params).

    A group holds a symbol's grid and a few small matrices, never its history.
    """
    size = len(layout.names) + 1

    def solve_all(sums: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if not len(sums) or not len(wanted):
            return pd.DataFrame({"symbol": [], "grid_idx": [], "coefficients": []})
        matrix = np.sum(np.stack(sums["products"].to_numpy()), axis=0).reshape(size, size)
        found = [solve(matrix, layout.active(dict(p))) for p in wanted["params"]]
        return pd.DataFrame({"symbol": wanted["symbol"], "grid_idx": wanted["grid_idx"], "coefficients": found})

    return (
        products.groupBy("symbol")
        .cogroup(grid.groupBy("symbol"))
        .applyInPandas(solve_all, "symbol string, grid_idx int, coefficients array<double>")
    )


def score(validation: DataFrame, coefficients: DataFrame, drop_last: bool = False) -> DataFrame:
    """``symbol, grid_idx, rmse, mape`` (percent) over the validation rows.

    ``drop_last`` leaves the last validation day out of the percentage error.
    A group is the last fifth of one symbol's days.
    """

    def errors(rows: pd.DataFrame, models: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(models):
            return pd.DataFrame({"symbol": [], "grid_idx": [], "rmse": [], "mape": []})
        rows = rows.sort_values("ds")
        actual = rows["y"].to_numpy()[:, None]
        gap = actual - np.stack(rows["x"].to_numpy()) @ np.stack(models["coefficients"].to_numpy()).T
        share = np.abs(gap) / np.maximum(np.abs(actual), EPSILON)
        share = share[:-1] if drop_last and len(share) > 1 else share
        return pd.DataFrame(
            {
                "symbol": models["symbol"],
                "grid_idx": models["grid_idx"],
                "rmse": np.sqrt(np.mean(gap**2, axis=0)),
                "mape": np.mean(share, axis=0) * 100,
            }
        )

    return (
        validation.groupBy("symbol")
        .cogroup(coefficients.groupBy("symbol"))
        .applyInPandas(errors, "symbol string, grid_idx int, rmse double, mape double")
    )


def predict(rows: DataFrame, coefficients: DataFrame) -> DataFrame:
    """Fitted value ``yhat`` and residual of every design row, for one model per symbol."""
    dot = F.aggregate(F.zip_with("x", "coefficients", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return (
        rows.join(coefficients, "symbol")
        .withColumn("yhat", dot)
        .withColumn("residual", F.col("y") - F.col("yhat"))
        .drop("x", "coefficients")
    )


def forecast_ahead(
    rows: DataFrame, coefficients: DataFrame, layout: Layout, holidays: Sequence[str] = (), horizon: int = 7
) -> DataFrame:
    """Forecasts for the ``horizon`` calendar days after the last one, one step at a time.

    Only the last design row of a symbol is needed: it holds every lag. Own lags
    move on with the forecasts. Lagged regressors move on once, to the values of
    the last day (a null one stays out), and then keep them, as the factor does.
    """
    last = rows.groupBy("symbol").agg(
        F.max("ds").alias("last_day"), F.max_by("x", "ds").alias("x"), F.max_by("y", "ds").alias("y"), F.max_by("regressors", "ds").alias("regressors")
    )
    days = last.join(coefficients, "symbol").withColumn(
        "step", F.explode(F.sequence(F.lit(1), F.lit(horizon)))
    )
    day = F.date_add("last_day", F.col("step"))
    columns = time_columns(day)
    columns["holiday"] = F.date_format(day, "MM-dd").isin(list(holidays)).cast("double") if holidays else F.lit(0.0)
    fixed = F.array(*[columns[n].cast("double") for n in layout.names if n in columns])
    steps = days.select("symbol", "step", day.alias("ds"), "x", "y", "regressors", "coefficients", fixed.alias("time"))
    time_at = [i for i, n in enumerate(layout.names) if n in columns]
    own_at = [layout.names.index(f"y_lag_{k}") for k in range(1, layout.max_lags.get("y", 0) + 1)]

    lags_at = [[layout.names.index(f"{v}_lag_{k}") for k in range(1, n + 1)] for v, n in layout.max_lags.items() if v != "y"]

    def walk(steps: pd.DataFrame) -> pd.DataFrame:
        steps = steps.sort_values("step")
        x = np.array(steps["x"].iloc[0], dtype=float)
        weights = np.asarray(steps["coefficients"].iloc[0], dtype=float)
        newest, found = float(steps["y"].iloc[0]), []
        for at, value in zip(lags_at, np.array(steps["regressors"].iloc[0], dtype=float)):
            if at and not np.isnan(value):
                x[at] = np.concatenate([[value], x[at][:-1]])
        for time in steps["time"]:
            x[time_at] = time
            if own_at:
                x[own_at] = np.concatenate([[newest], x[own_at][:-1]])
            newest = float(x @ weights)
            found.append(newest)
        return pd.DataFrame({"symbol": steps["symbol"], "ds": steps["ds"], "yhat": found})

    return steps.groupBy("symbol").applyInPandas(walk, "symbol string, ds date, yhat double")


def residuals_of(rows: DataFrame, training_only: bool = False) -> DataFrame:
    """Residuals by day; the training part only if asked."""
    kept = rows.where(~F.col("is_validation")) if training_only else rows
    return kept.select("symbol", "ds", "residual")


def regressor_rows(daily: DataFrame, stages: Mapping[str, Sequence[Column]]) -> DataFrame:
    """Long form of one-regressor candidates: stage, grid_idx and x for each row of ``daily``.

    Rows on which a candidate has no value yet are left out for that candidate.
    """
    marked = chronological_split(daily)
    candidates = [
        F.struct(F.lit(stage).alias("stage"), F.lit(i).alias("grid_idx"), x.cast("double").alias("x"))
        for stage, columns in stages.items()
        for i, x in enumerate(columns)
    ]
    wide = marked.select("symbol", "ds", "y", "is_validation", F.array(*candidates).alias("_all"))
    long = wide.select("symbol", "ds", "y", "is_validation", F.inline("_all"))
    return long.where(F.col("x").isNotNull())


def one_regressor_models(long: DataFrame, keys: Sequence[str] = ("symbol", "stage", "grid_idx")) -> DataFrame:
    """Least-squares line of y on x over the training rows of each candidate."""
    training = long.where(~F.col("is_validation"))
    return training.groupBy(*keys).agg(
        F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept")
    )


def one_regressor_forecasts(long: DataFrame, keys: Sequence[str] = ("symbol", "stage", "grid_idx")) -> DataFrame:
    """Every row with the forecast of its candidate's line."""
    models = one_regressor_models(long, keys)
    return long.join(models, list(keys)).withColumn("pred", F.col("intercept") + F.col("slope") * F.col("x"))
