"""Staged parameter search over all symbols at once."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bourseflow.operators import grid as g
from bourseflow.operators import linear
from bourseflow.session import cut_lineage


@dataclass(frozen=True)
class Stage:
    name: str
    lists: dict[str, list]
    kept: list[str]
    top_n: int = 1


# The value lists of each stage and what it hands on.
SEASON = ["yearly_seasonality", "weekly_seasonality"]
CLOSE = [*SEASON, "n_lags", "use_holidays"]
VOL_PRICE = ["volume", "high_low_diff", "MA"]
INST = ["foreign", "investment", "dealer"]
SHARE = [
    "ratio_over_400_shares",
    "shareholders_400_to_600",
    "shareholders_600_to_800",
    "shareholders_800_to_1000",
    "ratio_over_1000_shares",
]
STAGES = [
    Stage("default", {}, []),
    Stage("add_period", {"yearly_seasonality": [True], "weekly_seasonality": [True]}, SEASON),
    Stage("add_ar", {"n_lags": list(range(1, 16))}, ["n_lags"], top_n=4),
    Stage(
        "tune_close",
        {"yearly_seasonality": [True, False], "weekly_seasonality": [True, False], "use_holidays": [True, False]},
        CLOSE,
    ),
    Stage("lag_vol_price", {c: [0, 5, 10] for c in VOL_PRICE}, [*CLOSE, *VOL_PRICE]),
    Stage("lag_inst", {c: [1, 3, 5] for c in INST}, [*CLOSE, *VOL_PRICE, *INST]),
    Stage("lag_share", {c: [0, 5] for c in SHARE}, [*CLOSE, *VOL_PRICE, *INST, *SHARE]),
]
FINAL = Stage("with_future", {"factor": [True]}, [*CLOSE, *VOL_PRICE, *INST, *SHARE, "factor"])


def layout_for(stages: Sequence[Stage], factor: bool = False) -> linear.Layout:
    """Wide design that covers the largest lag of every list."""
    lags: dict[str, int] = {}
    for stage in stages:
        for name, values in stage.lists.items():
            if name == "n_lags" or name in linear.LAG_REGRESSORS:
                variable = "y" if name == "n_lags" else name
                lags[variable] = max(lags.get(variable, 0), *values)
    return linear.Layout({v: n for v, n in lags.items() if n > 0}, factor)


def keys_of(stages: Sequence[Stage], upto: int) -> list[str]:
    """Parameter names in the grid of stage ``upto``: kept by the stage before, or its own."""
    before = stages[upto - 1].kept if upto else []
    return sorted(set(before) | set(stages[upto].lists))


def tune(
    daily: DataFrame,
    stages: Sequence[Stage] = tuple(STAGES),
    holidays: Sequence[str] = (),
    factor: bool = False,
    drop_last: bool = False,
    start: DataFrame | None = None,
) -> DataFrame:
    """``stage, symbol, grid_idx, params, rmse, mape`` of every grid row of every stage.

    ``daily`` holds the price features (and ``factor``). The loop runs over the
    stages only; each stage is one job over all symbols and grid rows, whose
    results (a few dozen rows per symbol) are written to the shared folder.
    ``start``: best lists to begin with (symbol, params), else none.
    """
    layout = layout_for(stages if start is None else [*STAGES, *stages], factor)
    rows = cut_lineage(linear.design(daily, layout, holidays))
    products = cut_lineage(linear.cross_products(rows.where(~F.col("is_validation"))))
    validation = rows.where("is_validation")
    lists = start
    if lists is None:
        empty = F.create_map().cast("map<string,array<string>>")
        lists = products.select("symbol").distinct().select("symbol", empty.alias("params"))
    outcome = None
    for i, stage in enumerate(stages):
        keys = keys_of(stages, i) if start is None else sorted(set(STAGES[-1].kept) | set(stage.lists))
        rows_wanted = g.parameter_grid(g.merge_lists(lists, stage.lists), keys)
        models = linear.fit(products, rows_wanted, layout)
        scored = linear.score(validation, models, drop_last).join(rows_wanted, ["symbol", "grid_idx"])
        result = cut_lineage(
            scored.select(F.lit(stage.name).alias("stage"), "symbol", "grid_idx", "params", "rmse", "mape")
        )
        lists = g.candidate_lists(result, stage.kept, stage.top_n)
        outcome = result if outcome is None else outcome.unionByName(result)
    return outcome


def best_lists(results: DataFrame, stage: Stage) -> DataFrame:
    return g.candidate_lists(results.where(F.col("stage") == stage.name), stage.kept, stage.top_n)


def tune_with_factor(
    daily: DataFrame, factor_daily: DataFrame, holidays: Sequence[str] = (), stages: Sequence[Stage] = tuple(STAGES)
) -> DataFrame:
    """All stages, then the final fit with the known factor on the last stage's best lists."""
    staged = tune(daily, stages, holidays)
    start = cut_lineage(best_lists(staged, stages[-1]))
    final = tune(factor_daily, [FINAL], holidays, factor=True, drop_last=True, start=start)
    return staged.unionByName(final)
