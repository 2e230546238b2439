import itertools
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bourseflow.operators import grid as g
from bourseflow.operators import linear
from bourseflow.operators.compress import reconstruct
from bourseflow.plans import evaluation, tuning


@pytest.fixture(scope="module")
def series(spark):
    """Two symbols whose close follows its own second lag and the volume of the day before."""
    rng = np.random.default_rng(7)
    rows = []
    for symbol in ("a", "b"):
        volume = rng.uniform(1, 2, 160)
        y = [10.0, 11.0]
        for t in range(2, 160):
            y.append(3 + 0.6 * y[t - 2] + 2 * volume[t - 1] + rng.normal(0, 0.01))
        for t in range(160):
            rows.append((symbol, date(2023, 1, 2) + timedelta(days=t), float(y[t]), float(volume[t])))
    return spark.createDataFrame(rows, "symbol string, ds date, y double, volume double").cache()


LAYOUT = linear.Layout({"y": 3, "volume": 2})


def models(spark, rows, params_list):
    wanted = spark.createDataFrame(
        [(s, i, p) for s in ("a", "b") for i, p in enumerate(params_list)],
        "symbol string, grid_idx int, params map<string,string>",
    )
    return linear.fit(linear.cross_products(rows.where(~F.col("is_validation"))), wanted, LAYOUT)


def test_fit_equals_least_squares_on_the_rows(spark, series):
    rows = linear.design(series, LAYOUT, ["01-01"])
    params = [
        {"n_lags": "2", "volume": "1", "yearly_seasonality": "false", "weekly_seasonality": "false"},
        {"n_lags": "3", "yearly_seasonality": "false"},
    ]
    fitted = {(r["symbol"], r["grid_idx"]): np.array(r["coefficients"]) for r in models(spark, rows, params).collect()}
    assert len(fitted) == 4
    frame = rows.where("symbol = 'a' and not is_validation").orderBy("ds").toPandas()
    x, y = np.stack(frame["x"].to_numpy()), frame["y"].to_numpy()
    active = LAYOUT.active(params[0])
    expected, *_ = np.linalg.lstsq(x[:, active], y, rcond=None)
    assert x[:, active] @ fitted[("a", 0)][active] == pytest.approx(x[:, active] @ expected, abs=1e-2)
    assert fitted[("a", 0)][[i for i in range(len(LAYOUT.names)) if i not in active]].tolist() == [0.0] * (
        len(LAYOUT.names) - len(active)
    )
    at = LAYOUT.names.index
    assert fitted[("a", 0)][at("volume_lag_1")] == pytest.approx(2, abs=0.05)


def test_score_matches_pandas_and_drops_the_last_day_on_request(spark, series):
    rows = linear.design(series, LAYOUT)
    fitted = models(spark, rows, [{"n_lags": "2"}])
    predicted = linear.predict(rows, fitted).where("is_validation").toPandas().sort_values(["symbol", "ds"])
    for drop in (False, True):
        got = {r["symbol"]: r for r in linear.score(rows.where("is_validation"), fitted, drop).collect()}
        for symbol, part in predicted.groupby("symbol"):
            gap = part["y"] - part["yhat"]
            share = (gap / part["y"]).abs()
            assert got[symbol]["rmse"] == pytest.approx(np.sqrt((gap**2).mean()))
            assert got[symbol]["mape"] == pytest.approx((share[:-1] if drop else share).mean() * 100)


def test_split_counts_all_days(spark, series):
    rows = linear.design(series, LAYOUT).groupBy("symbol", "is_validation").count().collect()
    assert {(r["symbol"], r["is_validation"]): r["count"] for r in rows} == {
        (s, v): n for s in ("a", "b") for v, n in ((True, 32), (False, 125))
    }


def test_forecast_ahead_steps_on_its_own_values(spark, series):
    rows = linear.design(series, LAYOUT)
    params = {"n_lags": "2", "volume": "1", "yearly_seasonality": "false", "weekly_seasonality": "false"}
    fitted = models(spark, rows, [params])
    got = linear.forecast_ahead(rows, fitted, LAYOUT).where("symbol = 'a'").orderBy("ds").toPandas()
    weights = dict(zip(LAYOUT.names, fitted.where("symbol = 'a'").first()["coefficients"]))
    past = series.where("symbol = 'a'").orderBy("ds").toPandas()
    y, volume = list(past["y"]), past["volume"].iloc[-1]
    expected = []
    for step in range(1, 8):
        day = past["ds"].iloc[-1] + timedelta(days=step)
        trend = (day - date(2000, 1, 1)).days / 3652.5
        value = weights["intercept"] + weights["trend"] * trend + weights["volume_lag_1"] * volume
        value += weights["y_lag_1"] * y[-1] + weights["y_lag_2"] * y[-2]
        y.append(value)
        expected.append(value)
    assert got["yhat"].tolist() == pytest.approx(expected)
    assert [str(d) for d in got["ds"]][0] == str(past["ds"].iloc[-1] + timedelta(days=1))


def test_one_regressor_models_match_polyfit(spark, series):
    from bourseflow.operators.prices import previous

    long = linear.regressor_rows(series, {"own": [previous("y", 1), previous("y", 2)]})
    got = {(r["symbol"], r["grid_idx"]): r for r in linear.one_regressor_models(long).collect()}
    y = series.where("symbol = 'b'").orderBy("ds").toPandas()["y"].to_numpy()
    slope, intercept = np.polyfit(y[: 128 - 2], y[2:128], 1)
    assert (got[("b", 1)]["slope"], got[("b", 1)]["intercept"]) == pytest.approx((slope, intercept))


def test_grid_order_and_merge(spark):
    best = spark.createDataFrame(
        [("a", {"n_lags": ["4", "2"], "old": ["x"]})], "symbol string, params map<string,array<string>>"
    )
    merged = g.merge_lists(best, {"use_holidays": [True, False], "old": ["y", "z"]})
    rows = g.parameter_grid(merged, ["old", "n_lags", "use_holidays"]).orderBy("grid_idx").collect()
    expected = list(itertools.product(["4", "2"], ["y", "z"], ["true", "false"]))
    assert [(r["params"]["n_lags"], r["params"]["old"], r["params"]["use_holidays"]) for r in rows] == expected
    assert [r["grid_idx"] for r in rows] == list(range(8))
    assert sorted(rows[0]["params"]) == ["n_lags", "old", "use_holidays"]


def test_empty_grid_is_one_row(spark):
    empty = spark.createDataFrame([("a", {})], "symbol string, params map<string,array<string>>")
    rows = g.parameter_grid(g.merge_lists(empty, {}), []).collect()
    assert [(r["grid_idx"], r["params"]) for r in rows] == [(0, {})]


def test_candidates_lose_the_pairing_between_columns(spark):
    results = spark.createDataFrame(
        [("a", 0, {"p": "1", "q": "x"}, 2.0), ("a", 1, {"p": "2", "q": "y"}, 1.0), ("a", 2, {"p": "3", "q": "z"}, 3.0), ("a", 3, {"p": "4", "q": "w"}, 1.0)],
        "symbol string, grid_idx int, params map<string,string>, mape double",
    )
    lists = g.candidate_lists(results, ["p", "q"], 3)
    assert lists.first()["params"] == {"p": ["2", "4", "1"], "q": ["y", "w", "x"]}
    assert g.parameter_grid(lists, ["p", "q"]).count() == 9
    assert [r["grid_idx"] for r in evaluation.ranked_rows(results, 2).orderBy("rank").collect()] == [1, 3]


def test_stage_grid_sizes():
    sizes = {}
    kept = {}
    for i, stage in enumerate(tuning.STAGES):
        lists = {k: len(kept.get(k, [0])) for k in (tuning.STAGES[i - 1].kept if i else [])} | {
            k: len(v) for k, v in stage.lists.items()
        }
        sizes[stage.name] = int(np.prod(list(lists.values()) or [1]))
        kept = {k: range(stage.top_n) for k in stage.kept}
    assert sizes == {
        "default": 1, "add_period": 1, "add_ar": 15, "tune_close": 32,
        "lag_vol_price": 27, "lag_inst": 27, "lag_share": 32,
    }
    assert sum(sizes.values()) + 1 == 136


def test_staged_tuning_finds_the_generating_lags(spark, series):
    stages = [
        tuning.Stage("default", {"yearly_seasonality": [False], "weekly_seasonality": [False]}, tuning.SEASON),
        tuning.Stage("add_ar", {"n_lags": [1, 2, 3]}, [*tuning.SEASON, "n_lags"], top_n=2),
        tuning.Stage("volume", {"volume": [0, 1]}, [*tuning.SEASON, "n_lags", "volume"]),
    ]
    results = tuning.tune(series, stages)
    counts = {(r["symbol"], r["stage"]): r["count"] for r in results.groupBy("symbol", "stage").count().collect()}
    assert [counts[("a", s.name)] for s in stages] == [1, 3, 16]  # every kept column hands on two values
    best = tuning.best_lists(results, stages[-1]).collect()
    assert all(r["params"]["volume"] == ["1"] for r in best)
    table = evaluation.best_per_stage(results).where("symbol = 'a'").collect()
    mapes = {r["stage"]: r["mape"] for r in table}
    assert mapes["volume"] < mapes["add_ar"]


# Golden check: small copies of report rows (fixed values) and the cells they must give.
REPORT_ROWS = [
    ("2330", "default", 0, 23.6704317943364),
    ("2330", "add_ar", 3, 1.9578032512868133),
    ("2330", "add_ar", 1, 2.0347118965025137),
    ("2330", "tune_close", 25, 1.7812384838785937),
    ("2330", "tune_close", 14, 1.6506640333812643),
    ("2330", "lag_share", 25, 1.7196399085660643),
    ("2330", "lag_share", 0, 1.633154722478951),
    ("2330", "with_future", 0, 1.7979441992381138),
]


def test_summary_of_report_rows(spark):
    results = spark.createDataFrame(REPORT_ROWS, "symbol string, stage string, grid_idx int, mape double")
    names = ["default", "add_ar", "tune_close", "lag_share", "with_future"]
    row = evaluation.stage_summary(results, names).first()
    assert [row[n] for n in names] == [23.67, 1.96, 1.65, 1.63, 1.8]
    assert row["is_lower"] is False
    best = {r["stage"]: r["grid_idx"] for r in evaluation.best_per_stage(results).collect()}
    assert best["tune_close"] == 14
    long = evaluation.melt(evaluation.stage_summary(results, names), names)
    assert long.count() == 5 and long.columns == ["symbol", "Category", "Value"]
    better = evaluation.improved(evaluation.stage_summary(results, names), "tune_close", "add_ar")
    assert evaluation.relative_to(better, ["tune_close"], "add_ar").first()["tune_close"] == pytest.approx(1.65 / 1.96)


def test_factor_flow(spark, prices):
    factors = spark.createDataFrame(
        [("1", "2024-01-30", 10.0, 2), ("1", "2024-01-30", -10.0, 1), ("1", "2024-01-31", None, 3), ("2", "2024-01-29", 2.0, 4)],
        "symbol string, ds string, factor double, seq long",
    ).withColumn("ds", F.to_date("ds"))
    joined = evaluation.with_factor(prices, factors).where("symbol = '1'").orderBy("ds").collect()
    assert [r["factor"] for r in joined][:3] == [None, -10.0, None]
    rows = evaluation.sentiment_training_rows(prices, factors)
    assert {r["factor"] for r in rows.collect()} == {0.5}
    errors = evaluation.variant_errors(
        evaluation.with_factor(prices, factors), {"given": F.col("factor"), "none": F.lit(0.0)}, "2024-01-31"
    )
    got = {(r["symbol"], r["variant"]): r["mape"] for r in errors.collect()}
    pred = [12 * 0.9, 11, 11, 15, 14]
    y = [11.0, 11.0, 15.0, 14.0, 16.0]
    assert got[("1", "given")] == round(np.mean([abs(a - p) / a for a, p in zip(y, pred)]) * 100, 2)
    assert got[("2", "none")] == 50.0


def test_directions_both_modes(spark):
    rows = spark.createDataFrame(
        [("a", date(2024, 1, d), y, f) for d, y, f in [(1, 5.0, 1.0), (2, 6.0, -1.0), (3, 6.0, 1.0), (4, 5.0, 1.0)]],
        "symbol string, ds date, y double, factor double",
    )
    cells = evaluation.confusion(evaluation.directions(rows))
    got = {r["mode"]: r for r in evaluation.direction_metrics(cells).collect()}
    # actual: F T T F; same row: T F T T; row before: F T F T
    assert tuple(got["reference"][c] for c in ("tp", "fn", "fp", "tn")) == (1, 1, 2, 0)
    assert tuple(got["aligned"][c] for c in ("tp", "fn", "fp", "tn")) == (1, 1, 1, 1)
    assert got["reference"]["precision"] == pytest.approx(1 / 3) and got["aligned"]["accuracy"] == 0.5


def test_pairs_go_by_key(spark, prices):
    forecasts = prices.select("symbol", "ds", (F.col("y") + 1).alias("pred")).orderBy(F.desc("ds"))
    validation = prices.where("symbol = '1'")
    pairs = evaluation.validation_pairs(forecasts, validation)
    errors = evaluation.forecast_errors(pairs).collect()
    assert [(r["symbol"], round(r["rmse"], 6)) for r in errors] == [("1", 1.0)]


def test_the_split_does_not_depend_on_the_partitions(spark):
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(rng.normal(size=(400, 3)))], "i int, a double, b double, c double")
    sides = [{r["i"] for r in reconstruct(df.repartition(n), list("abc"), k=2, keys=["i"]).select("i").collect()} for n in (1, 7)]
    assert sides[0] == sides[1] and 50 < len(sides[0]) < 110


def test_compression_keeps_low_rank_data(spark):
    base = np.random.default_rng(3).normal(size=(300, 2))
    data = base @ np.random.default_rng(4).normal(size=(2, 5))
    df = spark.createDataFrame(pd.DataFrame(data, columns=list("abcde")))
    out = reconstruct(df, list("abcde"), k=3)
    assert 20 < out.count() < 120
    assert out.agg(F.max("squared_error")).first()[0] < 1e-12
    assert len(out.first()["code"]) == 3
