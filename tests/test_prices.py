import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bourseflow.operators import prices as p
from bourseflow.operators import stats


def by_day(df, symbol="1"):
    return df.where(F.col("symbol") == symbol).orderBy("ds").toPandas()


def test_average_move_divides_by_the_current_close(prices):
    got = {r["symbol"]: r for r in stats.average_daily_move(prices).collect()}
    y = pd.Series([10.0, 12.0, 11.0, 11.0, 15.0, 14.0, 16.0])
    assert got["1"]["avg_price_change"] == pytest.approx((y.diff() / y).abs().mean())
    assert got["2"]["avg_price_change_pct"] == f"{np.mean([1 / 4, 4 / 8]):.2%}"


def test_moving_average_needs_five_values(prices):
    out = by_day(p.with_price_features(prices))
    assert list(out["MA"]) == pytest.approx([11.8, 12.6, 13.4])
    assert set(out["high_low_diff"]) == {2.0}
    assert p.with_price_features(prices).where("symbol = '2'").count() == 0


def test_unrelated_null_column_drops_rows(prices):
    holed = prices.withColumn("dealer", F.when(F.dayofmonth("ds") != 3, 1.0))
    assert len(by_day(p.with_price_features(holed))) == 2


def test_moves_start_at_zero_inside_the_range(prices):
    out = by_day(p.with_day_moves(p.in_range(prices, "2024-01-31", "2024-02-02")))
    assert list(out["pct_change"]) == pytest.approx([0.0, 0.0, (15 / 11 - 1) * 100])
    assert list(out["volume_change"]) == [0.0, 100.0, 100.0]


def test_label_counts_ties_as_not_up_and_drops_the_last_day(prices):
    assert list(by_day(p.next_day_label(prices))["increase"]) == [True, False, False, True, False, True]


def test_lags_and_forecast_go_by_rows(prices):
    out = by_day(p.with_lags(prices, ["y"], 2))
    assert out["y_lag_2"].tolist()[2:] == [10.0, 12.0, 11.0, 11.0, 15.0]
    gap = prices.where(F.dayofmonth("ds") != 31).withColumn("factor", F.lit(10.0))
    assert by_day(p.with_percent_forecast(gap))["pred"].tolist()[1:3] == pytest.approx([11.0, 13.2])


def test_calendar_fills_gaps(prices):
    gap = prices.where("not (symbol = '1' and dayofmonth(ds) in (31, 1))")
    out = by_day(p.on_calendar(gap, ["y"]))
    assert out["was_filled"].tolist() == [0, 0, 1, 1, 0, 0, 0]
    assert out["y"].tolist()[:4] == [10.0, 12.0, 12.0, 12.0]


@pytest.mark.parametrize(("share", "held"), [(0.2, 1), (0.5, 3), (0.01, 1)])
def test_split_is_chronological(prices, share, held):
    flags = by_day(p.chronological_split(prices, share))["is_validation"].tolist()
    assert flags == [False] * (7 - held) + [True] * held


def test_month_end_skips_null_closes(prices):
    holed = prices.withColumn("y", F.when(~F.col("ds").isin("2024-01-31"), F.col("y")))
    got = {(r["symbol"], str(r["month_end"])): r["y"] for r in stats.month_end_close(holed).collect()}
    assert got[("1", "2024-01-31")] == 12.0
    panel = stats.price_panel(stats.month_end_close(holed), ["1", "2"]).orderBy("month_end").collect()
    assert [r["2"] for r in panel] == [4.0, None]


def test_standardize_flat_series(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 1.0), ("b", 3.0)], "symbol string, y double")
    assert sorted(r["z"] for r in stats.standardize(df).collect()) == [-1.0, 0.0, 0.0, 1.0]


def test_five_numbers_are_null_when_a_symbol_is_missing(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 4.0), (2, 5.0)], "k int, z double")
    rows = {r["k"]: r for r in stats.five_numbers(df, "k", "z", 3).collect()}
    assert (rows[1]["q1"], rows[1]["median"], rows[1]["q3"]) == tuple(np.percentile([1, 2, 4], [25, 50, 75]))
    assert rows[2]["median"] is None and rows[2]["max"] == 5.0


def test_correlations_match_pandas(spark):
    rng = np.random.default_rng(1)
    frame = pd.DataFrame(rng.normal(size=(60, 3)), columns=["a", "b", "c"])
    frame.loc[:9, "b"] = np.nan
    frame["flat"] = 1.0
    rows = [tuple(None if pd.isna(v) else float(v) for v in r) for r in frame.itertuples(index=False)]
    df = spark.createDataFrame(rows, "a double, b double, c double, flat double")
    got = {(r["left"], r["right"]): r["corr"] for r in stats.correlation_matrix(df, list(frame)).collect()}
    expected = frame[["a", "b", "c"]].corr()
    assert len(got) == 9
    for (i, j), value in got.items():
        assert value == pytest.approx(expected.loc[i, j])


def test_correlations_of_groups_far_from_zero(spark, capsys):
    """Large means, a missing half, a group of one row, and no row opened into pairs of columns."""
    rng = np.random.default_rng(3)
    frame = pd.DataFrame(rng.normal(size=(200, 3)) + 1e8, columns=["a", "b", "c"])
    frame["c"] = frame["a"] * 2 + rng.normal(size=200)
    frame.loc[100:, "b"] = np.nan
    frame["g"] = ["x" if i % 3 else "y" for i in range(200)]
    rows = [(r.g, r.a, None if pd.isna(r.b) else r.b, r.c) for r in frame.itertuples()] + [("one", 1.0, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "g string, a double, b double, c double").repartition(7)
    cells = stats.correlation_matrix(df, ["a", "b", "c"], ["g"])
    got = {(r["g"], r["left"], r["right"]): r["corr"] for r in cells.collect()}
    assert len(got) == 18 and not any(g == "one" for g, _, _ in got)
    for (g, i, j), value in got.items():
        assert value == pytest.approx(frame[frame.g == g][["a", "b", "c"]].corr().loc[i, j], abs=1e-6)
    cells.explain("formatted")
    assert "Generate" not in capsys.readouterr().out


@pytest.mark.parametrize("max_lag", [3, 10, 60])
def test_a_long_series_in_many_ranges(spark, capsys, max_lag):
    rng = np.random.default_rng(4)
    series = {"long": rng.normal(size=500).cumsum() + 1e6, "short": rng.normal(size=5), "flat": np.full(40, 0.1), "one": np.ones(1)}
    rows = [(k, i, float(v)) for k, x in series.items() for i, v in enumerate(x)] + [("long", 1000, None)]
    df = spark.createDataFrame(rows, "k string, i int, v double").repartition(6)
    found = stats.autocorrelation(df, "v", "i", ["k"], max_lag)
    got = {(r["k"], r["lag"]): (r["n"], r["acf"], r["band"]) for r in found.collect()}
    wanted = {}
    for k in ("long", "short"):
        d = series[k] - series[k].mean()
        acf = [float((d[: len(d) - j] * d[j:]).sum() / (d * d).sum()) for j in range(min(max_lag + 1, len(d)))]
        for j, a in enumerate(acf):
            wanted[k, j] = (len(d), a, 1.96 * np.sqrt((1 + 2 * sum(x * x for x in acf[1:j])) / len(d)) if j else 0.0)
    assert got.keys() == wanted.keys()
    for key, value in wanted.items():
        assert got[key] == pytest.approx(value, abs=1e-7)
    found.explain("formatted")
    plan = capsys.readouterr().out
    assert "Window" not in plan and "Generate" not in plan


def test_autocorrelation_and_band(spark):
    x = np.random.default_rng(2).normal(size=80).cumsum()
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(x)], "k string, i int, v double")
    got = stats.autocorrelation(df, "v", "i", ["k"], 10).orderBy("lag").collect()
    d = x - x.mean()
    acf = [float((d[: len(d) - k] * d[k:]).sum() / (d * d).sum()) for k in range(11)]
    assert [r["acf"] for r in got] == pytest.approx(acf)
    band = [0.0] + [1.96 * np.sqrt((1 + 2 * sum(a * a for a in acf[1:k])) / 80) for k in range(1, 11)]
    assert [r["band"] for r in got] == pytest.approx(band)


def test_describe_and_counts(spark):
    values = [0.0, 0.5, 0.5, 1.0, 0.25]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    got, expected = stats.describe(df, "x").first(), pd.Series(values).describe()
    assert list(got) == pytest.approx(expected.tolist())
    assert [tuple(r) for r in stats.value_counts(df, "x").collect()][0] == (0.5, 2)
    assert stats.null_rows(df, "x").count() == 1


def test_last_row_is_dropped_per_group(prices):
    assert p.without_last_day(prices).count() == prices.count() - 2


def test_row_mean(prices):
    got = {str(r["ds"]): r["mean"] for r in stats.row_mean(prices, "ds", "y").collect()}
    assert got["2024-01-29"] == 7.5


def test_row_counts_come_with_the_job(prices):
    df, seen = stats.observed(prices, "loaded")
    df.where("symbol = '2'").collect()
    assert seen.get == {"rows": 10}
