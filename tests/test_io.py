import csv
import json
from datetime import date, datetime

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from bourseflow.operators import prompts, scoring
from bourseflow.plans import scoring as plans
from bourseflow.session import new_table_path
from bourseflow.sources import files, sinks
from bourseflow.sources.versions import read_version, replace_rows
from bourseflow.streaming import loads

COMPANIES = [{"symbol": "2330", "stock_name": "台積電", "avg_change": 1.39, "keywords": ["科技"]}]
RULES = {"台積電": {"positive": ["甲"], "negative": ["乙"]}}


def write_csv(path, header, rows):
    with open(path, "w", newline="", encoding="utf-8") as f:
        writer = csv.writer(f)
        writer.writerow(header)
        writer.writerows(rows)


NEWS_HEADER = ["title", "keywords", "content", "publish_at", "id", "summary", "related_stocks", "uuid"]


def write_news(folder, day, contents, first_id=100):
    rows = [
        [f"t{i}", "['台積電', '超微']", c, f"{day} 08:00:{i:02d}", first_id - i, "", "['﻿2330', '2330']", f"u{day}{i}"]
        for i, c in enumerate(contents)
    ]
    write_csv(folder / f"news_{day}.csv", NEWS_HEADER, rows)


def test_price_files(spark, tmp_path):
    for symbol, y in (("2330", "600.5"), ("2301", "")):
        write_csv(
            tmp_path / f"{symbol}_stock_data_0630.csv",
            ["", "ds", "y", "volume"],
            [[0, "2024-01-02", y, "10"], [1, "2024-01-03", "NaN", "11"]],
        )
    got = files.read_prices(spark, str(tmp_path)).orderBy("symbol", "ds").collect()
    assert [(r["symbol"], r["ds"], r["y"], r["volume"]) for r in got] == [
        ("2301", date(2024, 1, 2), None, 10.0),
        ("2301", date(2024, 1, 3), None, 11.0),
        ("2330", date(2024, 1, 2), 600.5, 10.0),
        ("2330", date(2024, 1, 3), None, 11.0),
    ]


def test_news_files(spark, tmp_path):
    write_news(tmp_path, "2023-01-01", ['line one\nline "two", three', "x"])
    write_news(tmp_path, "2023-01-03", ["y"])
    got = files.read_news(spark, str(tmp_path)).orderBy("publish_at").collect()
    assert [str(r["news_date"]) for r in got] == ["2023-01-01", "2023-01-01", "2023-01-03"]
    assert got[0]["content"] == 'line one\nline "two", three'
    assert got[0]["keywords"] == ["台積電", "超微"] and got[0]["related_stocks"] == ["2330"]
    assert got[0]["publish_at"] == datetime(2023, 1, 1, 8)


def test_reports_and_best_parameters(spark, tmp_path):
    for symbol, mape in (("2330", 1.9), ("2301", 1.5)):
        (tmp_path / symbol).mkdir()
        write_csv(tmp_path / symbol / "add_ar.csv", ["", "n_lags", "RMSE", "MAPE"], [[3, 4, 9.0, mape], [1, 2, 9.5, 2.5]])
        (tmp_path / symbol / "add_ar.json").write_text(json.dumps({"n_lags": [4, 2], "flag": [True]}, indent=4))
    (tmp_path / "2330" / "other.csv").write_text("a\n1\n")
    got = files.read_reports(spark, str(tmp_path), "add_ar.csv")
    assert sorted((r["symbol"], r["grid_idx"], r["MAPE"]) for r in got.collect()) == [
        ("2301", 1, 2.5), ("2301", 3, 1.5), ("2330", 1, 2.5), ("2330", 3, 1.9),
    ]
    best = files.read_best_params(spark, str(tmp_path), "add_ar.json")
    assert {r["symbol"]: r["params"] for r in best.collect()}["2330"] == {"n_lags": ["4", "2"], "flag": ["true"]}
    path = new_table_path(spark, "best")
    sinks.write_best_params(best, path)
    stored = spark.read.text(path).collect()
    assert {str(r["symbol"]): json.loads(r["value"]) for r in stored}["2301"] == {"n_lags": ["4", "2"], "flag": ["true"]}
    again = files.read_best_params(spark, path)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, best.collect()))


def test_price_files_of_differing_headers(spark, tmp_path):
    """Columns in another order, one missing, one more, and rows that do not fit."""
    write_csv(tmp_path / "1_a.csv", ["", "ds", "y", "volume"], [[0, "2024-01-02", "1.5", "10"], [1, "2024-01-03", "x", "11"]])
    write_csv(tmp_path / "2_a.csv", ["volume", "extra", "y", "ds"], [["20", "?", "2.5", "2024-01-02"], ["21", "?", "3.5"]])
    write_csv(tmp_path / "3_a.csv", ["ds", "y"], [["2024-01-02", "4.5"], ["2024-01-03", ""], ["2024-01-04", "NaN"]])
    (tmp_path / "4_a.csv").write_text("")
    (tmp_path / "5_a.csv").write_text("\ufeffds,y\n2024-01-02,6.5\n", encoding="utf-8")
    seen = Observation()
    frame = files.read_prices(spark, str(tmp_path), observation=seen)
    assert dict(frame.dtypes) == {"symbol": "string", "ds": "date", "y": "double", "volume": "double"}
    got = sorted((r["symbol"], str(r["ds"]), r["y"], r["volume"]) for r in frame.collect())
    assert got == [
        ("1", "2024-01-02", 1.5, 10.0), ("2", "2024-01-02", 2.5, 20.0),
        ("3", "2024-01-02", 4.5, None), ("3", "2024-01-03", None, None), ("3", "2024-01-04", None, None), ("5", "2024-01-02", 6.5, None),
    ]
    assert seen.get == {"rows": 8, "broken": 2}
    types = {"ds": "date", "y": "double", "volume": "double"}
    assert sorted(r["_broken"] for r in files.broken_rows(spark, str(tmp_path), types).collect()) == ["1,2024-01-03,x,11", "21,?,3.5"]
    assert frame.select("symbol").count() == 6  # also when no other column is asked for


def test_big5_rules_factors_settings(spark, tmp_path):
    (tmp_path / "big5.csv").write_bytes("代號,有清理\n2330,1.5\n".encode("big5"))
    assert files.read_big5(spark, str(tmp_path / "big5.csv")).first().asDict() == {"代號": "2330", "有清理": "1.5"}
    write_csv(tmp_path / "rules.csv", ["publish_at", "content", "uuid"], [["2025-07-28", "如果, 甲", "u"]])
    assert files.read_rules(spark, str(tmp_path / "rules.csv")).first()["content"] == "如果, 甲"
    write_csv(
        tmp_path / "pred_2330.csv",
        ["date", "factor", "explanation", "updated_time", "news_count"],
        [["2024-11-01", "2.5", "OK", "2025-08-01 10:00:00", "15"], ["2024-11-04", "", "TLE", "2025-08-01 10:00:20", "0"]],
    )
    got = files.read_factors(spark, str(tmp_path / "pred_2330.csv")).orderBy("ds").collect()
    assert [(r["symbol"], r["factor"], r["explanation"], r["news_count"]) for r in got] == [
        ("2330", 2.5, "OK", 15), ("2330", None, "TLE", 0),
    ]
    (tmp_path / "stocks.yml").write_text("stocks:\n  - symbol: 2330\n    stock_name: '台積電'\n    avg_change: 1.39\n    keywords: ['科技']\n")
    companies = files.companies_of(files.read_settings(str(tmp_path / "stocks.yml")))
    assert files.company_table(spark, companies).first().asDict() == COMPANIES[0]


def test_overwrite_keeps_only_the_last_report(spark):
    path = new_table_path(spark, "report")
    sinks.overwrite_csv(spark.range(5), path)
    sinks.overwrite_csv(spark.createDataFrame([('a "b"\nc', 1)], "t string, n int"), path)
    got = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).collect()
    assert [tuple(r) for r in got] == [('a "b"\nc', "1")]


def test_status_of_each_kind_of_answer(spark):
    def client(prompt):
        import time

        if "slow" in prompt:
            time.sleep(3)
        return "no number" if "bad" in prompt else "<think>hm</think>\n1.5"

    df = spark.createDataFrame([("a", "fine"), ("b", "slow"), ("c", "bad"), ("d", "fine")], "k string, prompt string")
    got = {r["k"]: (r["factor"], r["explanation"]) for r in scoring.percent_scores(scoring.ask(df, client, 0.5)).collect()}
    assert got == {"a": (1.5, "OK"), "b": (None, "TLE"), "c": (None, "REJ"), "d": (1.5, "OK")}
    two_lines = scoring.ask(df, lambda p: "0.3\nwhy" if p == "fine" else "0.3")
    kept = {r["k"]: r["explanation"] for r in scoring.sentiment_scores(two_lines).collect()}
    assert kept == {"a": "why", "d": "why"}


def test_equal_prompts_get_equal_answers():
    client = scoring.KeywordClient(["上漲"], ["下跌"])
    assert client("上漲 上漲 下跌") == client("上漲 上漲 下跌") == "3.3"
    assert client("nothing") == "0.0"


def test_scored_days_end_to_end(spark, prices):
    daily = prices.where("symbol = '1'").withColumn("symbol", F.lit("2330")).withColumn("foreign", F.lit(80000.0))
    news = spark.createDataFrame(
        [(1, "台積電 上漲", "2024-01-30 08:00:00"), (2, "other", "2024-01-31 08:00:00"), (3, "2330 下跌", "2024-02-10 08:00:00")],
        "id long, content string, publish_at string",
    ).select("id", "content", F.to_timestamp_ntz("publish_at").alias("publish_at"), F.to_date("publish_at").alias("news_date"))
    rules = spark.createDataFrame([(f"u{i}", f"台積電 rule {'x' * i}") for i in range(20)], "uuid string, content string")
    client = scoring.KeywordClient(["上漲"], ["下跌"])
    args = (news, daily, COMPANIES, RULES, rules, client, "2024-01-29", "2024-02-20")
    got = plans.percent_days(*args).collect()
    # one trading day has matching news; the news of the third article is no trading day
    assert [(str(r["news_date"]), r["rule_count"], r["news_count"], r["explanation"]) for r in got] == [("2024-01-30", 15, 1, "OK")]
    prompt = got[0]["prompt"]
    assert "Change: 20.0%" in prompt and "Foreign net: 8.0" in prompt and "Mean move: 1.39%" in prompt
    assert "甲的消息，則隔日股價可能上漲。\n" in prompt and prompt.count("台積電 rule") == 15
    path = new_table_path(spark, "factors")
    sinks.append_factors(plans.percent_days(*args), path)
    sinks.append_factors(plans.percent_days(*args), path)
    stored = spark.read.parquet(path)
    assert stored.count() == 2 and stored.first()["news_count"] == 15 and stored.first()["article_count"] == 1
    first = scoring.keep_first(stored.withColumn("symbol", F.col("symbol").cast("string")).withColumnRenamed("date", "ds"))
    assert first.count() == 1
    two = lambda prompt: f"{0.5}\n{len(prompt) > 0}"
    days = plans.sentiment_days(news, COMPANIES, RULES, None, two, "2024-01-01", "2024-02-29").collect()
    assert sorted(str(r["news_date"]) for r in days) == ["2024-01-30", "2024-02-10"]


def test_streams_pick_up_new_files_once(spark, tmp_path):
    folder = tmp_path / "news"
    folder.mkdir()
    write_news(folder, "2023-01-01", ["台積電 上漲", "none"])
    table, progress = new_table_path(spark, "scored"), new_table_path(spark, "progress")
    asked = tmp_path / "asked"
    asked.mkdir()
    log = str(asked)

    def client(prompt):
        import uuid

        open(f"{log}/{uuid.uuid4().hex}", "w").close()
        return "0.9\nup"

    def score(days):
        return plans.sentiment_of(days, COMPANIES, RULES, None, client)

    state = new_table_path(spark, "articles")

    def run(progress, **options):
        loads.scoring_stream(files.stream_news(spark, str(folder)), COMPANIES, score, table, state, progress, **options)
        return sorted((str(r["date"]), r["article_count"]) for r in sinks.read_factor_table(spark, table).collect())

    assert run(progress) == [("2023-01-01", 1)]
    write_news(folder, "2023-01-02", ["2330 下跌"])
    assert run(progress) == [("2023-01-01", 1), ("2023-01-02", 1)]
    # a lost progress folder replays all files; nothing is asked or written twice
    assert run(new_table_path(spark, "progress")) == [("2023-01-01", 1), ("2023-01-02", 1)]
    assert len(list(asked.iterdir())) == 2
    # an article of the first day arrives late, in a file of its own: that day is scored again
    late = folder / "late"
    late.mkdir()
    write_news(late, "2023-01-01", ["台積電 下跌"], first_id=500)
    (late / "news_2023-01-01.csv").rename(folder / "news_2023-01-01.csv.late.csv")
    late.rmdir()
    assert run(progress) == [("2023-01-01", 2), ("2023-01-02", 1)]
    assert len(list(asked.iterdir())) == 3
    # with a watermark of one day the third day closes the first
    write_news(folder, "2023-01-03", ["2330 上漲"])
    run(progress, open_days=1)
    kept = read_version(spark, state, loads.LATEST, "news_date")
    assert {str(r["news_date"]) for r in kept.collect()} == {"2023-01-02", "2023-01-03"}
    assert [d for d, _ in run(progress, open_days=1)] == ["2023-01-01", "2023-01-02", "2023-01-03"]


def test_rows_are_replaced_by_key(spark, tmp_path):
    schema = "symbol string, day date, value double"
    path = str(tmp_path / "table")

    def put(rows, **options):
        frame = spark.createDataFrame([(s, d and date.fromisoformat(d), v) for s, d, v in rows], schema)
        return replace_rows(frame, path, ["symbol", "day"], "day", **options)

    def seen(version=None):
        found = read_version(spark, path, schema, "day", version).collect()
        return sorted(((r["symbol"], r["day"] and str(r["day"]), r["value"]) for r in found), key=repr)

    assert seen() == []
    assert put([("a", "2024-01-01", 1.0), ("b", "2024-01-01", 2.0), ("a", "2024-01-02", 3.0), ("a", None, 4.0)]) == 1
    assert put([("b", "2024-01-01", 5.0), ("a", None, 6.0)]) == 2
    second = [("a", "2024-01-01", 1.0), ("a", "2024-01-02", 3.0), ("a", None, 6.0), ("b", "2024-01-01", 5.0)]
    assert seen() == second and len(seen(1)) == 4
    # a write that ended before its manifest is not seen, and the next one takes its place
    spark.createDataFrame([("x", 9.0)], "symbol string, value double").write.parquet(f"{path}/data/held=3/day=2024-01-09")
    assert seen() == second
    assert put([("c", "2024-01-02", 7.0)]) == 3
    assert seen() == sorted([*second, ("c", "2024-01-02", 7.0)], key=repr)
    # a version that is there is left alone
    assert put([("c", "2024-01-02", 8.0)], version=3) == 3 and ("c", "2024-01-02", 7.0) in seen()
    # a key without a new row goes, and so does a partition that is not kept
    gone = spark.createDataFrame([("c", date(2024, 1, 2)), ("a", date(2024, 1, 2))], "symbol string, day date")
    put([("c", "2024-01-02", 8.0)], touched=gone)
    assert ("c", "2024-01-02", 8.0) in seen() and ("a", "2024-01-02", 3.0) not in seen()
    put([], keep=F.col("part") >= "2024-01-02")
    assert seen() == [("c", "2024-01-02", 8.0)]
    with pytest.raises(ValueError):
        replace_rows(spark.createDataFrame([], schema), path, ["symbol"], "day")


def test_document_stream_fills_the_chunk_table(spark, tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    write_news(folder, "2023-01-01", ["短內容", "長內容" * 3000])
    path, progress = new_table_path(spark, "chunks"), new_table_path(spark, "progress")
    for _ in range(2):
        source = files.stream_news(spark, str(folder)).select("uuid", F.col("news_date").cast("string").alias("publish_at"), "content")
        loads.index_stream(source, path, progress)
    assert spark.read.parquet(path).count() == 3


def test_templates_hold_every_place():
    for name in ("company", "context", "change_percent", "volume_change", "foreign_change", "avg_change", "rules_text", "company_rules_text"):
        assert "{" + name + "}" in prompts.PERCENT_TEMPLATE
    with pytest.raises(KeyError):
        from bourseflow.functions.text import fill_template

        fill_template("{unknown}")
