import uuid
from datetime import date

import pytest
from pyspark.errors import AnalysisException  # noqa: F401
from pyspark.sql import functions as F

from bourseflow.functions import dates, numbers, text


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("out")).first()["out"]


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("看這裡 https://a.b/c?d=1&e=(2)\n下一行", "看這裡 下一行"),
        ("  a \t\n b\u3000\u3000c  ", "a b c"),
        ("a  b", "a b"),
        ("http://x.y中文", "中文"),
        ("\u00a0全形\u3000空白\u00a0", "全形 空白"),
        ("", ""),
    ],
)
def test_clean_text(spark, raw, expected):
    assert one(spark, text.clean_text(F.col("t")), t=raw) == expected


def test_words_split_chinese_runs_and_keep_latin_runs(spark):
    assert one(spark, text.words(F.col("t")), t="AI 伺服器!") == ["AI", "伺", "伺服", "伺服器", "服", "服器", "器"]
    assert one(spark, text.words(F.col("t")), t="plain text 7") == ["plain", "text", "7"]


@pytest.mark.parametrize("raw", ["營收 12.5 億 https://a.b/c1 see Q3", "abc123def 4", "no digits", "", "１２ab"])
def test_article_words_equal_the_long_way(spark, raw):
    short = one(spark, text.article_words(F.col("t")), t=raw)
    long_way = text.word_tokens(text.words(text.blank_digits(text.clean_text(F.col("t")))))
    assert short == one(spark, long_way, t=raw)


@pytest.mark.parametrize(("n", "expected"), [(0, []), (1, []), (2, ["ab"]), (3, ["ab", "bc"])])
def test_joined_pairs(spark, n, expected):
    df = spark.createDataFrame([(["a", "b", "c"][:n],)], "a array<string>")
    assert df.select(text.joined_pairs(F.col("a")).alias("o")).first()["o"] == expected


def test_joined_windows_with_size_and_step(spark):
    df = spark.createDataFrame([(list("abcdefg"),)], "a array<string>")
    assert df.select(text.joined_pairs(F.col("a"), 3, 2).alias("o")).first()["o"] == ["abc", "cde", "efg"]


@pytest.mark.parametrize(
    ("reply", "score", "explanation"),
    [
        ("0.7\n獲利創高", 0.7, "獲利創高"),
        ("<think>\n1\n2</think>\n\n 0.4 \nline one\nline two", 0.4, "line one\nline two"),
        ("0.5", None, None),
        ("good\n0.5", None, None),
        ("nan\ntext", None, None),
        ("\u3000+2.5\ntext\n\u3000", 2.5, "text"),
    ],
)
def test_two_line_reply(spark, reply, score, explanation):
    s, e = text.parse_two_line_reply(F.col("r"))
    assert one(spark, s, r=reply) == score
    assert one(spark, e, r=reply) == explanation


@pytest.mark.parametrize(
    ("reply", "score"),
    [("2.2", 2.2), ("<think>x</think>-1.8\n", -1.8), ("2.2%", None), ("inf", None), ("1\n2", None), ("", None)],
)
def test_number_reply(spark, reply, score):
    assert one(spark, text.parse_number_reply(F.col("r")), r=reply) == score


def test_boxed_reply(spark):
    s, e = text.parse_boxed_reply(F.col("r"))
    reply = "\\boxed{\n0.3\nbecause}"
    assert (one(spark, s, r=reply), one(spark, e, r=reply)) == (0.3, "because")


@pytest.mark.parametrize("name", ["", "abc", "如果新聞出現 營收增加 的情況", "x" * 500])
def test_uuid5(spark, name):
    assert one(spark, text.uuid5(F.col("t")), t=name) == str(uuid.uuid5(uuid.NAMESPACE_DNS, name))


def test_list_text(spark):
    raw = "['\ufeff台積電', '超微', '台積電']"
    assert one(spark, text.parse_list_text(F.col("t")), t=raw) == ["台積電", "超微"]


def test_numbered_lines(spark):
    df = spark.createDataFrame([(["a", "b"],)], "a array<string>")
    assert df.select(text.numbered_lines(F.col("a")).alias("o")).first()["o"] == "新聞內容0: a\n新聞內容1: b"


def test_template_places_inside_values_stay(spark):
    filled = text.fill_template("<{a}|{b}|{a}>", a=F.col("x"), b=F.col("y"))
    assert one(spark, filled, x="{b}", y="2") == "<{b}|2|{b}>"


@pytest.mark.parametrize(
    ("start", "end", "n"), [("2023-01-01", "2023-01-05", 5), ("2024-05-13", "2024-05-13", 1), ("2024-05-15", "2024-05-13", 0)]
)
def test_date_range(spark, start, end, n):
    literal = dates.date_array(F.lit(start).cast("date"), F.lit(end).cast("date"))
    from_column = dates.date_array(F.col("a").cast("date"), F.col("b").cast("date"))
    for column in (literal, from_column):
        days = one(spark, column, a=start, b=end)
        assert len(days) == n
        assert n == 0 or (days[0] == date.fromisoformat(start) and days[-1] == date.fromisoformat(end))


def test_strict_date_rejects_a_time(spark):
    with pytest.raises(Exception, match="CANNOT_PARSE|2025-04-02"):
        one(spark, dates.strict_date(F.col("t")), t="2025-04-02 16:00:00")


def test_numbers(spark):
    row = spark.sql("select 1.5D as high, -0.5D as low, cast(null as double) as none, 0.013935D as move").select(
        numbers.clip(F.col("high"), 0, 1).alias("high"),
        numbers.clip(F.col("low"), 0, 1).alias("low"),
        numbers.clip(F.col("none"), 0, 1).alias("none"),
        numbers.percent_text(F.col("move")).alias("text"),
        numbers.short_percent(F.lit(2.125)).alias("even"),
        numbers.ten_thousands(F.lit(123456.0)).alias("tens"),
    )
    assert tuple(row.first()) == (1.0, 0.0, None, "1.39%", 2.12, 12.3)
