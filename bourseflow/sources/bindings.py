"""The market shapes (prices, news, factors, rules, vectors) taken from the given tables.

``lineitem`` rows act as trades, ``documents`` as news, ``labels`` as scores,
``benchmark`` as rule texts, ``embeddings`` as the vector store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bourseflow.functions.text import uuid5

N_SYMBOLS = 20
FIRST_SYMBOL = 2300
SYMBOLS = [str(FIRST_SYMBOL + i) for i in range(N_SYMBOLS)]
FIRST_NEWS_DAY = "1995-01-02"
NEWS_DAYS = 500

# Names the companies go by in the texts (matched in lower case).
STOCK_NAMES = (
    "Thble Attion Ering Thanea Oning Retion Onble Antion Inble Reing "
    "Nicht Enver Ersch Enlich Outre Eauou Ouaux Mente Queci Asque"
).split()
POSITIVE_WORDS = ["the", "and", "les", "und", "con"]
NEGATIVE_WORDS = ["that", "with", "der", "que", "los"]


SPREAD_BELOW_BYTES = 256 * 1024 * 1024


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_texts(spark: SparkSession, folder: str, name: str, key: str) -> DataFrame:
    """A text table; one that is too small to fill the cores is spread over them by key.

    A small file has few row groups, so its scan gives few tasks, while the work
    per text is large. Beyond the size bound the scan has tasks enough, and the
    texts stay where they are read.
    """
    table = read_table(spark, folder, name)
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= SPREAD_BELOW_BYTES:
        return table
    return table.repartition(spark.sparkContext.defaultParallelism, key)


def stock_daily(spark: SparkSession, folder: str) -> DataFrame:
    """Daily prices per symbol out of trades: one scan, one partial + final aggregation.

    The close is the price of the day's last trade. Order number, line number
    and price are packed into one decimal, because the engine aggregates by hash
    only over fixed-width values; a struct would force a sort of all trades.
    """
    trades = read_table(spark, folder, "lineitem")
    company = F.col("l_suppkey") % N_SYMBOLS + FIRST_SYMBOL
    trade_no = (F.col("l_orderkey") * 100 + F.col("l_linenumber")).cast("decimal(20,0)")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("decimal(18,0)")
    latest = (trade_no * F.lit(10**15).cast("decimal(16,0)") + cents).cast("decimal(38,0)")
    quantity = F.col("l_quantity")

    def part(condition):
        return F.sum(F.when(condition, quantity).otherwise(0.0))

    line, flag = F.col("l_linenumber"), F.col("l_returnflag")
    volume = F.sum(quantity)
    daily = trades.groupBy(company.alias("company"), F.col("l_shipdate").cast("date").alias("ds")).agg(
        F.max_by("l_extendedprice", latest).alias("y"),
        F.max("l_extendedprice").alias("high_price"),
        F.min("l_extendedprice").alias("low_price"),
        volume.alias("volume"),
        part(flag == "A").alias("foreign"),
        part(flag == "N").alias("investment"),
        part(flag == "R").alias("dealer"),
        (part(line >= 4) / volume).alias("ratio_over_400_shares"),
        (part(line == 4) / volume).alias("shareholders_400_to_600"),
        (part(line == 5) / volume).alias("shareholders_600_to_800"),
        (part(line == 6) / volume).alias("shareholders_800_to_1000"),
        (part(line >= 7) / volume).alias("ratio_over_1000_shares"),
    )
    return daily.select(F.col("company").cast("string").alias("symbol"), *[c for c in daily.columns if c != "company"])


def _published(doc_id):
    day = F.date_add(F.lit(FIRST_NEWS_DAY).cast("date"), (doc_id % NEWS_DAYS).cast("int"))
    seconds = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), doc_id % 86400)
    return day, day.cast("timestamp_ntz") + seconds


def news(spark: SparkSession, folder: str) -> DataFrame:
    return as_news(read_texts(spark, folder, "documents", "doc_id"))


def as_news(documents: DataFrame) -> DataFrame:
    day, moment = _published(F.col("doc_id"))
    return documents.select(
        F.col("doc_id").alias("id"),
        F.col("text").alias("content"),
        "source",
        moment.alias("publish_at"),
        day.alias("news_date"),
        uuid5(F.col("doc_id").cast("string")).alias("uuid"),
    )


def factors(spark: SparkSession, folder: str) -> DataFrame:
    """Scores per symbol and day; every third row comes a second time with another value."""
    labels = read_table(spark, folder, "labels")
    day, _ = _published(F.col("doc_id"))
    base = labels.select(
        (F.col("doc_id") % N_SYMBOLS + FIRST_SYMBOL).cast("string").alias("symbol"),
        day.alias("ds"),
        (F.col("quality") - F.col("toxic")).cast("double").alias("factor"),
        (F.col("doc_id") * 2).alias("seq"),
        F.col("doc_id"),
    )
    again = base.where(F.col("doc_id") % 3 == 0).select(
        "symbol", "ds", (F.col("factor") + 0.5).alias("factor"), (F.col("seq") + 1).alias("seq"), "doc_id"
    )
    return base.unionByName(again).drop("doc_id")


def rules(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "benchmark").select(
        F.date_add(F.lit(FIRST_NEWS_DAY).cast("date"), (F.col("item_id") % NEWS_DAYS).cast("int"))
        .cast("string")
        .alias("publish_at"),
        F.col("text").alias("content"),
        uuid5(F.col("text")).alias("uuid"),
    )


def companies() -> list[dict]:
    """The company list: symbol, name, mean daily move in percent, topic words."""
    return [
        {
            "symbol": symbol,
            "stock_name": name,
            "avg_change": round(1.0 + i / 10, 2),
            "keywords": [POSITIVE_WORDS[i % 5], NEGATIVE_WORDS[i % 5]],
        }
        for i, (symbol, name) in enumerate(zip(SYMBOLS, STOCK_NAMES, strict=True))
    ]


def company_rules() -> dict[str, dict[str, list[str]]]:
    """Positive and negative rule phrases per company."""
    return {
        name: {
            "positive": [f"order {i}", f"launch {i}"],
            "negative": [f"recall {i}", f"delay {i}"],
        }
        for i, name in enumerate(STOCK_NAMES)
    }


def replies(spark: SparkSession, folder: str) -> DataFrame:
    """Model replies of every shape: plain, with a thinking block, without a number."""
    labels = read_table(spark, folder, "labels")
    documents = read_table(spark, folder, "documents").select("doc_id", F.col("text").alias("head"))
    number = (F.col("quality") - F.col("toxic")).cast("string")
    head = F.regexp_replace("head", r"\n", " ")
    body = F.when(F.col("doc_id") % 11 == 0, head).otherwise(F.concat(number, F.lit("\n"), head))
    wrapped = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("<think>\nnot 9.9\n</think>\n"), body)).otherwise(body)
    return labels.join(documents, "doc_id").select("doc_id", wrapped.alias("reply"))
