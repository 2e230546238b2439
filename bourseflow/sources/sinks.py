"""Outputs: overwritten reports, appended scores, the chunk table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bourseflow.sources.versions import read_version, replace_rows

CHUNK_SCHEMA = "chunk_id string, publish_at date, content string"
#: Chunks with vectors; the last two are folders.
VECTOR_SCHEMA = "chunk_id string, content string, embedding array<float>, model string, publish_at date"


def overwrite_csv(df: DataFrame, path: str) -> None:
    """Replace a CSV report."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def overwrite_table(df: DataFrame, path: str, *partitions: str) -> None:
    df.write.mode("overwrite").partitionBy(*partitions).parquet(path)


FACTOR_TABLE = (
    "symbol string, date date, factor double, explanation string, updated_time timestamp_ntz,"
    " news_count int, article_count int, was_truncated boolean"
)


def factor_rows(scored: DataFrame) -> DataFrame:
    """Scored days as rows of the factor table, stamped with the time of writing.

    ``news_count`` keeps the number of retrieved rules, as readers of the table
    know it; ``article_count`` is the number of articles.
    """
    return scored.select(
        "symbol",
        F.col("news_date").alias("date"),
        "factor",
        "explanation",
        F.current_timestamp().cast("timestamp_ntz").alias("updated_time"),
        F.col("rule_count").alias("news_count"),
        F.col("news_count").alias("article_count"),
        "was_truncated",
    )


def append_factors(scored: DataFrame, path: str) -> None:
    """Append scored days, one folder per symbol; a day scored again is there twice."""
    factor_rows(scored).write.mode("append").partitionBy("symbol").parquet(path)


def replace_factors(scored: DataFrame, path: str, version: int | None = None, touched: DataFrame | None = None) -> int:
    """Put scored days in place of what is stored for them. ``touched`` (symbol, news_date) names days scored without a result, too."""
    if touched is not None:
        touched = touched.select("symbol", F.col("news_date").alias("date"))
    return replace_rows(factor_rows(scored), path, ["symbol", "date"], "date", version, touched)


def read_factor_table(spark: SparkSession, path: str) -> DataFrame:
    """One row per company and day of a table kept with ``replace_factors``."""
    return read_version(spark, path, FACTOR_TABLE, "date")


def write_best_params(lists: DataFrame, path: str) -> None:
    """One JSON object of lists per symbol, in a folder per symbol."""
    lists.select("symbol", F.to_json("params").alias("value")).write.mode("overwrite").partitionBy("symbol").text(path)


def reset_chunks(spark: SparkSession, path: str, schema: str = CHUNK_SCHEMA) -> None:
    """Empty the chunk table (or make it)."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def open_chunks(spark: SparkSession, path: str, schema: str = CHUNK_SCHEMA) -> DataFrame:
    """Stored chunks; the table is made when it is not there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        reset_chunks(spark, path, schema)
        return spark.read.schema(schema).parquet(path)


def append_chunks(new_chunks: DataFrame, path: str) -> None:
    new_chunks.write.mode("append").parquet(path)


def append_vectors(new_chunks: DataFrame, path: str) -> None:
    """Chunks with vectors, by the version of the model and the publishing day."""
    new_chunks.write.mode("append").partitionBy("model", "publish_at").parquet(path)
