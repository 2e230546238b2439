"""Loading documents into the chunk table, with or without vectors, and retrieving from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bourseflow.functions.vectors import embed
from bourseflow.operators.chunks import CHUNK_TOKENS, OVERLAP_TOKENS, index_rows, only_new, split_documents
from bourseflow.operators.nearest import nearest
from bourseflow.sources.sinks import VECTOR_SCHEMA, append_chunks, append_vectors, open_chunks, reset_chunks


def load_documents(
    documents: DataFrame,
    path: str,
    reset: bool = False,
    size: int = CHUNK_TOKENS,
    overlap: int = OVERLAP_TOKENS,
) -> None:
    """Append the chunks whose ids are not stored yet; a repeated load adds nothing.

    ``documents``: uuid, publish_at (``yyyy-MM-dd``), content.
    """
    spark = documents.sparkSession
    if reset:
        reset_chunks(spark, path)
    stored = open_chunks(spark, path)
    chunks = index_rows(split_documents(documents, size, overlap))
    append_chunks(only_new(chunks, stored), path)


def index_documents(documents: DataFrame, path: str, model, size: int = CHUNK_TOKENS, overlap: int = OVERLAP_TOKENS) -> None:
    """Append unseen chunks with their vectors, one folder per model version and publishing day.

    A chunk is embedded when it is stored, and never again: ids that the table
    holds for this version leave before the vectors are made. Another version
    is filled beside the old one, which can still be read meanwhile.
    """
    stored = open_chunks(documents.sparkSession, path, VECTOR_SCHEMA).where(F.col("model") == model.version)
    new = only_new(index_rows(split_documents(documents, size, overlap)), stored)
    append_vectors(embed(new, model).withColumn("model", F.lit(model.version)), path)


def stored_vectors(spark: SparkSession, path: str, model, first_day: str | None = None, last_day: str | None = None) -> DataFrame:
    """Stored chunks of a model version, of a range of days; other folders are not read."""
    stored = open_chunks(spark, path, VECTOR_SCHEMA).where(F.col("model") == model.version)
    if first_day is not None:
        stored = stored.where(F.col("publish_at") >= F.lit(first_day).cast("date"))
    if last_day is not None:
        stored = stored.where(F.col("publish_at") <= F.lit(last_day).cast("date"))
    return stored


def retrieve(
    queries: DataFrame, path: str, model, k: int = 15, first_day: str | None = None, last_day: str | None = None
) -> DataFrame:
    """``query_id, rank, distance, chunk_id, publish_at, content`` for texts (query_id, content), nearest first.

    The join reads ids and vectors of the days asked for; texts are joined to what it found.
    """
    stored = stored_vectors(queries.sparkSession, path, model, first_day, last_day)
    found = nearest(embed(queries, model), stored.withColumnRenamed("chunk_id", "vec_id"), k)
    texts = stored.select(F.col("chunk_id"), "publish_at", "content")
    return found.join(texts, found["vec_id"] == texts["chunk_id"]).select("query_id", "rank", "distance", "chunk_id", "publish_at", "content")
