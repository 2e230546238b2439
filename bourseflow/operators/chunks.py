"""Cutting documents into overlapping chunks and loading only unseen ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bourseflow.functions.dates import strict_date
from bourseflow.operators.ordering import with_position
from bourseflow.session import cut_lineage

CHUNK_TOKENS = 8192  # fixed values
OVERLAP_TOKENS = 80

# A token is one Chinese character or one run of other characters, with the
# white space before it, so that the tokens of a text add up to the text.
TOKEN_PATTERN = r"\s*[\x{4e00}-\x{9fff}]|\s*[^\s\x{4e00}-\x{9fff}]+|\s+$"


def text_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))


def split_documents(
    documents: DataFrame, size: int = CHUNK_TOKENS, overlap: int = OVERLAP_TOKENS
) -> DataFrame:
    """One row per chunk, with id ``uuid:i`` (i counts inside the document).

    Texts without any token give no chunk. A chunk count per document keeps ids
    stable when other documents are loaded before or after it.
    """
    counted = documents.withColumn("_tokens", text_tokens(F.col("content"))).withColumn("_n", F.size("_tokens"))
    # No starts for an empty text; a filter would be pushed down and split the text again.
    starts = F.when(
        F.col("_n") > 0, F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("_n") - overlap), F.lit(size - overlap))
    )
    rest = [c for c in documents.columns if c not in ("content", "uuid")]
    # The tokens of a text add up to it: a text of one chunk is its chunk, and its
    # tokens are not carried on.
    fits = F.col("_n") <= size
    cut = counted.select(
        "uuid",
        *rest,
        F.when(fits, F.col("content")).alias("_whole"),
        F.when(~fits, F.col("_tokens")).alias("_tokens"),
        F.posexplode(starts).alias("chunk_no", "_start"),
    )
    part = F.array_join(F.slice("_tokens", F.col("_start"), F.lit(size)), "")
    return cut.select(
        F.concat("uuid", F.lit(":"), F.col("chunk_no").cast("string")).alias("chunk_id"),
        "uuid",
        "chunk_no",
        *rest,
        F.coalesce("_whole", part).alias("content"),
    )


def batch_chunk_ids(chunks: DataFrame, order: list) -> DataFrame:
    """Ids ``uuid:i`` with i running over the whole batch in the given order.

    Leave the texts out of ``chunks`` and join them by ``uuid, chunk_no`` if needed.
    """
    numbered = with_position(cut_lineage(chunks), [*order, "chunk_no"], "batch_no")
    return numbered.withColumn("chunk_id", F.concat("uuid", F.lit(":"), F.col("batch_no").cast("string")))


def index_rows(chunks: DataFrame) -> DataFrame:
    """Stored form: id, text, and the publishing day as the only metadata."""
    return chunks.select("chunk_id", strict_date(F.col("publish_at")).alias("publish_at"), "content")


def only_new(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """Chunks whose id is not stored yet, each id once (the smallest row of equal ids).

    The stored side is read for its id column only.
    """
    rest = [c for c in chunks.columns if c != "chunk_id"]
    fresh = chunks.join(stored.select("chunk_id"), "chunk_id", "left_anti")
    once = fresh.groupBy("chunk_id").agg(F.min(F.struct(*rest)).alias("_row"))
    return once.select("chunk_id", "_row.*").select(*chunks.columns)
