"""Clean a corpus for training: five stages, each on what the one before has kept.

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is written
as Parquet and read again as the next stage's documents. All but the last keep
the columns of ``documents``.

Defined cases: a null text is an empty one; texts without words are never toxic,
near copies or contaminated, so they stay, and get no ids of tokens; of repeated
rows (equal texts, whatever their ids) one stays; different texts under one id
are different documents; rows without an id are kept like others and come back
without one; further columns pass through all stages but the last, which returns
``doc_id, lang, source, n_tokens, ids``; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bourseflow.llm import bpe, decontaminate, jaccard, secrets, toxicity
from bourseflow.session import cut_lineage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.7 or more go. The model is learned from the labelled rows of the raw table."""
    raw = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return toxicity.remove_toxic(docs, toxicity.learn(raw, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at 0.8 on shingles of five words, the one with the smallest id stays."""
    return jaccard.keep_first(docs, n=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which at least a twentieth lies in benchmark windows of 13 words go."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in it are replaced."""
    return secrets.redact(docs, secrets.learn(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text: ``doc_id, lang, source, n_tokens, ids``."""
    path = public_tokenizers.path("word_bpe_49k.json")
    found = bpe.with_ids(docs.select("doc_id", "lang", "source", "text"), path)
    return found.select("doc_id", "lang", "source", F.size("_ids").cast("bigint").alias("n_tokens"), F.col("_ids").alias("ids"))


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("bpe", encode),
]

#: The stages cannot be written in SQL; tests compare them with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is stored in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
