"""Registered queries of the training-data operators, over whole tables with their production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from bourseflow.llm import alignment, bpe, byte_bpe, convtrie, decontaminate, html, jaccard, licenses, secrets, substrings, toxicity, vptree, warc


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.report(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.report(table(spark, folder, "documents"))


def op3_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.report(table(spark, folder, "documents"))


def op4_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.report(table(spark, folder, "documents"))


def op5_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.report(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html.report(table(spark, folder, "pages"))


def op7_vantage_trees(spark: SparkSession, folder: str) -> DataFrame:
    return vptree.report(table(spark, folder, "embeddings"))


def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.report(table(spark, folder, "pages"))


def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op10_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.report(table(spark, folder, "documents"))


def op11_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.report(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN)


def op12_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    return convtrie.report(table(spark, folder, "conversations"))


def op13_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return byte_bpe.report(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


LLM_QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_substring_dedup,
        op3_jaccard_join,
        op4_license_scan,
        op5_bpe,
        op6_html_text,
        op7_vantage_trees,
        op8_warc,
        op9_decontamination,
        op10_secret_scan,
        op11_alignment,
        op12_conversation_trie,
        op13_byte_bpe,
    )
}

#: Where SQL can give the same rows on whole tables.
LLM_ORACLES = {"op8_warc": warc.REPORT_SQL}
