"""Batch scoring of prompts with a pluggable client, reply parsing and status."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as FutureTimeout

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from bourseflow.functions.text import parse_number_reply, parse_two_line_reply

Client = Callable[[str], str]

OK, TIMED_OUT, REJECTED = "OK", "TLE", "REJ"  # fixed values: status texts


class KeywordClient:
    """Offline default: counts positive and negative words in the prompt.

    The answer is ``(p - n) / (p + n)`` scaled to ``span``, with one digit, so
    equal prompts always get equal answers.
    """

    def __init__(self, positive: list[str], negative: list[str], span: float = 10.0, neutral: float = 0.0):
        self.positive, self.negative = positive, negative
        self.span, self.neutral = span, neutral

    def __call__(self, prompt: str) -> str:
        up = sum(prompt.count(w) for w in self.positive)
        down = sum(prompt.count(w) for w in self.negative)
        balance = (up - down) / (up + down) if up + down else 0.0
        return f"{self.neutral + self.span * balance:.1f}"


def ask(df: DataFrame, client: Client, timeout: float = 15.0, parallel: int = 8) -> DataFrame:
    """Add ``reply`` and ``timed_out`` by calling the client for each prompt.

    The only stage outside the JVM: rows stream through in Arrow batches, with
    ``parallel`` calls in flight per task. A late answer is dropped.
    """
    schema = StructType([*df.schema.fields, StructField("reply", StringType()), StructField("timed_out", BooleanType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pool = ThreadPoolExecutor(parallel)
        try:
            for batch in batches:
                texts, late = [], []
                prompts = batch["prompt"].tolist()
                # a window of `parallel` calls, so no prompt waits in a queue while its time runs
                for start in range(0, len(prompts), parallel):
                    calls = [pool.submit(client, p) for p in prompts[start : start + parallel]]
                    deadline = time.monotonic() + timeout
                    stuck = False
                    for call in calls:
                        try:
                            texts.append(call.result(timeout=max(0.0, deadline - time.monotonic())))
                            late.append(False)
                        except (TimeoutError, FutureTimeout):
                            texts.append(None)
                            late.append(True)
                            stuck = True
                    if stuck:
                        pool.shutdown(wait=False, cancel_futures=True)
                        pool = ThreadPoolExecutor(parallel)
                yield batch.assign(reply=texts, timed_out=late)
        finally:
            pool.shutdown(wait=False, cancel_futures=True)

    return df.mapInPandas(run, schema)


def _status(score):
    return F.when(F.col("timed_out"), TIMED_OUT).when(score.isNull(), REJECTED).otherwise(OK)


def percent_scores(asked: DataFrame) -> DataFrame:
    """Number-only replies: every prompt gives a row, failures with a null factor and a status."""
    score = parse_number_reply(F.col("reply"))
    return asked.withColumn("factor", F.when(~F.col("timed_out"), score)).withColumn(
        "explanation", _status(F.col("factor"))
    )


def sentiment_scores(asked: DataFrame) -> DataFrame:
    """Two-line replies: number and explanation; failed prompts give no row."""
    score, explanation = parse_two_line_reply(F.col("reply"))
    parsed = asked.withColumns({"factor": score, "explanation": explanation})
    return parsed.where(~F.col("timed_out") & F.col("factor").isNotNull())


def keep_first(factors: DataFrame, order: str = "updated_time", date: str = "ds") -> DataFrame:
    """The first row per symbol and date, in the order the rows were written.

    A grouped minimum instead of a window: partial minima leave one row per key
    and task for the shuffle, however often a day was scored again. All columns
    come from one row: at equal ``order`` the smallest of the other columns decides.
    """
    rest = [c for c in factors.columns if c not in ("symbol", date)]
    rest = [c for c in rest if c != order]
    first = F.min(F.struct(order, *rest)).alias("_first")
    found = factors.groupBy("symbol", date).agg(first)
    return found.select("symbol", date, *[F.col("_first")[c].alias(c) for c in (*rest, order)])
