"""Incremental index load and incremental scoring of arriving files."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bourseflow.operators.news import daily_digest, last_articles, match_companies
from bourseflow.plans.indexing import load_documents
from bourseflow.session import cut_lineage
from bourseflow.sources.sinks import replace_factors
from bourseflow.sources.versions import read_version, replace_rows


def run_batches(source: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process everything that has arrived, then stop; progress is kept in ``checkpoint``."""
    query = (
        source.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def index_stream(documents: DataFrame, path: str, checkpoint: str) -> None:
    """Stream of documents (uuid, publish_at, content) into the chunk table.

    A batch that runs twice after a failure adds nothing, because ids are keys.
    """
    run_batches(documents, lambda batch, _: load_documents(batch, path), checkpoint)


#: Articles kept per company and day.
LATEST = "symbol string, stock_name string, news_date date, publish_at timestamp_ntz, id bigint, content string"


def scoring_stream(
    news: DataFrame,
    companies: Sequence[dict],
    score: Callable[[DataFrame], DataFrame],
    path: str,
    state_path: str,
    checkpoint: str,
    max_news: int = 5,
    open_days: int | None = None,
) -> None:
    """Stream of articles into the factor table, one row per company and day.

    The last ``max_news`` articles of every company-day are kept in a table of
    their own. A batch merges its articles into the company-days it names; those
    whose last articles change are scored again with ``score`` (digests to scored
    days), and their rows are replaced. So articles that arrive late, in another
    file or batch, count as if they had come with the others. An article is known
    by its id: one that comes again changes nothing and asks the client nothing.
    The articles are stored after the scores, so a batch that failed in between
    scores its days again and replaces them by the same rows.

    ``open_days`` is the watermark: days more than that many days before the latest
    one seen are closed; their articles are not taken any more and their state is
    let go. Without it every day stays open.
    """
    keys = ["symbol", "news_date"]
    names = [c.split(" ")[0] for c in LATEST.split(", ")]

    def handle(batch: DataFrame, _: int) -> None:
        arrived = match_companies(batch, companies).select(*names)
        latest = cut_lineage(last_articles(arrived, max_news).drop("pos"))
        stored = read_version(batch.sparkSession, state_path, LATEST, "news_date")
        keep = None
        if open_days is not None:
            seen = latest.select("news_date").union(stored.select("news_date")).agg(F.max("news_date")).first()[0]
            first_open = F.date_sub(F.lit(seen), open_days)
            latest, keep = latest.where(F.col("news_date") >= first_open), F.col("part") >= first_open
        before = stored.join(latest.select(*keys).distinct(), keys, "left_semi")
        merged = last_articles(before.unionByName(latest).dropDuplicates([*keys, "id"]), max_news).drop("pos")
        merged = cut_lineage(merged)
        changed = cut_lineage(merged.join(before, [*keys, "id"], "left_anti").select(*keys).distinct())
        if changed.isEmpty():
            return
        merged = merged.join(changed, keys, "left_semi")
        replace_factors(score(daily_digest(merged, max_news)), path, touched=changed)
        replace_rows(merged.select(*names), state_path, keys, "news_date", keep=keep)

    run_batches(news, handle, checkpoint)
