"""From news and prices to scored days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bourseflow.functions.vectors import embed, embedding_model
from bourseflow.operators import prompts
from bourseflow.operators.nearest import nearest
from bourseflow.operators.news import daily_digest, match_companies
from bourseflow.operators.prices import in_range, with_day_moves
from bourseflow.operators.scoring import Client, ask, percent_scores, sentiment_scores
from bourseflow.plans.indexing import retrieve
from bourseflow.session import cut_lineage
from bourseflow.sources.files import company_table


def digests(news: DataFrame, companies: Sequence[dict], max_news: int = 5) -> DataFrame:
    """Company-days with matching news; other days give no row."""
    return daily_digest(match_companies(news, companies), max_news)


def not_yet(days: DataFrame, done: DataFrame | None) -> DataFrame:
    """Leave out company-days that are scored already (symbol, news_date): the client is the costly part."""
    return days if done is None else days.join(done, ["symbol", "news_date"], "left_anti")


def with_prices(digest: DataFrame, daily: DataFrame, start: str, end: str) -> DataFrame:
    """Add the day's moves: trading days in the range only."""
    moves = with_day_moves(in_range(daily, start, end)).select(
        "symbol", F.col("ds").alias("news_date"), "pct_change", "volume_change", "foreign"
    )
    return digest.join(moves, ["symbol", "news_date"])


def with_retrieved_rules(
    digest: DataFrame, rules: DataFrame, k: int = prompts.RULES_PER_PROMPT, dimensions: int = 256, model=None
) -> DataFrame:
    """Add the k rules nearest to the day's news, as lines in order of distance.

    ``digest`` is used twice, so it is written once; it holds at most a few
    articles per company and day. Without a ``model`` one is fitted on the rules.
    Filter ``rules`` by their day for a metadata filter.
    """
    digest = cut_lineage(digest)
    # a rule listed twice takes one place and is joined once
    rules = rules.groupBy("uuid").agg(F.min("content").alias("content"))
    model = embedding_model(rules, dimensions) if model is None else model
    day_key = F.concat_ws("|", "symbol", F.col("news_date").cast("string"))
    queries = embed(digest.select(day_key.alias("query_id"), prompts.query_text().alias("content")), model)
    store = embed(rules.select(F.col("uuid").alias("vec_id"), "content"), model)
    found = nearest(queries, store, k).join(rules.select(F.col("uuid").alias("vec_id"), "content"), "vec_id")
    return _with_lines(digest, day_key, found)


def _with_lines(digest: DataFrame, day_key: Column, found: DataFrame) -> DataFrame:
    lines = F.array_sort(F.collect_list(F.struct("rank", "content")))  # at most k rows
    texts = found.groupBy("query_id").agg(
        F.array_join(F.transform(lines, lambda r: r["content"]), "\n").alias("rules_text"),
        F.count(F.lit(1)).cast("int").alias("rule_count"),
    )
    return (
        digest.withColumn("query_id", day_key)
        .join(texts, "query_id", "left")
        .na.fill({"rules_text": "", "rule_count": 0})
        .drop("query_id")
    )


def with_indexed_rules(
    digest: DataFrame, path: str, model, k: int = prompts.RULES_PER_PROMPT, first_day: str | None = None, last_day: str | None = None
) -> DataFrame:
    """The same from a stored index of rules (``plans.indexing.index_documents``): only the news of the days are embedded."""
    digest = cut_lineage(digest)
    day_key = F.concat_ws("|", "symbol", F.col("news_date").cast("string"))
    queries = digest.select(day_key.alias("query_id"), prompts.query_text().alias("content"))
    found = retrieve(queries, path, model, k, first_day, last_day)
    return _with_lines(digest, day_key, found)


def without_rules(digest: DataFrame) -> DataFrame:
    """The variant that retrieves nothing."""
    return digest.withColumns({"rules_text": F.lit(""), "rule_count": F.lit(0)})


def with_prompts(
    digest: DataFrame, companies: Sequence[dict], company_rules: dict, prompt: Column, limit: int
) -> DataFrame:
    """Add company data and the prompt. The company list is a setting of fixed size."""
    spark = digest.sparkSession
    dimension = company_table(spark, companies).select("symbol", "avg_change")
    joined = digest.join(F.broadcast(dimension), "symbol")
    ruled = prompts.with_company_rules(joined, prompts.company_rule_texts(spark, company_rules))
    return prompts.with_prompt(ruled, prompt, limit)


def percent_days(
    news: DataFrame,
    daily: DataFrame,
    companies: Sequence[dict],
    company_rules: dict,
    rules: DataFrame | None,
    client: Client,
    start: str,
    end: str,
    timeout: float = 15.0,
    max_news: int = 5,
    limit: int = prompts.MAX_PROMPT_CHARS,
    done: DataFrame | None = None,
) -> DataFrame:
    """Percent variant: factor or null, with status OK, TLE or REJ, per company and trading day."""
    days = not_yet(with_prices(digests(news, companies, max_news), daily, start, end), done)
    days = without_rules(days) if rules is None else with_retrieved_rules(days, rules)
    asked = ask(with_prompts(days, companies, company_rules, prompts.percent_prompt(), limit), client, timeout)
    return percent_scores(asked)


def sentiment_of(
    days: DataFrame,
    companies: Sequence[dict],
    company_rules: dict,
    rules: DataFrame | None,
    client: Client,
    timeout: float = 15.0,
    limit: int = prompts.MAX_PROMPT_CHARS,
) -> DataFrame:
    """0-1 variant of digests; failed days give no row."""
    days = without_rules(days) if rules is None else with_retrieved_rules(days, rules)
    asked = ask(with_prompts(days, companies, company_rules, prompts.sentiment_prompt(), limit), client, timeout)
    return sentiment_scores(asked)


def sentiment_days(
    news: DataFrame,
    companies: Sequence[dict],
    company_rules: dict,
    rules: DataFrame | None,
    client: Client,
    start: str,
    end: str,
    timeout: float = 15.0,
    max_news: int = 5,
    limit: int = prompts.MAX_PROMPT_CHARS,
    done: DataFrame | None = None,
) -> DataFrame:
    """0-1 variant over all calendar days of the range; failed days give no row."""
    wanted = news.where(F.col("news_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    days = not_yet(digests(wanted, companies, max_news), done)
    return sentiment_of(days, companies, company_rules, rules, client, timeout, limit)
