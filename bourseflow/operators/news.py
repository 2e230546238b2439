"""News per company and day: keyword match and the latest articles."""

from __future__ import annotations

from array import array
from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bourseflow.functions.text import clean_text
from bourseflow.session import cut_lineage

ARTICLE_SEPARATOR = "\n\n---\n\n"  # fixed value


def match_keywords(company: dict) -> list[str]:
    """Articles are matched by the code and the name; the topic words are not used."""
    return [company["symbol"], company["stock_name"]]


def _hit(content: Column, keywords: Sequence[str]) -> Column:
    found = F.lit(False)
    for keyword in keywords:
        found = found | F.contains(content, F.lit(keyword.lower()))
    return found


def match_companies(news: DataFrame, companies: Sequence[dict], fold_content: bool = False) -> DataFrame:
    """One row per article and company named in it.

    The keyword is lower-cased, the article is not (unless ``fold_content``), so
    a Latin name is found only where it is written in lower case. The company
    list is a setting, so the match is an expression on each article: no join,
    no shuffle, and each article is read once for all companies.
    """
    content = F.lower("content") if fold_content else F.col("content")
    named = [
        F.when(
            _hit(content, match_keywords(c)),
            F.struct(F.lit(c["symbol"]).alias("symbol"), F.lit(c["stock_name"]).alias("stock_name")),
        )
        for c in companies
    ]
    # The outer form keeps the optimizer from testing the array's size in a filter
    # of its own, which would search each article twice.
    pairs = news.select("*", F.inline_outer(F.array_compact(F.array(*named))))
    return pairs.where(F.col("symbol").isNotNull())


def match_many(news: DataFrame, companies: Sequence[dict], fold_content: bool = False) -> DataFrame:
    """The rows of ``match_companies`` for a list of thousands.

    All keywords are one automaton, which reads an article once, whatever their
    number. The list is a setting and goes to every task. A task gives the places
    in the list that an article names; rows are made of them by Spark, so an article
    is not copied for every company it names unless its text is asked for. An empty
    keyword is in every article, and in none that is null.
    """
    spark = news.sparkSession
    listed = [(number, c["symbol"], c["stock_name"]) for number, c in enumerate(companies)]
    of: dict[str, list[int]] = {}
    for number, company in enumerate(companies):
        for keyword in match_keywords(company):
            of.setdefault(keyword.lower(), []).append(number)
    everywhere = of.pop("", [])
    shared = spark.sparkContext.broadcast((of, everywhere))

    def places(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of, everywhere = shared.value
        automaton = ahocorasick.Automaton()
        for keyword, numbers in of.items():
            automaton.add_word(keyword, numbers)
        if of:
            automaton.make_automaton()
        for batch in batches:
            ends, found = [0], array("i")
            for content in batch:
                text = content.as_py()
                if text is not None:
                    named = set(everywhere)
                    if of:
                        for _, numbers in automaton.iter(text.lower() if fold_content else text):
                            named.update(numbers)
                    found.extend(sorted(named))
                ends.append(len(found))
            numbers = pa.Array.from_buffers(pa.int32(), len(found), [None, pa.py_buffer(found)])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), numbers)

    found = F.arrow_udf(places, T.ArrayType(T.IntegerType()))(F.col("content"))
    numbered = news.select("*", found.alias("_places")).select(*news.columns, F.explode_outer("_places").alias("_place"))
    table = spark.createDataFrame(listed, "_place int, symbol string, stock_name string")
    return numbered.join(F.broadcast(table), "_place").drop("_place")


def _latest_first() -> WindowSpec:
    """A company's day; the files list it by ascending time and descending id."""
    return Window.partitionBy("symbol", "news_date").orderBy(F.desc("publish_at"), F.asc("id"))


def _last(matched: DataFrame, n: int) -> DataFrame:
    """The last n articles per company and day.

    Spark cuts each group to n rows before the shuffle, so a hot company or day stays small.
    """
    return matched.withColumn("_rank", F.row_number().over(_latest_first())).where(F.col("_rank") <= n)


def last_articles(matched: DataFrame, n: int = 5) -> DataFrame:
    """The last n articles per company and day, numbered from the earliest."""
    group = Window.partitionBy("symbol", "news_date")
    return _last(matched, n).withColumn("pos", F.max("_rank").over(group) - F.col("_rank")).drop("_rank")


def _not_before_the_last(matched: DataFrame, n: int) -> DataFrame:
    """Rows that can be among the last n of their company and day.

    The n-th last row of each is found without the texts and stored, one row per
    company and day; what comes before it goes, so texts that are not kept are not sorted.
    """
    keys = ["symbol", "news_date"]
    narrow = _last(matched.select(*keys, "publish_at", "id"), n).where(F.col("_rank") == n)
    nth = cut_lineage(narrow.select(*[F.col(c).alias(f"_{c}") for c in (*keys, "publish_at", "id")], F.lit(True).alias("_full")))
    earlier = F.col("publish_at").isNull() & F.col("_publish_at").isNotNull() | (F.col("publish_at") < F.col("_publish_at"))
    behind = F.col("_id").isNull() & F.col("id").isNotNull() | (F.col("id") > F.col("_id"))
    before = F.when(F.col("publish_at").eqNullSafe(F.col("_publish_at")), behind).otherwise(earlier)
    same = F.col("symbol").eqNullSafe(F.col("_symbol")) & F.col("news_date").eqNullSafe(F.col("_news_date"))
    met = matched.join(nth, same, "left")
    return met.where(F.col("_full").isNull() | ~F.coalesce(before, F.lit(False))).select(*matched.columns)


def daily_digest(matched: DataFrame, n: int = 5) -> DataFrame:
    """Per company and day: the last n articles, cleaned, in ascending order, and joined.

    The latest article looks at the ones before it inside the window that chose
    them, so only texts that are kept are sorted and shuffled, and once.
    """
    kept = _last(_not_before_the_last(matched, n), n).withColumn("content", clean_text(F.col("content")))
    earlier = [F.lead("content", k).over(_latest_first()) for k in range(n - 1, 0, -1)]
    articles = F.array_compact(F.array(*earlier, F.col("content")))
    latest = kept.withColumn("articles", articles).where(F.col("_rank") == 1)
    return latest.select(
        "symbol",
        "stock_name",
        "news_date",
        "articles",
        F.array_join("articles", ARTICLE_SEPARATOR).alias("context"),
        F.size("articles").alias("news_count"),
    )


def days_without_news(daily: DataFrame, news: DataFrame) -> DataFrame:
    """Trading days for which no news arrived at all.

    Both sides are reduced to distinct days first.
    """
    days = daily.select("ds").distinct()
    covered = news.select(F.col("news_date").alias("ds")).distinct()
    return days.join(covered, "ds", "left_anti")
