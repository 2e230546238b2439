"""Prompt building from news, prices, retrieved rules and company rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bourseflow.functions.numbers import short_percent, ten_thousands
from bourseflow.functions.text import fill_template

# The sentence form of a company rule and the size limits.
COMPANY_RULE = "如果新聞中有關於 {company} {rule}的消息，則隔日股價可能{direction}。"
MAX_PROMPT_CHARS = 7500
RULES_PER_PROMPT = 15

# Templates are settings; these defaults hold every place a caller may fill.
QUERY_TEMPLATE = "News about {company}; how may it move the share price of the next day?\n\n{context}\n"
SENTIMENT_TEMPLATE = (
    "Judge all news about {company} together. First line: a number from 0 (negative) to 1 (positive). "
    "Second line: the reason in one sentence.\n"
    "Rules of experience:\n{rules}\n{company_rules}\n\nNews:\n{context}\n"
)
PERCENT_TEMPLATE = (
    "Give one number: the move of {company} on the next trading day in percent, from -10.0 to 10.0.\n"
    "Rules of experience:\n{rules_text}\n{company_rules_text}\n"
    "Change: {change_percent}%\nVolume change: {volume_change}\nForeign net: {foreign_change}\n"
    "Mean move: {avg_change}%\n\nNews about {company}:\n{context}\n"
)


def company_rule_texts(spark: SparkSession, rules: dict[str, dict[str, list[str]]]) -> DataFrame:
    """``company, company_rules``: the positive sentences, then the negative ones, as lines.

    The rule file is a small setting (a few phrases per listed company).
    """
    rows = []
    for company, by_sign in rules.items():
        lines = []
        for sign, direction in (("positive", "上漲"), ("negative", "下跌")):
            for rule in by_sign[sign]:
                lines.append(COMPANY_RULE.format(company=company, rule=rule, direction=direction))
        rows.append((company, "\n".join(lines)))
    return spark.createDataFrame(rows, "company string, company_rules string")


def with_company_rules(digest: DataFrame, rule_texts: DataFrame) -> DataFrame:
    """Add the company's rules; a company without an entry is an error, not a gap."""
    joined = digest.join(F.broadcast(rule_texts), F.col("stock_name") == F.col("company"), "left").drop("company")
    missing = F.concat(F.lit("no rules for company "), F.col("stock_name"))
    return joined.withColumn(
        "company_rules", F.when(F.col("company_rules").isNull(), F.raise_error(missing)).otherwise(F.col("company_rules"))
    )


def query_text(template: str = QUERY_TEMPLATE) -> Column:
    return fill_template(template, company=F.col("stock_name"), context=F.col("context"))


def percent_prompt(template: str = PERCENT_TEMPLATE) -> Column:
    return fill_template(
        template,
        company=F.col("stock_name"),
        context=F.col("context"),
        change_percent=short_percent(F.col("pct_change")),
        volume_change=ten_thousands(F.col("volume_change")),
        foreign_change=ten_thousands(F.col("foreign")),
        avg_change=F.col("avg_change"),
        rules_text=F.col("rules_text"),
        company_rules_text=F.col("company_rules"),
    )


def sentiment_prompt(template: str = SENTIMENT_TEMPLATE) -> Column:
    return fill_template(
        template,
        company=F.col("stock_name"),
        context=F.col("context"),
        rules=F.col("rules_text"),
        company_rules=F.col("company_rules"),
    )


def with_prompt(df: DataFrame, prompt: Column, limit: int = MAX_PROMPT_CHARS) -> DataFrame:
    """Add ``prompt`` cut at the limit (the news stand last) and whether it was cut.

    The limit is that of the model input; the texts themselves stay whole.
    """
    whole = df.withColumn("_whole", prompt)
    return whole.select(
        *[c for c in df.columns],
        F.substring("_whole", 1, limit).alias("prompt"),
        (F.char_length("_whole") > limit).alias("was_truncated"),
    )
