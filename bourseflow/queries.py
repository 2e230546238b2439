"""Registered queries: each operator bound to the given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bourseflow.functions import text
from bourseflow.functions.dates import date_array, month_label
from bourseflow.functions.vectors import embed, embedding_model
from bourseflow.operators import chunks, grid, linear, news, prices, prompts, scoring, stats, words
from bourseflow.operators.compress import reconstruct
from bourseflow.operators.nearest import nearest, nearest_few
from bourseflow.plans import evaluation, indexing, tuning
from bourseflow.plans import scoring as score_plans
from bourseflow.session import cut_lineage, new_table_path
from bourseflow.sources import bindings as b
from bourseflow.sources.files import read_reports
from bourseflow.sources.sinks import append_factors, read_factor_table
from bourseflow.sources.versions import read_version, replace_rows
from bourseflow.streaming import loads

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

RANGE = ("1995-01-01", "1996-12-31")
EVALUATED_FROM = "1995-06-01"
HOLIDAYS = ["01-01", "02-28", "04-04", "05-01", "10-10"]
RULE_DAY = "1996-06-01"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _plain(df: DataFrame, digits: int = 4) -> DataFrame:
    """Dates and times as text, doubles rounded: a form every engine writes alike."""
    columns = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("date", "timestamp", "timestamp_ntz"):
            c = c.cast("string")
        elif kind in ("double", "float"):
            c = F.round(c, digits)
        columns.append(c.alias(name))
    return df.select(*columns)


# prices and statistics


@query
def avg_abs_change(spark, sf):
    return _plain(stats.average_daily_move(b.stock_daily(spark, sf)), 8)


@query
def price_features(spark, sf):
    out = prices.with_price_features(b.stock_daily(spark, sf))
    return _plain(out.select("symbol", "ds", "high_low_diff", F.col("MA").alias("ma")))


@query
def pct_volume_change(spark, sf):
    out = prices.with_day_moves(prices.in_range(b.stock_daily(spark, sf), *RANGE))
    return _plain(out.select("symbol", "ds", "pct_change", "volume_change", "foreign"))


LAGGED = ["volume", "MA", "high_low_diff"]


@query
def lag_features(spark, sf):
    featured = prices.with_price_features(b.stock_daily(spark, sf))
    out = prices.with_lags(featured, LAGGED).na.drop("any")
    names = {f"{v}_lag_{k}": f"{v.lower()}_lag_{k}" for v in LAGGED for k in (1, 2, 3)}
    return _plain(out.select("symbol", "ds", *[F.col(k).alias(v) for k, v in names.items()]))


@query
def corr_matrix(spark, sf):
    featured = prices.with_price_features(b.stock_daily(spark, sf))
    lagged = prices.with_lags(featured, tuning.SHARE)
    columns = [f"{v}_lag_{k}" for v in tuning.SHARE for k in (1, 2, 3)] + ["y"]
    cells = stats.correlation_matrix(lagged, columns, ["symbol"])
    return _plain(cells.select("symbol", F.col("left").alias("var_a"), F.col("right").alias("var_b"), "corr"))


@query
def month_end_last(spark, sf):
    monthly = prices.without_last_day(stats.month_end_close(b.stock_daily(spark, sf)), order="month_end")
    return _plain(monthly.withColumn("month", month_label(F.col("month_end"))))


@query
def price_pivot(spark, sf):
    return _plain(stats.price_panel(stats.month_end_close(b.stock_daily(spark, sf)), b.SYMBOLS))


@query
def standardize(spark, sf):
    return _plain(stats.standardize(b.stock_daily(spark, sf)).select("symbol", "ds", "z"))


@query
def boxplot_stats(spark, sf):
    return _plain(stats.monthly_boxplot(b.stock_daily(spark, sf), len(b.SYMBOLS)))


def _daily_quartiles(spark, sf):
    return stats.five_numbers(stats.standardize(b.stock_daily(spark, sf)), "ds", "z")


@query
def daily_quartiles(spark, sf):
    return _plain(_daily_quartiles(spark, sf))


@query
def acf(spark, sf):
    series = _daily_quartiles(spark, sf).select(F.lit("median").alias("series"), "ds", "median")
    return _plain(stats.autocorrelation(series, "median", "ds", ["series"]))


@query
def row_mean(spark, sf):
    return _plain(stats.row_mean(stats.standardize(b.stock_daily(spark, sf)), "ds", "z"))


@query
def next_day_label(spark, sf):
    return _plain(prices.next_day_label(b.stock_daily(spark, sf)))


@query
def densify_ffill(spark, sf):
    daily = cut_lineage(b.stock_daily(spark, sf).select("symbol", "ds", "y"))  # used twice; one row per day
    return _plain(prices.on_calendar(daily, ["y"]))


@query
def date_range(spark, sf):
    """Every day between the first and the last news of a source; a reversed span gives none."""
    spans = b.news(spark, sf).groupBy("source").agg(F.min("news_date").alias("lo"), F.max("news_date").alias("hi"))
    forward = spans.select("source", F.lit("forward").alias("kind"), F.explode(date_array(F.col("lo"), F.col("hi"))).alias("day"))
    reverse = spans.select("source", F.lit("reverse").alias("kind"), F.explode(date_array(F.col("hi"), F.col("lo"))).alias("day"))
    return _plain(forward.unionByName(reverse))


@query
def days_without_news(spark, sf):
    return _plain(news.days_without_news(b.stock_daily(spark, sf), b.news(spark, sf)))


# factors and evaluation


@query
def factor_dedup(spark, sf):
    return _plain(scoring.keep_first(b.factors(spark, sf), "seq").select("symbol", "ds", "factor", "seq"))


@query
def factor_left_join(spark, sf):
    joined = evaluation.with_factor(b.stock_daily(spark, sf), b.factors(spark, sf))
    return _plain(
        joined.select(
            "symbol",
            "ds",
            "y",
            F.col("factor").isNull().cast("int").alias("is_missing"),
            F.coalesce("factor", F.lit(0.0)).alias("factor"),
        )
    )


@query
def missing_factors(spark, sf):
    joined = evaluation.with_factor(b.stock_daily(spark, sf), b.factors(spark, sf))
    return stats.null_rows(joined, "factor").groupBy("symbol").agg(F.count(F.lit(1)).alias("n_missing"))


@query
def factor_clip(spark, sf):
    rows = evaluation.sentiment_training_rows(b.stock_daily(spark, sf), b.factors(spark, sf))
    return _plain(rows.select("symbol", "ds", "y", "factor"))


@query
def factor_describe(spark, sf):
    joined = evaluation.with_factor(b.stock_daily(spark, sf), b.factors(spark, sf))
    filled = joined.na.fill({"factor": evaluation.NEUTRAL_FACTOR})
    return _plain(stats.describe(filled, "factor", ["symbol"]))


@query
def percent_score_mape(spark, sf):
    return evaluation.percent_forecast_error(b.stock_daily(spark, sf), b.factors(spark, sf), EVALUATED_FROM)


def _directions(spark, sf):
    joined = evaluation.with_factor(prices.with_price_features(b.stock_daily(spark, sf)), b.factors(spark, sf))
    rows = joined.na.fill({"factor": 0.0})
    judged = evaluation.directions(rows).where(F.col("ds") >= F.lit(EVALUATED_FROM).cast("date"))
    return evaluation.confusion(judged)


@query
def direction_confusion(spark, sf):
    return _directions(spark, sf)


@query
def direction_metrics(spark, sf):
    return _plain(evaluation.direction_metrics(_directions(spark, sf)))


@query
def value_counts(spark, sf):
    return _plain(stats.value_counts(b.factors(spark, sf), "factor"))


# news text and words


@query
def keyword_match(spark, sf):
    matched = news.match_companies(b.news(spark, sf), b.companies())
    return matched.select("id", "symbol", "stock_name")


KEYWORDS = 5_000


@query
def keyword_match_many(spark, sf):
    """Articles and how many of 5,000 keywords they name: the first words of the rules, in alphabetical order, as companies."""
    found = b.rules(spark, sf).select(F.explode(text.article_words(F.col("content"))).alias("word")).where(F.char_length("word") > 3)
    listed = [r["word"] for r in found.distinct().orderBy("word").limit(KEYWORDS).collect()]
    matched = news.match_many(b.news(spark, sf).select("id", "content"), [{"symbol": w, "stock_name": w} for w in listed])
    # the places of the words stand for them: numbers are aggregated by hash, strings by a sort of all pairs
    places = F.broadcast(spark.createDataFrame(list(enumerate(listed)), "place int, symbol string"))
    numbered = matched.join(places, "symbol").groupBy("id")
    counted = numbered.agg(F.count(F.lit(1)).alias("n_named"), F.min("place").alias("_first"), F.max("place").alias("_last"))
    for name in ("first", "last"):
        counted = counted.join(places.select(F.col("place").alias(f"_{name}"), F.col("symbol").alias(f"{name}_named")), f"_{name}")
    return counted.select("id", "n_named", "first_named", "last_named")


@query
def last_n_news(spark, sf):
    matched = news.match_companies(b.news(spark, sf), b.companies())
    return _plain(news.last_articles(matched).select("symbol", "news_date", "pos", "id", "publish_at"))


@query
def daily_digest(spark, sf):
    out = score_plans.digests(b.news(spark, sf), b.companies())
    return _plain(out.select("symbol", "stock_name", "news_date", "news_count", "context"))


@query
def clean_text(spark, sf):
    """Articles and raw pages (which hold URLs), cleaned."""
    articles = b.read_texts(spark, sf, "documents", "doc_id").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    pages = b.read_texts(spark, sf, "pages", "page_id").select(
        F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.concat("url", F.lit("\n"), "html").alias("text")
    )
    return articles.unionByName(pages).select("kind", "id", text.clean_text(F.col("text")).alias("cleaned"))


def _labels(spark, sf):
    """Next-day labels of all symbols."""
    return prices.next_day_label(b.stock_daily(spark, sf).select("symbol", "ds", "y"))


def _news_order():
    return [F.col("publish_at").asc(), F.col("id").desc()]


def _word_counts(spark, sf, paired=False):
    return words.labelled_counts(words.day_words(b.news(spark, sf)), _labels(spark, sf), paired)


def _bigram_counts(spark, sf, **form):
    return words.labelled_counts(words.day_bigrams(b.news(spark, sf), packed=True), _labels(spark, sf), **form)


@query
def word_share(spark, sf):
    return _plain(words.shares(_word_counts(spark, sf)), 8)


@query
def bigram_share(spark, sf):
    """Shares of all pairs, as a profile per symbol and label."""
    return _plain(words.share_profile(words.shares(_bigram_counts(spark, sf, heads=True))), 8)


@query
def bigram_share_flat(spark, sf):
    counts = words.flat_bigrams(b.news(spark, sf), _labels(spark, sf), _news_order(), heads=True)
    return _plain(words.share_profile(words.shares(counts)), 8)


@query
def share_diff_topk(spark, sf):
    """The top 100 pairs of every symbol."""
    return _plain(words.top_words(words.share_difference(_bigram_counts(spark, sf, paired=True)), 100), 8)


@query
def rule_table(spark, sf):
    phrases = b.read_table(spark, sf, "benchmark").select(
        F.regexp_replace("text", r"\s+", " ").alias("phrase"), (F.col("item_id") % 2 == 0).alias("rising")
    )
    return words.rule_table(phrases, words.share_difference(_word_counts(spark, sf, paired=True)), RULE_DAY)


@query
def uuid5(spark, sf):
    return b.read_table(spark, sf, "documents").select("doc_id", text.uuid5(F.col("text")).alias("uuid"))


@query
def token_counts(spark, sf):
    counted = b.news(spark, sf).withColumn("tokens", text.article_words(F.col("content")))
    return counted.select("id", F.size("tokens").alias("n_tokens"), F.char_length("content").alias("n_chars"))


@query
def numbered_news(spark, sf):
    """Latest articles of a company-day as numbered lines."""
    digest = score_plans.digests(b.news(spark, sf), b.companies(), 3)
    return _plain(digest.select("symbol", "news_date", text.numbered_lines(F.col("articles")).alias("lines")))


# chunks and retrieval


def _documents(spark, sf):
    return b.news(spark, sf).select("id", "uuid", F.col("news_date").cast("string").alias("publish_at"), "content")


@query
def chunk_text(spark, sf):
    out = chunks.split_documents(_documents(spark, sf))
    return out.select("id", "chunk_id", "chunk_no", "publish_at", "content")


@query
def chunk_batch_ids(spark, sf):
    cut = chunks.split_documents(_documents(spark, sf)).select("id", "uuid", "chunk_no")
    return chunks.batch_chunk_ids(cut, ["id"]).select("id", "chunk_no", "chunk_id")


@query
def insert_new_only(spark, sf):
    """Stored: chunks of the labelled documents. Offered: all documents, the labelled ones twice."""
    documents = _documents(spark, sf)
    labelled = documents.join(b.read_table(spark, sf, "labels").select(F.col("doc_id").alias("id")), "id", "left_semi")
    stored = chunks.index_rows(chunks.split_documents(labelled))
    offered = chunks.index_rows(chunks.split_documents(documents.unionByName(labelled)))
    return _plain(chunks.only_new(offered, stored))


def _vectors(spark, sf):
    return b.read_table(spark, sf, "embeddings").select("vec_id", "embedding", "label")


def _centroids(spark, sf):
    """Mean vector of each label: the query vectors."""
    long = _vectors(spark, sf).select("label", F.posexplode("embedding").alias("pos", "value"))
    means = long.groupBy("label", "pos").agg(F.avg("value").alias("value"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "value")))  # one entry per dimension
    return means.groupBy("label").agg(F.transform(ordered, lambda e: e["value"]).alias("embedding"))


@query
def knn_topk(spark, sf):
    queries = _centroids(spark, sf).withColumnRenamed("label", "query_id")
    return _plain(nearest_few(queries, _vectors(spark, sf), 15), 6)


@query
def knn_filtered(spark, sf):
    queries = _centroids(spark, sf).withColumnRenamed("label", "query_id")
    return _plain(nearest_few(queries, _vectors(spark, sf).where(F.col("label") == 3), 3), 6)


@query
def knn_join(spark, sf):
    """Stored vectors nearest to each document: the vector of a document is that of its text, hashed to the store's size."""
    model = embedding_model(b.rules(spark, sf), 64)
    queries = embed(b.news(spark, sf).select(F.col("id").alias("query_id"), "content"), model).select("query_id", "embedding")
    return _plain(nearest(queries, _vectors(spark, sf), 5), 6)


@query
def embed_text(spark, sf):
    """Unit vectors of all documents (weights fitted on the rules)."""
    model = embedding_model(b.rules(spark, sf))
    out = embed(b.news(spark, sf).select("id", "content"), model)
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    used = F.size(F.filter("embedding", lambda v: v != 0))
    return _plain(out.select("id", used.alias("n_used"), F.sqrt(norm).alias("norm")))


@query
def rule_retrieval(spark, sf):
    """Rules nearest to the news of each company and day."""
    days = score_plans.with_retrieved_rules(score_plans.digests(b.news(spark, sf), b.companies()), b.rules(spark, sf))
    return _plain(days.select("symbol", "news_date", "rule_count", "rules_text"))


INDEXED_DAYS = ("1995-02-01", "1995-12-31")


@query
def index_then_retrieve(spark, sf):
    """Documents indexed in two loads, the first ones offered again; then the articles of a range of days nearest to each rule."""
    path, model = new_table_path(spark, "vectors"), embedding_model(b.rules(spark, sf))
    documents = _documents(spark, sf).select("uuid", "publish_at", "content", "id")
    indexing.index_documents(documents.where("id % 2 = 0").drop("id"), path, model)
    indexing.index_documents(documents.drop("id"), path, model)
    rules = b.read_table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("content"))
    found = indexing.retrieve(rules, path, model, 5, *INDEXED_DAYS)
    return _plain(found.select("query_id", "rank", "chunk_id", "publish_at", "distance"), 6)


@query
def indexed_rules(spark, sf):
    """As ``rule_retrieval``, from a stored index of the rules."""
    path, rules = new_table_path(spark, "rule-vectors"), b.rules(spark, sf).dropDuplicates(["uuid"])
    model = embedding_model(rules)
    indexing.index_documents(rules, path, model)
    days = score_plans.with_indexed_rules(score_plans.digests(b.news(spark, sf), b.companies()), path, model)
    return _plain(days.select("symbol", "news_date", "rule_count", "rules_text"))


# prompts and scores


def _prompted(spark, sf):
    days = score_plans.with_prices(
        score_plans.digests(b.news(spark, sf), b.companies()), b.stock_daily(spark, sf), *RANGE
    )
    return score_plans.with_prompts(
        score_plans.without_rules(days),
        b.companies(),
        b.company_rules(),
        prompts.percent_prompt(),
        prompts.MAX_PROMPT_CHARS,
    )


@query
def build_prompt(spark, sf):
    return _plain(_prompted(spark, sf).select("symbol", "news_date", "prompt", "was_truncated"))


@query
def parse_response(spark, sf):
    replies = b.replies(spark, sf)
    score, explanation = text.parse_two_line_reply(F.col("reply"))
    alone = text.parse_number_reply(F.col("reply"))
    return replies.select(
        "doc_id",
        F.when(score.isNull(), scoring.REJECTED).otherwise(scoring.OK).alias("status"),
        F.coalesce(score.cast("string"), F.lit("")).alias("score"),
        F.coalesce(explanation, F.lit("")).alias("explanation"),
        F.coalesce(alone.cast("string"), F.lit("")).alias("number_alone"),
    )


def _client():
    return scoring.KeywordClient(b.POSITIVE_WORDS, b.NEGATIVE_WORDS)


def _two_line_client():
    number = scoring.KeywordClient(b.POSITIVE_WORDS, b.NEGATIVE_WORDS, span=0.5, neutral=0.5)
    return lambda prompt: f"{number(prompt)}\nword balance"


@query
def score_status(spark, sf):
    scored = scoring.percent_scores(scoring.ask(_prompted(spark, sf), _client()))
    return _plain(scored.select("symbol", "news_date", "factor", "explanation", "news_count"))


@query
def factor_append(spark, sf):
    """Scores appended to a partitioned table and read back."""
    path = new_table_path(spark, "factors")
    append_factors(scoring.percent_scores(scoring.ask(_prompted(spark, sf), _client())), path)
    stored = spark.read.schema(
        "symbol string, date date, factor double, explanation string, news_count int, article_count int"
    ).parquet(path)
    return _plain(stored)


# grids, forecasts, summaries


def _featured(spark, sf):
    return prices.with_price_features(b.stock_daily(spark, sf))


def _candidates():
    lag = prices.previous
    return {
        "add_ar": [lag("y", k) for k in range(1, 16)],
        "lag_vol_price": [lag(v, k) for v in tuning.VOL_PRICE for k in (5, 10)],
        "lag_inst": [lag(v, k) for v in tuning.INST for k in (1, 3, 5)],
        "lag_share": [lag(v, 5) for v in tuning.SHARE],
        "with_future": [F.col("factor")],
    }


SUMMARY_STAGES = ["add_ar", "lag_vol_price", "lag_inst", "lag_share", "with_future"]


def _one_regressor_results(spark, sf):
    rows = evaluation.sentiment_training_rows(b.stock_daily(spark, sf), b.factors(spark, sf))
    long = linear.regressor_rows(rows, _candidates())
    judged = linear.one_regressor_forecasts(long).where("is_validation")
    return evaluation.forecast_errors(judged, ["symbol", "stage", "grid_idx"])


@query
def stage_errors(spark, sf):
    return _plain(_one_regressor_results(spark, sf), 3)


@query
def stage_best(spark, sf):
    return evaluation.best_per_stage(_one_regressor_results(spark, sf))


@query
def top_lags(spark, sf):
    results = _one_regressor_results(spark, sf).where(F.col("stage") == "add_ar")
    return _plain(evaluation.ranked_rows(results, 10).select("symbol", "rank", "grid_idx", "mape"), 3)


@query
def stage_summary(spark, sf):
    return evaluation.stage_summary(_one_regressor_results(spark, sf), SUMMARY_STAGES)


@query
def report_tree_summary(spark, sf):
    """The same matrix from a tree of report files, whose columns differ and stand in another order by stage."""
    root = new_table_path(spark, "reports")
    results = cut_lineage(_one_regressor_results(spark, sf).withColumnsRenamed({"rmse": "RMSE", "mape": "MAPE"}))
    stages = []
    for i, stage in enumerate(SUMMARY_STAGES):
        columns = [F.col("grid_idx").alias("_c0"), F.lit("x").alias(f"{stage}_lag"), "RMSE", "MAPE"]
        columns = columns if i % 2 else [columns[0], "MAPE", "RMSE"]
        rows = results.where(F.col("stage") == stage).select("symbol", *columns)
        rows.write.partitionBy("symbol").option("header", True).csv(f"{root}/{stage}")
        read = read_reports(spark, f"{root}/{stage}", "part-*.csv", {"_c0": "int", "RMSE": "double", "MAPE": "double"})
        stages.append(read.select("symbol", F.lit(stage).alias("stage"), F.col("_c0").alias("grid_idx"), F.col("MAPE").alias("mape")))
    return evaluation.stage_summary(reduce(DataFrame.unionByName, stages), SUMMARY_STAGES)


@query
def melt_summary(spark, sf):
    matrix = evaluation.stage_summary(_one_regressor_results(spark, sf), SUMMARY_STAGES)
    return evaluation.melt(matrix, SUMMARY_STAGES).select(
        "symbol", F.col("Category").alias("category"), F.col("Value").alias("value")
    )


@query
def improved_symbols(spark, sf):
    """Symbols whose own-lag error is below the volume-and-price error, relative to it."""
    matrix = evaluation.stage_summary(_one_regressor_results(spark, sf), SUMMARY_STAGES)
    better = evaluation.improved(matrix, "add_ar", "lag_vol_price").select("symbol", "add_ar", "lag_vol_price")
    return _plain(evaluation.relative_to(better, ["add_ar"], "lag_vol_price"))


@query
def param_grid(spark, sf):
    """Grid of the fourth stage over each symbol's four best lags."""
    results = _one_regressor_results(spark, sf).where(F.col("stage") == "add_ar")
    lags = results.withColumn(
        "params", F.create_map(F.lit("n_lags"), (F.col("grid_idx") + 1).cast("string"))
    )
    lists = grid.candidate_lists(lags, ["n_lags"], 4)
    stage = tuning.STAGES[3]
    rows = grid.parameter_grid(grid.merge_lists(lists, stage.lists), tuning.keys_of(tuning.STAGES, 3))
    keys = ["n_lags", "use_holidays", "weekly_seasonality", "yearly_seasonality"]
    return rows.select("symbol", "grid_idx", *[F.col("params")[k].alias(k) for k in keys])


@query
def time_split(spark, sf):
    return _plain(prices.chronological_split(b.stock_daily(spark, sf)).select("symbol", "ds", "is_validation"))


@query
def forecast_naive(spark, sf):
    marked = prices.chronological_split(b.stock_daily(spark, sf)).withColumn("pred", prices.previous("y"))
    return _plain(evaluation.forecast_errors(marked.where("is_validation")), 3)


def _ar1(spark, sf):
    long = linear.regressor_rows(b.stock_daily(spark, sf), {"ar": [prices.previous("y")]})
    return linear.one_regressor_forecasts(long, ["symbol"])


@query
def forecast_ar1(spark, sf):
    judged = _ar1(spark, sf).where("is_validation")
    return _plain(evaluation.forecast_errors(judged), 3)


@query
def residuals(spark, sf):
    rows = _ar1(spark, sf).withColumn("residual", F.col("y") - F.col("pred"))
    return _plain(linear.residuals_of(rows, training_only=True), 3)


@query
def residual_acf(spark, sf):
    rows = _ar1(spark, sf).withColumn("residual", F.col("y") - F.col("pred"))
    return _plain(stats.autocorrelation(linear.residuals_of(rows, True), "residual", "ds", ["symbol"]))


@query
def rmse_mape(spark, sf):
    """Errors of the percent forecast, forecasts and closes paired by symbol and day."""
    daily = cut_lineage(b.stock_daily(spark, sf))  # used twice; one row per day
    forecasts = evaluation.percent_forecast_rows(daily, b.factors(spark, sf), EVALUATED_FROM)
    held_out = prices.chronological_split(daily).where("is_validation")
    return _plain(evaluation.forecast_errors(evaluation.validation_pairs(forecasts, held_out)), 3)


@query
def variant_comparison(spark, sf):
    """Errors of three factor variants side by side: none, as given, reversed."""
    rows = evaluation.with_factor(_featured(spark, sf), b.factors(spark, sf))
    variants = {"no_factor": F.lit(0.0), "given": F.col("factor"), "reversed": -F.col("factor")}
    errors = evaluation.variant_errors(rows, variants, EVALUATED_FROM)
    return evaluation.compare_variants(errors, list(variants))


def _fitted(spark, sf):
    daily = _featured(spark, sf)
    layout = linear.Layout({"y": 4, "volume": 5, "foreign": 3})
    params = {"n_lags": "4", "volume": "5", "foreign": "3", "use_holidays": "true"}
    rows = linear.design(daily, layout, HOLIDAYS)
    entries = F.create_map(*[F.lit(x) for kv in params.items() for x in kv])
    wanted = daily.select("symbol").distinct().select("symbol", F.lit(0).alias("grid_idx"), entries.alias("params"))
    models = linear.fit(linear.cross_products(rows.where(~F.col("is_validation"))), wanted, layout)
    return rows, models, layout


@query
def forecast_ridge(spark, sf):
    rows, models, _ = _fitted(spark, sf)
    return _plain(linear.predict(rows, models).select("symbol", "ds", "is_validation", "y", "yhat", "residual"), 2)


@query
def forecast_ahead(spark, sf):
    rows, models, layout = _fitted(spark, sf)
    return _plain(linear.forecast_ahead(rows, models, layout, HOLIDAYS), 2)


@query
def staged_tuning(spark, sf):
    """All seven stages and the final fit with the factor."""
    daily = cut_lineage(b.stock_daily(spark, sf))  # used twice; one row per day
    with_factors = evaluation.sentiment_training_rows(daily, b.factors(spark, sf))
    results = tuning.tune_with_factor(prices.with_price_features(daily), with_factors, HOLIDAYS)
    best = evaluation.best_per_stage(results)
    names = [s.name for s in tuning.STAGES] + [tuning.FINAL.name]
    return evaluation.compare_variants(best.withColumnRenamed("stage", "variant"), names)


@query
def pca_reconstruct(spark, sf):
    out = reconstruct(b.stock_daily(spark, sf), tuning.SHARE, keys=["symbol", "ds"])
    return _plain(out.select("symbol", "ds", "squared_error"), 6)


# streams


def _document_stream(spark, sf):
    schema = b.read_table(spark, sf, "documents").schema
    # a pattern of this one name: the table may be a file or a folder of files, and a stream takes a file only by a pattern
    source = spark.readStream.schema(schema).parquet(f"{sf}/documents.parque[t]")
    return b.as_news(source)


@query
def index_stream(spark, sf):
    """Documents streamed into the chunk table."""
    path, progress = new_table_path(spark, "chunks"), new_table_path(spark, "chunks-progress")
    source = _document_stream(spark, sf).select("uuid", F.col("news_date").cast("string").alias("publish_at"), "content")
    loads.index_stream(source, path, progress)
    stored = spark.read.parquet(path)
    return _plain(stored.select("chunk_id", "publish_at", F.char_length("content").alias("n_chars")))


@query
def score_stream(spark, sf):
    """Documents streamed into the factor table (0-1 variant, nothing retrieved).

    They arrive in three batches that cut through every company and day, so most
    days are scored before all their articles are there, and again later.
    """
    arrivals, progress = new_table_path(spark, "arrivals"), new_table_path(spark, "stream-progress")
    path, state = new_table_path(spark, "stream-factors"), new_table_path(spark, "stream-articles")
    news_rows = b.news(spark, sf)
    news_rows.withColumn("batch", F.pmod(F.xxhash64("id"), F.lit(3))).write.partitionBy("batch").parquet(arrivals)

    def score(days):
        return score_plans.sentiment_of(days, b.companies(), b.company_rules(), None, _two_line_client())

    for batch in range(3):  # what has arrived so far
        glob = "{" + ",".join(f"batch={i}" for i in range(batch + 1)) + "}"
        source = spark.readStream.schema(news_rows.schema).parquet(f"{arrivals}/{glob}")
        wanted = source.where(F.col("news_date").between(*(F.lit(d).cast("date") for d in RANGE)))
        loads.scoring_stream(wanted, b.companies(), score, path, state, progress)
    stored = read_factor_table(spark, path)
    return _plain(stored.select("symbol", "date", "factor", "explanation", "article_count"))


@query
def factor_replace(spark, sf):
    """Scores of company-days, replaced where a later row scores the day again; a write that fails leaves no trace."""
    path = new_table_path(spark, "replaced-factors")
    rows = b.factors(spark, sf).select("symbol", "ds", "factor", "seq")
    later = rows.groupBy("symbol", "ds").agg(F.max(F.struct("seq", "factor")).alias("x"), F.count(F.lit(1)).alias("n")).where("n > 1")
    keys = ["symbol", "ds"]
    replace_rows(scoring.keep_first(rows, "seq").select(*rows.columns), path, keys, "ds")
    replace_rows(later.select("symbol", "ds", "x.factor", "x.seq"), path, keys, "ds")
    # rows of a third write that ended before its manifest
    rows.withColumn("factor", F.lit(99.0)).write.partitionBy("ds").parquet(f"{path}/data/held=3")
    return _plain(read_version(spark, path, rows.schema, "ds"))


@query
def sentiment_scores(spark, sf):
    """Batch form of ``score_stream``."""
    days = score_plans.sentiment_days(
        b.news(spark, sf), b.companies(), b.company_rules(), None, _two_line_client(), *RANGE
    )
    return _plain(days.select("symbol", "news_date", "factor", "explanation", "news_count"))
