"""CSV, JSON and YAML inputs."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bourseflow.functions.text import parse_list_text

PRICE_COLUMNS = [
    "y",
    "high_price",
    "low_price",
    "volume",
    "foreign",
    "investment",
    "dealer",
    "ratio_over_400_shares",
    "shareholders_400_to_600",
    "shareholders_600_to_800",
    "shareholders_800_to_1000",
    "ratio_over_1000_shares",
]
NEWS_SCHEMA = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("keywords", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("publish_at", T.TimestampNTZType()),
        T.StructField("id", T.LongType()),
        T.StructField("summary", T.StringType()),
        T.StructField("related_stocks", T.StringType()),
        T.StructField("uuid", T.StringType()),
    ]
)
FACTOR_SCHEMA = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("factor", T.DoubleType()),
        T.StructField("explanation", T.StringType()),
        T.StructField("updated_time", T.TimestampNTZType()),
        T.StructField("news_count", T.IntegerType()),
    ]
)


#: Name of the column that holds the text of a row that does not fit its file's header.
BROKEN = "_broken"


def _headers(lines: DataFrame) -> dict[str, list[str]]:
    """Files by their first line. The driver lists these files anyway; there are few different headers."""
    first = lines.select(F.col("_metadata.file_path").alias("file"), "value", F.monotonically_increasing_id().alias("place"))
    found: dict[str, list[str]] = {}
    for file, header in first.groupBy("file").agg(F.min_by("value", "place")).collect():
        found.setdefault(header.lstrip("\ufeff"), []).append(file)
    return found


def _names(header: str, unnamed: str) -> list[str]:
    names: list[str] = []
    for i, name in enumerate(next(csv.reader([header]), [])):
        name = name.strip() or (unnamed if i == 0 else f"_c{i}")
        names.append(name if name not in names else f"{name}_{i}")
    return names


def read_by_header(
    spark: SparkSession,
    path: str,
    types: dict[str, str],
    options: dict[str, str] | None = None,
    unnamed: str = "row",
    observation: Observation | None = None,
) -> DataFrame:
    """CSV files whose headers differ, as one frame: columns are found by name in every file.

    Files of one header are one scan, with the ``types`` of the columns they name
    (others are text); columns a file lacks are null, and an unnamed first column
    is called ``unnamed``. A row that does not fit its header or its types is kept
    apart: it is left out here and counted by ``observation`` (``rows``, ``broken``),
    and ``broken_rows`` gives it. Adds ``_file``, the path.
    """
    scanned = _scan_by_header(spark, path, types, options or {}, unnamed)
    if observation is not None:
        scanned = scanned.observe(observation, F.count(F.lit(1)).alias("rows"), F.count(BROKEN).alias("broken"))
    return scanned.where(F.col(BROKEN).isNull()).drop(BROKEN)


def broken_rows(spark: SparkSession, path: str, types: dict[str, str], options: dict[str, str] | None = None) -> DataFrame:
    """``_file, _broken`` of the rows that ``read_by_header`` leaves out."""
    scanned = _scan_by_header(spark, path, types, options or {}, "row")
    return scanned.where(F.col(BROKEN).isNotNull()).select("_file", BROKEN)


def _scan_by_header(spark: SparkSession, path: str, types: dict[str, str], options: dict[str, str], unnamed: str) -> DataFrame:
    reader = spark.read.options(**options)
    frames = []
    for header, paths in sorted(_headers(reader.text(path)).items()):
        names = _names(header, unnamed)
        fields = ", ".join(f"`{n}` {types.get(n, 'string')}" for n in names)
        scan = spark.read.schema(f"{fields}, {BROKEN} string").option("header", True).option("escape", '"')
        found = scan.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BROKEN).csv(sorted(paths))
        # a row is broken if any column is, so all are parsed whatever a query asks for (nothing of them is added)
        judged = [F.col(f"`{n}`").cast("string") for n in names]
        nothing = F.substring(F.concat_ws("", *judged), 1, 0)
        frames.append(found.withColumns({BROKEN: F.concat(BROKEN, nothing), "_file": F.col("_metadata.file_path")}))
    if not frames:
        return spark.createDataFrame([], f"{BROKEN} string, _file string")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_prices(
    spark: SparkSession, path: str, columns: Sequence[str] = tuple(PRICE_COLUMNS), observation: Observation | None = None
) -> DataFrame:
    """All ``<symbol>_*.csv`` files of a folder as one frame; columns are found by the header of each file.

    Columns that no file has are left out; NaN is null; broken rows are counted by ``observation``.
    """
    types = {"ds": "date"} | {c: "double" for c in columns}
    raw = read_by_header(spark, path, types, observation=observation)
    symbol = F.regexp_extract("_file", r"/(\d+)_[^/]*$", 1).alias("symbol")
    numbers = [F.when(~F.isnan(c), F.col(c)).alias(c) for c in columns if c in raw.columns]
    return raw.select(symbol, "ds", *numbers)


def _news_columns(raw: DataFrame) -> DataFrame:
    day = F.regexp_extract(F.col("_metadata.file_name"), r"news_(\d{4}-\d{2}-\d{2})\.csv", 1)
    return raw.select(
        "title",
        parse_list_text(F.col("keywords")).alias("keywords"),
        "content",
        "publish_at",
        "id",
        "summary",
        parse_list_text(F.col("related_stocks")).alias("related_stocks"),
        "uuid",
        day.cast("date").alias("news_date"),
    )


def _news_options(reader):
    return (
        reader.schema(NEWS_SCHEMA)
        .option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
    )


def read_news(spark: SparkSession, path: str) -> DataFrame:
    """Day files ``news_<date>.csv``; quoted texts may span lines, absent days give no rows."""
    return _news_columns(_news_options(spark.read).csv(path))


def stream_news(spark: SparkSession, path: str) -> DataFrame:
    """The same files as a stream of newly arrived days."""
    return _news_columns(_news_options(spark.readStream).csv(path))


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rule table ``publish_at, content, uuid``."""
    return spark.read.schema("publish_at string, content string, uuid string").option("header", True).option(
        "multiLine", True
    ).option("escape", '"').csv(path)


def read_factors(spark: SparkSession, path: str) -> DataFrame:
    """Scored days, one CSV per symbol (``pred_<symbol>.csv``), in written order."""
    raw = (
        spark.read.schema(FACTOR_SCHEMA)
        .option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
        .csv(path)
    )
    symbol = F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)", 1)
    return raw.select(symbol.alias("symbol"), F.col("date").alias("ds"), "factor", "explanation", "updated_time", "news_count")


#: Columns of a tuning report that are numbers; parameters are text.
REPORT_TYPES = {"grid_idx": "int", "RMSE": "double", "MAPE": "double"}


def _folder(path) -> Column:
    """Name of a file's folder; of a folder ``name=value``, the value."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -2), "^[^=]*=", "")


def read_reports(
    spark: SparkSession, root: str, file_name: str, types: dict[str, str] | None = None, observation: Observation | None = None
) -> DataFrame:
    """Every file of that name (or glob) below ``root``, tagged with its folder's name as ``symbol``.

    A tuning report starts with an unnamed column, the position before sorting
    (``grid_idx``). Files may name their columns in any order; broken rows are
    counted by ``observation``.
    """
    options = {"recursiveFileLookup": "true", "pathGlobFilter": file_name}
    raw = read_by_header(spark, root, REPORT_TYPES if types is None else types, options, "grid_idx", observation)
    return raw.select(_folder("_file").alias("symbol"), *[f"`{c}`" for c in raw.columns if c != "_file"])


def read_best_params(spark: SparkSession, root: str, file_name: str = "*") -> DataFrame:
    """Best-parameter files (an object of lists) as ``symbol, params map<string, array<string>>``; also what ``write_best_params`` wrote."""
    raw = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", file_name)
        .load(root)
    )
    text = F.decode("content", "UTF-8")
    params = F.from_json(text, "map<string,array<string>>")
    return raw.where(params.isNotNull()).select(_folder("path").alias("symbol"), params.alias("params"))


def read_big5(spark: SparkSession, path: str) -> DataFrame:
    """Result table in Big5 encoding, which Spark reads only with all Java charsets allowed."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    return spark.read.option("header", True).option("encoding", "Big5").csv(path)


def read_settings(path: str) -> dict:
    """A YAML settings file. Settings are small and belong to the driver."""
    import yaml

    with open(path, encoding="utf-8") as file:
        return yaml.safe_load(file)


def companies_of(settings: dict) -> list[dict]:
    """The ``stocks`` list of the settings, symbols as text."""
    return [{**stock, "symbol": str(stock["symbol"])} for stock in settings["stocks"]]


def company_table(spark: SparkSession, companies: Sequence[dict]) -> DataFrame:
    """Company dimension: symbol, stock_name, avg_change, keywords."""
    rows = [(c["symbol"], c["stock_name"], float(c["avg_change"]), list(c["keywords"])) for c in companies]
    return spark.createDataFrame(rows, "symbol string, stock_name string, avg_change double, keywords array<string>")
