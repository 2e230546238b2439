"""Every registered query runs; those with SQL give the same rows as another engine."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_points

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def other_engine():
    connection = duckdb.connect()
    for table in TABLES.split():
        connection.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    yield connection
    connection.close()


def rows_as_text(rows):
    text = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else repr(v)
    return sorted(tuple(text(v) for v in row) for row in rows)


@pytest.mark.parametrize("name", sorted(entry_points.oracle_sql()))
def test_same_rows_as_sql(spark, other_engine, name):
    df = entry_points.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = other_engine.execute(entry_points.oracle_sql()[name])
    assert sorted(d[0] for d in found.description) == columns
    places = [[d[0] for d in found.description].index(c) for c in columns]
    expected = rows_as_text([tuple(row[i] for i in places) for row in found.fetchall()])
    got = rows_as_text([tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()])
    assert got == expected


WITHOUT_SQL = sorted(set(entry_points.queries()) - set(entry_points.oracle_sql()))


@pytest.mark.parametrize("name", WITHOUT_SQL)
def test_runs(spark, name):
    assert entry_points.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    rows = entry_points.entry(spark).collect()
    suppliers = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_suppkey").distinct().collect()
    assert [r["symbol"] for r in rows] == sorted({str(2300 + r["l_suppkey"] % 20) for r in suppliers})


def test_documents_stream_from_a_file_or_a_folder(spark, tmp_path):
    rows = [(i, f"text number {i}", "en", "a", 10) for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.repartition(2).write.parquet(str(tmp_path / "folder" / "documents.parquet"))
    (tmp_path / "file").mkdir()
    df.toPandas().to_parquet(tmp_path / "file" / "documents.parquet")
    for kind in ("folder", "file"):
        assert entry_points.queries()["index_stream"](spark, str(tmp_path / kind)).count() == 4
