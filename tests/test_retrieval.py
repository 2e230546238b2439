import numpy as np
import pytest
from pyspark.sql import functions as F

from bourseflow.functions.vectors import embed, embedding_model
from bourseflow.operators import chunks, nearest as nn
from bourseflow.plans.indexing import index_documents, load_documents, retrieve, stored_vectors
from bourseflow.session import new_table_path


def documents(spark, rows):
    return spark.createDataFrame(rows, "uuid string, publish_at string, content string")


def test_short_and_long_documents(spark):
    df = documents(spark, [("test1", "2025-04-02", "短內容"), ("test2", "2025-04-02", "長內容" * 3000)])
    got = chunks.split_documents(df).orderBy("chunk_id").collect()
    assert [r["chunk_id"] for r in got] == ["test1:0", "test2:0", "test2:1"]
    assert len(got[1]["content"]) == 8192 and len(got[2]["content"]) == 9000 - 8112


@pytest.mark.parametrize(("n", "expected"), [(0, 0), (1, 1), (8192, 1), (8193, 2), (9000, 2), (16304, 2), (16305, 3)])
def test_chunk_counts(spark, n, expected):
    assert chunks.split_documents(documents(spark, [("d", "2025-01-01", "字" * n)])).count() == expected


def test_chunks_add_up_to_the_text(spark):
    content = "  Alpha beta\n\n中文 gamma,delta  epsilon 字\t尾 \n"
    df = documents(spark, [("d", "2025-01-01", content)])
    parts = chunks.split_documents(df, size=3, overlap=0).orderBy("chunk_no").collect()
    assert "".join(r["content"] for r in parts) == content
    overlapped = chunks.split_documents(df, size=3, overlap=1).orderBy("chunk_no").collect()
    assert len(overlapped) > len(parts)


def test_batch_ids_run_over_the_batch(spark):
    df = documents(spark, [("b", "2025-01-01", "one"), ("a", "2025-01-01", "字" * 9000)])
    ids = chunks.batch_chunk_ids(chunks.split_documents(df), ["uuid"])
    assert sorted(r["chunk_id"] for r in ids.collect()) == ["a:0", "a:1", "b:2"]


def test_repeated_load_adds_nothing(spark):
    path = new_table_path(spark, "store")
    first = documents(spark, [("a", "2025-01-01", "one"), ("b", "2025-01-02", "two"), ("a", "2025-01-01", "one")])
    load_documents(first, path)
    load_documents(first.unionByName(documents(spark, [("c", "2025-01-03", "three")])), path)
    stored = spark.read.parquet(path)
    assert sorted(r["chunk_id"] for r in stored.collect()) == ["a:0", "b:0", "c:0"]
    assert set(stored.columns) == {"chunk_id", "publish_at", "content"}
    load_documents(documents(spark, [("z", "2025-01-03", "new")]), path, reset=True)
    assert [r["chunk_id"] for r in spark.read.parquet(path).collect()] == ["z:0"]


def test_a_time_of_day_in_publish_at_is_an_error(spark):
    df = documents(spark, [("a", "2025-04-02 16:00:00", "x")])
    with pytest.raises(Exception, match="2025-04-02"):
        load_documents(df, new_table_path(spark, "store"))


def vectors(spark, n, d, seed, name, ties=False):
    data = np.random.default_rng(seed).normal(size=(n, d)).round(3)
    if ties:
        data[n // 2 :] = data[: n - n // 2]
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(data)]
    return data, spark.createDataFrame(rows, f"{name} long, embedding array<double>")


def brute(queries, store, k):
    out = {}
    for i, q in enumerate(queries):
        d = ((store - q) ** 2).sum(axis=1)
        best = sorted((round(float(x), 9), j) for j, x in enumerate(d))[:k]
        out[i] = [j for _, j in best]
    return out


def result(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r["vec_id"])
    return out


@pytest.mark.parametrize("options", [{}, {"pivots": 5, "group_rows": 7}, {"pivots": 1}])
def test_every_partition_finds_the_same_neighbours(spark, options):
    q, queries = vectors(spark, 12, 6, 1, "query_id")
    s, store = vectors(spark, 90, 6, 2, "vec_id", ties=True)
    assert result(nn.nearest(queries, store.repartition(5), 7, **options)) == brute(q, s, 7)


def test_few_queries_and_their_bound(spark, monkeypatch):
    q, queries = vectors(spark, 12, 6, 1, "query_id")
    s, store = vectors(spark, 90, 6, 2, "vec_id", ties=True)
    assert result(nn.nearest_few(queries, store.repartition(5), 7)) == brute(q, s, 7)
    monkeypatch.setattr(nn, "FEW_VALUES", 12 * 6 - 1)
    with pytest.raises(ValueError, match="too many queries"):
        nn.nearest_few(queries, store)


def test_a_hot_vector_and_missing_vectors(spark):
    """A third of the store is one vector; it is dealt in several groups, and ties still go to the smaller id."""
    data = np.random.default_rng(4).normal(size=(300, 4)).round(3)
    data[::3] = data[0]
    store = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)] + [(999, None)], "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(0, data[0].tolist()), (1, data[1].tolist()), (2, None)], "query_id long, embedding array<double>")
    got = result(nn.nearest(queries, store, 8, pivots=6, group_rows=20))
    assert got == brute(data[:2], data, 8)
    assert nn.nearest(queries, store.limit(0)).count() == nn.nearest(queries.limit(0), store).count() == 0


def test_nothing_runs_before_the_result_is_asked_for(spark):
    _, queries = vectors(spark, 3, 2, 1, "query_id")
    _, store = vectors(spark, 9, 2, 2, "vec_id")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("lazy", "lazy")
    nn.nearest(queries, store, 2)
    assert not tracker.getJobIdsForGroup("lazy")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_fewer_vectors_than_k_and_text_ids(spark):
    store = spark.createDataFrame([("x", [0.0, 0.0]), ("y", [1.0, 0.0])], "vec_id string, embedding array<double>")
    queries = spark.createDataFrame([("q", [0.9, 0.0])], "query_id string, embedding array<double>")
    for find in (nn.nearest, nn.nearest_few):
        assert result(find(queries, store, 15)) == {"q": ["y", "x"]}
        assert result(find(queries, store.where("vec_id = 'x'"), 3)) == {"q": ["x"]}


def test_embedding_is_stable_and_finds_the_same_text(spark):
    texts = ["alpha beta gamma", "delta epsilon", "營收增加 獲利提升", "alpha delta"]
    rules = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "vec_id long, content string")
    model = embedding_model(rules, 64)
    store = embed(rules, model)
    queries = embed(rules.withColumnRenamed("vec_id", "query_id"), model)
    assert store.first()["embedding"] == queries.first()["embedding"]
    found = nn.nearest(queries, store, 1).where(F.col("rank") == 1).collect()
    assert all(r["query_id"] == r["vec_id"] for r in found)


class Counting:
    """Another embedder: the length of the text, and a note of every text that it is asked for."""

    version = "lengths"

    def __init__(self, folder):
        self.folder = str(folder)

    def embed(self, df, text="content"):
        folder = self.folder

        @F.udf("array<float>")
        def one(t):
            import uuid

            open(f"{folder}/{uuid.uuid4().hex}", "w").close()
            return [float(len(t))]

        return df.withColumn("embedding", one.asNondeterministic()(F.col(text)))


def test_index_then_retrieve(spark, tmp_path, capsys):
    path, asked = new_table_path(spark, "index"), tmp_path / "asked"
    asked.mkdir()
    model = Counting(asked)
    first = documents(spark, [("a", "2025-01-01", "x" * 5), ("b", "2025-01-02", "x" * 9), ("a", "2025-01-01", "x" * 5)])
    index_documents(first, path, model)
    index_documents(first.unionByName(documents(spark, [("c", "2025-01-03", "x" * 10)])), path, model)
    assert len(list(asked.iterdir())) == 3  # nothing is embedded twice
    queries = spark.createDataFrame([(1, "x" * 8)], "query_id long, content string")
    found = retrieve(queries, path, model, 2).orderBy("rank").collect()
    assert [(r["chunk_id"], r["distance"]) for r in found] == [("b:0", 1.0), ("c:0", 4.0)]
    found = retrieve(queries, path, model, 2, last_day="2025-01-02").orderBy("rank").collect()
    assert [(r["chunk_id"], str(r["publish_at"]), r["content"]) for r in found] == [("b:0", "2025-01-02", "x" * 9), ("a:0", "2025-01-01", "x" * 5)]
    stored_vectors(spark, path, model, "2025-01-02").explain("formatted")
    assert "PartitionFilters: [isnotnull(model" in capsys.readouterr().out
    # another version is filled beside the first
    other = embedding_model(first, 16)
    index_documents(first, path, other)
    assert retrieve(queries, path, other, 9).count() == 2 and retrieve(queries, path, model, 9).count() == 3


def test_few_distances_of_a_group_are_computed_one_by_one(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from bourseflow.operators import nearest as module

    rng = np.random.default_rng(4)
    stored, asked = (1e3 + rng.integers(0, 3, (n, 8)) / 7 for n in (3000, 40))
    ids, far = rng.permutation(3000), np.linalg.norm(stored - 1e3, axis=1)
    to_pivot = np.linalg.norm(asked - 1e3, axis=1)
    limits = [None if i % 2 else 0.5 for i in range(40)]
    vectors = lambda x: pa.array(list(x), pa.list_(pa.float64()))
    one = pa.table({"query_id": range(40), "embedding": vectors(asked), "to_pivot": to_pivot, "limit": pa.array(limits, pa.float64())})
    two = pa.table({"vec_id": ids, "embedding": vectors(stored), "far": far})
    seen, plain = [], module._squares
    monkeypatch.setattr(module, "_squares", lambda v, q: (seen.append(len(v)), plain(v, q))[1])
    found = module._search(5)(one, two).to_pylist()
    for i in range(40):
        near = sorted(zip(plain(stored, asked[i]).tolist(), ids.tolist()))[:5]
        got = [(r["distance"], r["vec_id"]) for r in found if r["query_id"] == i]
        assert got[: len(near)] == near if limits[i] is None else [x for x in got if x[0] <= 0.25] == [x for x in near if x[0] <= 0.25]
    assert sum(seen) < 40 * 3000 / 10
