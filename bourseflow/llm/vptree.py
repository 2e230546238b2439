"""Approximate nearest neighbours with vantage-point trees.

Every task takes a shard of the vectors and builds one vantage-point tree over
it: a node holds a vantage point, the median distance to it, and the points
inside and outside. A search goes down the nearer side first and visits the
other only if the triangle inequality cannot rule it out: the border lies
within ``factor`` times the distance of the worst of the k best so far. Factor
one is the exact search; smaller factors leave more out. Leaves are compared as
blocks of vectors, in double precision.

Queries are the stated set; they are read in blocks of at most ``QUERY_BYTES``,
each broadcast, so a block costs one pass over the vectors. A task returns its
k best per query; these are merged in two steps, so no single task sees all
shards' candidates of a query.

Defined cases: vectors that are null, empty, zero, of another length than the
most common one, or hold a null or a non-finite number take no part, as queries
or candidates; equal distances go to the smaller id; a row is no neighbour of
its own id, so repeated rows do not find each other, and a repeated candidate
counts once; fewer candidates than k give fewer rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 10
FACTOR = 0.6
LEAF = 64
QUERY_BYTES = 32 << 20
SHARD_ROWS = 20_000
MERGE_GROUPS = 16


class Tree:
    """Vantage-point tree of a shard, as arrays; ``order`` has the leaves' rows side by side."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        self.vectors, self.ids, self.leaf = vectors, ids, leaf
        self.nodes: list[tuple[int, float, int, int]] = []  # vantage row, median, inside node, outside node
        self.leaves: dict[int, np.ndarray] = {}
        rng = np.random.default_rng(len(ids))
        self.root = self._build(np.arange(len(ids)), rng)

    def _build(self, rows: np.ndarray, rng) -> int:
        """Iterative, as repeated vectors could make a deep tree."""
        root = self._new()
        open_ = [(root, rows)]
        while open_:
            node, rows = open_.pop()
            if len(rows) > self.leaf:
                # of a few candidates, the one whose distances spread most
                tries = rng.choice(rows, size=min(5, len(rows)), replace=False)
                sample = self.vectors[rng.choice(rows, size=min(100, len(rows)), replace=False)]
                spread = [np.linalg.norm(sample - self.vectors[t], axis=1).std() for t in tries]
                vantage = int(tries[int(np.argmax(spread))])
                d = np.linalg.norm(self.vectors[rows] - self.vectors[vantage], axis=1)
                median = float(np.median(d))
                inside = d < median
                if 0 < inside.sum() < len(rows):
                    a, b = self._new(), self._new()
                    self.nodes[node] = (vantage, median, a, b)
                    open_ += [(a, rows[inside]), (b, rows[~inside])]
                    continue
            self.leaves[node] = rows
        return root

    def _new(self) -> int:
        self.nodes.append((-1, 0.0, -1, -1))
        return len(self.nodes) - 1

    def search(self, query: np.ndarray, own: int, k: int, factor: float) -> list[tuple[float, int]]:
        """The k nearest found, as (distance, id)."""
        best: list[tuple[float, int]] = []  # heap of (-distance, -id)
        seen: set[int] = set()
        radius = np.inf
        open_: list[tuple[float, int, int]] = [(0.0, 0, self.root)]
        count = 0
        while open_:
            bound, _, node = heapq.heappop(open_)
            if bound > radius * factor:
                if bound > radius:
                    break
                continue
            rows = self.leaves.get(node)
            if rows is None:
                vantage, median, a, b = self.nodes[node]
                d = float(np.sqrt(((self.vectors[vantage] - query) ** 2).sum()))
                count += 1
                open_push = heapq.heappush
                open_push(open_, (max(bound, d - median), count, a))
                open_push(open_, (max(bound, median - d), -count, b))
                continue
            ds = np.sqrt(((self.vectors[rows] - query) ** 2).sum(axis=1))
            for i in np.flatnonzero(ds <= radius):
                d, name = float(ds[i]), int(self.ids[rows[i]])
                if name == own or name in seen:
                    continue
                if len(best) < k:
                    heapq.heappush(best, (-d, -name))
                    seen.add(name)
                elif (-d, -name) > best[0]:
                    seen.discard(-heapq.heapreplace(best, (-d, -name))[1])
                    seen.add(name)
                if len(best) == k:
                    radius = -best[0][0]
        return sorted((-d, -i) for d, i in best)


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``id bigint, v array<double>`` of the rows that take part."""
    v = F.col(vector_column).cast("array<double>")
    rows = vectors.select(F.col(id_column).cast("bigint").alias("id"), v.alias("v")).where("id is not null and v is not null and size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(fine & F.exists("v", lambda x: x != 0))


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the right width, and which they are."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    right = sizes == width
    flat = column.filter(pa.array(right)).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, width), right


def _query_blocks(queries: DataFrame, width: int, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    ids: list[int] = []
    rows: list = []
    for row in queries.toLocalIterator():
        if len(row["v"]) != width:
            continue
        ids.append(row["id"])
        rows.append(row["v"])
        if len(rows) * width * 8 >= limit:
            yield np.array(ids), np.array(rows, dtype=np.float64)
            ids, rows = [], []
    if rows:
        yield np.array(ids), np.array(rows, dtype=np.float64)


def search(
    vectors: DataFrame, queries: DataFrame, k: int = K, factor: float = FACTOR, id_column: str = "vec_id", vector_column: str = "embedding", leaf: int = LEAF, query_bytes: int = QUERY_BYTES, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """``query_id, rank, id, score``: the k nearest of ``vectors`` found for each row of ``queries``."""
    if not 0 < factor <= 1:
        raise ValueError("the factor is above 0, and at most 1")
    rows, asked = usable(vectors, id_column, vector_column), usable(queries, id_column, vector_column)
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    schema = "query_id bigint, id bigint, score double"
    if common is None:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, id bigint, score double")
    width = common["n"]
    # even shards, whatever the files are like: a tree needs some thousands of rows to prune well
    shards = max(1, round(common["count"] / shard_rows))
    sharded = rows.repartition(shards, F.xxhash64("id"))
    found = None
    for ids, block in _query_blocks(asked, width, query_bytes):
        shared = vectors.sparkSession.sparkContext.broadcast((ids, block))

        def step(batches, shared=shared):
            own_ids, own = [], []
            for batch in batches:
                matrix, right = _matrix(batch.column(1), width)
                own.append(matrix)
                own_ids.append(batch.column(0).to_numpy(zero_copy_only=False)[right])
                if sum(map(len, own_ids)) >= 4 * shard_rows:  # a larger share than planned: several trees
                    yield from _answers(own_ids, own, shared.value, k, factor, leaf)
                    own_ids, own = [], []
            if own_ids:
                yield from _answers(own_ids, own, shared.value, k, factor, leaf)

        part = sharded.mapInArrow(step, schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, id bigint, score double")
    # the k best of each of a few groups of shards, then of the groups
    found = found.distinct()
    first = Window.partitionBy("query_id", "group").orderBy("score", "id")
    cut = found.withColumn("group", F.pmod(F.xxhash64("id"), F.lit(MERGE_GROUPS))).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    last = Window.partitionBy("query_id").orderBy("score", "id")
    return cut.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _answers(ids: list[np.ndarray], rows: list[np.ndarray], queries, k: int, factor: float, leaf: int) -> Iterator[pa.RecordBatch]:
    tree = Tree(np.concatenate(rows), np.concatenate(ids), leaf)
    out: tuple[list, list, list] = ([], [], [])
    for name, query in zip(*queries):
        for d, i in tree.search(query, int(name), k, factor):
            for column, value in zip(out, (int(name), i, d)):
                column.append(value)
    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "id", "score"])


def report(vectors: DataFrame, every: int = 100) -> DataFrame:
    """The registered query: rows whose id is divisible by ``every`` against all."""
    queries = vectors.where(F.col("vec_id") % every == 0)
    return search(vectors, queries).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def brute_force(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, k: int = K) -> dict[int, list[tuple[float, int]]]:
    out = {}
    place = {int(i): n for n, i in enumerate(ids)}
    for q in query_ids:
        d = np.sqrt(((rows - rows[place[int(q)]]) ** 2).sum(axis=1))
        order = np.lexsort((ids, d))
        out[int(q)] = [(float(d[i]), int(ids[i])) for i in order if ids[i] != q][:k]
    return out
