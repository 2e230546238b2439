"""Exact n-gram Jaccard join in the metric space of shingle sets.

The Jaccard distance is a metric, but almost all texts are at distance 1 from
each other, and pivots drawn at random would tell nothing. So a region is
opened by a value that its members share, and its pivot is one of them.

1. Texts with equal sets are one class. Of a class's shingles the smallest hashes
   are its sample, long enough that the samples of linked classes share ``m``
   values. Values that no other class has can't be among them: they are dropped,
   and with them the classes that keep fewer than ``m``, twice. So texts that have
   only passages in common with others leave before any pair is looked at.
2. The rarest values left, all but ``m - 1``, are a class's probes: linked classes
   share one. Classes that share a probe meet in the region of the pivot, the
   smallest class among them.
3. The distance of each class to one of its pivots is computed, and to others only
   where the links so far do not connect them. Regions in which all are connected
   are done.
4. A region of bounded size is joined exactly in one task: numbers of common
   shingles for all members that are not connected with the pivot, as products of
   0/1 matrices.
5. A larger one is split again. From a pivot p a class x is seen as its difference
   ``x ^ p``, which is short, and ``|x ^ y|`` is at least ``||x ^ p| - |y ^ p||``.
   By this triangle inequality a partner must share a certain number of values
   of the difference, or is so near that it is linked with the nearest class
   of the region (``_differences``). With these values and numbers, steps 1 to 3
   give the regions of the next level, around new pivots, and the links found
   there close regions. A region that would be copied more than ``COPIES`` times,
   or is still large at the last level, is joined in pairs of blocks, one task
   each.
6. Components of the links give the smallest document id reachable.

Shingles are 64-bit hashes built from BLAKE2b digests of their words, classes a
128-bit hash of their set.

Defined cases: null text, and text without words, have the empty set and are
linked with nothing, equal ones neither; a text with fewer words than a shingle
has one shingle, the whole sequence; repeated rows are in one class; rows
without id take part and get the smallest id of their component, or null.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bourseflow.llm import words as W
from bourseflow.llm.components import connected
from bourseflow.session import cut_lineage

#: Shingles (over all members) of a region that one task joins; levels of splitting; copies of a member that a split may make.
CELL_VALUES, LEVELS, COPIES = 2_000_000, 3, 4
#: Bits that tell which texts are read again: a million rows of 64 at most.
ID_BITS = 1 << 26
#: Entries of a matrix that a task holds.
_ENTRIES = 2_000_000
#: Rows whose sets a task holds.
_ROWS = 1_000


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each (lower-cased) text."""
    out = []
    for a, b in W.chunks(texts):
        words = W.Words([t.translate(W.LOWER) for t in texts[a:b]])
        runs = words.runs(n)
        for i in range(b - a):
            begin, end = words.starts(i, n)
            if end > begin:
                out.append(np.unique(runs[begin:end]))
            elif (stop := int(words.bounds[i + 1])) > begin:  # fewer words than a shingle: the sequence itself
                k = stop - begin
                out.append(words.runs(k)[begin : begin + 1] ^ np.uint64(k))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
    return out


def sample_size(size: int, percent: int) -> tuple[int, int]:
    """How many values a set's sample has, and how many of them it shares with that of any linked set.

    A linked set has at least ``least`` of the values in common. If both sides take
    their ``size - least + m`` smallest, the first m common values are among them,
    for the smaller m of both; m grows with the size, and the smallest linked set
    has ``least`` values. The more they must share, the fewer meet by chance, whose
    number grows faster than that of the texts: m is a tenth of the size at least.
    """

    def spare_and_m(k: int) -> tuple[int, int]:
        spare = k - (percent * k + 99) // 100
        return spare, min(max(spare // 2, k // 10) + 1, k - spare)

    spare, m = spare_and_m(size)
    return spare + m, spare_and_m(size - spare)[1]


def _slices(batches):
    """Batches of no more than ``_ROWS`` rows."""
    for batch in batches:
        yield from (batch.slice(i, _ROWS) for i in range(0, len(batch), _ROWS))


def _sampled(n: int, percent: int):
    def step(batches):
        for batch in _slices(batches):
            sizes, nodes, samples, shared = [], [], [], []
            for s in shingle_sets(W.as_bytes(batch.column(1)), n):
                sizes.append(len(s))
                nodes.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                k, m = sample_size(len(s), percent) if len(s) else (0, 0)
                samples.append(s[:k].view(np.int64))  # sets are sorted by hash
                shared.append(m)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(samples, pa.list_(pa.int64())), pa.array(shared, pa.int64())],
                names=["doc_id", "n_shingles", "node", "sample", "need"],
            )

    return step


def _sets(n: int):
    """Class and set of each text, again from the text; of the class asked for only, where one is named. Further columns are passed on."""

    def step(batches):
        for batch in _slices(batches):
            wanted = batch.column(1).to_pylist()
            nodes, sets, places = [], [], []
            for i, s in enumerate(shingle_sets(W.as_bytes(batch.column(0)), n)):
                node = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                if len(s) and wanted[i] in (None, node):
                    nodes.append(node)
                    sets.append(s.tobytes())
                    places.append(i)
            rest = [c.take(pa.array(places, pa.int64())) for c in batch.columns[2:]]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(sets, pa.binary()), *rest], names=["node", "shingles", *batch.schema.names[2:]])

    return step


def _as_set(x: bytes) -> np.ndarray:
    return np.frombuffer(x, dtype=np.uint64)


def _side_by_side(sets: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of all sets, one set behind the other, where Arrow holds them, and each set's size."""
    if not len(sets):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    _, offsets, data = sets.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int32)[sets.offset : sets.offset + len(sets) + 1].astype(np.int64)
    return np.frombuffer(data, dtype=np.uint64, count=(bounds[-1] - bounds[0]) // 8, offset=bounds[0]), np.diff(bounds) // 8


def _common(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    place = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[place] == a).sum())


def _peeled(rows: DataFrame, needs: DataFrame) -> DataFrame:
    """``cell, who, need, values``: the shared ones of ``rows(cell, who, value)`` as (count, value), for classes that keep as many as they need."""
    counts = rows.groupBy("cell", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    lists = rows.join(counts, ["cell", "value"]).groupBy("cell", "who").agg(F.collect_list(F.struct("n", "value")).alias("values"))
    return lists.join(needs, ["cell", "who"]).where(F.size("values") >= F.col("need"))


def regions(items: DataFrame) -> DataFrame:
    """``cell, pivot, node`` of ``items(cell, node, need, values)``, in which linked classes of a cell share at least as many values as either needs.

    Rows of values go by 64 bits of their class; two classes that share them would
    only keep more values than they need to.
    """
    items = items.withColumn("who", F.xxhash64("node"))
    needs = items.groupBy("cell", "who").agg(F.min("need").alias("need"))
    left = cut_lineage(_peeled(items.select("cell", "who", F.explode("values").alias("value")), needs))
    # without the classes that left, more values are alone
    left = cut_lineage(_peeled(left.select("cell", "who", F.explode("values.value").alias("value")), needs))
    probes = left.select("cell", "who", F.explode(F.slice(F.sort_array("values"), F.lit(1), F.size("values") - F.col("need") + 1)).alias("probe"))
    probes = cut_lineage(probes.select("cell", "who", F.col("probe.value").alias("probe")))
    met = probes.groupBy("cell", "probe").agg(F.min("who").alias("first"), F.max("who").alias("last")).where("first < last").drop("last")
    found = probes.join(met, ["cell", "probe"]).where("who != first").select("cell", "first", "who").distinct()
    names = items.select("cell", "who", "node")
    found = found.join(names, ["cell", "who"]).drop("who")
    return found.join(names.select("cell", F.col("who").alias("first"), F.col("node").alias("pivot")), ["cell", "first"]).select("cell", "pivot", "node")


def _measure(batches):
    """|common| and |union| of each class and its pivot, instead of a rounded quotient."""
    for batch in batches:
        common, union = [], []
        for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            a, b = _as_set(a), _as_set(b)
            common.append(k := _common(a, b))
            union.append(len(a) + len(b) - k)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(common, pa.int64()), pa.array(union, pa.int64())], names=["a", "b", "common", "union"])


def _fits(percent: int):
    return 100 * F.least("size", "pivot_size") >= percent * F.greatest("size", "pivot_size")


def _fitting(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs(pivot, node)`` whose sizes allow a link, found without their sets."""
    sizes = sets.select("node", "size")
    met = pairs.join(sizes, "node").join(sizes.select(F.col("node").alias("pivot"), F.col("size").alias("pivot_size")), "pivot")
    return met.where(_fits(percent)).select("pivot", "node")


def _close(paired: DataFrame, pivots: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` among the pairs of ``paired(pivot, node, size, shingles)``; sizes decide before sets are compared."""
    right = pivots.select(F.col("node").alias("pivot"), F.col("size").alias("pivot_size"), F.col("shingles").alias("pivot_shingles"))
    joined = paired.join(right, "pivot").where(_fits(percent)).select("node", "pivot", "shingles", "pivot_shingles")
    measured = joined.mapInArrow(_measure, "a binary, b binary, common bigint, union bigint")
    return cut_lineage(measured.where(100 * F.col("common") >= percent * F.col("union")).select("a", "b"))


def _differences(percent: int):
    """Each class x of a region as ``x ^ p``, with the weight that decides.

    With w(x) = (100 + percent) |x ^ p| - (100 - percent) |x|, classes x and y are
    linked where twice (100 + percent) times the values that their differences
    share is at least w(x) + w(y).
    """

    def step(batches):
        for batch in batches:
            values, weights = [], []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                a, b = _as_set(a), _as_set(b)
                values.append(np.setxor1d(a, b, assume_unique=True).view(np.int64))
                weights.append((100 + percent) * len(values[-1]) - (100 - percent) * len(a))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values, pa.list_(pa.int64())), pa.array(weights, pa.int64())], names=["cell", "node", "values", "weight"])

    return step


def _split(cells: DataFrame, sets: DataFrame, pivots: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Items for the regions of the next level, and links with the nearest class, of ``cells(cell, pivot, node)``."""
    right = pivots.select(F.col("node").alias("pivot"), F.col("shingles").alias("pivot_shingles"))
    joined = cells.join(sets.select("node", "shingles"), "node").join(right, "pivot").select("cell", "node", "shingles", "pivot_shingles")
    seen = cut_lineage(joined.mapInArrow(_differences(percent), "cell binary, node binary, values array<bigint>, weight bigint"))
    nearest = seen.groupBy("cell").agg(F.min(F.struct("weight", "node")).alias("nearest")).select("cell", "nearest.*").withColumnsRenamed({"weight": "least", "node": "nearest"})
    weighed = seen.join(nearest, "cell")
    # two whose weights are no more than 0 together are linked whatever they share; both are linked with the nearest then
    links = weighed.where("weight + least <= 0 and node != nearest").select(F.col("node").alias("a"), F.col("nearest").alias("b"))
    need = F.greatest(F.lit(1), F.ceil((F.col("weight") + F.col("least")) / (2 * (100 + percent))))
    return weighed.select("cell", "node", "values", need.cast("bigint").alias("need")), links


def _join_cell(percent: int):
    """Links inside one cell, enough to connect what is linked; ``outer`` classes are compared with all, others are connected with the pivot already."""

    def step(table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_pylist()
        root = table.column("label").combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
        side, outer = table.column("side").to_numpy(), table.column("outer").to_numpy(zero_copy_only=False)
        values, size = _side_by_side(table.column("shingles").combine_chunks().cast(pa.binary()))
        n = len(size)
        # in the order of values; few arrays of all of them live at a time, and numbers have 32 bits
        order = np.argsort(values, kind="stable")
        owner = np.repeat(np.arange(n, dtype=np.int32), size)[order]
        ordered = values[order]
        del values, order
        new = np.ones(len(ordered), dtype=bool)
        np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
        del ordered
        column = np.cumsum(new, dtype=np.int32) - np.int32(1)
        count = np.bincount(column) if len(column) else np.zeros(0, dtype=np.int64)
        everywhere = int((count == n).sum())
        telling = (count > 1) & (count < n)
        inside = telling[column]
        owner, column = owner[inside], (np.cumsum(telling, dtype=np.int32) - np.int32(1))[column[inside]]
        width, height = max(1, _ENTRIES // n), max(1, _ENTRIES // n)
        cuts = np.arange(0, int(telling.sum()) + width, width)
        places = np.searchsorted(column, cuts)
        rows = np.flatnonzero(outer)
        out_a, out_b = [], []
        for first in range(0, len(rows), height):
            strip = rows[first : first + height]
            shared = np.full((len(strip), n), everywhere, dtype=np.float32)
            for begin, a, b in zip(cuts, places, places[1:]):
                if b > a:
                    has = np.zeros((n, min(width, int(column[b - 1]) - begin + 1)), dtype=np.float32)
                    has[owner[a:b], column[a:b] - begin] = 1
                    shared += has[strip] @ has.T
            for i, common in zip(strip, shared):
                k = common.astype(np.int64)
                close = 100 * k >= percent * (size[i] + size - k)
                # blocks meet as sides 0 and 1; -1 is a cell on its own
                if side[i] >= 0:
                    close &= side != side[i]
                for j in np.flatnonzero(close):
                    if root[i] != root[j]:
                        root[root == root[j]] = root[i]
                        out_a.append(nodes[i])
                        out_b.append(nodes[j])
        return pa.table({"a": pa.array(out_a, pa.binary()), "b": pa.array(out_b, pa.binary())})

    return step


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``members(cell, pivot, node)`` with the components of both so far; a class without links is its own."""
    pivot_of = labels.select(F.col("node").alias("pivot"), F.col("label").alias("pivot_label"))
    found = members.join(labels, "node", "left").join(pivot_of, "pivot", "left")
    return found.withColumns({"label": F.coalesce("label", "node"), "pivot_label": F.coalesce("pivot_label", "pivot")})


def _open_cells(members: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """``cell, pivot, node, label, outer, size, total`` of the cells in which something is left to connect; ``total`` counts the cell's shingles."""
    found = _labelled(members, labels).withColumn("outer", F.col("label") != F.col("pivot_label")).drop("pivot_label").join(sets.select("node", "size"), "node")
    cells = found.groupBy("cell").agg(F.sum("size").alias("total"), F.min("label").alias("low"), F.max("label").alias("high"), F.max("outer").alias("any"))
    return found.join(cells.where("any and low < high").select("cell", "total"), "cell")


def _in_blocks(cells: DataFrame, cell_values: int) -> DataFrame:
    """Members of large cells, dealt in pairs of blocks of half a cell each."""
    blocks = F.ceil(F.col("total") / max(1, cell_values // 2)).cast("int")
    dealt = cells.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("block") == F.col("other"), -1).when(F.col("block") < F.col("other"), 0).otherwise(1)
    return dealt.select("cell", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "node", "label", "outer", side.alias("side"))


def _place(column: str = "doc_id"):
    return F.pmod(F.col(column), F.lit(ID_BITS))


def _bit(column: str = "doc_id"):
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(_place(column), F.lit(64)).cast("int"))


def _bits(ids: DataFrame) -> DataFrame:
    """``word, bits``: a table of ``ID_BITS`` bits in which the place of every id is set.

    It has 64 bits to a row, however many ids there are, so it can be broadcast;
    beyond that many ids it merely tells less.
    """
    return ids.select(F.shiftright(_place(), 6).alias("word"), _bit().alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))


def _thinned(docs: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """``docs`` without most rows whose id is not among ``ids``: those whose place in the table of bits is empty."""
    found = docs.withColumn("word", F.shiftright(_place(column), 6)).join(F.broadcast(_bits(ids)), "word")
    return found.where(F.col("bits").bitwiseAND(_bit(column)) != 0).select(*docs.columns)


def _untouched(docs: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The rows with an id that ``_thinned`` leaves out; none of ``ids`` is among them."""
    found = docs.where(F.col(column).isNotNull()).withColumn("word", F.shiftright(_place(column), 6)).join(F.broadcast(_bits(ids)), "word", "left")
    return found.where(F.coalesce("bits", F.lit(0).cast("bigint")).bitwiseAND(_bit(column)) == 0).select(*docs.columns)


def _read_sets(docs: DataFrame, wanted: DataFrame, prints: DataFrame, n: int) -> DataFrame:
    """``wanted(node, doc, ...)`` with ``shingles, size`` of each class, read again from the row of its smallest id, or from the rows without one."""
    schema = "node binary, shingles binary, chosen binary, is_pivot boolean"
    named = wanted.withColumnRenamed("doc", "doc_id").where("doc_id is not null")
    # rows that share their id may be alike
    many = cut_lineage(prints.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("doc_id"))
    found = []
    for how in ("left_anti", "left_semi"):
        asked = cut_lineage(named.join(many, "doc_id", how))
        met = _thinned(docs, asked).join(asked, "doc_id").select("text", "node", "chosen", "is_pivot")
        found.append(met.mapInArrow(_sets(n), schema))
    nameless = docs.where("doc_id is null").select("text", F.lit(None).cast("binary").alias("node")).mapInArrow(_sets(n), "node binary, shingles binary")
    nameless = nameless.dropDuplicates(["node"]).join(wanted.where("doc is null").drop("doc"), "node")
    alone, shared = found
    every = alone.unionByName(shared.dropDuplicates(["node"])).unionByName(nameless)
    return every.withColumn("size", (F.octet_length("shingles") / 8).cast("bigint"))


def similar_components(
    docs: DataFrame, n: int = 3, percent: int = 90, id_column: str = "doc_id", text_column: str = "text", cell_values: int = CELL_VALUES, levels: int = LEVELS, copies: int = COPIES
) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, node (class), label (of its component), component_id``.

    Classes link at a Jaccard similarity of ``percent`` hundredths or more
    (50 to 100). Ids must be integers. The last three arguments bound the work
    of a task; rows are the same for all values.
    """
    docs = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    prints = cut_lineage(docs.mapInArrow(_sampled(n, percent), "doc_id bigint, n_shingles bigint, node binary, sample array<bigint>, need bigint"))
    rows = prints.where("node is not null")
    # of equal sets one sample counts
    firsts = [F.any_value(F.col(c)).alias(name) for c, name in (("need", "need"), ("sample", "values"))]
    items = cut_lineage(rows.groupBy("node").agg(F.min("doc_id").alias("doc"), *firsts).withColumn("cell", F.lit(b"")))
    classes = items.select("node", "doc")
    members = cut_lineage(regions(items).select(F.col("pivot").alias("cell"), "pivot", "node"))

    # a class is first compared with its smallest pivot, whose name goes with its set
    chosen = members.groupBy("node").agg(F.min("pivot").alias("chosen"))
    pivots = members.select(F.col("pivot").alias("node")).distinct().withColumn("is_pivot", F.lit(True))
    wanted = chosen.join(pivots, "node", "full_outer").withColumn("is_pivot", F.coalesce("is_pivot", F.lit(False))).join(classes, "node")
    wanted = cut_lineage(wanted)
    sets = cut_lineage(_read_sets(docs, wanted, prints, n))
    chosen, pivots = wanted.select("node", "chosen"), sets.where("is_pivot")

    labels, join = None, _join_cell(percent)

    def connect(*links: DataFrame) -> DataFrame:
        known = [] if labels is None else [labels.select(F.col("node").alias("a"), F.col("label").alias("b"))]
        return cut_lineage(connected(reduce(DataFrame.union, [*known, *links])))

    for level in range(levels + 1):
        # one pivot per class connects most of a family; a set is sent again only for pairs still apart
        pairs = members.select("pivot", "node").distinct()
        if labels is None:
            labels = connect(_close(sets.where("chosen is not null").select(F.col("chosen").alias("pivot"), "node", "size", "shingles"), pivots, percent))
            pairs = pairs.join(chosen, (pairs["node"] == chosen["node"]) & (pairs["pivot"] == chosen["chosen"]), "left_anti")
        apart = _fitting(_labelled(pairs, labels).where("label != pivot_label").select("pivot", "node"), sets, percent)
        labels = connect(_close(apart.join(sets.select("node", "size", "shingles"), "node"), pivots, percent))
        cells = cut_lineage(_open_cells(members, labels, sets))
        small = cells.where(F.col("total") <= cell_values).select("cell", "node", "label", "outer", F.lit(-1).alias("side"))
        found = [small.join(sets.select("node", "shingles"), "node").groupBy("cell").applyInArrow(join, "a binary, b binary")]
        large = cells.where(F.col("total") > cell_values)
        rest = large.limit(1).count() > 0
        blocks = large
        if rest and level < levels:
            # the pivot is a member like others, at distance 0 from itself
            whole = large.select("cell", "pivot", "node").unionByName(large.select("cell", "pivot", F.col("pivot").alias("node")).distinct())
            items, near = _split(whole, sets, pivots, percent)
            found.append(near)
            inner = cut_lineage(regions(items))
            much = inner.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).join(large.groupBy("cell").agg(F.count(F.lit(1)).alias("had")), "cell")
            much = much.where(F.col("n") > copies * F.col("had")).select("cell")
            blocks = large.join(much, "cell", "left_semi")
            members = cut_lineage(inner.join(much, "cell", "left_anti").select(F.concat("cell", "pivot").alias("cell"), "pivot", "node"))
            pivots = sets.join(members.select(F.col("pivot").alias("node")).distinct(), "node", "left_semi")
        if rest:
            met = _in_blocks(blocks, cell_values).join(sets.select("node", "shingles"), "node")
            found.append(met.groupBy("cell", "low", "high").applyInArrow(join, "a binary, b binary"))
        labels = connect(*found)
        if not rest:
            break
    labelled = prints.select("doc_id", "n_shingles", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = labelled.where("node is not null").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    return labelled.join(smallest, "label", "left").select("doc_id", "n_shingles", "node", "label", component)


def report(docs: DataFrame) -> DataFrame:
    """The registered query."""
    return similar_components(docs).select("doc_id", "n_shingles", "component_id")


def _nodes(n: int, text: int):
    """The class of each row's text, behind the row's columns; null without words."""

    def step(batches):
        for batch in batches:
            found = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in shingle_sets(W.as_bytes(batch.column(text)), n)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=[*batch.schema.names, "node"])

    return step


def keep_first(docs: DataFrame, n: int = 5, percent: int = 80, **options) -> DataFrame:
    """Documents with one row of each component, that with the smallest id.

    Of different texts with that id the one with the smallest class stays, of
    equal ones any; a component without ids keeps its smallest class. Rows whose
    texts have no words all stay. Other columns may have any names.
    """
    names = docs.columns
    id_place, text_place = names.index("doc_id"), names.index("text")
    rows = docs.toDF(*(f"c{i}" for i in range(len(names))))
    id_column = F.col(f"c{id_place}").cast("bigint")
    found = cut_lineage(similar_components(rows, n, percent, f"c{id_place}", f"c{text_place}", **options).select("doc_id", "node", "label"))
    heads = found.where("node is not null").groupBy("label").agg(F.min(F.struct(F.isnull("doc_id"), "doc_id", "node")).alias("x")).select("x.doc_id", "x.node")
    # an id names its row, unless several rows have it: those are told apart by their class
    many = cut_lineage(found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 and doc_id is not null").select("doc_id"))
    # texts move only where their row may go: most ids are neither dropped nor given twice
    dropped = found.where("node is not null").select("doc_id").join(heads, "doc_id", "left_anti").where("doc_id is not null")
    asked = cut_lineage(dropped.union(many).distinct())
    keyed = rows.withColumn("key", id_column)
    doubtful = _thinned(keyed, asked, "key").join(asked, F.col("key") == asked["doc_id"], "left_anti")
    single = _untouched(keyed, asked, "key").unionByName(doubtful).drop("key")
    several = _thinned(keyed, many, "key").join(many, F.col("key") == many["doc_id"], "left_semi").unionByName(keyed.where("key is null")).drop("key")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    several = cut_lineage(several.mapInArrow(_nodes(n, text_place), f"{fields}, node binary"))
    first = several.join(heads.withColumnRenamed("node", "head"), id_column.eqNullSafe(F.col("doc_id")) & (F.col("node") == F.col("head")), "left_semi")
    first = first.dropDuplicates([f"c{id_place}", "node"])
    return single.unionByName(first.unionByName(several.where("node is null")).drop("node")).toDF(*names)


def brute_force(rows: list[tuple[int | None, str | None]], n: int = 3, percent: int = 90) -> list[tuple]:
    """(doc_id, n_shingles, component_id) by comparing all pairs, for tests."""
    sets = []
    for _, text in rows:
        ws = (text or "").encode().translate(W.LOWER).split()
        sets.append({tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} or ({tuple(ws)} if ws else set()))
    parent = list(range(len(rows)))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    holders: dict[tuple, list[int]] = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        shared: dict[int, int] = {}
        for x in s:
            for j in holders[x]:
                if j > i:
                    shared[j] = shared.get(j, 0) + 1
        for j, k in shared.items():
            if 100 * k >= percent * (len(s) + len(sets[j]) - k):
                parent[root(i)] = root(j)
    ids: dict[int, int] = {}
    for i, (name, _) in enumerate(rows):
        if name is not None:
            ids[root(i)] = min(ids.get(root(i), name), name)
    return [(name, len(sets[i]), ids.get(root(i))) for i, (name, _) in enumerate(rows)]
