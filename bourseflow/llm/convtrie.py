"""Prefix trie of conversations: balanced parentheses per shard, shared spines merged.

A node is a distinct sequence of first turns. Spark prepares narrow rows (a
128-bit digest of role and text and the number of words per turn), and numbers
turns by range partitioning, so one very long conversation is no single task. A
turn that no other conversation has at the same place ends what can be shared;
only the turns before it and that one turn enter the trie, the tail behind it
has one member per node and is written directly. Equal conversations become one
row, so the rows of the trie are distinct and sort into ranges without hot keys.

A shard is a stretch of conversations in the order of their digests, so every
subtree is a stretch of it:

* the trie of the shard is a sequence of parentheses in preorder, an opening one
  per node, built from the common prefixes of neighbours;
* the excess of opening over closing ones is kept with its minimum and maximum
  per block and per power of two of blocks. ``find_close`` looks for the first
  later place whose excess is one lower, up and down these ranges, for all nodes
  at once; it delimits the subtrees;
* the rank of ``()`` pairs counts leaves; sums along the preorder give members
  and saved words of a subtree as a difference of two entries.

Nodes on the first and the last path of a shard (its spine) may go on in the
neighbouring shards; all others are whole. The spine, with what hangs below it
already added up, is a trie again: spines of ``FAN`` neighbouring partitions are
merged the same way, and so on until one is left. A task holds a bounded number
of nodes, plus the digests of the longest shared path.

Ids of the conversations that end at a node are hashed in ascending order by a
task that streams them, whatever their number.

Defined cases: null role or text is empty; turns go by number, null first, and
equal numbers by the digest of role and text; repeated rows are turns of their
own; rows without conversation id belong to no conversation and are left out; a
negative id's head is ``id - id % 20`` with the remainder as in SQL; a conversation
whose turns are all replaced by an absent head has no turn and ends at the root;
without conversations there is no root; further columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bourseflow.session import cut_lineage

#: Conversations of one group share their head: at most so many turns of its first member.
GROUP, HEAD = 20, 4
#: Turns (with the roots) that make a shard; neighbouring partitions whose spines are merged by one task.
SHARD_TURNS, FAN = 200_000, 32
#: Places of a block of the excess.
BLOCK = 64
#: Bytes of a turn's digest.
_WIDTH = 16
_NONE = np.iinfo(np.int64).max
_EMPTY = hashlib.sha256(b"").hexdigest()


# --- balanced parentheses ---------------------------------------------------------------------------


class Excess:
    """Excess of a balanced sequence with minima and maxima of blocks and of pairs, fours, ... of blocks."""

    def __init__(self, opens: np.ndarray, block: int = BLOCK):
        n_blocks = max(1, -(-len(opens) // block))
        values = np.full(n_blocks * block, _NONE)
        values[: len(opens)] = np.cumsum(np.where(opens, 1, -1))
        self.values, self.block = values, block
        self.leaves = 1 << (n_blocks - 1).bit_length()
        # a heap: the range of node k is those of nodes 2k and 2k + 1, the last half are blocks
        self.low, self.high = np.full(2 * self.leaves, _NONE), np.full(2 * self.leaves, -_NONE)
        blocks = slice(self.leaves, self.leaves + n_blocks)
        self.low[blocks] = values.reshape(-1, block).min(axis=1)
        self.high[blocks] = np.where(values == _NONE, -_NONE, values).reshape(-1, block).max(axis=1)
        size = self.leaves // 2
        while size:
            self.low[size : 2 * size] = np.minimum(self.low[2 * size : 4 * size : 2], self.low[2 * size + 1 : 4 * size : 2])
            self.high[size : 2 * size] = np.maximum(self.high[2 * size : 4 * size : 2], self.high[2 * size + 1 : 4 * size : 2])
            size //= 2

    def _scan(self, rows: np.ndarray, at: np.ndarray, wanted: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Look from ``at`` to the end of its block; the rows that have no answer there."""
        left = []
        while len(rows):
            hit = self.values[at] == wanted[rows]
            found[rows[hit]] = at[hit]
            at = at + 1
            over = ~hit & (at % self.block == 0)
            left.append(rows[over])
            go = ~hit & ~over
            rows, at = rows[go], at[go]
        return np.concatenate(left) if left else rows

    def _holds(self, node: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        return (self.low[node] <= wanted) & (wanted <= self.high[node])

    def find_close(self, places: np.ndarray) -> np.ndarray:
        """The closing parenthesis of each opening one: the first later place whose excess is one lower."""
        wanted, found = self.values[places] - 1, np.full(len(places), -1)
        at = places + 1
        border = at % self.block == 0
        rows = np.concatenate((self._scan(np.flatnonzero(~border), at[~border], wanted, found), np.flatnonzero(border)))
        # up, to the first range on the right that holds the excess
        node = self.leaves + places[rows] // self.block
        climbing = np.ones(len(rows), dtype=bool)
        while climbing.any():
            even = climbing & (node % 2 == 0)
            even[even] = self._holds(node[even] + 1, wanted[rows[even]])
            node[even] += 1
            climbing &= ~even
            node[climbing] //= 2
        # down, to the first block of that range that holds it
        while (inner := node < self.leaves).any():
            left = node[inner] * 2
            node[inner] = left + ~self._holds(left, wanted[rows[inner]])
        self._scan(rows, (node - self.leaves) * self.block, wanted, found)
        return found


# --- one shard --------------------------------------------------------------------------------------

#: What a spine node carries of the nodes below it that are whole.
_SUMS = ("convs", "leaves", "saved", "children")


class Trie:
    """Trie of distinct paths in ascending order.

    ``path`` holds the digests of a path one after the other. ``sums`` and
    ``least`` belong to the nodes of each path, root first: members, leaves,
    saved words and children already counted below the node, the smallest
    member; ``ends`` is the digest of the ids that end at the node, or null.
    """

    def __init__(self, paths: list[bytes], words: np.ndarray, sums: dict[str, np.ndarray], least: np.ndarray, ends: np.ndarray):
        n = len(paths)
        size = np.array([len(p) // _WIDTH for p in paths], dtype=np.int64)
        flat = np.frombuffer(b"".join(paths), dtype=np.dtype((np.void, _WIDTH)))
        first = np.concatenate(([0], np.cumsum(size)))
        shared = self._shared(flat, first, size)
        opened = size - shared  # new nodes of each path, the root apart
        opened[:1] += 1
        starts = np.concatenate(([0], np.cumsum(opened)))
        m = int(starts[-1])
        self.paths, self.m, self.size = paths, m, size
        path_of = self.path_of = np.repeat(np.arange(n), opened)
        base = np.where(np.arange(n) == 0, 0, shared + 1)
        self.depth = np.arange(m) - starts[path_of] + base[path_of]
        # parentheses: a path first closes what the one before it does not share, then opens its own
        closed = np.concatenate((size[:-1] - shared[1:], [size[-1] + 1])) if n else np.zeros(0, dtype=np.int64)
        before = np.concatenate(([0], np.cumsum(closed)))[:-1]  # closings before path i opens
        place = np.arange(m) + before[path_of]
        bits = np.zeros(2 * m, dtype=bool)
        bits[place] = True
        rank = np.cumsum(bits)
        self.stop = rank[Excess(bits).find_close(place)]  # preorder number behind the subtree
        leaf = ~bits[place + 1]
        self._key = np.sort(self.depth * m + np.arange(m))
        self.parent = self._at(np.maximum(self.depth - 1, 0), np.arange(m))  # the root's is itself
        nodes_per = size + 1
        row = np.repeat(np.arange(n), nodes_per)
        level = np.arange(len(row)) - np.repeat(np.concatenate(([0], np.cumsum(nodes_per)))[:-1], nodes_per)
        node = self._at(level, starts[row + 1] - 1)
        self.last_path = node[len(node) - int(nodes_per[-1]) :]
        self.words = np.zeros(m, dtype=np.int64)
        self.words[node] = words
        self.own = {k: self._added(node, sums[k]) for k in _SUMS}
        self.least = np.full(m, _NONE)
        np.minimum.at(self.least, node, least)
        self.ends = np.full(m, None, dtype=object)
        given = np.array([e is not None for e in ends], dtype=bool)
        self.ends[node[given]] = ends[given]
        self.own_least = self.least.copy()
        order = np.argsort(-self.depth, kind="stable")
        cuts = np.flatnonzero(np.diff(self.depth[order])) + 1
        for same in np.split(order, cuts):
            if len(same) and self.depth[same[0]] > 0:
                np.minimum.at(self.least, self.parent[same], self.least[same])
        self.children = np.bincount(self.parent[1:], minlength=m) if m else np.zeros(0, dtype=np.int64)
        self.convs = self._below(self.own["convs"])
        # a "()" pair is a leaf, unless children of it are counted already
        self.leaves = self._below(self.own["leaves"] + (leaf & (self.own["children"] == 0)))

    def _added(self, node: np.ndarray, values: np.ndarray) -> np.ndarray:
        out = np.zeros(self.m, dtype=np.int64)
        np.add.at(out, node, values)
        return out

    def _at(self, depth: np.ndarray, before: np.ndarray) -> np.ndarray:
        """The last node of each depth that is not behind a place in preorder: the ancestor there."""
        return self._key[np.searchsorted(self._key, depth * self.m + before, side="right") - 1] - depth * self.m

    def _below(self, values: np.ndarray) -> np.ndarray:
        """Sums over subtrees, from sums along the preorder."""
        total = np.concatenate(([0], np.cumsum(values)))
        return total[self.stop] - total[np.arange(self.m)]

    @staticmethod
    def _shared(flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Turns that each path shares with the one before it."""
        out = np.zeros(len(size), dtype=np.int64)
        if len(size) < 2:
            return out
        both = np.minimum(size[1:], size[:-1])
        row = np.repeat(np.arange(len(both)), both)
        step = np.arange(len(row)) - np.repeat(np.concatenate(([0], np.cumsum(both)))[:-1], both)
        same = flat[first[row + 1] + step] == flat[first[row] + step]
        stop = both.copy()
        np.minimum.at(stop, row[~same], step[~same])
        out[1:] = stop
        return out

    def key(self, node: int) -> bytes:
        """Digest of the node's path, under which children of spine nodes find them."""
        return hashlib.blake2b(self.paths[self.path_of[node]][: int(self.depth[node]) * _WIDTH], digest_size=16).digest()


def _columns(rows: pa.Table) -> tuple:
    """Paths and the flat arrays of their nodes."""
    flat = lambda name: rows.column(name).combine_chunks().flatten()
    sums = {k: flat(k).to_numpy() for k in _SUMS}
    least = flat("least").fill_null(_NONE).to_numpy()
    ends = np.array(flat("ends").to_pylist(), dtype=object)
    return rows.column("path").to_pylist(), flat("words").to_numpy().astype(np.int64), sums, least, ends


_NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
_KEYS = "key binary, parent_key binary"
_LISTS = ("words", *_SUMS, "least")
_SPINE = "shard bigint, path binary, " + ", ".join(f"{c} array<bigint>" for c in _LISTS) + ", ends array<string>"
_ROW = f"is_node boolean, {_NODE}, {_KEYS}, {_SPINE}"
_LONGS, _TEXTS = pa.list_(pa.int64()), pa.list_(pa.string())
_TYPES = {"boolean": pa.bool_(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<bigint>": _LONGS, "array<string>": _TEXTS}
_SCHEMA = pa.schema([(name, _TYPES[kind]) for name, kind in (c.split(" ") for c in _ROW.split(", "))])


def _rows(trie: Trie, shard: int, whole_trie: bool, was_spine: bool) -> pa.Table:
    """Whole nodes of a shard, and its spine as one or two paths."""
    spine = np.zeros(trie.m, dtype=bool)
    left = np.arange(int(trie.size[0]) + 1)
    if not whole_trie:
        spine[left] = spine[trie.last_path] = True
    own = trie.own
    saved = trie._below(np.where(spine, 0, (trie.convs - 1) * trie.words + own["saved"]))
    children = trie.children + own["children"]
    nodes = np.flatnonzero(~spine)
    up = trie.parent[nodes]
    inner = (trie.depth[nodes] > 0) & ~spine[up]
    open_above = (trie.depth[nodes] > 0) & spine[up]
    keys = {int(k): trie.key(k) for k in np.unique(up[open_above])}
    n = len(nodes)
    columns = {
        "is_node": pa.array(np.ones(n, dtype=bool)),
        "conv_id": pa.array(trie.least[nodes]),
        "depth": pa.array(trie.depth[nodes]),
        "parent_conv_id": pa.array(trie.least[up], mask=~inner),
        "n_convs": pa.array(trie.convs[nodes]),
        "n_children": pa.array(children[nodes]),
        "n_leaves": pa.array(trie.leaves[nodes]),
        "saved_tokens": pa.array(saved[nodes]),
        "ends_sha256": pa.array([_EMPTY if e is None else e for e in trie.ends[nodes]], pa.string()),
        "key": pa.array([trie.key(k) for k in nodes] if was_spine else [None] * n, pa.binary()),
        "parent_key": pa.array([keys[k] if o else None for k, o in zip(up.tolist(), open_above.tolist())], pa.binary()),
    }
    out = [pa.table([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in _SCHEMA], schema=_SCHEMA)]
    if not whole_trie:
        # what hangs below the spine and is whole is added to it
        tops, above = nodes[open_above], up[open_above]
        sums = {k: own[k].copy() for k in _SUMS}
        for k, values in (("convs", trie.convs), ("leaves", trie.leaves), ("saved", saved), ("children", np.ones(trie.m, dtype=np.int64))):
            np.add.at(sums[k], above, values[tops])
        least = trie.own_least.copy()
        np.minimum.at(least, above, trie.least[tops])
        paths = [(trie.paths[0], left, np.zeros(len(left), dtype=bool))]
        if len(trie.paths) > 1:
            right = trie.last_path
            paths.append((trie.paths[-1], right, np.isin(right, left)))
        for path, on, told in paths:
            lists = {"words": trie.words[on]} | {k: np.where(told, 0, sums[k][on]) for k in _SUMS} | {"least": np.where(told, _NONE, least[on])}
            row = {"is_node": False, "shard": shard, "path": path, "ends": [None if t else e for e, t in zip(trie.ends[on], told)]}
            row |= {k: v.tolist() for k, v in lists.items()}
            out.append(pa.Table.from_pylist([row], schema=_SCHEMA))
    return pa.concat_tables(out)


def _first_level(shard_turns: int):
    """Shards of a partition of sorted conversations."""

    def shard_of(rows: pa.Table, number: int) -> pa.Table:
        paths = rows.column("path").to_pylist()
        sizes = np.array([len(p) // _WIDTH for p in paths]) + 1
        last = np.cumsum(sizes) - 1  # a row's last node; what the row says belongs to it
        total = int(sizes.sum())
        tail = rows.column("tail").to_numpy().astype(np.int64)
        sums = {k: np.zeros(total, dtype=np.int64) for k in _SUMS}
        sums["convs"][last] = rows.column("n").to_numpy()
        sums["leaves"][last] = sums["children"][last] = tail
        least, ends = np.full(total, _NONE), np.full(total, None, dtype=object)
        least[last], ends[last] = rows.column("conv_id").to_numpy(), rows.column("ends").to_pylist()
        words = rows.column("words").combine_chunks().flatten().to_numpy()
        return _rows(Trie(paths, words, sums, least, ends), number, False, False)

    def step(batches):
        number = TaskContext.get().partitionId()
        held, turns = [], 0
        for batch in batches:
            size = len(batch.column(1).flatten())
            if held and turns + size > shard_turns:
                yield from shard_of(pa.Table.from_batches(held), number).to_batches()
                held, turns = [], 0
            held.append(batch)
            turns += size
        if turns:
            yield from shard_of(pa.Table.from_batches(held), number).to_batches()

    return step


def _merge(fan: int, whole_trie: bool):
    """Spines of neighbouring shards as one trie."""

    def step(table: pa.Table) -> pa.Table:
        table = table.sort_by("path")
        return _rows(Trie(*_columns(table)), table.column("shard")[0].as_py() // fan, whole_trie, True)

    return step


def trie_nodes(paths: DataFrame, shard_turns: int = SHARD_TURNS, fan: int = FAN) -> DataFrame:
    """Nodes of the distinct ``paths(path, words, n, conv_id, tail, ends)``.

    ``words`` starts with 0 for the root; ``n`` conversations with smallest id
    ``conv_id`` have this path; ``ends`` is the digest of the ids that end there,
    or null if the only one goes on by itself (``tail``).
    """
    spark = paths.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = cut_lineage(paths.select("path", "words", "n", "conv_id", "tail", "ends"))
    # stored: later levels must see the shards of one run
    level = cut_lineage(rows.repartitionByRange(n, "path").sortWithinPartitions("path").mapInArrow(_first_level(shard_turns), _ROW))
    levels = [level]
    most = level.agg(F.max("shard")).first()[0]
    while True:
        whole = most is None or most < fan
        group = F.lit(0) if whole else F.floor(F.col("shard") / fan)
        level = cut_lineage(level.where("not is_node").withColumn("_group", group).groupBy("_group").applyInArrow(_without_group(_merge(fan, whole)), _ROW))
        levels.append(level)
        if whole:
            break
        most //= fan
    found = reduce(DataFrame.unionByName, levels).where("is_node")
    names = [c.split(" ")[0] for c in _NODE.split(", ")]
    # a node below a spine node finds it when that is whole; only such nodes are joined, and keys are unique
    above = reduce(DataFrame.unionByName, levels[1:]).where("is_node").select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_above"))
    joined = found.where("parent_key is not null").join(above, "parent_key", "left").withColumn("parent_conv_id", F.col("_above"))
    return found.where("parent_key is null").select(names).unionByName(joined.select(names))


def _without_group(step):
    return lambda table: step(table.drop_columns(["_group"]))


# --- conversations ----------------------------------------------------------------------------------


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, position, digest, words`` of every turn; numbered in ranges, so a long conversation is several tasks."""
    spark = conversations.sparkSession
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        "turn",
        F.substring(F.sha2(whole, 256), 1, 2 * _WIDTH).alias("digest"),
        F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("bigint").alias("words"),
        F.monotonically_increasing_id().alias("tie"),  # of equal rows; which is first changes nothing
    )
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("turn").asc_nulls_first(), "digest", "tie"]
    placed = cut_lineage(cut_lineage(rows).repartitionByRange(n, "conv_id", *order).withColumn("range", F.spark_partition_id()))
    sizes = placed.groupBy("conv_id", "range").agg(F.count(F.lit(1)).alias("size"))
    # a range border cuts one conversation at most: these rows are no more than twice the ranges
    cut = sizes.groupBy("conv_id").agg(F.count(F.lit(1)).alias("ranges")).where("ranges > 1").select("conv_id")
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.join(F.broadcast(cut), "conv_id", "left_semi").select("conv_id", "range", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("range", "conv_id").orderBy(*order)
    placed = placed.withColumn("row", F.row_number().over(inside)).join(F.broadcast(offsets), ["conv_id", "range"], "left")
    return placed.select("conv_id", (F.col("row") - 1 + F.coalesce("offset", F.lit(0))).alias("position"), "digest", "words")


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns after each conversation took over the head of its group, and all conversations (also those left without a turn)."""
    heads = turns.where((F.col("conv_id") % GROUP == 0) & (F.col("position") < HEAD - 1))
    heads = heads.groupBy(F.col("conv_id").alias("head")).agg(F.collect_list(F.struct("position", "digest", "words")).alias("given"))
    h = (F.crc32(F.col("conv_id").cast("string")) % HEAD).alias("h")
    convs = turns.select("conv_id").distinct().select("conv_id", (F.col("conv_id") - F.col("conv_id") % GROUP).alias("head"), h)
    convs = convs.join(heads, "head", "left").withColumn("given", F.filter(F.coalesce("given", F.array()), lambda x: x["position"] < F.col("h")))
    convs = cut_lineage(convs.select("conv_id", "h", "given", F.size("given").alias("taken")))
    first = convs.select("conv_id", F.inline("given"))
    own = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").where("position >= h")
    own = own.select("conv_id", (F.col("position") - F.col("h") + F.col("taken")).alias("position"), "digest", "words")
    return cut_lineage(first.unionByName(own)), convs.select("conv_id")


def _ended(batches):
    """SHA-256 of the ids of each key, of rows sorted by key and id; a key's ids are never held together."""
    key = digest = None
    for batch in batches:
        keys, out = [], []
        for k, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if k != key:
                if key is not None:
                    keys.append(key)
                    out.append(digest.hexdigest())
                key, digest = k, hashlib.sha256(str(i).encode())
            else:
                digest.update(f",{i}".encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(out, pa.string())], names=["short", "ends"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest.hexdigest()], pa.string())], names=["short", "ends"])


def prefix_nodes(conversations: DataFrame, **options) -> DataFrame:
    """All nodes: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    turns, convs = rebuilt_turns(cut_lineage(numbered_turns(conversations)))
    sizes = turns.groupBy("conv_id").agg((F.max("position") + 1).alias("size"))
    # a turn that is alone at its place: the node there has one member, and so have all below it
    alone = turns.groupBy("position", "digest").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id")).where("n = 1")
    alone = alone.groupBy("conv_id").agg(F.min("position").alias("alone"))
    known = convs.join(sizes, "conv_id", "left").join(alone, "conv_id", "left")
    known = cut_lineage(known.select("conv_id", F.coalesce("size", F.lit(0)).alias("size"), "alone"))
    found = turns.join(known, "conv_id")
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    last = F.col("position") == F.col("size") - 1
    tails = found.where("position > alone").select(
        "conv_id",
        (F.col("position") + 1).cast("bigint").alias("depth"),
        F.col("conv_id").alias("parent_conv_id"),
        one.alias("n_convs"),
        F.when(last, none).otherwise(one).alias("n_children"),
        one.alias("n_leaves"),
        none.alias("saved_tokens"),
        F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(_EMPTY)).alias("ends_sha256"),
    )
    shared = found.where("alone is null or position <= alone").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("position", "digest", "words"))).alias("turns"))
    path = F.unhex(F.array_join(F.transform("turns", lambda x: x["digest"]), ""))
    words = F.concat(F.array(none), F.transform("turns", lambda x: x["words"]))
    listed = known.join(shared, "conv_id", "left").withColumn("turns", F.coalesce("turns", F.array()))
    listed = listed.select("conv_id", path.alias("path"), words.alias("words"), F.coalesce(F.col("alone") + 1 < F.col("size"), F.lit(False)).alias("tail"))
    listed = cut_lineage(listed.withColumn("short", F.unhex(F.sha2("path", 256))))
    ends = listed.where("not tail").select("short", "conv_id").repartition("short").sortWithinPartitions("short", "conv_id").mapInArrow(_ended, "short binary, ends string")
    distinct = listed.groupBy("short").agg(
        F.first("path").alias("path"), F.first("words").alias("words"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"), F.max("tail").alias("tail")
    )
    return trie_nodes(distinct.join(ends, "short", "left"), **options).unionByName(tails)


def report(conversations: DataFrame) -> DataFrame:
    """The registered query."""
    return prefix_nodes(conversations)


def brute_force(rows: list[tuple]) -> list[tuple]:
    """The report's rows from dictionaries of sequences; rows are (conv_id, turn, role, text). For tests."""
    own: dict[int, list] = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own.setdefault(conv, []).append((turn is not None, turn or 0, digest, role, text))
    own = {c: [x[3:] for x in sorted(turns)] for c, turns in own.items()}
    members: dict[tuple, list[int]] = {}
    ended: dict[tuple, list[int]] = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % HEAD
        head = conv - int(math.fmod(conv, GROUP))
        path = tuple(own.get(head, [])[:h] + turns[h:])
        ended.setdefault(path, []).append(conv)
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(conv)
    below = {p: [0, 0, 0] for p in members}  # children, leaves, saved words
    for path in members:
        if path:
            below[path[:-1]][0] += 1
    for path, convs in members.items():
        words = len(re.findall("[^\\x20\\x09-\\x0D]+", path[-1][1])) if path else 0
        leaf = below[path][0] == 0
        for d in range(len(path) + 1):
            below[path[:d]][1] += leaf
            below[path[:d]][2] += (len(convs) - 1) * words
    out = []
    for path, convs in members.items():
        ids = ",".join(map(str, sorted(ended.get(path, []))))
        parent = min(members[path[:-1]]) if path else None
        out.append((min(convs), len(path), parent, len(convs), *below[path], hashlib.sha256(ids.encode()).hexdigest()))
    return out
