"""Benchmark decontamination by suffix arrays of the training text.

Each task takes whole documents in shards of about a megabyte, sorts the word
suffixes of a shard into a suffix array, and binary-searches every suffix of
every benchmark item in it, a word at a time. That gives all places of the
windows that decide. The longest verbatim match of a document is found the
other way round: every place of the text is followed through the sorted
suffixes of the items, so it depends on that document only.

Only suffixes that can reach a window are sorted: a word that no item holds
ends every match, so stretches of known words shorter than the shortest window
are left out. The shard stays small and the result whole.

The benchmark is the stated query set. It is read in blocks of at most
``block_words`` words; each block is broadcast and costs one more pass in the
same job, so neither the driver nor a task ever holds more than one block of
it per pass.

Defined cases: null text or id is allowed (no words; the row is kept); an item
without words matches nothing; items with equal texts each count; repeated rows
each get their own result; further columns of either table are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bourseflow.llm import words as W
from bourseflow.llm.names import keeping_columns

SHARD_BYTES = 1 << 20
BLOCK_WORDS = 2_000_000
#: Words of an item's runs that are kept as tables; longer matches are searched in its sorted suffixes.
LEVELS = 4


class Queries:
    """Word ids of a block of items, with the length each suffix must match."""

    def __init__(self, items: list[tuple[object, bytes]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.names: list[str] = []
        self.item_of, self.starts, self.needs, flat = [], [], [], []
        for name, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in text.translate(W.LOWER_ALNUM).split()]
            if not ids:
                continue
            need = min(window, len(ids))
            item, at = len(self.names), len(flat)
            self.names.append(str(name))
            flat += [*ids, 0]  # 0 ends every item
            for i in range(len(ids)):
                self.item_of.append(item)
                self.starts.append(at + i)
                self.needs.append(need if i + need <= len(ids) else 0)  # 0: too short to decide, length only
        self.flat = np.array(flat + [0], dtype=np.int64)
        self.item_of, self.starts, self.needs = (np.array(x, dtype=np.int64) for x in (self.item_of, self.starts, self.needs))
        self.shortest = int(self.needs[self.needs > 0].min()) if len(self.names) else 0
        self.sorted = self.starts
        self.levels: list[np.ndarray] = []
        self.first = np.zeros(1, dtype=np.int64)
        if len(self.names):
            self._sort()

    def _sort(self) -> None:
        """Item suffixes in order, the distinct runs of 2 to ``LEVELS`` words (run before, next word), and where the longest begin."""
        self.sorted = suffix_array(self.flat, self.starts, int(np.bincount(self.item_of).max()))
        self.base = len(self.vocabulary) + 1
        rank = self.flat[self.sorted]
        for depth in range(1, LEVELS):
            word = self.flat[np.minimum(self.sorted + depth, len(self.flat) - 1)]
            # 0 ends an item: such a run goes on nowhere, and no text has the word 0
            found, self.first, rank = np.unique(rank * self.base + word, return_index=True, return_inverse=True)
            self.levels.append(found)
            if depth == LEVELS - 1:
                self.first = np.append(self.first, len(self.sorted))

    def longest(self, ids: np.ndarray) -> np.ndarray:
        """Words that match some item from each place on; ``ids`` has 0 where no item's word is, and at its end."""
        size = (ids > 0).astype(np.int64)
        alive = np.flatnonzero(size)
        rank = ids[alive]
        for depth, found in enumerate(self.levels, start=1):
            word = ids[alive + depth]  # a 0 ends every text, and a run that reached it is no longer alive
            key = rank * self.base + word
            at = np.minimum(np.searchsorted(found, key), len(found) - 1)
            keep = (word > 0) & (found[at] == key)
            alive, rank = alive[keep], at[keep]
            size[alive] = depth + 1
        lo, hi = self.first[rank], self.first[rank + 1]
        depth = LEVELS
        while len(alive):
            word = ids[alive + depth]
            ends = []
            for side in (0, 1):
                a, b = lo.copy(), hi.copy()
                while (open_ := a < b).any():
                    mid = (a + b) // 2
                    there = self.flat[np.minimum(self.sorted[np.minimum(mid, len(self.sorted) - 1)] + depth, len(self.flat) - 1)]
                    right = (there < word) if side == 0 else (there <= word)
                    a = np.where(open_ & right, mid + 1, a)
                    b = np.where(open_ & ~right, mid, b)
                ends.append(a)
            keep = (ends[0] < ends[1]) & (word > 0)
            alive, lo, hi = alive[keep], ends[0][keep], ends[1][keep]
            depth += 1
            size[alive] = depth
        return size


def suffix_array(ids: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes that start at ``at``, sorted by their first ``depth`` words or more (prefix doubling)."""
    n = len(ids)
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64) + 1
    done = 1
    while done < depth:
        behind = np.zeros(n, dtype=np.int64)
        behind[: n - done] = rank[done:] if done < n else 0
        key = rank * (n + 2) + behind
        found, rank = np.unique(key, return_inverse=True)
        rank = rank.astype(np.int64) + 1
        if len(found) == n:
            break
        done *= 2
    return at[np.argsort(rank[at], kind="stable")]


def search(ids: np.ndarray, sa: np.ndarray, q: Queries) -> tuple[np.ndarray, np.ndarray]:
    """For each item suffix: the range of the suffix array that matches its needed words."""
    m = len(q.starts)
    lo, hi = np.zeros(m, dtype=np.int64), np.full(m, len(sa), dtype=np.int64)
    low_at, high_at = np.zeros(m, dtype=np.int64), np.zeros(m, dtype=np.int64)
    alive = np.flatnonzero(q.needs)
    depth = 0
    while len(alive) and len(sa):
        word = q.flat[q.starts[alive] + depth]
        ends = []
        for side in (0, 1):  # first suffix whose word at this depth is >= word, and > word
            a, b = lo[alive].copy(), hi[alive].copy()
            while True:
                open_ = a < b
                if not open_.any():
                    break
                mid = (a + b) // 2
                there = ids[np.minimum(sa[np.minimum(mid, len(sa) - 1)] + depth, len(ids) - 1)]  # clamped where nothing is open
                right = (there < word) if side == 0 else (there <= word)
                a = np.where(open_ & right, mid + 1, a)
                b = np.where(open_ & ~right, mid, b)
            ends.append(a)
        keep = (ends[0] < ends[1]) & (word > 0)
        alive = alive[keep]
        lo[alive], hi[alive] = ends[0][keep], ends[1][keep]
        depth += 1
        here = alive[q.needs[alive] == depth]
        low_at[here], high_at[here] = lo[here], hi[here]
        alive = alive[q.needs[alive] > depth]
    return low_at, high_at


def _scan(texts: list[bytes], q: Queries) -> Iterator[tuple[int, list[tuple[int, int]], list[str], int, int]]:
    """Per text: number of words, merged hit spans, names of items with a window in it, longest match and where it starts."""
    get = q.vocabulary.get
    split = [t.translate(W.LOWER_ALNUM).split() for t in texts]
    counts = np.array([len(x) for x in split], dtype=np.int64)
    offsets = np.concatenate(([0], np.cumsum(counts + 1)))  # one 0 after each text
    ids = np.zeros(int(offsets[-1]) + 1, dtype=np.int64)
    for i, words in enumerate(split):
        ids[offsets[i] : offsets[i] + len(words)] = np.fromiter((get(w, 0) for w in words), dtype=np.int64, count=len(words))
    hit = np.zeros(len(ids) + 1, dtype=np.int64)
    found: dict[int, set[int]] = {}
    best, best_at = np.zeros(len(texts), dtype=np.int64), np.full(len(texts), -1, dtype=np.int64)
    if q.shortest:
        matched = q.longest(ids)
        for i in np.flatnonzero(np.maximum.reduceat(matched, offsets[:-1])) if len(texts) else ():
            mine = matched[offsets[i] : offsets[i + 1]]
            best_at[i] = mine.argmax()  # the first of equals
            best[i] = mine[best_at[i]]
        known = np.concatenate(([0], (ids > 0).astype(np.int8), [0]))
        step = np.diff(known)
        begins, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        long = ends - begins >= q.shortest
        begins, ends = begins[long], ends[long]
        if len(begins):
            sizes = ends - begins
            at_packed = np.concatenate(([0], np.cumsum(sizes + 1)))
            back = np.concatenate([np.append(np.arange(a, b), b) for a, b in zip(begins, ends)])
            packed = np.append(ids[back], 0)
            packed[at_packed[1:] - 1] = 0
            # positions from which at least the shortest window follows
            offset = np.arange(len(back)) - np.repeat(at_packed[:-1], sizes + 1)
            left = np.repeat(sizes, sizes + 1) - offset
            at = np.flatnonzero(left >= q.shortest)
            sa = suffix_array(packed, at, int(q.needs.max()))
            lo, hi = search(packed, sa, q)
            text_of = np.searchsorted(offsets, back, side="right") - 1
            for j in np.flatnonzero(hi > lo):
                where = sa[lo[j] : hi[j]]
                np.add.at(hit, back[where], 1)
                np.add.at(hit, back[where] + q.needs[j], -1)
                for t in np.unique(text_of[where]):
                    found.setdefault(int(t), set()).add(int(q.item_of[j]))
    inside = np.concatenate(([0], (np.cumsum(hit)[:-1] > 0).astype(np.int8), [0]))
    step = np.diff(inside)
    span_a, span_b = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    first = np.searchsorted(span_a, offsets)
    for i in range(len(texts)):
        spans = [(int(a - offsets[i]), int(b - offsets[i])) for a, b in zip(span_a[first[i] : first[i + 1]], span_b[first[i] : first[i + 1]])]
        yield int(counts[i]), spans, [q.names[k] for k in found.get(i, ())], int(best[i]), int(best_at[i])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_FOUND = "_spans array<struct<start:bigint,end:bigint>>, _items array<string>, _n_words bigint, _longest bigint, _longest_at bigint"


def _blocks(items: DataFrame, id_column: str, text_column: str, block_words: int) -> Iterator[list[tuple[object, bytes]]]:
    """Items in blocks of at most ``block_words`` words (a longer item alone); at least one, maybe empty, block."""
    block, size, any_ = [], 0, False
    for row in items.select(F.col(id_column).cast("string").alias("i"), F.col(text_column).alias("t")).toLocalIterator():
        text = (row["t"] or "").encode()
        n = len(text) // 2 + 1  # a word and its gap take two bytes at least
        if block and size + n > block_words:
            any_ = True
            yield block
            block, size = [], 0
        block.append((row["i"], text))
        size += n
    if block or not any_:
        yield block


def find_matches(
    docs: DataFrame,
    items: DataFrame,
    window: int = 13,
    text_column: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_words: int = BLOCK_WORDS,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """``docs`` with the matches of each row, in the rows' own partitions (no shuffle).

    Adds ``_n_words``, ``_spans`` (merged word spans inside a window), ``_items``
    (ids as text of items with such a window), ``_longest`` and ``_longest_at``
    (words of the longest verbatim match with any item, and the first place where
    one starts; 0 and -1 without one).
    """
    session = docs.sparkSession
    out, have = docs, False
    for block in _blocks(items, item_id, item_text, block_words):
        shared = session.sparkContext.broadcast(Queries(block, window))
        names = [n for n in docs.columns]
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", " + _FOUND

        def step(batches, shared=shared, have=have, names=names):
            for batch in batches:
                texts = W.as_bytes(batch.column(names.index(text_column)))
                rows = []
                for a, b in W.chunks(texts, shard_bytes):
                    rows += _scan(texts[a:b], shared.value)
                spans, found = [r[1] for r in rows], [r[2] for r in rows]
                longest, place = [r[3] for r in rows], [r[4] for r in rows]
                if have:
                    old = {c: batch.column(len(names) + k).to_pylist() for k, c in enumerate(("spans", "items", "n", "longest", "at"))}
                    spans = [merged([*a, *((s["start"], s["end"]) for s in b)]) for a, b in zip(spans, old["spans"])]
                    found = [[*a, *b] for a, b in zip(found, old["items"])]
                    place = [p if l > o or (l == o and p < q) else q for p, l, o, q in zip(place, longest, old["longest"], old["at"])]
                    longest = [max(a, b) for a, b in zip(longest, old["longest"])]
                new = [
                    pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], type=_SPANS),
                    pa.array(found, type=pa.list_(pa.string())),
                    pa.array([r[0] for r in rows], type=pa.int64()),
                    pa.array(longest, type=pa.int64()),
                    pa.array(place, type=pa.int64()),
                ]
                fields = [*names, "_spans", "_items", "_n_words", "_longest", "_longest_at"]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *new], names=fields)

        out, have = out.mapInArrow(step, schema), True
    return out


def hit_words() -> Column:
    """Words inside any window, from ``_spans``."""
    return F.aggregate("_spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])


def contaminated(share_of: int = 20) -> Column:
    """A window is there, and at least one word in ``share_of`` is inside windows."""
    return (hit_words() > 0) & (hit_words() * share_of >= F.col("_n_words"))


def remove_contaminated(docs: DataFrame, items: DataFrame, share_of: int = 20, **options) -> DataFrame:
    """Documents that are not contaminated, with their own columns, whatever their names."""
    text = options.get("text_column", "text")
    return keeping_columns(docs, ["doc_id", text], lambda d: find_matches(d, items, **options).where(~contaminated(share_of)).select(*d.columns))


def report(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """One row per document: the registered query."""
    narrow = docs.select("doc_id", "text")
    found = find_matches(narrow, items, **options).drop("text")
    joined = F.array_join(F.array_sort("_items"), ",")
    return found.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        hit_words().alias("n_hit"),
        F.size("_items").cast("bigint").alias("n_items"),
        F.sha2(joined.cast("binary"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
        F.col("_longest").alias("longest_match"),
    )


def brute_force(texts: list[str | None], items: list[tuple[object, str | None]], window: int = 13) -> list[tuple]:
    """The same report by sets of windows, for tests: (n_words, n_hit, n_items, items_sha256, contaminated)."""
    low = lambda t: (t or "").encode().translate(W.LOWER_ALNUM).split()
    out = []
    for text in texts:
        ws = low(text)
        hit, names = set(), set()
        for k, (name, item) in enumerate(items):
            its = low(item)
            n = min(window, len(its))
            if not n:
                continue
            wanted = {tuple(its[i : i + n]) for i in range(len(its) - n + 1)}
            for i in range(len(ws) - n + 1):
                if tuple(ws[i : i + n]) in wanted:
                    hit.update(range(i, i + n))
                    names.add((k, str(name)))
        listed = ",".join(sorted(n for _, n in names))
        out.append((len(ws), len(hit), len(names), hashlib.sha256(listed.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(ws)))
    return out
