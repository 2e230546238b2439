"""Counts of terms by day, packed: one row holds the counts of many terms, compressed.

A row per term and day is several times the size of the texts when the terms are pairs
of words. Here a task counts some millions of terms at a time and deals them by a hash
of the term into buckets; what it found for a bucket is one row (a block). All blocks of
a bucket meet in one task, so a term is complete there, and its counts of days become
sums of slots (a symbol with a label) by a matrix of weights.

Codes say what a count belongs to, and each code has a row of weights: ``day_code`` for
days, ``SLOT_CODE + slot`` for counts of one slot alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Terms that a task counts before it writes blocks; entries of a bucket that a task opens at once.
COUNTED, OPENED = 4_000_000, 4_000_000
#: Buckets, at least; sums that a task makes at once; counts that are tallied in a table.
BUCKETS, SUMS, TALLIED = 64, 4_000_000, 1024
#: Kinds of counts of a day: of the articles' terms, of pairs across two articles, of an article beside its own copy.
INNER, ACROSS, COPIED = range(3)
#: From here on, codes are slots.
SLOT_CODE = 1 << 30

BLOCKS = T.StructType().add("bucket", T.IntegerType()).add("entries", T.LongType()).add("size", T.LongType()).add("block", T.BinaryType())
_MIX = np.uint64(0x9E3779B97F4A7C15)


def day_code(day: Column, kind: int = INNER) -> Column:
    return F.unix_date(day.cast("date")) * F.lit(3) + F.lit(kind)


def _powers(n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, dtype=np.uint64), np.cumprod(np.full(n, _MIX, dtype=np.uint64))])


def _polynomials(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number of each term: that of a joined pair follows from those of its tokens (modulo 2 to the 64th)."""
    out = np.empty(len(ends) - 1, dtype=np.uint64)
    powers = _powers(int(np.diff(ends).max(initial=0)))
    step = 200_000
    for begin in range(0, len(out), step):
        some = ends[begin : begin + step + 1]
        place = np.arange(some[0], some[-1]) - np.repeat(some[:-1], np.diff(some))
        sums = np.zeros(len(place) + 1, dtype=np.uint64)
        np.cumsum((data[some[0] : some[-1]].astype(np.uint64) + np.uint64(1)) * powers[place], out=sums[1:])
        out[begin : begin + step] = sums[some[1:] - some[0]] - sums[some[:-1] - some[0]]
    return out


def _mixed(numbers: np.ndarray) -> np.ndarray:
    """Hashes, the same in every process."""
    out = numbers ^ (numbers >> np.uint64(32))
    out *= _MIX
    out ^= out >> np.uint64(29)
    return out


def _text(terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the terms, and where each ends (with a leading begin)."""
    terms = terms.cast(pa.large_binary())
    _, ends, data = terms.buffers()
    ends = np.frombuffer(ends, dtype=np.int64)[terms.offset : terms.offset + len(terms) + 1] if len(terms) else np.zeros(1, dtype=np.int64)
    return np.frombuffer(data or b"", dtype=np.uint8), ends


def _planes(numbers: np.ndarray) -> bytes:
    """All first bytes, all second bytes and so on: the upper ones are nearly all zero."""
    return np.ascontiguousarray(numbers.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _numbers(data: memoryview, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8, count=8 * n).reshape(8, n).T).reshape(-1).view("<i8")


def _packed(lengths: np.ndarray, text: bytes, sizes: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> tuple[int, bytes]:
    raw = b"".join([np.array([len(lengths), len(codes)], dtype="<i8").tobytes(), _planes(lengths), _planes(sizes), _planes(codes), _planes(counts), text])
    return len(raw), pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def _unpacked(size: int, block: bytes):
    raw = memoryview(pa.Codec("zstd").decompress(block, decompressed_size=size, asbytes=True))
    n, m = (int(x) for x in np.frombuffer(raw, dtype="<i8", count=2))
    at, arrays = 16, []
    for length in (n, n, m, m):
        arrays.append(_numbers(raw[at:], length))
        at += 8 * length
    lengths, sizes, codes, counts = arrays
    return lengths, np.frombuffer(raw, dtype=np.uint8)[at:], sizes, codes, counts


def _places(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(begins - before, sizes) + np.arange(sizes.sum())


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, dtype=np.int64)


def _numbered(keys: np.ndarray, codes: np.ndarray, low: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, how many codes each has, and the codes with their counts, in order."""
    if int(keys.max()) < (1 << 62) // span:
        both = keys * span + (codes - low)
        both.sort()
        begins = _runs(both)
        key, code = np.divmod(both[begins], span)
    else:
        order = np.lexsort((codes, keys))
        key, code = keys[order], codes[order]
        begins = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (code[1:] != code[:-1])]))
        key, code = key[begins], code[begins] - low
    counts = np.diff(np.append(begins, len(keys)))
    first = _runs(key)
    return key[first], np.diff(np.append(first, len(key))), code + low, counts


def _blocks(terms: pa.Array, left: np.ndarray | None, codes: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Counts of the terms by code, one row per bucket; the row without bucket has the sums of the codes.

    With ``left``, what is counted are pairs: the terms at these places, each joined with the next one. Pairs are
    told apart by the numbers of their tokens, so one that can be cut in two ways may be twice in a block.
    """
    encoded = terms.dictionary_encode()
    by_term = pc.sort_indices(encoded.dictionary).to_numpy()
    rank = np.empty(len(by_term) + 1, dtype=np.int64)
    rank[by_term], rank[-1] = np.arange(len(by_term)), -1  # the last one is null
    ids = rank[encoded.indices.fill_null(-1).to_numpy()]
    listed = encoded.dictionary.take(pa.array(by_term))
    second, n_terms = None if left is None else ids[left + 1], max(1, len(listed))
    ids = ids if left is None else ids[left]
    known = ids >= 0 if left is None else (ids >= 0) & (second >= 0)
    if not known.all():
        ids, codes, second = ids[known], codes[known], None if left is None else second[known]
    out = []
    if len(ids):
        low, span = int(codes.min()), int(codes.max()) - int(codes.min()) + 1
        key, sizes, code, counts = _numbered(ids if left is None else ids * n_terms + second, codes, low, span)
        data, ends = _text(listed)
        numbers, lengths = _polynomials(data, ends), np.diff(ends)
        if left is None:
            one, two, number = key, None, numbers[key]
        else:
            one, two = np.divmod(key, n_terms)
            number = numbers[one] + _powers(int(lengths.max()))[lengths[one]] * numbers[two]
        bucket = (_mixed(number) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        words = listed.take(pa.array(one[order]))
        if two is not None:
            words = pc.binary_join_element_wise(words, listed.take(pa.array(two[order])), "")
        data, ends = _text(words)
        places = _places((np.cumsum(sizes) - sizes)[order], sizes[order])
        bucket, sizes, code, counts = bucket[order], sizes[order], code[places], counts[places]
        entry_ends = np.concatenate([[0], np.cumsum(sizes)])
        cuts = np.append(_runs(bucket), len(bucket))
        for a, b in zip(cuts[:-1], cuts[1:]):
            of = slice(entry_ends[a], entry_ends[b])
            packed = _packed(np.diff(ends[a : b + 1]), data[ends[a] : ends[b]].tobytes(), sizes[a:b], code[of], counts[of])
            out.append((int(bucket[a]), int(entry_ends[b] - entry_ends[a]), *packed))
        seen, total = np.unique(codes, return_counts=True)
        out.append((None, len(seen), *_packed(np.empty(0), b"", np.empty(0), seen, total)))
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
    columns = [pa.array([row[i] for row in out], kind) for i, kind in enumerate(kinds)]
    return pa.RecordBatch.from_arrays(columns, names=["bucket", "entries", "size", "block"])


def pack(rows: DataFrame, paired: bool, beside: tuple[str, ...] = ()) -> DataFrame:
    """Blocks of the counts of ``rows``: code, terms (an array).

    ``paired``: the terms are tokens, and what is counted are pairs of neighbours, joined.
    ``beside``: columns of the rows that are handed on as well, in rows without block.
    """
    buckets = max(BUCKETS, 2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.select("code", "terms", *beside)
    kept = rows.select(*beside).schema

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, left, codes, n, kinds = [], [], [], 0, []

        def flushed():
            found = _blocks(pa.concat_arrays(held), np.concatenate(left) if paired else None, np.concatenate(codes), buckets)
            nothing = [pa.nulls(len(found), kind) for kind in kinds]
            return pa.RecordBatch.from_arrays([*found.columns, *nothing], names=[*found.schema.names, *beside])

        for batch in batches:
            kinds = [batch.schema.field(c).type for c in beside]
            some = batch.select(["code", "terms"]).filter(pc.is_valid(batch.column("code")))
            lists = some.column("terms")
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            terms, row = lists.flatten(), np.repeat(np.arange(len(some)), lengths)
            if paired:
                inside = np.flatnonzero(row[1:] == row[:-1])
                left.append(inside + n)
                row = row[inside]
            held.append(terms)
            codes.append(some.column("code").to_numpy(zero_copy_only=False).astype(np.int64)[row])
            n += len(terms)
            if beside:
                empty = [pa.nulls(len(batch), f.type) for f in to_arrow_schema(BLOCKS)]
                yield pa.RecordBatch.from_arrays([*empty, *[batch.column(c) for c in beside]], names=[*BLOCKS.names, *beside])
            if n >= COUNTED:
                yield flushed()
                held, left, codes, n = [], [], [], 0
        if n:
            yield flushed()

    return rows.mapInArrow(step, T.StructType([*BLOCKS.fields, *kept.fields]))


def code_totals(blocks: DataFrame) -> dict[int, int]:
    """How many terms each code has; a row per day."""

    def step(batches):
        for batch in batches:
            found = [_unpacked(size.as_py(), block.as_py())[3:] for size, block in zip(batch.column("size"), batch.column("block"))]
            if found:
                codes, counts = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), pa.array(counts.astype(np.int64))], names=["code", "n"])

    opened = blocks.where("bucket is null and block is not null").select("size", "block").mapInArrow(step, "code bigint, n bigint")
    return {r[0]: r[1] for r in opened.groupBy("code").agg(F.sum("n")).collect()}


@dataclass
class Weights:
    """``table``: a row of weights for each of ``codes`` (in order), a column for each slot; ``first``: the number of the first slot."""

    codes: np.ndarray
    table: np.ndarray
    first: int

    def rows(self, codes: np.ndarray) -> np.ndarray:
        """Numbers of the rows of codes; the last row, of zeros, for others."""
        place = np.minimum(np.searchsorted(self.codes, codes), max(0, len(self.codes) - 1))
        known = self.codes[place] == codes if len(self.codes) else np.zeros(len(codes), dtype=bool)
        return np.where(known, place, len(self.codes))

    @staticmethod
    def of(codes: np.ndarray, table: np.ndarray, first: int) -> Weights:
        slots = np.arange(table.shape[1])
        codes = np.concatenate([codes, SLOT_CODE + first + slots]).astype(np.int64)
        table = np.concatenate([table, np.eye(len(slots), dtype=np.int64)])
        order = np.argsort(codes)
        return Weights(codes[order], np.concatenate([table[order], np.zeros((1, len(slots)), dtype=np.int64)]), first)


@dataclass
class Opened:
    """The terms of a bucket in order, and their counts: ``begins`` of the entries of each term."""

    terms: pa.Array
    begins: np.ndarray
    rows: np.ndarray
    counts: np.ndarray

    def sums(self, chosen: np.ndarray, weights: Weights) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Some of the terms at a time, in order, with their sums: a row per slot."""
        sizes = np.diff(np.append(self.begins, len(self.rows)))[chosen]
        most = max(1, SUMS // max(1, weights.table.shape[1]))
        part = (np.cumsum(sizes) - 1) // most if len(sizes) else sizes
        cuts = np.append(_runs(part), len(part))
        for a, b in zip(cuts[:-1], cuts[1:]):
            some, places = chosen[a:b], _places(self.begins[chosen[a:b]], sizes[a:b])
            each = weights.table[self.rows[places]] * self.counts[places, None]
            found = np.add.reduceat(each, np.cumsum(sizes[a:b]) - sizes[a:b], axis=0)
            yield some, np.ascontiguousarray(found.T)


def _opened(table: pa.Table, weights: Weights) -> Iterator[Opened]:
    """The terms of a bucket, as many at once as a task holds."""
    parts = max(1, -(-int(pc.sum(table.column("entries")).as_py() or 0) // OPENED))
    blocks = list(zip(table.column("size").to_pylist(), table.column("block")))
    for part in range(parts):
        texts, lengths, sizes, codes, counts = [], [], [], [], []
        for size, block in blocks:
            length, text, n, code, count = _unpacked(size, block.as_buffer())
            if parts > 1:
                ends = np.concatenate([[0], np.cumsum(length)])
                mine = np.flatnonzero((_mixed(_polynomials(text, ends)) >> np.uint64(33)) % np.uint64(parts) == part)
                entries = _places((np.cumsum(n) - n)[mine], n[mine])
                text, length, n, code, count = text[_places(ends[mine], length[mine])], length[mine], n[mine], code[entries], count[entries]
            for held, x in zip((texts, lengths, sizes, codes, counts), (text, length, n, code, count)):
                held.append(x)
        text, length, n, code, count = (np.concatenate(x) for x in (texts, lengths, sizes, codes, counts))
        if not len(length):
            continue
        ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
        terms = pa.Array.from_buffers(pa.large_string(), len(length), [None, pa.py_buffer(ends), pa.py_buffer(text)])
        encoded = terms.dictionary_encode()
        order = pc.sort_indices(encoded.dictionary).to_numpy()
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        n_rows = len(weights.table)
        keys = np.repeat(rank[encoded.indices.to_numpy()], n) * n_rows + weights.rows(code)
        by = np.argsort(keys, kind="stable")
        keys, count = keys[by], count[by]
        begins = _runs(keys)
        count = np.add.reduceat(count, begins)
        word, rows = np.divmod(keys[begins], n_rows)
        yield Opened(encoded.dictionary.take(pa.array(order)), _runs(word), rows, count)


def _classes(opened: Opened) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms with more than one entry; the others by class of equal entries, in order, and where the classes begin."""
    sizes = np.diff(np.append(opened.begins, len(opened.rows)))
    one = np.flatnonzero(sizes == 1)
    entry = opened.begins[one]
    order = np.lexsort((one, opened.counts[entry], opened.rows[entry]))
    one, entry = one[order], entry[order]
    changed = (opened.rows[entry][1:] != opened.rows[entry][:-1]) | (opened.counts[entry][1:] != opened.counts[entry][:-1])
    return np.flatnonzero(sizes > 1), one, np.flatnonzero(np.concatenate([[True], changed])) if len(one) else np.empty(0, dtype=np.int64)


def _tally(opened: Opened, weights: Weights) -> pa.Table:
    """How many terms have which sum in each slot, with the first and the last of them."""
    several, one, begins = _classes(opened)
    n_slots, beyond = weights.table.shape[1], len(opened.terms)
    number = np.zeros((n_slots, TALLIED), dtype=np.int64)
    first, last = np.full((n_slots, TALLIED), beyond), np.full((n_slots, TALLIED), -1)
    low, high = np.empty(TALLIED, dtype=np.int64), np.empty(TALLIED, dtype=np.int64)
    rest = []  # slot, sum, number, first, last
    for some, sums in opened.sums(several, weights):
        for slot, sum_ in enumerate(sums):
            small = sum_ < TALLIED
            if not small.all():
                wide = np.flatnonzero(~small)
                rest.append((np.full(len(wide), slot), sum_[wide], np.ones(len(wide), dtype=np.int64), some[wide], some[wide]))
                sum_, ranks = sum_[small], some[small]
            else:
                ranks = some
            number[slot] += np.bincount(sum_, minlength=TALLIED)
            low.fill(beyond)
            high.fill(-1)
            high[sum_] = ranks  # of equal indices the last one holds
            low[sum_[::-1]] = ranks[::-1]
            np.minimum(first[slot], low, out=first[slot])
            np.maximum(last[slot], high, out=last[slot])
    if len(one):
        ends = np.append(begins[1:], len(one))
        entry = opened.begins[one[begins]]
        sums = weights.table[opened.rows[entry]] * opened.counts[entry, None]
        for slot in range(n_slots):
            rest.append((np.full(len(begins), slot), sums[:, slot], ends - begins, one[begins], one[ends - 1]))
    slot, sum_ = np.nonzero(number)
    rest.append((slot, sum_, number[slot, sum_], first[slot, sum_], last[slot, sum_]))
    slot, sum_, number, first, last = (np.concatenate(x) for x in zip(*rest))
    some = np.flatnonzero(sum_ > 0)
    some = some[np.lexsort((sum_[some], slot[some]))]
    slot, sum_, number, first, last = slot[some], sum_[some], number[some], first[some], last[some]
    at = np.flatnonzero(np.concatenate([[True], (slot[1:] != slot[:-1]) | (sum_[1:] != sum_[:-1])])) if len(slot) else np.empty(0, dtype=np.int64)
    if len(at):
        number, first, last = np.add.reduceat(number, at), np.minimum.reduceat(first, at), np.maximum.reduceat(last, at)
    ends = [opened.terms.take(pa.array(x, pa.int64())).cast(pa.string()) for x in (first, last)]
    return pa.table({"slot": pa.array((slot[at] + weights.first).astype(np.int32)), "n": sum_[at], "n_words": number, "first_word": ends[0], "last_word": ends[1]})


def _rows(opened: Opened, weights: Weights) -> Iterator[pa.Table]:
    """Every sum: a row per term and slot."""
    for some, sums in opened.sums(np.arange(len(opened.terms)), weights):
        slot, place = np.nonzero(sums)
        yield pa.table({"slot": pa.array((slot + weights.first).astype(np.int32)), "word": opened.terms.take(pa.array(some[place])).cast(pa.string()), "n": sums[slot, place]})


def _best(opened: Opened, weights: Weights, totals: np.ndarray, min_chars: int, k: int, rising: bool) -> pa.Table:
    """The k terms of each symbol (two slots) with the largest difference of shares."""
    several, one, begins = _classes(opened)
    # terms of a class have equal differences, so none but its first k long enough can be among the k best
    long_enough = pc.greater_equal(pc.utf8_length(opened.terms), min_chars).to_numpy(zero_copy_only=False)
    kept = long_enough[one]
    before = np.cumsum(kept) - kept
    nth = before - np.repeat(before[begins], np.diff(np.append(begins, len(one)))) if len(one) else before
    chosen = np.sort(np.concatenate([several[long_enough[several]], one[kept & (nth < k)]]))
    best = [(np.empty(0), np.empty(0, dtype=np.int64))] * (weights.table.shape[1] // 2)
    for some, sums in opened.sums(chosen, weights):
        for i, (held, ranks) in enumerate(best):
            up, down = sums[2 * i], sums[2 * i + 1]
            with np.errstate(divide="ignore", invalid="ignore"):
                shares = [np.where(n > 0, n / totals[weights.first + 2 * i + j] * 100, 0.0) for j, n in enumerate((up, down))]
            gain = shares[0] - shares[1] if rising else -(shares[0] - shares[1])
            near = (up > 0) | (down > 0)
            if len(held) >= k:
                near &= gain > held[k - 1]  # of equal ones the first stay
            near = np.flatnonzero(near)
            held, ranks = np.concatenate([held, gain[near]]), np.concatenate([ranks, some[near]])
            order = np.argsort(-held, kind="stable")[:k]
            best[i] = held[order], ranks[order]
    symbol = np.repeat(np.arange(len(best)), [len(x) for x, _ in best]) + weights.first // 2
    ranks = np.concatenate([r for _, r in best]) if best else np.empty(0, dtype=np.int64)
    return pa.table({"place": pa.array(symbol.astype(np.int32)), "word": opened.terms.take(pa.array(ranks, pa.int64())).cast(pa.string()), "diff": np.concatenate([x for x, _ in best]) if best else np.empty(0)})


def _by_bucket(blocks: DataFrame, weights: Weights, find, **kinds: T.DataType) -> DataFrame:
    shared = blocks.sparkSession.sparkContext.broadcast(weights)
    schema = T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])
    empty = to_arrow_schema(schema).empty_table()

    def step(table: pa.Table) -> pa.Table:
        found = [t for opened in _opened(table, shared.value) for t in find(opened, shared.value)]
        return pa.concat_tables(found) if found else empty

    return blocks.where("bucket is not null").select("bucket", "entries", "size", "block").groupBy("bucket").applyInArrow(step, schema)


def tally(blocks: DataFrame, weights: Weights) -> DataFrame:
    return _by_bucket(blocks, weights, lambda o, w: [_tally(o, w)], slot=T.IntegerType(), n=T.LongType(), n_words=T.LongType(), first_word=T.StringType(), last_word=T.StringType())


def rows(blocks: DataFrame, weights: Weights) -> DataFrame:
    return _by_bucket(blocks, weights, _rows, slot=T.IntegerType(), word=T.StringType(), n=T.LongType())


def best(blocks: DataFrame, weights: Weights, totals: np.ndarray, min_chars: int, k: int, rising: bool) -> DataFrame:
    return _by_bucket(blocks, weights, lambda o, w: [_best(o, w, totals, min_chars, k, rising)], place=T.IntegerType(), word=T.StringType(), diff=T.DoubleType())
