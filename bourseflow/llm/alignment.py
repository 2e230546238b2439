"""Alignment of two tokenizers over a corpus, in Arrow columns.

The tokens of a text by A (byte-level BPE, with the pattern that splits its texts) and by B (pieces with byte fallback)
cover the same bytes. Where a token of A and one of B end at the same byte, the
text is cut: groups of tokens between two cuts belong together, and the two tokens
that end there are linked. Everything works on whole batches of tokens, not on
tokens:

1. Lists of ids are flattened; parent indices say whose token each is.
2. Byte lengths are looked up by id and summed up; taking off the sum at the
   start of its text makes the sum a segmented one: the end of each token.
3. An Acero hash join of both sides on (text, end) gives the cuts and the links.
4. ``Table.group_by`` counts the links of each id pair within a task; Spark adds
   the partial counts up.

Linked tokens end together, so one's bytes end with the other's: the pairs that
can occur are given by the two vocabularies (``possible_pairs``, about 200,000 for
the files used here), however large the corpus is. The counts are an array over
them, which is why they may be collected and broadcast. Texts are encoded once, by libraries: A by tiktoken, if the
file's merges can be read as ranks (``ranked``), else by tokenizers with pieces that were met before remembered. The ranks of a text's
links among the possible pairs are stored, and read again with the corpus-wide counts.

Defined cases: null and empty texts, and texts of which a tokenizer does not give
back all bytes (white space or characters normalized away, or U+2581, which B
writes for a space), have no tokens: zeros and no groups; such texts count for
no pair. Strings of special tokens are ordinary text. Repeated rows each get a row
and each count; very long texts are encoded whole, on their own; an empty table
gives an empty one; further columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import sys
from collections.abc import Callable, Iterable, Iterator
from itertools import chain
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bourseflow.session import cut_lineage

#: Bytes of texts that are encoded together; a longer text is encoded on its own.
CHUNK_BYTES = 1 << 19
#: Links that are counted together; a text with more is counted on its own.
CHUNK_LINKS = 500_000
#: Pieces remembered by a process (in two tables of half as many), up to so many characters each.
CACHE_PIECES, CACHED_LETTERS = 600_000, 40
_IDS = pa.list_(pa.int32())
#: Name of the module that holds what a process has loaded.
KEPT = "_bourseflow_alignment_kept"
#: Fixed values of the file format: the pattern of a byte-level vocabulary, and the settings of its merges that ranks have no place for.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SETTINGS = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
#: What stands behind an id in the text of the groups: inside a group, before B's side, before the next group, at the end.
SIGNS = (",", "|", ";", "")


def _byte_letters() -> dict[str, int]:
    """The byte for each letter of a byte-level vocabulary: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Pair:
    """Both tokenizers, the bytes of their tokens, and the id pairs that can end together."""

    def __init__(self, path_a: str, path_b: str, pattern: str):
        # a task uses the core it has been given
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_padding()
        self.a.no_truncation()
        # the tokenizer splits a text into pieces and encodes each on its own
        self.split = regex.compile(pattern).findall
        self.pieces = _Remembered(self._pieces)
        self.ranked = ranked(path_a, self.a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a, self.bytes_b = bytes_of_a(path_a), bytes_of_b(self.b)
        self.size_a = np.array([len(x) for x in self.bytes_a], dtype=np.int64)
        self.size_b = np.array([len(x) for x in self.bytes_b], dtype=np.int64)
        self.pairs = possible_pairs(self.bytes_a, self.bytes_b)
        self.signed = pa.array((f"{i}{sign}" for i in range(max(len(self.bytes_a), len(self.bytes_b))) for sign in SIGNS), pa.string())
        self.bytes_a, self.bytes_b = pa.array(self.bytes_a, pa.binary()), pa.array(self.bytes_b, pa.binary())

    @property
    def cache(self) -> dict[str, int]:
        """Pieces of A met last."""
        return self.pieces.numbers

    @property
    def older(self) -> dict[str, int]:
        """Pieces of A met before those."""
        return self.pieces.older

    def ids_a(self, texts: list[str]) -> pa.ListArray:
        """Ids of A, those of ``encode_a``."""
        if self.ranked is None:
            return self.encode_a(texts)
        found = [np.empty(0, dtype=np.int32), *map(self._ids_by_rank, texts)]
        offsets = np.cumsum([len(x) for x in found])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(found, dtype=np.int32, casting="unsafe")))

    def _ids_by_rank(self, text: str) -> np.ndarray:
        try:
            return self.ranked.encode_to_numpy(text, disallowed_special=())
        except ValueError:  # white space of hundreds of thousands of characters is too much for its pattern
            return self.encode_a([text]).values.to_numpy()

    def encode_a(self, texts: list[str]) -> pa.ListArray:
        """Ids of A. Distinct pieces that are not remembered go to the tokenizer, which splits them again where it must."""
        return self.pieces.ids([self.split(t) for t in texts])

    def _pieces(self, pieces: list[str]) -> pa.ListArray:
        return pa.array([e.ids for e in self.a.encode_batch_fast(pieces, add_special_tokens=False)], _IDS)

    def encode_b(self, texts: list[str]) -> pa.ListArray:
        return pa.array(self.b.encode(texts, num_threads=1), _IDS)


class _Numbers(dict):
    """A number by piece. One that is not known gets the next and is among the ``fresh``."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, piece: str) -> int:
        number = self[piece] = self.first + len(self.fresh)
        self.fresh.append(piece)
        return number

    def of(self, pieces: Iterable[str], first: int) -> np.ndarray:
        self.first, self.fresh = first, []
        return np.fromiter(map(self.__getitem__, pieces), dtype=np.int64)


class _Remembered:
    """Ids of the pieces that a process has met: a number by piece, and the list of ids by number."""

    def __init__(self, encode: Callable[[list[str]], pa.ListArray]):
        self.encode = encode
        self.numbers, self.older = _Numbers(), _Numbers()
        self.lists = self.older_lists = pa.array([], _IDS)

    def ids(self, split: list[list[str]]) -> pa.ListArray:
        """Ids of each list of pieces, put together."""
        if len(self.lists) > CACHE_PIECES // 2:
            self.older, self.older_lists = self.numbers, self.lists
            self.numbers, self.lists = _Numbers(), self.lists[:0]
        numbers = self.numbers.of(chain.from_iterable(split), len(self.lists))
        lists = self.lists
        if fresh := self.numbers.fresh:
            added = self._fresh(fresh)
            lists = self.lists = pa.concat_arrays([lists, added])
            if long := [p for p in fresh if len(p) > CACHED_LETTERS]:
                short = pa.array([len(p) <= CACHED_LETTERS for p in fresh])
                self.lists = pa.concat_arrays([lists[: -len(fresh)], pc.if_else(short, added, pa.scalar(None, _IDS))])
                for p in long:
                    del self.numbers[p]
        taken = lists.take(pa.array(numbers))
        bounds = np.cumsum([0, *map(len, split)])
        return pa.ListArray.from_arrays(pa.array(taken.offsets.to_numpy()[bounds]), taken.values)

    def _fresh(self, pieces: list[str]) -> pa.ListArray:
        older = list(map(self.older.get, pieces))
        asked = [p for p, k in zip(pieces, older) if k is None]
        found = pa.concat_arrays([self.older_lists, *(self.encode(asked[i : i + 10_000]) for i in range(0, len(asked), 10_000))])
        place = iter(range(len(self.older_lists), len(found)))
        return found.take(pa.array([next(place) if k is None else k for k in older], pa.int64()))


def bytes_of_a(path: str) -> list[bytes]:
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    letters = _byte_letters()
    vocabulary = spec["model"]["vocab"]
    out = [b""] * (max(vocabulary.values()) + 1)
    special = {t["content"] for t in spec["added_tokens"]}
    for token, i in vocabulary.items():
        if token not in special:
            out[i] = bytes(letters[c] for c in token)
    return out


def ranked(path: str, tokenizer) -> tiktoken.Encoding | None:
    """The vocabulary of a byte-level BPE file as ranks, or None if they would not give the tokenizer's ids.

    Ranks merge two neighbours whenever their bytes are a token's, the one of the lowest id first. That is what the file says if
    its merges make tokens in the order of their ids, and if every token's bytes are merged to that token: neighbours that make
    up a token in another way than by its merge would keep it from being reached.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, split, added = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
    if model.get("type") != "BPE" or any(model.get(x) for x in SETTINGS) or spec.get("normalizer"):
        return None
    if split.get("type") != "ByteLevel" or split.get("add_prefix_space", True) or not split.get("use_regex", True):
        return None
    special = {t["content"]: t["id"] for t in added}
    # others than special ones are looked for in texts; without any, tiktoken would look for the empty string
    if not special or not all(t["special"] for t in added):
        return None
    vocabulary = {t: i for t, i in model["vocab"].items() if t not in special}
    merges = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
    made = np.array([vocabulary.get(a + b, -1) for a, b in merges])
    letters = _byte_letters()
    if not letters.keys() <= vocabulary.keys() or (np.diff(made, prepend=-1) <= 0).any():
        return None
    if any([x.id for x in tokenizer.model.tokenize(t)] != [i] for t, i in vocabulary.items()):
        return None
    ranks = {bytes(letters[c] for c in t): i for t, i in vocabulary.items()}
    return tiktoken.Encoding(path, pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens=special)


def bytes_of_b(model) -> list[bytes]:
    out = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_control(i) or model.is_unknown(i):
            out.append(b"")
        else:
            out.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
    return out


def possible_pairs(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Sorted keys ``a_id << 32 | b_id`` of the pairs of which one's bytes end with the other's."""
    out = set()
    for swap, (long, short) in enumerate(((a, b), (b, a))):
        ids: dict[bytes, list[int]] = {}
        for i, x in enumerate(short):
            if x:
                ids.setdefault(x, []).append(i)
        for i, x in enumerate(long):
            for k in range(len(x)):
                for j in ids.get(x[k:], ()):
                    out.add((j << 32 | i) if swap else (i << 32 | j))
    return np.array(sorted(out), dtype=np.int64)


def pair_of(path_a: str, path_b: str, pattern: str) -> Pair:
    """One per process, pair of files and pattern.

    The package's functions bring their code and its variables along with every task (``bourseflow/__init__.py``), so a variable
    of this module would begin anew in each. What a worker has loaded is kept in a module that no task brings.
    """
    loaded = vars(sys.modules.setdefault(KEPT, ModuleType(KEPT))).setdefault("pairs", {})
    if (path_a, path_b, pattern) not in loaded:
        loaded[path_a, path_b, pattern] = Pair(path_a, path_b, pattern)
    return loaded[path_a, path_b, pattern]


def _side(lists: pa.ListArray, sizes: np.ndarray, name: str) -> pa.Table:
    """One row per token: text, id, place in its text's list, and the byte its range ends at."""
    flat, parents = pc.list_flatten(lists), pc.list_parent_indices(lists).cast(pa.int64())
    total = np.concatenate(([0], np.cumsum(sizes[flat.to_numpy()], dtype=np.int64)))
    first = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(), dtype=np.int64)))[:-1]
    ends = total[1:] - total[first][parents.to_numpy()]
    return pa.table({"text": parents, "end": pa.array(ends), name: flat.cast(pa.int64()), f"{name}_row": pa.array(np.arange(len(flat), dtype=np.int64))})


def _links(a: pa.Table, b: pa.Table, room: np.ndarray) -> pa.Table:
    """``place, a_row, b_row`` of the tokens that end together, in order; a text has ``room`` for more ends than it has bytes."""
    base = np.concatenate(([0], np.cumsum(room)))
    sides = []
    for side, name in ((a, "a"), (b, "b")):
        place = pa.array(base[side.column("text").to_numpy()] + side.column("end").to_numpy())
        sides.append(pa.table({"place": place, f"{name}_row": side.column(f"{name}_row")}))
    links = sides[0].join(sides[1], keys="place", join_type="inner", use_threads=False)
    order = np.lexsort((links.column("b_row").to_numpy(), links.column("a_row").to_numpy()))
    return links.take(pa.array(order))


def _joined(lists: pa.ListArray, of: pa.Array) -> pa.Array:
    """Bytes of each list of tokens, put together."""
    taken = pa.ListArray.from_arrays(lists.offsets, of.take(lists.flatten()))
    return pc.binary_join(taken, b"")


def _without(lists: pa.ListArray, whole: np.ndarray) -> pa.ListArray:
    """Lists of texts that are not ``whole`` are empty."""
    return pc.if_else(pa.array(whole), lists, pa.array([[]] * len(lists), lists.type))


def _group_texts(a: pa.Table, b: pa.Table, links: pa.Table, n_texts: int, signed: pa.Array) -> list[str]:
    """``a1,a2|b1;a3|b2,b3`` of every text."""
    cut_a, cut_b = np.zeros(len(a), dtype=bool), np.zeros(len(b), dtype=bool)
    cut_a[links.column("a_row").to_numpy()] = True
    cut_b[links.column("b_row").to_numpy()] = True
    # groups are numbered over all texts; both sides have the same groups
    group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
    texts_a, texts_b = a.column("text").to_numpy(), b.column("text").to_numpy()
    place_a = np.arange(len(a)) + np.searchsorted(group_b, group_a)
    place_b = np.arange(len(b)) + np.searchsorted(group_a, group_b, side="right")
    last_b = np.concatenate((texts_b[1:] != texts_b[:-1], [True])) if len(b) else np.zeros(0, dtype=bool)
    # an id and the sign behind it are one entry of a table of texts
    words, text = np.empty(len(a) + len(b), dtype=np.int64), np.empty(len(a) + len(b), dtype=np.int64)
    words[place_a] = a.column("a").to_numpy() * len(SIGNS) + cut_a
    words[place_b] = b.column("b").to_numpy() * len(SIGNS) + np.where(cut_b, np.where(last_b, 3, 2), 0)
    text[place_a], text[place_b] = texts_a, texts_b
    offsets = np.searchsorted(text, np.arange(n_texts + 1)).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), signed.take(pa.array(words))), "").to_pylist()


def aligned(texts: list[str | None], own: Pair) -> pa.Table:
    """One row per text: ``n_a, n_b, n_groups, groups``, and ``links``, the link's ranks among the possible pairs."""
    given = np.array([bool(t) for t in texts], dtype=bool)
    led = [f" {t}" if t else "" for t in texts]
    a, b = own.ids_a(led), own.encode_b([t or "" for t in texts])
    wanted = pa.array([t.encode() for t in led], pa.binary())
    same = [pc.equal(_joined(x, of), wanted).to_numpy(zero_copy_only=False) for x, of in ((a, own.bytes_a), (b, own.bytes_b))]
    whole = given & same[0] & same[1]
    a, b = _without(a, whole), _without(b, whole)
    side_a, side_b = _side(a, own.size_a, "a"), _side(b, own.size_b, "b")
    links = _links(side_a, side_b, np.array([len(x) + 1 for x in wanted.to_pylist()], dtype=np.int64))
    ids_a, ids_b = (side.column(name).to_numpy()[links.column(f"{name}_row").to_numpy()] for side, name in ((side_a, "a"), (side_b, "b")))
    met = pa.array(ids_a << 32 | ids_b).dictionary_encode()
    ranks = np.searchsorted(own.pairs, met.dictionary.to_numpy()).astype(np.int32)[met.indices.to_numpy()]
    groups = _group_texts(side_a, side_b, links, len(texts), own.signed)
    text = side_a.column("text").to_numpy()[links.column("a_row").to_numpy()]
    offsets = np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32)
    # links of one cut follow each other
    place = links.column("place").to_numpy()
    n_groups = np.bincount(text[np.flatnonzero(np.diff(place, prepend=-1))], minlength=len(texts)).astype(np.int64)
    return pa.table(
        {
            "n_a": pc.list_value_length(a).cast(pa.int64()),
            "n_b": pc.list_value_length(b).cast(pa.int64()),
            "n_groups": pa.array(n_groups),
            "groups": pa.array(groups, pa.large_string()),
            "links": pa.ListArray.from_arrays(pa.array(offsets), pa.array(ranks)),
        }
    )


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    begin = size = 0
    for i, t in enumerate(texts):
        more = len(t or "")
        if i > begin and size + more > CHUNK_BYTES // 2:
            yield begin, i
            begin, size = i, 0
        size += more
    if begin < len(texts):
        yield begin, len(texts)


def align(docs: DataFrame, path_a: str, path_b: str, pattern: str, digest: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, groups, links`` of every text; with ``digest`` the SHA-256 of the groups instead of them."""
    name = "groups_sha256" if digest else "groups"

    def step(batches):
        own = pair_of(path_a, path_b, pattern)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for begin, end in _chunks(texts):
                found = aligned(texts[begin:end], own)
                groups = found.column("groups").to_pylist()
                if digest:
                    groups = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
                columns = [found.column(c).combine_chunks() for c in ("n_a", "n_b", "n_groups")]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[begin:end], *columns, pa.array(groups, pa.string()), found.column("links").combine_chunks()],
                    names=["doc_id", "n_a", "n_b", "n_groups", name, "links"],
                )

    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(step, f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, {name} string, links array<int>")


def pair_counts(alignment: DataFrame, path_a: str, path_b: str, pattern: str) -> DataFrame:
    """``a_id, b_id, n``: how many links of the corpus hold each pair. At most as many rows as there are possible pairs."""

    def step(batches):
        tables = []
        for batch in batches:
            one = pa.table({"pair": pc.list_flatten(batch.column(0))}).group_by("pair", use_threads=False).aggregate([([], "count_all")])
            tables.append(one.rename_columns(["pair", "n"]))
            if len(tables) > 20:
                tables = [_added(tables)]
        if tables:
            yield from _added(tables).to_batches()

    counted = alignment.select("links").mapInArrow(step, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))

    def named(batches):
        pairs = pair_of(path_a, path_b, pattern).pairs
        for batch in batches:
            keys = pairs[batch.column(0).to_numpy()]
            yield pa.RecordBatch.from_arrays([pa.array(keys >> 32), pa.array(keys & 0xFFFFFFFF), batch.column(1)], names=["a_id", "b_id", "n"])

    return counted.mapInArrow(named, "a_id bigint, b_id bigint, n bigint")


def _added(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).group_by("pair", use_threads=False).aggregate([("n", "sum")]).rename_columns(["pair", "n"])


def with_counts(alignment: DataFrame, counts: DataFrame, path_a: str, path_b: str, pattern: str) -> DataFrame:
    """``alignment`` with ``n_links, n_best, count_sum`` in place of ``links``.

    ``counts`` is collected: its size is bounded by the vocabularies, not by the corpus.
    """
    best = counts.groupBy("b_id").agg(F.max("n").alias("most"))
    table = counts.join(best, "b_id").select("a_id", "b_id", "n", (F.col("n") == F.col("most")).alias("best")).toArrow()
    shared = alignment.sparkSession.sparkContext.broadcast([c.to_numpy() for c in table.columns])
    kept = [c for c in alignment.columns if c != "links"]
    place = alignment.columns.index("links")

    def sliced(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        size = np.cumsum(pc.coalesce(pc.list_value_length(batch.column(place)), 0).to_numpy()) // CHUNK_LINKS
        cuts = [0, *(np.flatnonzero(np.diff(size)) + 1), len(batch)]
        return (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a)

    def step(batches):
        a, b, n, best = shared.value
        pairs = pair_of(path_a, path_b, pattern).pairs
        rank = np.searchsorted(pairs, a.astype(np.int64) << 32 | b.astype(np.int64))
        counted = pa.table({"pair": pa.array(rank.astype(np.int32)), "n": pa.array(n), "best": pa.array(best.astype(np.int64))})
        for batch in chain.from_iterable(map(sliced, batches)):
            lists = batch.column(place)
            # rows of one batch may hold very many links: equal ones of a text meet first
            flat = pa.table({"row": pc.list_parent_indices(lists).cast(pa.int64()), "pair": pc.list_flatten(lists)})
            flat = flat.group_by(["row", "pair"], use_threads=False).aggregate([([], "count_all")]).rename_columns(["row", "pair", "times"])
            met = flat.join(counted, keys="pair", join_type="inner", use_threads=False)
            times = met.column("times")
            sums = pa.table({"row": met.column("row"), "best": pc.multiply(met.column("best"), times), "count": pc.multiply(met.column("n"), times)})
            sums = sums.group_by("row", use_threads=False).aggregate([("best", "sum"), ("count", "sum")])
            n_best, count_sum = np.zeros(len(batch), dtype=np.int64), np.zeros(len(batch), dtype=np.int64)
            n_best[sums.column("row").to_numpy()] = sums.column("best_sum").to_numpy()
            count_sum[sums.column("row").to_numpy()] = sums.column("count_sum").to_numpy()
            others = [batch.column(i) for i in range(len(batch.columns)) if i != place]
            n_links = pc.coalesce(pc.list_value_length(lists), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*others, n_links, pa.array(n_best), pa.array(count_sum)], names=[*kept, "n_links", "n_best", "count_sum"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in alignment.schema.fields if f.name != "links")
    return alignment.mapInArrow(step, f"{fields}, n_links bigint, n_best bigint, count_sum bigint")


def report(docs: DataFrame, path_a: str, path_b: str, pattern: str) -> DataFrame:
    """The registered query."""
    alignment = cut_lineage(align(docs, path_a, path_b, pattern, digest=True))
    found = with_counts(alignment, pair_counts(alignment, path_a, path_b, pattern), path_a, path_b, pattern)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def brute_force(rows: list[tuple], path_a: str, path_b: str) -> list[tuple]:
    """Rows of the report, token by token in plain Python, for tests."""
    own = Pair(path_a, path_b, "")
    a_bytes, b_bytes = bytes_of_a(path_a), bytes_of_b(own.b)
    found, counts = [], {}
    for doc, text in rows:
        ids_a = own.a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = own.b.encode(text) if text else []
        wanted = (" " + text).encode() if text else b""
        if b"".join(a_bytes[i] for i in ids_a) != wanted or b"".join(b_bytes[i] for i in ids_b) != wanted:
            ids_a, ids_b = [], []
        ends = []
        for ids, of in ((ids_a, a_bytes), (ids_b, b_bytes)):
            at, place = 0, {}
            for k, i in enumerate(ids):
                at += len(of[i])
                place.setdefault(at, []).append(k)
            ends.append(place)
        links, groups, from_a, from_b = [], [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            links += [(ids_a[i], ids_b[j]) for i in ends[0][end] for j in ends[1][end]]
            to_a, to_b = ends[0][end][-1] + 1, ends[1][end][-1] + 1
            groups.append(",".join(map(str, ids_a[from_a:to_a])) + "|" + ",".join(map(str, ids_b[from_b:to_b])))
            from_a, from_b = to_a, to_b
        for link in links:
            counts[link] = counts.get(link, 0) + 1
        found.append((doc, ids_a, ids_b, links, groups))
    most: dict[int, int] = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    out = []
    for doc, ids_a, ids_b, links, groups in found:
        best = sum(counts[x] == most[x[1]] for x in links)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((doc, len(ids_a), len(ids_b), len(groups), len(links), best, sum(counts[x] for x in links), digest))
    return out
