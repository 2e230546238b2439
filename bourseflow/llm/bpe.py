"""Exact BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word exactly one token can be the last one of its
encoding. An automaton over the vocabulary (a trie with suffix links) lists the
tokens that end at a place; the right one is the token whose pair with the last
token of the prefix before it is compatible, that is, no merge across their
border would have come first. The last token of each prefix is stored with a
back-pointer; following the pointers from the end gives the ids. No merge queue
is simulated, and the work is linear in the word's length times the tokens that
end at a place.

The vocabulary is read from the tokenizer file by every executor process once;
its path is a parameter. The driver never holds texts, and nothing is shuffled.

Encoded words and tested pairs are remembered per process, in tables of fixed
size: words in two of ``CACHE_WORDS``, of which the older one goes when the
newer is full.

Defined cases: null text is empty and has no ids; special tokens written out in
a text are taken as such, as the library does; repeated rows each get a row;
texts are encoded whole; further columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import sys
import unicodedata
from array import array
from collections import deque
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

CACHE_WORDS = 120_000
CACHED_LETTERS = 40
PAIRS = 400_000
#: Bytes of a word's beginning whose prefixes are remembered.
HEAD = 6

#: Fixed values of the file format: the words a text is split into, and white space.
_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_ODD_SPACE = regex.compile(r"[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else extra))
        extra += b not in plain
    return out


class Encoder:
    """Vocabulary of a tokenizer file with word-end marks."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        vocabulary: dict[str, int] = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        named = {i: t for t, i in vocabulary.items()} | {i: t for t, i in self.special.items()}
        self.tokens = [named.get(i, "") for i in range(max(named) + 1)]
        # a word's symbols are its byte letters, the last one with the word-end mark
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.born: dict[int, int] = {}
        symbols: dict[int, list[int]] = {i: [i] for t, i in vocabulary.items()}
        for r, (a, b) in enumerate(merges):
            left, right, whole = vocabulary[a], vocabulary[b], vocabulary[a + b]
            self.rank.setdefault((left, right), r)
            if whole not in self.parts:
                self.parts[whole], self.born[whole] = (left, right), r
                symbols[whole] = symbols[left] + symbols[right]
        letters = byte_letters()
        self.inner = [vocabulary[c] for c in letters]
        self.final = [vocabulary[c + self.end] for c in letters]
        self._automaton(symbols)
        self.known: dict[int, bool] = {}
        self.cache: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.heads: dict[bytes, tuple[int, tuple, tuple]] = {}
        self.splitter = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None

    def _automaton(self, symbols: dict[int, list[int]]) -> None:
        """Trie of all tokens with suffix links; ``ends[node]`` lists (token, length), longest first."""
        self.next: list[dict[int, int]] = [{}]
        own: list[tuple[int, int] | None] = [None]
        for token, syms in symbols.items():
            node = 0
            for s in syms:
                to = self.next[node].get(s)
                if to is None:
                    to = self.next[node][s] = len(self.next)
                    self.next.append({})
                    own.append(None)
                node = to
            own[node] = (token, len(syms))
        self.link = [0] * len(self.next)
        self.ends: list[tuple[tuple[int, int], ...]] = [()] * len(self.next)
        queue = deque([0])
        while queue:
            node = queue.popleft()
            for s, to in self.next[node].items():
                if node:
                    back = self.link[node]
                    while back and s not in self.next[back]:
                        back = self.link[back]
                    self.link[to] = self.next[back].get(s, 0)
                self.ends[to] = ((own[to],) if own[to] else ()) + self.ends[self.link[to]]
                queue.append(to)

    def compatible(self, left: int, right: int) -> bool:
        """No merge across the border of the two tokens comes before those that made them.

        The tokens are taken apart from the latest merge back; whenever two parts
        face each other at the border, their own merge must be later than the
        merges that hide them (at equal rank the place further left wins).
        """
        never = len(self.rank) + 1
        hidden_left = hidden_right = never
        rank, born = self.rank, self.born
        while True:
            r = rank.get((left, right))
            if r is not None and r < hidden_left and r <= hidden_right:
                return False
            a, b = born.get(left, -1), born.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:
                hidden_left, left = a, self.parts[left][1]
            else:
                hidden_right, right = b, self.parts[right][0]

    def word(self, data: bytes) -> tuple[int, ...]:
        """Ids of one word, from its UTF-8 bytes."""
        n = len(data)
        if n > HEAD + 1:
            # every word with this beginning has the same last tokens so far
            head = data[:HEAD]
            start = self.heads.get(head)
            if start is None:
                if len(self.heads) >= CACHE_WORDS:
                    self.heads.clear()
                last, back = [0], [0]
                start = self.heads[head] = (self._walk(0, map(self.inner.__getitem__, head), last, back), tuple(last), tuple(back))
            node, last, back = start[0], list(start[1]), list(start[2])
            rest = data[HEAD:-1]
        else:
            node, last, back, rest = 0, [0], [0], data[:-1]
        self._walk(node, [*map(self.inner.__getitem__, rest), self.final[data[-1]]], last, back)
        ids = []
        i = n
        while i:
            ids.append(last[i])
            i = back[i]
        ids.reverse()
        return tuple(ids)

    def _walk(self, node: int, symbols, last: list[int], back: list[int]) -> int:
        """Append the last token and the back-pointer of each further prefix; returns the automaton's node."""
        goto, ends, known = self.next, self.ends, self.known
        i = len(last) - 1
        for s in symbols:
            i += 1
            to = goto[node].get(s)
            if to is None:
                to = self._goto(node, s)
            node = to
            for token, size in ends[node]:
                j = i - size
                if not j:
                    break
                key = last[j] << 20 | token
                fits = known.get(key)
                if fits is None:
                    if len(known) >= PAIRS:
                        known.clear()
                    fits = known[key] = self.compatible(last[j], token)
                if fits:
                    break
            last.append(token)
            back.append(j)
        return node

    def _goto(self, node: int, s: int) -> int:
        """Where a symbol leads from a node without that child: along suffix links; the answer is kept as an arc."""
        back = node
        while back and s not in self.next[back]:
            back = self.link[back]
        to = self.next[node][s] = self.next[back].get(s, 0)
        return to

    def chunk(self, text: str) -> tuple[int, ...]:
        """Ids of a stretch without white space."""
        hit = self.cache.get(text)
        if hit is None:
            hit = self.older.get(text)
            if hit is None:
                words = _WORD.findall(text)
                hit = self.word(text.encode()) if len(words) == 1 else tuple(i for w in words for i in self.chunk(w))
            if len(text) <= CACHED_LETTERS:
                if len(self.cache) >= CACHE_WORDS:  # words not seen since the last change of tables go
                    self.older, self.cache = self.cache, {}
                self.cache[text] = hit
        return hit

    def _plain(self, text: str, ids: array) -> None:
        text = unicodedata.normalize("NFC", text)
        text = text.replace("Σ", "σ").lower()  # letter by letter: no final sigma
        parts = regex.split(r"\s+", text) if _ODD_SPACE.search(text) else text.split()
        hits = list(map(self.cache.get, parts))
        if None in hits:
            hits = [self.chunk(p) if h is None else h for p, h in zip(parts, hits)]
        ids.extend(chain.from_iterable(hits))

    def encode(self, text: str) -> array:
        ids = array("I")
        at = 0
        for m in self.splitter.finditer(text) if self.splitter else ():
            self._plain(text[at : m.start()], ids)
            ids.append(self.special[m.group()])
            at = m.end()
        self._plain(text[at:] if at else text, ids)
        return ids

    def decode(self, ids) -> str:
        """Tokens joined by one space: the file names no decoder."""
        return " ".join(map(self.tokens.__getitem__, ids))


_loaded: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per process and path."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def with_ids(docs: DataFrame, path: str, text_column: str = "text") -> DataFrame:
    """``docs`` with ``_ids`` (array of token ids)."""
    names = docs.columns

    def step(batches):
        own = encoder(path)
        for batch in batches:
            ids, ends = array("I"), [0]  # of the whole batch, four bytes each
            for text in batch.column(names.index(text_column)):
                ids.extend(own.encode(text.as_py() or ""))
                ends.append(len(ids))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(ids, dtype=np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*names, "_ids"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(step, f"{fields}, _ids array<int>")


def decoded(encoded: DataFrame, path: str, ids_column: str = "_ids") -> DataFrame:
    """``encoded`` with ``_decoded``, the text of its ids; null ids give the empty text."""
    names = encoded.columns

    def step(batches):
        own = encoder(path)
        for batch in batches:
            texts = [own.decode(ids or ()) for ids in batch.column(names.index(ids_column)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, "_decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(step, f"{fields}, _decoded string")


def report(docs: DataFrame, path: str) -> DataFrame:
    """The registered query: digests of ids and decoded text, a row at a time, so no column of ids is kept."""

    def step(batches):
        own = encoder(path)
        for batch in batches:
            counts, ids_digest, text_digest = [], [], []
            for text in batch.column(1):
                ids = own.encode(text.as_py() or "")
                counts.append(len(ids))
                ids_digest.append(hashlib.sha256(_little(ids)).hexdigest())
                text_digest.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_digest), pa.array(text_digest)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(step, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def _little(ids: array) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    if sys.byteorder == "big":
        ids = array("I", ids)
        ids.byteswap()
    return ids.tobytes()
