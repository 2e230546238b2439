"""Byte-level BPE by dynamic programming over byte prefixes, with exact appends and edits.

A text is split into pieces by the pattern of the vocabulary. Inside a piece
every byte prefix has exactly one token that can end its encoding: of the tokens
that end there, the one whose pair with the last token of the prefix before it
would not have been merged across their border. That token is stored for every
prefix (``lasts``, one number per byte); walking back from the end of a piece,
token by token, gives its ids. No merge queue is simulated for texts.

Because the numbers of a prefix depend on nothing to the right of it, they stay
valid when text is appended, and an edit needs work only near it:

* the pattern looks at most ``REACH`` characters past a match, so pieces that end
  that far before the edit stay;
* in the first piece that changes, the numbers before the first changed byte stay;
* behind the edit, once as many numbers and bytes as the longest token has agree
  with the old ones, the rest of the piece agrees, and once a piece starts where
  an old one did, so do all later ones.

``with_prefixes`` stores the numbers beside the texts and ``edited`` applies one
edit per row to them; both are maps over rows without a shuffle. The vocabulary
is read from its file by every worker process once; the path is a parameter.
Pieces met before are remembered in two tables of ``CACHE_PIECES``, of which the
older one goes when the newer is full.

Defined cases: null text is the empty text and has no ids; strings of special
tokens are ordinary text; repeated rows each get a row; texts are encoded whole,
also very long ones or ones without any split (linear in the length times the
tokens that end at a place); an empty table gives an empty table; further columns
stay as they are, and added columns get a free name if theirs is taken (``free``).
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections import deque
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

CACHE_PIECES = 300_000
CACHED_LETTERS = 40
PAIRS = 600_000
#: Bytes of a piece's beginning whose last tokens are remembered, by beginning.
HEAD = 6
#: Characters past its end that decide a match: a contraction has three letters.
REACH = 3


class Encoder:
    """Ranks of a vocabulary file (a base64 token and its rank per line) and the pattern that splits texts."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            pairs = [line.split() for line in file if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self._automaton()
        self.longest = max(map(len, self.ranks))
        self.decimal = [str(i) for i in range(len(self.tokens))]
        self.split = regex.compile(pattern).findall
        self.matches = regex.compile(pattern).finditer
        self.made: dict[int, tuple[int, int] | None] = {}
        self.known: dict[int, bool] = {}
        self.cache: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.heads: dict[bytes, tuple[int, tuple[int, ...]]] = {}

    def _automaton(self) -> None:
        """Trie of the tokens' bytes with links to the longest suffix; ``ends[node]`` are the (token, length) that end there, longest first."""
        self.arcs: list[dict[int, int]] = [{}]
        own: dict[int, tuple[int, int]] = {}
        for token, rank in self.ranks.items():
            node = 0
            for byte in token:
                to = self.arcs[node].get(byte)
                if to is None:
                    to = self.arcs[node][byte] = len(self.arcs)
                    self.arcs.append({})
                node = to
            own[node] = (rank, len(token))
        self.suffix = [0] * len(self.arcs)
        self.ends: list[tuple[tuple[int, int], ...]] = [()] * len(self.arcs)
        queue = deque([0])
        while queue:
            node = queue.popleft()
            for byte, to in list(self.arcs[node].items()):
                if node:
                    self.suffix[to] = self._arc(self.suffix[node], byte)
                self.ends[to] = ((own[to],) if to in own else ()) + self.ends[self.suffix[to]]
                queue.append(to)

    def _arc(self, node: int, byte: int) -> int:
        """Where a byte leads from a node, if need be from its suffixes."""
        while True:
            to = self.arcs[node].get(byte)
            if to is not None or not node:
                return to or 0
            node = self.suffix[node]

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; ``(token, token)`` for a byte, None if no merge ever makes it."""
        if token in self.made:
            return self.made[token]
        data = self.tokens[token]
        pieces = [data[i : i + 1] for i in range(len(data))]
        while len(pieces) > 2:
            found = [(self.ranks.get(a + b, token), i) for i, (a, b) in enumerate(zip(pieces, pieces[1:]))]
            rank, i = min(found)
            if rank >= token:
                break
            pieces[i : i + 2] = [pieces[i] + pieces[i + 1]]
        if len(pieces) == 1:
            found = (token, token)
        else:
            found = (self.ranks[pieces[0]], self.ranks[pieces[1]]) if len(pieces) == 2 else None
        self.made[token] = found
        return found

    def fits(self, left: int, right: int) -> bool:
        """``right`` can follow ``left`` (-1: begin a piece): some merge makes it, and both stay as they are when encoded together."""
        return self.parts(right) is not None and (left < 0 or self.compatible(left, right))

    def compatible(self, left: int, right: int) -> bool:
        """Both tokens stay as they are when their bytes are encoded together.

        They are taken apart from the latest merge back. Whenever two parts face
        each other at the border, a merge of theirs must come later than the
        merges that hide them; of equal ranks the one further left comes first.
        """
        never = len(self.tokens)
        hidden_left = hidden_right = never
        tokens, ranks = self.tokens, self.ranks
        while True:
            rank = ranks.get(tokens[left] + tokens[right], never)
            if rank < hidden_left and rank <= hidden_right:
                return False
            single = len(tokens[left]) == 1, len(tokens[right]) == 1
            if all(single):
                return True
            if single[1] or (not single[0] and left > right):
                hidden_left, left = left, self.parts(left)[1]
            else:
                hidden_right, right = right, self.parts(right)[0]

    def extend(self, data: bytes, lasts: list[int]) -> None:
        """Last tokens of the prefixes of ``data`` that ``lasts`` does not have yet."""
        node = 0
        for byte in data[max(0, len(lasts) - self.longest) : len(lasts)]:
            node = self._arc(node, byte)
        self._walk(node, data[len(lasts) :], lasts)

    def _walk(self, node: int, data: bytes, lasts: list[int]) -> int:
        """Append the last token of each further prefix, from the automaton's node on; the node behind it."""
        arcs, ends, known = self.arcs, self.ends, self.known
        i = len(lasts)
        for byte in data:
            to = arcs[node].get(byte)
            node = self._arc(node, byte) if to is None else to
            for token, size in ends[node]:
                left = lasts[i - size] if i >= size else -1  # the prefix before the token
                key = left << 20 | token
                fits = known.get(key)
                if fits is None:
                    if len(known) >= PAIRS:
                        known.clear()
                    fits = known[key] = self.fits(left, token)
                if fits:
                    break
            lasts.append(token)
            i += 1
        return node

    def ids(self, lasts) -> list[int]:
        """Tokens of a piece, from its end back."""
        out, i = [], len(lasts) - 1
        while i >= 0:
            out.append(lasts[i])
            i -= len(self.tokens[lasts[i]])
        out.reverse()
        return out

    def prefixes(self, data: bytes) -> list[int]:
        """``lasts`` of a whole piece. A piece that is a token is that token, also if no merge makes it."""
        lasts: list[int] = []
        if len(data) > HEAD:
            # pieces with the same beginning have the same last tokens so far
            head = data[:HEAD]
            known = self.heads.get(head)
            if known is None:
                if len(self.heads) >= CACHE_PIECES:
                    self.heads.clear()
                node = self._walk(0, head, lasts)
                self.heads[head] = (node, tuple(lasts))
            else:
                node = known[0]
                lasts.extend(known[1])
            self._walk(node, data[HEAD:], lasts)
        else:
            self._walk(0, data, lasts)
        whole = self.ranks.get(data)
        if whole is not None:
            lasts[-1] = whole
        return lasts

    def piece(self, text: str) -> tuple[int, ...]:
        hit = self.older.get(text)
        if hit is None:
            data = text.encode()
            whole = self.ranks.get(data)
            hit = (whole,) if whole is not None else tuple(self.ids(self.prefixes(data)))
        if len(text) <= CACHED_LETTERS:
            if len(self.cache) >= CACHE_PIECES:
                self.older, self.cache = self.cache, {}
            self.cache[text] = hit
        return hit

    def encode(self, text: str) -> list[int]:
        pieces = self.split(text)
        hits = list(map(self.cache.get, pieces))
        if None in hits:
            hits = [self.cache.get(p) or self.piece(p) if h is None else h for p, h in zip(pieces, hits)]
        return list(chain.from_iterable(hits))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class Prefixes:
    """Text, ends of its pieces in characters and in bytes, and the last token of every byte prefix of each piece."""

    def __init__(self, own: Encoder, text: str, ends: list[int], stops: list[int], lasts):
        self.own, self.text, self.ends, self.stops, self.lasts = own, text, ends, stops, lasts
        self.redone = len(lasts)

    @classmethod
    def of(cls, own: Encoder, text: str) -> Prefixes:
        ends, stops, lasts = [], [], array("i")
        for match in own.matches(text):
            lasts.extend(own.prefixes(match.group().encode()))
            ends.append(match.end())
            stops.append(len(lasts))
        return cls(own, text, ends, stops, lasts)

    def ids(self) -> list[int]:
        out, begin = [], 0
        for stop in self.stops:
            out += self.own.ids(self.lasts[begin:stop])
            begin = stop
        return out

    def replaced(self, at: int, removed: int, inserted: str) -> Prefixes:
        """The state after ``removed`` characters from ``at`` on gave way to ``inserted``; ``redone`` counts the prefixes computed anew."""
        own, old = self.own, self.text
        at = min(max(at, 0), len(old))
        removed = min(max(removed, 0), len(old) - at)
        text = old[:at] + inserted + old[at + removed :]
        shift = len(inserted) - removed
        keep = 0
        while keep < len(self.ends) and self.ends[keep] + REACH <= at:
            keep += 1
        ends, stops = self.ends[:keep], self.stops[:keep]
        lasts = array("i", self.lasts[: stops[-1] if stops else 0])
        old_piece = {(self.ends[i - 1] if i else 0): i for i in range(keep, len(self.ends))}
        redone = 0
        for match in own.matches(text, ends[-1] if ends else 0):
            i = old_piece.get(match.start() - shift)
            if match.start() >= at + len(inserted) and i is not None:
                move = len(lasts) - (self.stops[i - 1] if i else 0)
                lasts.extend(self.lasts[self.stops[i - 1] if i else 0 :])
                ends += [e + shift for e in self.ends[i:]]
                stops += [s + move for s in self.stops[i:]]
                break
            data = match.group().encode()
            i = old_piece.get(match.start()) if match.start() <= at else None
            fresh, n = self._again(data, i)
            redone += n
            lasts.extend(fresh)
            ends.append(match.end())
            stops.append(len(lasts))
        out = Prefixes(own, text, ends, stops, lasts)
        out.redone = redone
        return out

    def _again(self, data: bytes, i: int | None) -> tuple[list[int], int]:
        """Numbers of a piece that starts where the old piece ``i`` did, and how many were computed."""
        own = self.own
        if i is None:
            return own.prefixes(data), len(data)
        begin, stop = (self.stops[i - 1] if i else 0), self.stops[i]
        start = self.ends[i - 1] if i else 0
        was, known = self.text[start : self.ends[i]].encode(), list(self.lasts[begin:stop])
        if was in own.ranks:  # its last number may be the token as a whole
            known = known[:-1]
        same = 0
        while same < min(len(data), len(was), len(known)) and data[same] == was[same]:
            same += 1
        lasts, shift, agree, done = known[:same], len(data) - len(was), 0, same
        while len(lasts) < len(data):
            own.extend(data[: len(lasts) + 64], lasts)
            while done < len(lasts):
                j = done - shift
                agree = agree + 1 if 0 <= j < len(known) and known[j] == lasts[done] and was[j] == data[done] else 0
                done += 1
                if agree >= own.longest and data[done:] == was[done - shift :]:
                    rest = known[done - shift :]
                    lasts[done:] = rest
                    own.extend(data, lasts)
                    return self._whole(data, lasts), done - same + len(data) - done - len(rest)
        return self._whole(data, lasts), len(data) - same

    def _whole(self, data: bytes, lasts: list[int]) -> list[int]:
        whole = self.own.ranks.get(data)
        if whole is not None:
            lasts[-1] = whole
        return lasts


_loaded: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One per process, path and pattern."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Encoder(path, pattern)
    return _loaded[path, pattern]


def free(df: DataFrame, name: str) -> str:
    """``name``, or with underscores behind it, so that no column of ``df`` has it in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _mapped(df: DataFrame, added: list[tuple[str, T.DataType, pa.DataType]], columns_of) -> DataFrame:
    """``df`` with columns appended; ``columns_of(batch)`` yields one list per new column."""
    names = [free(df, name) for name, _, _ in added]
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, kind) for n, (_, kind, _) in zip(names, added))])
    labels = [*(f"c{i}" for i in range(len(df.columns))), *names]

    def step(batches):
        for batch in batches:
            fresh = [pa.array(values, kind) for values, (_, _, kind) in zip(columns_of(batch), added)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *fresh], names=labels)

    # columns are told apart by place, so that clashing names in the table do no harm
    plain = T.StructType([T.StructField(n, f.dataType) for n, f in zip(labels, schema.fields)])
    return df.toDF(*labels[: len(df.columns)]).mapInArrow(step, plain).toDF(*schema.fieldNames())


_LIST = (T.ArrayType(T.IntegerType()), pa.list_(pa.int32()))


def with_ids(docs: DataFrame, path: str, pattern: str, text_column: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array of token ids)."""
    place = docs.columns.index(text_column)

    def columns_of(batch):
        own = encoder(path, pattern)
        return ([own.encode(t or "") for t in batch.column(place).to_pylist()],)

    return _mapped(docs, [("ids", *_LIST)], columns_of)


def decoded(encoded: DataFrame, path: str, pattern: str, ids_column: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``, the bytes of its ids; null ids give no bytes."""
    place = encoded.columns.index(ids_column)

    def columns_of(batch):
        own = encoder(path, pattern)
        return ([own.decode(ids or ()) for ids in batch.column(place).to_pylist()],)

    return _mapped(encoded, [("decoded", T.BinaryType(), pa.binary())], columns_of)


def with_prefixes(docs: DataFrame, path: str, pattern: str, text_column: str = "text") -> DataFrame:
    """``docs`` with ``ends``, ``stops`` (ends of the pieces in characters and bytes) and ``lasts`` (last token of every byte prefix)."""
    place = docs.columns.index(text_column)

    def columns_of(batch):
        own = encoder(path, pattern)
        states = [Prefixes.of(own, t or "") for t in batch.column(place).to_pylist()]
        return [s.ends for s in states], [s.stops for s in states], [s.lasts for s in states]

    return _mapped(docs, [("ends", *_LIST), ("stops", *_LIST), ("lasts", *_LIST)], columns_of)


def edited(
    states: DataFrame, path: str, pattern: str, text="text", ends="ends", stops="stops", lasts="lasts", at="at", removed="removed", inserted="inserted"
) -> DataFrame:
    """One edit per row applied to the stored numbers of ``with_prefixes``.

    ``removed`` characters from ``at`` on (null: none) give way to ``inserted``
    (null: nothing); a null ``at`` appends. Places outside the text are moved to
    its border. Adds ``new_text``, ``new_ends``, ``new_stops``, ``new_lasts``,
    ``new_ids`` and ``n_redone``, the number of prefixes computed anew.
    """
    places = [states.columns.index(c) for c in (text, ends, stops, lasts, at, removed, inserted)]

    def columns_of(batch):
        own = encoder(path, pattern)
        out: list[list] = [[], [], [], [], [], []]
        for t, e, s, numbers, where, n, more in zip(*(batch.column(p).to_pylist() for p in places)):
            t = t or ""
            state = Prefixes(own, t, e or [], s or [], array("i", numbers or [])).replaced(len(t) if where is None else where, n or 0, more or "")
            for column, value in zip(out, (state.text, state.ends, state.stops, state.lasts, state.ids(), state.redone)):
                column.append(value)
        return out

    kinds = [("new_text", T.StringType(), pa.string()), ("new_ends", *_LIST), ("new_stops", *_LIST), ("new_lasts", *_LIST), ("new_ids", *_LIST)]
    return _mapped(states, [*kinds, ("n_redone", T.LongType(), pa.int64())], columns_of)


def report(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The registered query: digests of the ids and of the decoded bytes, a text at a time, so no column of ids is kept."""

    def step(batches):
        own = encoder(path, pattern)
        decimal = own.decimal.__getitem__
        for batch in batches:
            counts, ids_digest, bytes_digest = [], [], []
            for text in batch.column(1):
                ids = own.encode(text.as_py() or "")
                counts.append(len(ids))
                ids_digest.append(hashlib.sha256(" ".join(map(decimal, ids)).encode()).hexdigest())
                bytes_digest.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_digest), pa.array(bytes_digest)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(step, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
