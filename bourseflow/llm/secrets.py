"""Secret scan: fixed patterns, and formats inferred as probabilistic automata.

The fixed patterns label credentials. From a bounded sample of them one
automaton is inferred per kind: the labelled values make a prefix tree over
character classes with visit counts; states whose outgoing and ending
frequencies do not differ by more than a Hoeffding bound allows, along all
their common continuations, are merged. Loops come out of merging, so formats
of other lengths are covered. A candidate is any longer run of key characters
that no single fixed span covers wholly; its score is the mean log-likelihood
ratio per character of the best automaton against an automaton of ordinary long
words (runs of letters outside fixed spans). It becomes a span of kind
``format`` where that is positive, and a format finds it as likely per
character as all but the least likely fiftieth of its own labelled values.

Sample: of all documents, the ``SAMPLE_VALUES`` distinct labelled values with
the smallest hash per kind. Every task hands on its own smallest ones only.

Defined cases: null text is empty; a corpus without labelled values has no
automata and fixed spans only; repeated rows each get a row; texts are scanned
whole; further columns are kept by the scan and not read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from heapq import heappush, heappushpop
from itertools import accumulate
from math import log, log2, sqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bourseflow.llm.names import keeping_columns
from bourseflow.session import cut_lineage

SAMPLE_VALUES = 1_000
ALPHA = 0.01
KINDS = ("assign", "access", "hex", "format")

_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{12,}")


def fixed_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, kind, value) of the fixed patterns, by start and kind.

    A run of AKIA... or hex characters that is too short holds no longer one, so
    their least length is part of the pattern; a short assignment does use up
    its place, so it is dropped after the match.
    """
    found = [(m.start(), m.end(), 0, m.group(1)) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    found += [(m.start(), m.end(), 1, m.group()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2, m.group()) for m in _HEX.finditer(text)]
    return sorted(found)


def _uncovered(text: str, fixed: list[tuple]) -> Iterator[re.Match]:
    """Candidates that no single fixed span (sorted by start) covers wholly."""
    starts = [x[0] for x in fixed]
    reach = list(accumulate((x[1] for x in fixed), max, initial=0))
    for m in _CANDIDATE.finditer(text):
        if reach[bisect_right(starts, m.start())] < m.end():
            yield m


def _classes() -> dict[str, str]:
    table = {c: "d" for c in "0123456789"}
    table |= {c: "h" for c in "abcdef"} | {c: "l" for c in "ghijklmnopqrstuvwxyz"}
    table |= {c: "H" for c in "ABCDEF"} | {c: "U" for c in "GHIJKLMNOPQRSTUVWXYZ"}
    return table | {c: c for c in "+/_.=-"}


CLASS = _classes()
_TRANSLATE = str.maketrans(CLASS)
END = "$"


class Automaton:
    """Probabilistic automaton inferred from strings of classes."""

    def __init__(self, strings: list[str], alpha: float = ALPHA):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[Counter] = [Counter()]
        for s in strings:
            state = 0
            for c in s:
                self.count[state][c] += 1
                to = self.next[state].get(c)
                if to is None:
                    to = self.next[state][c] = len(self.next)
                    self.next.append({})
                    self.count.append(Counter())
                state = to
            self.count[state][END] += 1
        self._merge(alpha)
        totals = [sum(c.values()) for c in self.count]
        n = len(set(CLASS.values())) + 1
        # add-half estimates: a class not seen in a state is unlikely, not impossible
        self.cost = [{c: log2((k + 0.5) / (t + 0.5 * n)) for c, k in counts.items()} for counts, t in zip(self.count, totals)]
        self.rare = [log2(0.5 / (t + 0.5 * n)) for t in totals]

    def _differ(self, a: int, b: int, bound: float) -> bool:
        """Some frequency differs by more than the Hoeffding bound, here or after a common class."""
        open_ = [(a, b)]
        while open_:
            a, b = open_.pop()
            na, nb = sum(self.count[a].values()), sum(self.count[b].values())
            if not na or not nb:
                continue
            limit = bound * (1 / sqrt(na) + 1 / sqrt(nb))
            for c in {*self.count[a], *self.count[b]}:
                if abs(self.count[a][c] / na - self.count[b][c] / nb) > limit:
                    return True
            open_ += [(self.next[a][c], self.next[b][c]) for c in self.next[a] if c in self.next[b]]
        return False

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below ``b`` to ``a``."""
        open_ = [(a, b)]
        while open_:
            a, b = open_.pop()
            self.count[a] += self.count[b]
            for c, to in self.next[b].items():
                mine = self.next[a].get(c)
                if mine is None:
                    self.next[a][c] = to
                else:
                    open_.append((mine, to))

    def _merge(self, alpha: float) -> None:
        bound = sqrt(0.5 * log(2 / alpha))
        settled = [0]
        queue = [(0, c) for c in self.next[0]]
        while queue:
            # the most visited open state first
            queue = sorted({(p, c) for p in settled for c, to in self.next[p].items() if to not in settled}, key=lambda x: (-sum(self.count[self.next[x[0]][x[1]]].values()), x))
            if not queue:
                return
            parent, c = queue[0]
            state = self.next[parent][c]
            for old in settled:
                if not self._differ(old, state, bound):
                    self.next[parent][c] = old
                    self._fold(old, state)
                    break
            else:
                settled.append(state)

    def score(self, s: str) -> float:
        """Log-likelihood in bits, with the end."""
        total, state = 0.0, 0
        for c in s:
            total += self.cost[state].get(c, self.rare[state])
            state = self.next[state].get(c, state)
        return total + self.cost[state].get(END, self.rare[state])


class Formats:
    """Automata of the kinds, the automaton of ordinary words, and the score a candidate needs."""

    def __init__(self, values: dict[str, list[str]], words: list[str]):
        classed = {k: [v.translate(_TRANSLATE) for v in vs] for k, vs in values.items() if vs}
        self.kinds = {k: Automaton(vs) for k, vs in classed.items()}
        self.words = Automaton([w.translate(_TRANSLATE) for w in words] or ["l"])
        # a candidate must be as likely as all but the least likely fiftieth of the labelled values
        self.least = {}
        for k, vs in classed.items():
            own = sorted(self.kinds[k].score(v) / (len(v) + 1) for v in vs)
            self.least[k] = own[len(own) // 50]

    def fit(self, classed: str) -> float | None:
        """Bits per character by which the best format beats ordinary words; None where no format is likely enough."""
        n = len(classed) + 1
        scores = [s for k, a in self.kinds.items() if (s := a.score(classed) / n) >= self.least[k]]
        margin = max(scores) - self.words.score(classed) / n if scores else 0.0
        return margin if margin > 0 else None

    def spans(self, text: str) -> list[tuple[int, int, int, float]]:
        """All spans (start, end, kind, score) by start and kind; fixed spans have no score."""
        fixed = [(a, b, k, None) for a, b, k, _ in fixed_spans(text)]
        if not self.kinds:
            return fixed
        more = []
        for m in _uncovered(text, fixed):
            if (score := self.fit(m.group().translate(_TRANSLATE))) is not None:
                more.append((m.start(), m.end(), 3, score))
        return sorted([*fixed, *more], key=lambda x: x[:3]) if more else fixed


class _Smallest:
    """The distinct values with the smallest hash, of those that were offered."""

    def __init__(self, size: int):
        self.size = size
        self.heap: list[tuple[int, str]] = []
        self.kept: set[str] = set()

    def offer(self, value: str) -> None:
        if value in self.kept:
            return
        item = (-int.from_bytes(blake2b(value.encode(), digest_size=7).digest()), value)
        if len(self.heap) < self.size:
            heappush(self.heap, item)
        elif item > self.heap[0]:
            self.kept.discard(heappushpop(self.heap, item)[1])
        else:
            return
        self.kept.add(value)


def _values(sample_values: int):
    """Labelled values, and long runs of letters as ordinary words: the smallest by hash of a task."""

    def step(batches):
        found = {kind: _Smallest(sample_values) for kind in (*KINDS[:3], "word")}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                fixed = fixed_spans(text or "")
                for _, _, k, value in fixed:
                    found[KINDS[k]].offer(value)
                for m in _uncovered(text or "", fixed):
                    if m.group().isalpha():
                        found["word"].offer(m.group())
        rows = [(kind, value, -h) for kind, best in found.items() for h, value in best.heap]
        kinds, values, orders = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.string()), pa.array(orders, pa.int64())], names=["kind", "value", "order"])

    return step


def learn(docs: DataFrame, sample_values: int = SAMPLE_VALUES) -> Formats:
    """Infer the formats from all documents, in one scan; at most ``4 * sample_values`` values reach the driver."""
    found = cut_lineage(docs.select("text").mapInArrow(_values(sample_values), "kind string, value string, order bigint"))
    values: dict[str, list[str]] = {}
    for kind in (*KINDS[:3], "word"):
        rows = found.where(F.col("kind") == kind).distinct().orderBy("order", "value").limit(sample_values).collect()
        values[kind] = [r["value"] for r in rows]
    words = values.pop("word")
    return Formats(values, words)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("score", pa.float64())]))


def scan(docs: DataFrame, formats: Formats, text_column: str = "text") -> DataFrame:
    """``docs`` with ``_spans``: start, end (characters), kind, and score of inferred spans."""
    shared = docs.sparkSession.sparkContext.broadcast(formats)
    names = docs.columns

    def step(batches):
        formats = shared.value
        for batch in batches:
            rows = [
                [{"start": a, "end": b, "kind": KINDS[k], "score": s} for a, b, k, s in formats.spans(t or "")]
                for t in batch.column(names.index(text_column)).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, _SPANS)], names=[*names, "_spans"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(step, f"{fields}, _spans array<struct<start:bigint,end:bigint,kind:string,score:double>>")


def redact(docs: DataFrame, formats: Formats, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by ``mark`` (overlapping spans by one); ``n_chars`` follows where there is one.

    Other columns may have any names.
    """
    return keeping_columns(docs, ["text", "n_chars"], lambda d: _redacted(d, formats, mark))


def _redacted(docs: DataFrame, formats: Formats, mark: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(formats)
    names = docs.columns

    def step(batches):
        formats = shared.value
        for batch in batches:
            texts = []
            for text in batch.column(names.index("text")).to_pylist():
                parts, at = [], 0
                for a, b, _, _ in formats.spans(text or ""):
                    if a >= at:
                        parts += [text[at:a], mark]
                    at = max(at, b)
                texts.append("".join([*parts, text[at:]]) if parts else text)
            columns = list(batch.columns)
            columns[names.index("text")] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    out = docs.mapInArrow(step, fields)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def report(docs: DataFrame) -> DataFrame:
    """The registered query."""
    found = scan(docs.select("doc_id", "text"), learn(docs)).drop("text")
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("_spans", lambda s: s["kind"] != "format")
    of = lambda kind: F.size(F.filter("_spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    counts = [of(kind) for kind in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("_spans")).alias("spans"))
