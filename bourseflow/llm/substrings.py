"""Exact substring removal with suffix automata.

A word goes if a window of ``min_words`` words around it also starts in a
document with a smaller id. Sending every document past the automaton of every
reference shard would grow with the square of the corpus, so documents are
routed to the shards that can match them first:

1. Every window names an anchor, the smallest hash of its ``GRAM``-word grams.
   Equal windows have equal anchors. Anchors that occur in two documents or
   more are kept with their home, the smallest document that has them.
2. Passages of home documents are the references. They are dealt to shards of
   about ``SHARD_WORDS`` words; a shard's suffix automaton is built from words
   (not hashes) and goes to every group of passages routed to that shard. A
   shard that many passages ask for serves them in several groups (salts), so
   no group grows with the number of copies; its references are copied instead.
3. Passages are streamed through the automaton. Where the matching statistic
   reaches ``min_words``, the window starts in the home document: it goes.
4. The rest, windows that are not in the home document but maybe in another
   document with the same anchor, are settled by a plain aggregation over their
   128-bit hashes (smallest document per window), with partial sums per task.

Defined cases: null text has no words; rows without id remove nothing and are
no reference; rows with the same id do not remove from each other, and equal
rows get equal results; texts shorter than the window stay whole; further
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bourseflow.llm import words as W
from bourseflow.session import cut_lineage

GRAM = 16
SHARD_WORDS = 60_000
GROUP_WORDS = 600_000


class SuffixAutomaton:
    """Suffix automaton of word sequences, kept apart by separators that match nothing."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        self.last = 0
        self._separators = 0

    def _extend(self, word) -> None:
        nxt, link, length = self.next, self.link, self.length
        cur, p = len(nxt), self.last
        nxt.append({})
        length.append(length[p] + 1)
        link.append(0)
        while p >= 0 and word not in nxt[p]:
            nxt[p][word] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][word]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(word) == q:
                    nxt[p][word] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        self.last = cur

    def add(self, words: list[bytes]) -> None:
        for word in words:
            self._extend(word)
        self._separators += 1
        self._extend(self._separators)

    def matches(self, words: list[bytes]) -> Iterator[int]:
        """Matching statistic: length of the longest match that ends at each word."""
        nxt, link, length = self.next, self.link, self.length
        state = size = 0
        for word in words:
            while state and word not in nxt[state]:
                state = link[state]
                size = length[state]
            to = nxt[state].get(word)
            if to is not None:
                state, size = to, size + 1
            yield size


def covered(sizes: list[int], min_words: int) -> list[tuple[int, int]]:
    """Maximal spans of words inside matches of ``min_words`` words or more, from the matching statistic."""
    spans: list[tuple[int, int]] = []
    for end, size in enumerate(sizes, start=1):
        if size >= min_words:
            begin = end - size
            if spans and begin <= spans[-1][1]:
                spans[-1] = (min(begin, spans[-1][0]), end)
            else:
                spans.append((begin, end))
    return spans


def _anchors(words: W.Words, min_words: int) -> np.ndarray:
    """Anchor of the window that starts at each word (windows over two texts have one too; callers leave them out)."""
    return W.sliding_min(words.runs(GRAM), min_words - GRAM + 1) if len(words.hashes) >= min_words else np.zeros(0, dtype=np.uint64)


def _digest(words: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(words)).digest()


def _fingerprint(min_words: int):
    def step(batches):
        for batch in batches:
            texts = W.as_bytes(batch.column(1))
            counts, digests, anchors = [], [], []
            for a, b in W.chunks(texts):
                words = W.Words(texts[a:b])
                names = _anchors(words, min_words).view(np.int64)
                for i in range(b - a):
                    split = texts[a + i].split()
                    counts.append(len(split))
                    digests.append(_digest(split))
                    begin, end = words.starts(i, min_words)
                    anchors.append(np.unique(names[begin:end]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(anchors, pa.list_(pa.int64()))],
                names=["doc_id", "n_words", "whole", "anchors"],
            )

    return step


def _passages(min_words: int):
    """Runs of windows with the same home, as words."""

    def step(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = W.as_bytes(batch.column(1))
            lists = batch.column(2)
            out = {k: [] for k in ("home", "doc_id", "whole", "start", "n", "words")}
            at = 0
            for a, b in W.chunks(texts):
                words = W.Words(texts[a:b])
                names = _anchors(words, min_words).view(np.int64)
                for i in range(b - a):
                    known = lists[at].values
                    order = np.argsort(anchors := known.field("anchor").to_numpy(zero_copy_only=False))
                    anchors, homes = anchors[order], known.field("home").to_numpy(zero_copy_only=False)[order]
                    begin, end = words.starts(i, min_words)
                    mine = names[begin:end]
                    if len(mine) and len(anchors):
                        split = texts[a + i].split()
                        whole = _digest(split)
                        place = np.minimum(np.searchsorted(anchors, mine), len(anchors) - 1)
                        shared = anchors[place] == mine
                        home = homes[place]
                        cut = np.flatnonzero(np.concatenate(([True], (shared[1:] != shared[:-1]) | (home[1:] != home[:-1]))))
                        for s, e in zip(cut, np.append(cut[1:], len(mine))):
                            if shared[s]:
                                run = split[s : e - 1 + min_words]
                                for k, v in zip(out, (int(home[s]), ids[at], whole, int(s), len(run), b" ".join(run))):
                                    out[k].append(v)
                    at += 1
            types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]
            for k in range(0, len(out["home"]), 2000):
                yield pa.RecordBatch.from_arrays([pa.array(v[k : k + 2000], t) for v, t in zip(out.values(), types)], names=list(out))

    return step


_VERDICT = pa.schema([("doc_id", pa.int64()), ("whole", pa.binary()), ("start", pa.int64()), ("end", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())])


def _stream(min_words: int):
    """One group: the automaton of a shard's references, and the passages routed to it."""

    def step(passages: pa.Table, references: pa.Table) -> pa.Table:
        automaton = SuffixAutomaton()
        for text in references.column("words_of").to_pylist():
            automaton.add(text.split())
        cols = [[] for _ in _VERDICT]
        ids, wholes, starts, texts = (passages.column(c).to_pylist() for c in ("doc_id", "whole", "start", "words"))
        for i, text in enumerate(texts):
            split = text.split()
            sizes = list(automaton.matches(split))
            spans = covered(sizes, min_words)
            # windows in no single match stay open, also those that straddle two matches of one span
            free = [s for s, size in enumerate(sizes[min_words - 1 :]) if size < min_words]
            hashed = W.Words([text]) if free else None
            h1 = hashed.runs(min_words, 0).view(np.int64)[free].tolist() if free else []
            h2 = hashed.runs(min_words, 1).view(np.int64)[free].tolist() if free else []
            k = len(spans) + len(free)
            cols[0] += [ids[i]] * k
            cols[1] += [wholes[i]] * k
            cols[2] += [starts[i] + s for s, _ in spans] + [starts[i] + f for f in free]
            cols[3] += [starts[i] + e for _, e in spans] + [starts[i] + f + min_words for f in free]
            cols[4] += [None] * len(spans) + h1
            cols[5] += [None] * len(spans) + h2
        return pa.table([pa.array(c, f.type) for c, f in zip(cols, _VERDICT)], schema=_VERDICT)

    return step


def _cut(batches):
    """Words that stay, from the text and its removed spans."""
    for batch in batches:
        ids = batch.column(0).to_pylist()
        texts = W.as_bytes(batch.column(1))
        out = {"doc_id": [], "whole": [], "n_removed": [], "kept": []}
        for i, (text, spans) in enumerate(zip(texts, batch.column(2).to_pylist())):
            split = text.split()
            whole = _digest(split)
            gone = np.zeros(len(split) + 1, dtype=np.int64)
            for s in spans:
                if s["whole"] == whole:
                    gone[s["start"]] += 1
                    gone[s["end"]] -= 1
            stays = np.cumsum(gone)[: len(split)] == 0
            if not stays.all():
                for k, v in zip(out, (ids[i], whole, int((~stays).sum()), b" ".join(w for w, s in zip(split, stays) if s))):
                    out[k].append(v)
        yield pa.RecordBatch.from_arrays(
            [pa.array(out["doc_id"], pa.int64()), pa.array(out["whole"], pa.binary()), pa.array(out["n_removed"], pa.int64()), pa.array(out["kept"], pa.binary()).cast(pa.string())],
            names=list(out),
        )


def remove_repeats(docs: DataFrame, min_words: int = 50, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, whole (sha256 of all words), kept``.

    ``kept`` is the text that stays (words joined by one space); null where
    nothing was removed. Ids must be integers; ``min_words`` is at least ``GRAM``.
    """
    if min_words < GRAM:
        raise ValueError(f"windows have at least {GRAM} words")
    docs = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    prints = cut_lineage(docs.mapInArrow(_fingerprint(min_words), "doc_id bigint, n_words bigint, whole binary, anchors array<bigint>"))
    places = prints.where("doc_id is not null").select("doc_id", F.explode("anchors").alias("anchor"))
    homes = places.groupBy("anchor").agg(F.min("doc_id").alias("home"), F.max("doc_id").alias("last")).where("home < last").drop("last")
    lists = places.join(homes, "anchor").groupBy("doc_id").agg(F.collect_set(F.struct("anchor", "home")).alias("homes"))
    routed = cut_lineage(docs.join(lists, "doc_id").select("doc_id", "text", "homes"))
    passages = cut_lineage(
        routed.mapInArrow(_passages(min_words), "home bigint, doc_id bigint, whole binary, start bigint, n bigint, words binary")
    )

    known = passages.where("home = doc_id")
    asked = passages.where("home < doc_id")
    total = known.agg(F.sum("n").alias("n")).first()["n"] or 0
    shards = max(1, -(-int(total) // SHARD_WORDS))
    shard = F.pmod(F.xxhash64("home"), F.lit(shards)).cast("int").alias("shard")
    load = asked.groupBy(shard).agg(F.sum("n").alias("asked")).select("shard", F.ceil(F.col("asked") / GROUP_WORDS).cast("int").alias("salts"))
    # salts depend on the words asked of a shard; both sides of the join are grouped by shard, one row each on the right
    asked = asked.withColumn("shard", shard).join(load, "shard").withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.col("salts")).cast("int"))
    known = known.withColumn("shard", shard).join(load, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    references = known.select(F.col("shard").alias("to_shard"), F.col("salt").alias("to_salt"), F.col("words").alias("words_of"))
    verdicts = cut_lineage(
        asked.select("shard", "salt", "doc_id", "whole", "start", "words")
        .groupBy("shard", "salt")
        .cogroup(references.groupBy("to_shard", "to_salt"))
        .applyInArrow(_stream(min_words), "doc_id bigint, whole binary, start bigint, end bigint, h1 bigint, h2 bigint")
    )
    matched = verdicts.where("h1 is null").select("doc_id", "whole", "start", "end")
    free = verdicts.where("h1 is not null")
    firsts = free.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    again = free.join(firsts, ["h1", "h2"]).where("doc_id > first").select("doc_id", "whole", "start", "end")
    spans = matched.unionByName(again).groupBy("doc_id").agg(F.collect_list(F.struct("whole", "start", "end")).alias("spans"))
    kept = (
        routed.select("doc_id", "text")
        .join(spans, "doc_id")
        .mapInArrow(_cut, "doc_id bigint, whole binary, n_removed bigint, kept string")
        .dropDuplicates(["doc_id", "whole"])
    )
    return (
        prints.select("doc_id", "n_words", "whole")
        .join(kept, ["doc_id", "whole"], "left")
        .select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("bigint")).alias("n_removed"), "whole", "kept")
    )


def report(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """The registered query: digests of what stays."""
    return remove_repeats(docs, min_words).select(
        "doc_id", "n_words", "n_removed", F.coalesce(F.sha2(F.col("kept").cast("binary"), 256), F.lower(F.hex("whole"))).alias("kept_sha256")
    )


def brute_force(rows: list[tuple[int | None, str | None]], min_words: int = 50) -> list[tuple]:
    """(doc_id, n_words, n_removed, kept_sha256) by a dictionary of windows, for tests."""
    split = [(i, (t or "").encode().split()) for i, t in rows]
    first: dict[tuple, int] = {}
    for i, ws in split:
        for k in range(len(ws) - min_words + 1 if i is not None else 0):
            w = tuple(ws[k : k + min_words])
            first[w] = min(first.get(w, i), i)
    out = []
    for i, ws in split:
        gone = set()
        for k in range(len(ws) - min_words + 1 if i is not None else 0):
            if first[tuple(ws[k : k + min_words])] < i:
                gone.update(range(k, k + min_words))
        kept = b" ".join(w for k, w in enumerate(ws) if k not in gone)
        out.append((i, len(ws), len(gone), hashlib.sha256(kept).hexdigest()))
    return out
