"""Toxicity by a weighted grammar of finite-state transducers.

Five small machines read the words of a clause as classes: *insult* and
*threat* give weight, *target*, *negation* and *reported speech* scale what the
others give. They are composed once into a single machine, whose arcs carry the
next state, the factor and the extra weight. A document's evidence is the sum
over its clauses that hold a head (an insult or a threat word), so words count
by the clause they stand in: "you are a fool" weighs more than "not a fool" or
"they called him a fool".

The insult lexicon holds seed words, and words and stems (a word's first 4 to 7
letters, any ending) learned from labelled rows: one is taken if its rows are
mostly toxic and its neighbours vary (sixteen buckets of the word before it),
so that words of one much-copied toxic document are not mistaken for insults. A two-parameter logistic curve on the evidence
gives the score. Both are fitted on at most ``SAMPLE_ROWS`` labelled rows,
those with the smallest hash of their id.

Never inputs of a score: labels, language, source, id.

Defined cases: null and empty texts have no evidence and get the base score; a
text is scored whole, of any length; without labels the seed grammar and a
fixed curve score; repeated rows each get a row; a label given twice counts
twice; further columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from math import exp, log, log1p

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bourseflow.llm.names import keeping_columns

SAMPLE_ROWS = 20_000
LEXICON_WORDS = 2_000
BUCKETS = 16
STEMS = (4, 5, 6, 7)
THRESHOLD = 0.7

INSULT, THREAT, TARGET, NEGATION, REPORT, INTENT, OTHER = range(7)

#: Seed words of each class.
SEEDS = {
    INSULT: "idiot moron fool loser scum trash clown stupid dumb worthless pathetic disgusting vermin imbecile".split(),
    THREAT: "kill hurt destroy beat shoot stab strangle".split(),
    TARGET: "you your yours he him she her they them their this that these those".split(),
    NEGATION: "not never no nor neither without hardly".split(),
    REPORT: "said says say called calls wrote writes quoted quotes claimed claims told according allegedly".split(),
    INTENT: "will shall gonna going must should want".split(),
}
SEED_WEIGHT = 1.5
THREAT_WEIGHT = 2.0

_WORD = re.compile(r"[^\W\d_]+")
_CLAUSE_END = re.compile(r"[.!?;:\n]")


@dataclass(frozen=True)
class Machine:
    """Arcs ``(state, class) -> (next, factor, extra)``; a missing arc goes to ``(rest[state], 1, 0)``."""

    arcs: dict[tuple[int, int], tuple[int, float, float]]
    rest: tuple[int, ...]

    def step(self, state: int, kind: int) -> tuple[int, float, float]:
        return self.arcs.get((state, kind), (self.rest[state], 1.0, 0.0))


def grammar() -> list[Machine]:
    """The five machines. State 0 is the start of a clause."""
    heads = (INSULT, THREAT)
    insult = Machine({(0, INSULT): (0, 1.0, 0.0)}, (0,))
    # intent, then a threat verb within three words, then a target within three words
    threat = Machine(
        {(s, INTENT): (1, 1.0, 0.0) for s in range(7)}
        | {(s, THREAT): (4, 1.0, 0.0) for s in (1, 2, 3)}
        | {(s, TARGET): (0, 1.0, THREAT_WEIGHT) for s in (4, 5, 6)},
        (0, 2, 3, 0, 5, 6, 0),
    )
    target = Machine({(0, TARGET): (1, 1.0, 0.0)} | {(1, h): (1, 1.4, 0.0) for h in heads}, (0, 1))
    # a negation reaches three words on
    negation = Machine(
        {(s, NEGATION): (1, 1.0, 0.0) for s in range(4)}
        | {(s, h): (0, 0.2, 0.0) for s in (1, 2, 3) for h in heads}
        | {(s, TARGET): (s, 1.0, 0.0) for s in (1, 2, 3)},
        (0, 2, 3, 0),
    )
    reported = Machine({(0, REPORT): (1, 1.0, 0.0)} | {(1, h): (1, 0.5, 0.0) for h in heads}, (0, 1))
    return [insult, threat, target, negation, reported]


def compose(machines: Iterable[Machine]) -> list[list[tuple[int, float, float]]]:
    """Product of the machines: reachable states only; factors multiply, extras add up."""
    machines = list(machines)
    start = (0,) * len(machines)
    number, table, open_ = {start: 0}, [], [start]
    while open_:
        state = open_.pop(0)
        row = []
        for kind in range(7):
            moves = [m.step(s, kind) for m, s in zip(machines, state)]
            to = tuple(m[0] for m in moves)
            if to not in number:
                number[to] = len(number)
                open_.append(to)
            factor = float(np.prod([m[1] for m in moves]))
            row.append((number[to], factor, sum(m[2] for m in moves) * factor))
        table.append(row)
    return table


class Scorer:
    """Evidence of whole texts, from a lexicon ``word or stem* -> weight`` and the composed machine."""

    def __init__(self, lexicon: dict[str, float]):
        self.kinds = {w: kind for kind, words in SEEDS.items() for w in words}
        self.weights = dict.fromkeys(SEEDS[INSULT], SEED_WEIGHT) | {w: x for w, x in lexicon.items() if w[-1] != "*"}
        self.kinds |= dict.fromkeys(self.weights, INSULT)
        self.stems = {w[:-1]: x for w, x in lexicon.items() if w[-1] == "*"}
        self.table = compose(grammar())
        self.heads = ahocorasick.Automaton()
        for word in [*self.stems, *(w for w, kind in self.kinds.items() if kind in (INSULT, THREAT))]:
            self.heads.add_word(word, len(word))
        self.heads.make_automaton()

    def kind(self, word: str) -> tuple[int, float]:
        """Class of a word, and its weight if it is an insult."""
        known = self.kinds.get(word)
        if known is not None:
            return known, self.weights.get(word, 0.0)
        for k in STEMS:
            if (weight := self.stems.get(word[:k])) is not None and len(word) > k:
                return INSULT, weight
        return OTHER, 0.0

    def clause(self, text: str) -> float:
        state, total = 0, 0.0
        for word in _WORD.findall(text):
            kind, weight = self.kind(word)
            state, factor, extra = self.table[state][kind]
            total += extra + weight * factor
        return total

    def clauses(self, text: str | None) -> list[tuple[int, int, float]]:
        """Start, end and weight of every clause with a head word."""
        low = (text or "").lower()
        found, done = [], 0
        for last, size in self.heads.iter(low):
            begin, end = last - size + 1, last + 1
            if begin < done or (begin and _WORD.match(low[begin - 1])):
                continue
            end = _WORD.match(low, begin).end()
            if self.kind(low[begin:end])[0] not in (INSULT, THREAT):
                continue
            a = 1 + max(low.rfind(c, done, begin) for c in ".!?;:\n")
            a = max(a, done)
            b = m.start() if (m := _CLAUSE_END.search(low, end)) else len(low)
            found.append((a, b, self.clause(low[a:b])))
            done = b
        return found


@dataclass(frozen=True)
class Model:
    lexicon: dict[str, float]
    base: float = -2.0
    slope: float = 4.0

    def score(self, evidence: float) -> float:
        return 1 / (1 + exp(-max(-50.0, min(50.0, self.base + self.slope * log1p(evidence)))))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def _count_words(batches):
    """Per word and stem: toxic rows by a bucket of the word before its first place, and other rows."""
    counts: dict[str, list[int]] = {}
    buckets: dict[str, int] = {}
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            seen: set[str] = set()
            before = ""
            for word in _WORD.findall((text or "").lower()):
                for form in (word, *(word[:k] + "*" for k in STEMS if len(word) > k)):
                    if form in seen:
                        continue
                    seen.add(form)
                    row = counts.setdefault(form, [0] * (BUCKETS + 1))
                    if toxic:
                        if before not in buckets:
                            buckets[before] = int.from_bytes(before.encode()[-4:], "little") * 2654435761 % 2**32 // (2**32 // BUCKETS) % BUCKETS
                        row[buckets[before]] += 1
                    else:
                        row[BUCKETS] += 1
                before = word
            if len(counts) > 200_000:
                yield _count_rows(counts)
                counts, buckets = {}, {}
    yield _count_rows(counts)


def _count_rows(counts: dict[str, list[int]]) -> pa.RecordBatch:
    columns = np.array(list(counts.values()), dtype=np.int64).reshape(len(counts), BUCKETS + 1)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(counts), pa.string()), *(pa.array(columns[:, k], pa.int64()) for k in range(BUCKETS + 1))],
        names=["word", *(f"t{k}" for k in range(BUCKETS)), "clean"],
    )


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit the lexicon and the curve on at most ``sample_rows`` labelled rows outside the held-out fold."""
    marks = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(~held_out() & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    # which rows: by a hash of the id; at most sample_rows small rows come to the driver's broadcast
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")
    toxic = sum((F.col(f"t{k}") for k in range(BUCKETS)), F.lit(0))
    squares = sum((F.col(f"t{k}") * F.col(f"t{k}") for k in range(BUCKETS)), F.lit(0))
    fields = ", ".join(f"t{k} bigint" for k in range(BUCKETS))
    totals = sample.groupBy("toxic").count().collect()
    n = {bool(r["toxic"]): r["count"] for r in totals}
    if not n.get(True) or not n.get(False):
        return Model({})
    prior = log(n[True] / n[False])
    counted = sample.mapInArrow(_count_words, f"word string, {fields}, clean bigint").groupBy("word").agg(
        *(F.sum(f"t{k}").alias(f"t{k}") for k in range(BUCKETS)), F.sum("clean").alias("clean")
    )
    taken = (
        counted.select("word", toxic.alias("toxic"), squares.alias("squares"), "clean")
        .where((F.col("toxic") >= 8) & (F.col("toxic") >= 4 * F.col("clean")) & (F.col("toxic") * F.col("toxic") >= 4 * F.col("squares")))
        .orderBy(F.desc("toxic"), "word")
        .limit(LEXICON_WORDS)
        .collect()
    )
    known = {w for words in SEEDS.values() for w in words} - set(SEEDS[INSULT])
    rows = {r["word"]: r for r in taken}
    # a stem that brings clean rows which one of its longer forms leaves out, with most of its toxic rows, gives way to it
    purer = {
        w[:k] + "*"
        for w, r in rows.items()
        for k in STEMS
        if len(w.rstrip("*")) > k and (s := rows.get(w[:k] + "*")) and r["clean"] < s["clean"] and r["toxic"] >= 0.8 * s["toxic"]
    }
    chosen = rows.keys() - purer
    lexicon = {
        r["word"]: max(0.5, min(3.0, (log((r["toxic"] + 0.5) / (r["clean"] + 0.5)) - prior) / 3)) for r in taken
        # a shorter stem stands for its longer forms
        if r["word"] in chosen and r["word"] not in known and not any(r["word"][:k] + "*" in chosen for k in STEMS if len(r["word"].rstrip("*")) > k)
    }
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def weigh(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            evidence = [round(sum(c[2] for c in scorer.clauses(t)) * 4) / 4 for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(evidence, pa.float64()), batch.column(1).cast(pa.int32())], names=["evidence", "toxic"])

    capped = F.least("evidence", F.lit(50.0)).alias("evidence")  # the curve is flat there; keeps the table small
    table = sample.mapInArrow(weigh, "evidence double, toxic int").groupBy(capped, "toxic").count().collect()
    return Model(lexicon, *_curve([(log1p(r["evidence"]), r["toxic"] > 0, r["count"]) for r in table]))


def _curve(points: list[tuple[float, bool, int]]) -> tuple[float, float]:
    """Logistic regression on one input, by damped Newton steps with a slight penalty on the slope."""
    x, y, n = (np.array(c, dtype=float) for c in zip(*points))
    design = np.stack([np.ones_like(x), x])
    beta = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(beta @ design, -30, 30)))
        gradient = design @ (n * (y - p)) - np.array([0, 0.01]) * beta
        hessian = (design * (n * p * (1 - p))) @ design.T + np.diag([1e-6, 0.01])
        move = np.linalg.solve(hessian, gradient)
        beta += move * min(1.0, 4 / max(1e-9, np.abs(move).max()))
    return float(beta[0]), float(max(0.0, beta[1]))


def score(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """``docs`` with ``_score`` and ``_clauses`` (start, end, weight of each matched clause, in characters of the lower-cased text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("weight", pa.float64())]))

    def step(batches):
        model = shared.value
        scorer = Scorer(model.lexicon)
        for batch in batches:
            clauses = [scorer.clauses(t) for t in batch.column(names.index(text_column)).to_pylist()]
            scores = [model.score(sum(c[2] for c in cs)) for cs in clauses]
            rows = [[{"start": a, "end": b, "weight": w} for a, b, w in cs] for cs in clauses]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array(rows, kind)], names=[*names, "_score", "_clauses"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(step, f"{fields}, _score double, _clauses array<struct<start:bigint,end:bigint,weight:double>>")


def remove_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Documents scored below the threshold, with their own columns, whatever their names."""
    return keeping_columns(docs, ["doc_id", "text"], lambda d: score(d, model).where(F.col("_score") < threshold).drop("_score", "_clauses"))


def report(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The registered query."""
    scored = score(docs.select("doc_id", "text"), learn(docs, labels))
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= threshold).cast("int").alias("predicted"),
        F.size("_clauses").alias("n_clauses"),
    )
