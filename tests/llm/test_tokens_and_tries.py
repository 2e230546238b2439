"""Byte-level BPE, alignment of two tokenizers and the conversation trie, against libraries and brute force."""

import base64
import hashlib
import json
import os
import random
import tracemalloc
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from bourseflow.llm import alignment, byte_bpe, convtrie

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
# the added columns' names are taken
DOCS = "doc_id bigint, text string, ids string, lasts string, n_a bigint, links string"
KEY = lambda row: tuple((x is None, x) for x in row)


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def text(rng):
    letters = rng.choice(["ab ", "aA1 .'sdlt", "é中\U0001f600a \n", "    \t\na.", "-=_*#", "".join(chr(rng.randrange(32, 0x3000)) for _ in range(8))])
    return "".join(rng.choice(letters) for _ in range(rng.randrange(60)))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = [(None, "no id"), (1, None), (2, ""), (3, " "), (4, "one  two\t\n three"), (5, "<|endoftext|> <s> </s> <0x41>"), (6, "▁x"), (7, "ﬁ ① é"), (8, "say 'll it's"), (8, "say 'll it's")]
    out += [(9, "ab" * 40_000), (10, "word and " * 20_000), (11, "x" * 5_000)]
    return out + [(i, " ".join(rng.choice(["The", "house", "of", "grün", "中文", "don't", "12"]) for _ in range(rng.randrange(80)))) for i in range(20, 60)] + [(i, text(rng)) for i in range(60, 100)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "i", "l", 0, None) for i, t in rows], DOCS).repartition(5)


def test_byte_bpe_is_the_library(library):
    own, rng = byte_bpe.encoder(RANKS, PATTERN), random.Random(5)
    for _ in range(3000):
        given = text(rng)
        assert own.encode(given) == library.encode_ordinary(given)


def test_every_prefix_has_its_last_token(library):
    own, rng = byte_bpe.encoder(RANKS, PATTERN), random.Random(6)
    for _ in range(300):
        piece = bytes(rng.choice(b"abcther ") for _ in range(rng.randrange(1, 30)))
        lasts = []
        own.extend(piece, lasts)
        for end in range(1, len(piece) + 1):
            assert own.ids(lasts[:end]) == library._encode_single_piece(piece[:end])


def test_edits_are_exact_and_local(library):
    own, rng = byte_bpe.encoder(RANKS, PATTERN), random.Random(7)
    for _ in range(2000):
        state = byte_bpe.Prefixes.of(own, text(rng) + text(rng))
        for _ in range(3):
            at = rng.choice([len(state.text), rng.randrange(len(state.text) + 1)])
            state = state.replaced(at, rng.randrange(4), rng.choice([text(rng)[:6], "", "'", "l", " "]))
            whole = byte_bpe.Prefixes.of(own, state.text)
            assert (state.ends, state.stops, list(state.lasts)) == (whole.ends, whole.stops, list(whole.lasts))
            assert state.ids() == library.encode_ordinary(state.text)
    long = byte_bpe.Prefixes.of(own, "many words in a row " * 5_000)
    assert long.replaced(50_000, 3, "new").redone < 100
    one = byte_bpe.Prefixes.of(own, "ab" * 20_000)  # no split at all
    assert one.replaced(20_000, 1, "xyz").redone < 2_000


def test_byte_bpe_columns(spark, docs, rows, library):
    want = sorted(((i, library.encode_ordinary(t or "")) for i, t in rows), key=repr)
    found = byte_bpe.with_ids(docs, RANKS, PATTERN)
    assert found.columns == [*docs.columns, "ids_"]
    assert sorted(((r["doc_id"], r["ids_"]) for r in found.collect()), key=repr) == want
    back = byte_bpe.decoded(found, RANKS, PATTERN, "ids_").select("text", "decoded").collect()
    assert all(bytes(r["decoded"]).decode() == (r["text"] or "") for r in back)
    digests = [(i, len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest()) for i, x in want]
    assert sorted((tuple(r)[:3] for r in byte_bpe.report(docs, RANKS, PATTERN).collect()), key=repr) == sorted(digests, key=repr)
    states = byte_bpe.with_prefixes(docs.select("doc_id", "text"), RANKS, PATTERN)
    edits = states.selectExpr("*", "if(doc_id % 2 = 0, null, 3) as at", "if(doc_id % 3 = 0, null, 2) as removed", "if(doc_id = 2, null, ' more text') as inserted")
    for r in byte_bpe.edited(edits, RANKS, PATTERN).collect():
        t = r["text"] or ""
        at = len(t) if r["at"] is None else min(r["at"], len(t))
        new = t[:at] + (r["inserted"] or "") + t[at + (r["removed"] or 0) :]
        assert r["new_text"] == new and r["new_ids"] == library.encode_ordinary(new)
    empty = docs.limit(0)
    assert byte_bpe.report(empty, RANKS, PATTERN).count() == byte_bpe.with_prefixes(empty, RANKS, PATTERN).count() == 0


def test_alignment(docs, rows):
    found = sorted(map(tuple, alignment.report(docs, A, B, PATTERN).collect()), key=KEY)
    assert found == sorted(alignment.brute_force(rows, A, B), key=KEY)
    assert alignment.report(docs.limit(0), A, B, PATTERN).count() == 0


def test_pieces_are_encoded_as_the_whole_text():
    own, rng = alignment.pair_of(A, B, PATTERN), random.Random(8)
    given = [" " + text(rng) for _ in range(3000)] + ["", " \x1c\x85 \u2028a\u00a0 b  ", "<|endoftext|> <|endoftext|>"]
    whole = [e.ids for e in own.a.encode_batch(given, add_special_tokens=False)]
    assert own.encode_a(given).to_pylist() == whole == own.encode_a(given).to_pylist()


def test_ranks_give_the_ids_of_the_tokenizer(monkeypatch):
    """A text is encoded in one pass over it, without being taken apart in Python; white space too long for the ranks' pattern is not."""
    own, rng = alignment.Pair(A, B, PATTERN), random.Random(21)
    given = ["", " ", " <|endoftext|> <|endoftext|>", " \x1c\x85 \u2028a\u00a0 b  ", " " + "ab" * 40_000, "x" * 9_000]
    given += [" " + text(rng) for _ in range(2000)]
    given += ["".join(f"a{chr(c)}1{chr(c)} {chr(c)}.  {chr(c)}" for c in range(at, at + 500)) for at in [*range(0, 0xD800, 500), *range(0xE000, 0x32000, 500)] if at + 500 <= 0xD800 or at >= 0xE000]
    want = [e.ids for e in own.a.encode_batch(given, add_special_tokens=False)]
    with monkeypatch.context() as m:
        m.setattr(own, "encode_a", None)
        assert own.ids_a(given).to_pylist() == want
        assert own.ids_a([]).to_pylist() == []
    long = " a" + " " * 1_000_000 + "b"
    assert own.ids_a(["c", long, "c d"]).to_pylist() == [e.ids for e in own.a.encode_batch(["c", long, "c d"], add_special_tokens=False)]


def test_files_that_are_no_ranks(tmp_path):
    """Merges out of the order of ids, a token that its merges do not reach, other settings: the tokenizer encodes."""
    with open(A, encoding="utf-8") as file:
        spec = json.load(file)
    letters = [t for t in spec["model"]["vocab"] if len(t) == 1]
    base = {t: i for i, t in enumerate(sorted(letters))}
    n, given = len(base), ["abc abcd", " bcab cabd  abc <|x|>", "aabcc"]

    def own(merges, ids=None, **model):
        made = dict(zip([a + b for a, b in merges], ids or range(n, n + len(merges))))
        added = [spec["added_tokens"][0] | {"content": "<|x|>", "id": n + len(merges)}]
        path = tmp_path / f"{len(list(tmp_path.iterdir()))}.json"
        path.write_text(json.dumps(spec | {"added_tokens": added, "model": spec["model"] | {"vocab": base | made, "merges": [list(m) for m in merges]} | model}))
        found = alignment.Pair(str(path), B, PATTERN)
        assert found.ids_a(given).to_pylist() == [e.ids for e in found.a.encode_batch(given, add_special_tokens=False)]
        return found.ranked

    assert own([("b", "c"), ("a", "b"), ("a", "bc")]) is not None
    assert own([("b", "c"), ("a", "b"), ("a", "bc")], [n + 1, n, n + 2]) is None
    assert own([("b", "c"), ("a", "b"), ("ab", "c")]) is None
    assert own([("b", "c"), ("a", "b"), ("a", "bc")], ignore_merges=True) is None


def test_a_worker_loads_the_vocabularies_once(spark):
    """Not once per task: most of the time of a small task would go into it."""
    pair_of, n = alignment.pair_of, 64

    def step(batches):
        for batch in batches:
            own = pair_of(A, B, PATTERN)
            own.tasks = getattr(own, "tasks", 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([os.getpid()]), pa.array([own.tasks])], names=["worker", "tasks"])

    found = spark.range(n, numPartitions=n).mapInArrow(step, "worker bigint, tasks bigint").collect()
    counted = Counter(r["worker"] for r in found)
    assert sum(counted.values()) == n > len(counted)
    assert all(max(r["tasks"] for r in found if r["worker"] == w) == k for w, k in counted.items())


def test_remembered_pieces_take_little_room():
    """Ids are numbers in Arrow, not a tuple of Python's numbers per piece."""
    own, rng = alignment.Pair(A, B, PATTERN), random.Random(20)
    given = [" ".join("".join(rng.choice("abcdefghij") for _ in range(8)) for _ in range(2_000)) for _ in range(10)]
    tracemalloc.start()
    own.encode_a(given)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 230 * len(own.cache)


def test_pieces_are_forgotten_in_turn(monkeypatch):
    """Few pieces are remembered and long ones are not; the ids stay those of the whole texts."""
    monkeypatch.setattr(alignment, "CACHE_PIECES", 200)
    own, rng = alignment.Pair(A, B, PATTERN), random.Random(12)
    for _ in range(30):
        given = [" " + text(rng) for _ in range(20)] + [" " + "verylongword" * 9, ""]
        assert own.encode_a(given).to_pylist() == [e.ids for e in own.a.encode_batch(given, add_special_tokens=False)]
        assert max(map(len, own.cache), default=0) <= alignment.CACHED_LETTERS and len(own.cache) + len(own.older) < 1_000


def test_links_of_tokens_that_end_together():
    """Tokens without bytes end where the one before does, also at a text's start; links are in order, within their text."""
    a = pa.table({"text": [0, 0, 0, 1, 1], "end": [0, 2, 2, 0, 3], "a_row": range(5)})
    b = pa.table({"text": [0, 0, 1, 1], "end": [1, 2, 0, 3], "b_row": range(4)})
    links = alignment._links(a, b, np.array([3, 4]))
    assert list(zip(links["a_row"].to_pylist(), links["b_row"].to_pylist())) == [(1, 1), (2, 1), (3, 2), (4, 3)]
    assert links["place"].to_pylist() == [2, 2, 3, 6]


def test_alignment_groups_and_counts(docs, rows):
    found = alignment.align(docs.where("doc_id between 20 and 60"), A, B, PATTERN)
    for r in found.collect():
        groups = [g.split("|") for g in r["groups"].split(";")] if r["groups"] else []
        assert r["n_a"] == sum(len(g[0].split(",")) for g in groups) and r["n_b"] == sum(len(g[1].split(",")) for g in groups)
    counts = alignment.pair_counts(found, A, B, PATTERN).collect()
    assert sum(r["n"] for r in counts) == sum(len(r["links"]) for r in found.collect())
    assert len({(r["a_id"], r["b_id"]) for r in counts}) == len(counts)


def test_find_close():
    rng = random.Random(9)
    for _ in range(200):
        wanted, bits, open_ = {}, [], []
        left = rng.randrange(1, 300)
        while left or open_:
            if left and (not open_ or rng.random() < 0.55):
                open_.append(len(bits))
                bits.append(True)
                left -= 1
            else:
                wanted[open_.pop()] = len(bits)
                bits.append(False)
        places = np.flatnonzero(bits)
        for block in (1, 2, 4, 64):
            assert convtrie.Excess(np.array(bits), block).find_close(places).tolist() == [wanted[p] for p in places]


def conversations(seed, n):
    rng, out = random.Random(seed), []
    for c in [*range(n), -45, -40, 10**9]:
        if rng.random() < 0.1:
            continue
        k = rng.choice([0, 1, 1, 2, 3, 5, 9])
        turns = [("user", "a b")] * k if rng.random() < 0.3 else [(rng.choice(["user", "sys", None]), rng.choice(["x", "x  y", None, "z z z"])) for _ in range(k)]
        out += [(c, t if rng.random() > 0.05 else None, *turn) for t, turn in enumerate(turns)]
    out += [(None, 0, "a", "b"), out[0], out[0]]
    # long ones with a long shared part, and one with a common text of its own
    out += [(77, t, "user", f"w{t % 3}") for t in range(400)] + [(78, t, "user", f"w{t % 3}") for t in range(390)]
    return [*out, (81, 0, "user", "long " * 50_000)]


@pytest.mark.parametrize("seed, n, options", [(1, 60, {}), (2, 300, {"shard_turns": 20, "fan": 2})])
def test_conversation_trie(spark, seed, n, options):
    rows = conversations(seed, n)
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, digest string, depth int").repartition(4)
    found = sorted(map(tuple, convtrie.prefix_nodes(table, **options).collect()), key=KEY)
    assert found == sorted(convtrie.brute_force(rows), key=KEY)


def test_conversation_trie_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert convtrie.report(empty).collect() == []
    # the head of the group is not there: its turns give way and nothing takes their place
    alone = [(3, 0, "user", "a"), (3, 1, "user", "b")]
    assert sorted(map(tuple, convtrie.report(spark.createDataFrame(alone, empty.schema)).collect())) == sorted(convtrie.brute_force(alone))
