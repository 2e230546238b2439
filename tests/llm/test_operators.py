"""Every operator on small tables with awkward rows, against brute force or the tokenizers library."""

import hashlib
import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from bourseflow.llm import bpe, decontaminate, html, jaccard, licenses, secrets, substrings, toxicity, vptree, warc

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, words string"
PATH = public_tokenizers.path("word_bpe_49k.json")


def texts():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4)))
    passage = [word() for _ in range(70)]
    rows = [(None, "no id here " * 40), (3, None), (4, ""), (5, "  \n\t "), (6, "One"), (7, "one"), (8, "Zwei Wörter"), (8, "Zwei Wörter")]
    base = [word() for _ in range(300)]
    for i in range(10, 40):
        copy = list(base)
        for _ in range(i % 7):
            copy[rng.randrange(300)] = word()
        rows.append((i, " ".join(copy)))
    for i in range(40, 60):
        own = [word() for _ in range(rng.randint(0, 90))]
        rows.append((i, " ".join(own[:20] + passage[rng.randint(0, 15) :] + own[20:])))
    rows.append((60, " ".join(word() for _ in range(60_000))))  # a very long text
    rows += [(61, rows[20][1]), (61, rows[21][1])]  # one id, two texts
    return rows


@pytest.fixture(scope="module")
def rows():
    return texts()


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None, None, "x") for i, t in rows], DOCS).repartition(5)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows)


def test_substrings(docs, rows):
    got = sorted(map(tuple, substrings.report(docs).collect()), key=repr)
    assert got == sorted(substrings.brute_force(rows), key=repr)
    assert any(r[2] for r in got)


def test_substrings_at_seams(spark):
    rng, rows = random.Random(11), []
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    for g in range(0, 80, 4):
        a, b = words(60), words(60)
        edited = [*b[:30], "edited", *b[31:]]
        # a deletion at the same place in two copies, and one more edit within a window of the seam
        rows += [(g, " ".join([*a, "x", *b])), (g + 1, " ".join(a + b)), (g + 2, " ".join(a + b)), (g + 3, " ".join(a + edited))]
    got = sorted(map(tuple, substrings.report(frame(spark, rows)).collect()))
    assert got == sorted(substrings.brute_force(rows))
    assert {r[2] for r in got if r[0] % 4 == 3} == {90}


@pytest.mark.parametrize("options", [{}, {"n": 5, "percent": 80}, {"percent": 80, "cell_values": 2000, "levels": 2}, {"percent": 80, "cell_values": 1000, "levels": 0}])
def test_jaccard(docs, rows, options):
    found = jaccard.similar_components(docs, **options).select("doc_id", "n_shingles", "component_id").collect()
    wanted = jaccard.brute_force(rows, options.get("n", 3), options.get("percent", 90))
    assert sorted(map(tuple, found), key=repr) == sorted(wanted, key=repr)


@pytest.mark.parametrize("options", [{}, {"cell_values": 20_000}, {"cell_values": 20_000, "copies": 0}])
def test_jaccard_in_a_family(spark, options):
    """Copies of one text with a few changed words: hardly any are linked, and all are near every pivot."""
    rng = random.Random(5)
    base, family = [f"w{i}" for i in range(300)], []
    for i in range(400):
        copy = list(base)
        for _ in range(rng.randint(2, 9)):
            copy[rng.randrange(300)] = f"x{rng.randrange(10**6)}"
        family.append((i, " ".join(copy)))
    found = jaccard.similar_components(frame(spark, family), **options).select("doc_id", "n_shingles", "component_id").collect()
    wanted = jaccard.brute_force(family)
    assert sorted(map(tuple, found)) == sorted(wanted)
    assert 20 < len({c for _, _, c in wanted}) < 400


def thue_morse(k):
    """Complementary words of ``2 ** k`` letters, which hashes linear in the letters take for equal."""
    a, b = "a", "b"
    for _ in range(k):
        a, b = a + b, b + a
    return a, b


def test_words_that_collide_by_construction(spark):
    a, b = thue_morse(11)
    rows = [(1, f"x {a} y"), (2, f"x {b} y")]
    found = jaccard.similar_components(frame(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, found)) == sorted(jaccard.brute_force(rows)) == [(1, 1, 1), (2, 1, 2)]
    side = " ".join(f"w{i}" for i in range(45))
    rows = [(1, f"{side} zz {side}"), (2, f"{side} {a} {side}"), (3, f"{side} {b} {side}")]
    assert sorted(map(tuple, substrings.report(frame(spark, rows)).collect())) == sorted(substrings.brute_force(rows))
    # runs of words in that order
    first, second = (" ".join("one" if c == "a" else "two" for c in x[:64]) for x in thue_morse(6))
    rows = [(1, first), (2, second)]
    assert sorted(map(tuple, substrings.report(frame(spark, rows)).collect())) == sorted(substrings.brute_force(rows))


@pytest.mark.parametrize("percent", [50, 80, 90, 97])
def test_samples_share_enough(percent):
    """Linked sets share as many of their samples as either needs; enough of them that few others do."""
    rng = random.Random(percent)
    for size in (1, 2, 5, 19, 60, 333, 1000):
        for _ in range(20):
            k = size * percent // 100 + rng.randint(0, size // 9)
            common = max(1, min(size, k))
            both = rng.sample(range(10**6), 2 * size)
            a, b = sorted(both[:size]), sorted(both[size - common : size] + both[size : size + rng.randint(0, size - common)])
            shared = len(set(a) & set(b))
            if 100 * shared >= percent * (len(a) + len(b) - shared):
                samples = [(set(x[:n]), need) for x in (a, b) for n, need in [jaccard.sample_size(len(x), percent)]]
                assert len(samples[0][0] & samples[1][0]) >= max(samples[0][1], samples[1][1])
    assert jaccard.sample_size(1000, percent)[1] >= 1000 * percent // 100 // 10


def cell(sets, side):
    nodes = [i.to_bytes(16, "big") for i in range(len(sets))]
    shingles = pa.array([s.tobytes() for s in sets], pa.binary())
    return pa.table({"cell": nodes[:1] * len(sets), "node": nodes, "label": nodes, "outer": [True] * len(sets), "side": pa.array(side, pa.int32()), "shingles": shingles})


def test_jaccard_cell_connects_what_is_linked():
    """Against all pairs; also in blocks, and where the table is a slice of a larger one."""
    rng = np.random.default_rng(5)
    for sides in ([-1], [0, 1]):
        base = rng.integers(0, 2**63, 40, dtype=np.uint64)
        sets = [np.unique(np.where(rng.random(40) < rng.choice([0.02, 0.2, 0.9]), rng.integers(0, 2**63, 40, dtype=np.uint64), base)) for _ in range(60)]
        side = [sides[i % len(sides)] for i in range(60)]
        common = lambda a, b: len(np.intersect1d(sets[a], sets[b]))
        wanted = list(range(60))
        for a in range(10, 60):
            for b in range(a):
                if b >= 10 and (side[a] < 0 or side[a] != side[b]) and 100 * (k := common(a, b)) >= 80 * (len(sets[a]) + len(sets[b]) - k):
                    wanted = [wanted[b] if x == wanted[a] else x for x in wanted]
        found = list(range(60))
        for r in jaccard._join_cell(80)(cell(sets, side).slice(10)).to_pylist():
            a, b = (int.from_bytes(r[c], "big") for c in "ab")
            found = [found[b] if x == found[a] else x for x in found]
        assert [wanted.index(x) for x in wanted] == [found.index(x) for x in found] and len(set(found)) < 60


def test_jaccard_cell_holds_few_copies_of_its_sets():
    """A cell of 16 MB of shingles, as large as one gets."""
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    table = cell([np.unique(np.concatenate((base[i % 100 :], rng.integers(0, 2**63, i % 100, dtype=np.uint64)))) for i in range(2000)], [-1] * 2000)
    # most are connected with the pivot already
    table = table.set_column(table.schema.get_field_index("outer"), "outer", pa.array([i % 100 == 99 for i in range(2000)]))
    tracemalloc.start()
    jaccard._join_cell(80)(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5 * table.column("shingles").nbytes


def test_jaccard_moves_no_texts_that_stay(spark):
    """Rows that are surely kept are told by a table of bits; sizes rule out pairs before sets move."""
    rows = frame(spark, [(i, f"t{i}") for i in range(300)] + [(None, "x"), (-5, "y"), (-5, "z")])
    ids = spark.createDataFrame([(7,), (-5,), (7 + jaccard.ID_BITS,), (64,)], "doc_id bigint")
    away = {r["doc_id"] for r in jaccard._untouched(rows, ids, "doc_id").collect()}
    assert away == set(range(300)) - {7, 64}
    assert sorted(r["text"] for r in jaccard._thinned(rows, ids).collect()) == ["t64", "t7", "y", "z"]
    sets = spark.createDataFrame([(b"a", 100), (b"b", 90), (b"c", 89)], "node binary, size bigint")
    pairs = spark.createDataFrame([(b"a", b"b"), (b"a", b"c"), (b"c", b"b")], "pivot binary, node binary")
    assert sorted((r["pivot"], r["node"]) for r in jaccard._fitting(pairs, sets, 90).collect()) == [(b"a", b"b"), (b"c", b"b")]


def test_jaccard_keeps_one_of_each(docs, rows):
    kept = [r["doc_id"] for r in jaccard.keep_first(docs).collect()]
    firsts = {c for _, n, c in jaccard.brute_force(rows, 5, 80) if n and c is not None}
    assert firsts <= set(kept) and {3, 4, 5, None} <= set(kept)
    assert set(kept) <= firsts | {3, 4, 5, None}


def test_jaccard_keeps_clean_texts_of_a_shared_id(spark):
    one, two, three = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, one), (1, two), (1, one), (2, one), (None, two), (None, three), (None, three), (7, ""), (7, three), (8, None), (8, None)]
    kept = [(r["doc_id"], r["text"]) for r in jaccard.keep_first(frame(spark, rows)).collect()]
    assert sorted(kept, key=repr) == sorted([(1, one), (1, two), (7, ""), (7, three), (8, None), (8, None)], key=repr)
    named = frame(spark, rows).toDF("doc_id", "text", "node", "label", "cell", "pivot", "value")
    assert jaccard.keep_first(named).columns == named.columns and jaccard.keep_first(named).count() == 6
    assert jaccard.keep_first(named.limit(0)).count() == 0


def test_decontamination(spark, docs, rows):
    items = [(1, " ".join(rows[15][1].split()[40:80])), (2, "zwei wörter"), (3, None), (4, ""), (5, rows[45][1]), (5, "ONE")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    wanted = sorted(((i, *r) for (i, _), r in zip(rows, decontaminate.brute_force([t for _, t in rows], items))), key=repr)
    for block in (decontaminate.BLOCK_WORDS, 30):  # in one broadcast, and in several passes
        got = decontaminate.report(docs, bench, block_words=block, shard_bytes=2000).drop("longest_match").collect()
        assert sorted(map(tuple, got), key=repr) == wanted
    kept = decontaminate.remove_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not r[5] for r in wanted)
    empty = decontaminate.report(docs, bench.limit(0)).collect()
    assert len(empty) == len(rows) and not any(r["contaminated"] for r in empty)


def longest_by_hand(text, items):
    from bourseflow.llm import words as W

    low = lambda t: (t or "").encode().translate(W.LOWER_ALNUM).split()
    ws, best = low(text), (0, -1)
    for _, item in items:
        row = [0] * (len(ws) + 1)
        for word in reversed(low(item)):  # longest common prefixes with the item's suffixes
            row = [row[i + 1] + 1 if ws[i] == word else 0 for i in range(len(ws))] + [0]
            best = max(best, max(((n, -i) for i, n in enumerate(row) if n), default=best))
    return best[0], abs(best[1]) if best[0] else -1


def test_longest_match(spark):
    rng = random.Random(9)
    word = lambda: rng.choice("abcdefgh")
    items = [(k, " ".join(word() for _ in range(rng.randint(1, 60)))) for k in range(8)] + [(8, None), (9, "rare " * 5)]
    rows = []
    for i in range(40):
        a = rng.randint(0, 20)
        rows.append((i, " ".join([*(word() for _ in range(a)), "x", *items[i % 8][1].split()[: 50 - a], "y", *(word() for _ in range(a))])))
    rows += [(i + 100, rows[i // 5][1]) for i in range(40)]  # copies of one document, in one shard
    rows += [(200, None), (201, "x y"), (202, "rare"), (203, items[0][1]), (204, "x A, b")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    wanted = [longest_by_hand(t, items) for _, t in rows]
    for options in ({}, {"shard_bytes": 300}, {"block_words": 40}):
        found = decontaminate.find_matches(frame(spark, rows), bench, **options)
        got = {r["doc_id"]: (r["_longest"], r["_longest_at"]) for r in found.collect()}
        assert [got[i] for i, _ in rows] == wanted


def test_bpe_is_exact(docs, rows):
    library = Tokenizer.from_file(PATH)
    library.no_padding()
    library.no_truncation()
    wanted = []
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        wanted.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert sorted(map(tuple, bpe.report(docs, PATH).collect()), key=repr) == sorted(wanted, key=repr)
    ids = bpe.with_ids(docs.select("doc_id", "text"), PATH)
    assert sorted(len(r["_decoded"]) for r in bpe.decoded(ids, PATH).collect()) == sorted(
        len(library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False)) for _, t in rows
    )


def test_bpe_odd_letters():
    own, library, rng = bpe.encoder(PATH), Tokenizer.from_file(PATH), random.Random(3)
    letters = "aaabcdeinorst'́éİΣσßǅ.,!<|endoftext|>\t\n\x1c\x85  　中文한🙂👍🏽0½²ⅧﬁſKÅ\x00\x7f"
    for k in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) + ("<|endoftext|>x" if k % 5 == 0 else "")
        assert list(own.encode(text)) == library.encode(text, add_special_tokens=False).ids


def test_licenses(spark):
    rows = [(1, "x. Licensed under CC BY-NC 4.0."), (2, "All rights\nreserved. all RIGHTS reserved cc by"), (3, None), (None, "GNU General Public License"), (4, "all rights"), (2, "All rights\nreserved. all RIGHTS reserved cc by"), (5, "Released under the MIT License")]
    got = {(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"]) for r in licenses.report(frame(spark, rows)).collect()}
    assert got == {
        (1, 8, 1, 3, 3, "cc-by", "cc-by,cc-by-nc"),
        (2, 8, 3, 0, 6, "cc-by,reserved", "cc-by,reserved"),
        (3, 0, 0, None, None, "", ""),
        (None, 4, 1, 1, 1, "gpl", "gpl"),
        (4, 2, 0, None, None, "", ""),
        (5, 5, 0, None, None, "", "mit"),
    }
    assert licenses.report(frame(spark, rows)).count() == len(rows)
    nodes = licenses.report(frame(spark, rows))._jdf.queryExecution().toString()
    assert "Python" not in nodes and "Arrow" not in nodes


def test_toxicity(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(400):
        ws = [rng.choice("der die das und mit von ein zu im auf".split()) for _ in range(30)]
        toxic = i % 4 == 0
        if toxic:
            ws.insert(rng.randrange(30), "schurk" + rng.choice(["e", "en", "isch", "erei"]))
        rows.append((i, " ".join(ws) + "."))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, None), (1001, "")]
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    found = {r["doc_id"]: r for r in toxicity.report(frame(spark, rows), table).collect()}
    held = [i for i, _, _ in labels if found[i]["held_out"]]
    assert len(held) > 80 and sum(found[i]["predicted"] == labels[i][2] for i in held) >= 0.95 * len(held)
    assert found[1000]["score"] == found[1001]["score"] < 0.7
    none = toxicity.report(frame(spark, rows[:5]), table.limit(0)).collect()
    assert all(0 <= r["score"] <= 1 for r in none)


def test_toxic_clauses():
    weight = lambda t: sum(c[2] for c in toxicity.Scorer({"schurk*": 2.0}).clauses(t))
    assert weight("You are an idiot") > weight("an idiot") > weight("he said an idiot") > weight("not an idiot") > 0
    assert weight("I will kill you") > 0 == weight("they kill time")
    assert weight("der Schurken") == 2.0 and weight("schurk") == 0 and weight("xschurken") == 0 and weight(None) == 0


def test_secrets(spark):
    rng = random.Random(4)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(60)]
    rows = [(i, f'some words here token = "{h}" internationalization') for i, h in enumerate(hexes)]
    rows += [(100, None), (101, ""), (102, "token = secret = abcdefghijkl9"), (103, "PassWord:'abcdefghijkl' AKIAABCDEFGHIJKLMN AKIA123"), (104, "key deadbeef01234567-0123456789abcdef")]
    found = {r["doc_id"]: r for r in secrets.report(frame(spark, rows)).collect()}
    assert (found[0]["n_assign"], found[0]["n_access"], found[0]["n_hex"]) == (1, 0, 1)
    assert found[100]["spans"] == found[101]["spans"] == found[102]["spans"] == ""
    assert found[103]["spans"] == "assign:0:22,access:24:42"
    assert found[103]["base_sha256"] == hashlib.sha256(b"assign:0:22,access:24:42").hexdigest()
    assert found[104]["n_hex"] == 2
    formats = secrets.learn(frame(spark, rows))
    assert formats.fit("9d41d8cd98f00b204e9800998ecf8427ea0b1c2d".translate(secrets._TRANSLATE)) and formats.fit("internationalization2".translate(secrets._TRANSLATE)) is None
    clean = secrets.redact(frame(spark, rows), formats)
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert texts[0] == 'some words here [SECRET]" internationalization' and texts[100] is None
    assert secrets.report(frame(spark, [(1, "x")])).count() == 1


def test_secrets_learn_from_all_documents(spark):
    rng = random.Random(6)
    key = lambda n=24: "".join(rng.choice("ABCDEFGHJKMNPQRSTUVWXYZ0123456789") for _ in range(n))
    plain = [(i, f"plain words internationalization misunderstandings {i}") for i in range(40)]
    rare = [(100 + i, f"token: {key()} internationalization") for i in range(5)]  # fewer than 20 values of the kind
    other = [(None, f"secret={key()}"), (200, f"see {key()} there"), (201, "see internationalization there"), (202, "see QRSTUVWXYZQRST0123456789012345 there")]
    docs = frame(spark, plain + rare + other)
    found = {r["doc_id"]: r["spans"] for r in secrets.report(docs).collect()}
    assert found[200] == "format:4:28" and found[201] == found[0] == ""
    assert found[202] == "format:4:34,hex:18:34"  # a fixed span inside does not hide the run around it
    formats = secrets.learn(docs)
    # one scan keeps the same bounded sample, however the rows are dealt
    assert [(k, a.count) for k, a in formats.kinds.items()] == [(k, a.count) for k, a in secrets.learn(docs.repartition(3)).kinds.items()]
    best, again = secrets._Smallest(4), secrets._Smallest(4)
    for value in "abcdefgh" * 2:
        best.offer(value)
    for value in "hgfedcba":
        again.offer(value)
    assert sorted(best.heap) == sorted(again.heap) and len(best.kept) == len(best.heap) == 4


def test_html():
    page = """<!DOCTYPE html><html><head><title>t</title><script>var a="</p><p>x";</script></head><body><header>Site</header><nav><a href=x>menu</a></nav>
    <div class="cookie-notice">We use cookies</div><article><h1>Head &amp; line</h1><p>First <b>bo</b>ld<br>and
    more<p>Second&nbsp;one<ul><li>a<li>b</ul><form>f</form><div class="ad">buy</div></article><aside>s</aside><section id="comments"><p>I like it</p></section><footer>f</footer>"""
    assert html.main_text(page) == "Head & line First bold and more Second one a b"
    assert html.main_text(None) == html.main_text("") == html.main_text("<p>") == ""
    plain = "<body><div id='menu'><a>m</a></div><div><p>" + "long text " * 20 + "</p><p>short</p></div><div class=sidebar>side</div></body>"
    assert html.main_text(plain) == ("long text " * 20).strip() + " short"
    assert html.main_text("<div>" * 5000 + "deep") == "deep"


@pytest.mark.parametrize("wrapper", ["<div class='layout has-sidebar'>{}<div class='sidebar'>x y</div></div>", "<div id='page' class='no-sidebar'>{}</div>", "<section id='related-work'>{}</section>"])
@pytest.mark.parametrize("element", ["article", "main", "div"])
def test_html_in_marked_wrappers(wrapper, element):
    text = " ".join(f"word{i}" for i in range(120))
    page = "<body><div class='cookie-notice'>We use cookies</div>{}<div id='comments'><article><p>I like it</p></article></div></body>"
    inner = f"<{element}><p>{text}</p><div class='promo'>buy now</div></{element}>"
    found = html.main_text(page.format(wrapper.format(inner)))
    if element == "div":  # the only article element is a comment's, so its reader's words decide what is most of the page
        found = html.main_text(page.replace("article>", "p>").format(wrapper.format(inner)))
    assert found == text


def test_html_of_very_long_and_broken_pages():
    import time

    begin = time.perf_counter()
    assert html.main_text("<div>" * 20_000 + "deep" + "</p>" * 20_000) == "deep"
    assert len(html.main_text("<body><article>" + "<p>some text" * 50_000)) == 50_000 * 10 - 1
    assert time.perf_counter() - begin < 30


def test_filters_keep_columns_of_any_name(spark, rows):
    names = ["doc_id", "text", "_score", "_clauses", "_n_words", "_spans", "TEXT_", "kept_0"]
    docs = spark.createDataFrame([(i, t, 1, 2, 3, 4, "x", None) for i, t in rows[:12]], "doc_id bigint, text string, a int, b int, c int, d int, e string, f string").toDF(*names)
    items = spark.createDataFrame([(1, "no id here no id here no id here no id here no id")], "item_id bigint, text string")
    labels = spark.createDataFrame([(i, 0, 0) for i in range(12)], "doc_id bigint, quality int, toxic int")
    plain = docs.select("doc_id", "text")
    for apply in (
        lambda d: toxicity.remove_toxic(d, toxicity.learn(plain, labels)),
        lambda d: decontaminate.remove_contaminated(d, items),
        lambda d: secrets.redact(d, secrets.learn(plain)),
    ):
        kept = apply(docs)
        assert kept.columns == names
        assert sorted(map(repr, kept.select("doc_id", "text").collect())) == sorted(map(repr, apply(plain).collect()))


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, "u", None), (None, None, "<p>ä b</p>"), (1, "u", None)], "page_id bigint, url string, html string")
    assert sorted((r["text"], r["n_chars"]) for r in html.report(pages).collect()) == [("", 0), ("", 0), ("ä b", 3)]


def test_warc(spark):
    import duckdb

    rng = random.Random(2)
    noise = "".join(chr(rng.randrange(32, 0x2FFF)) for _ in range(40_000))
    rows = [(i, f"http://x/{i}\n", "same payload " * 20) for i in range(20, 40)] + [(3, "u", None), (4, None, ""), (5, "u", "short"), (6, "u", "short"), (7, "u", noise), (8, "u", noise)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    files = warc.write(pages, warc.new_table_path(spark, "warc"))
    wanted = None
    for size in (700, 1 << 20):  # ranges far smaller than a record, and one range
        got = sorted(map(tuple, warc.read(files, size).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()))
        assert wanted is None or got == wanted
        wanted = got
    data = duckdb.connect()
    data.execute("create table pages(page_id bigint, url varchar, html varchar)")
    data.executemany("insert into pages values (?, ?, ?)", rows)
    assert sorted(data.execute(warc.REPORT_SQL).fetchall()) == wanted
    assert warc.report(pages.limit(0)).count() == 0


def test_vantage_trees(spark):
    rng = np.random.default_rng(5)
    points = rng.normal(size=(1500, 16)).astype("float32")
    rows = [(i, p.tolist(), 1) for i, p in enumerate(points)]
    odd = [(2000, None, 1), (2100, [0.0] * 16, 1), (2200, [float("nan")] * 16, 1), (2300, [], 1), (2400, [1.0], 1), (None, points[0].tolist(), 1), (7, points[7].tolist(), 1)]
    vectors = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>, label int")
    exact = vptree.brute_force(np.arange(1500), points.astype("float64"), np.arange(0, 1500, 100))
    queries = vectors.where("vec_id % 100 = 0")
    got: dict[int, list] = {}
    for r in sorted(vptree.search(vectors, queries, factor=1.0, shard_rows=400, query_bytes=600).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["score"], r["id"]))
    assert got.keys() == exact.keys()
    for q in exact:
        assert [i for _, i in got[q]] == [i for _, i in exact[q]]
        assert np.allclose([d for d, _ in got[q]], [d for d, _ in exact[q]], rtol=1e-12)
    found = vptree.report(vectors).collect()
    hits = sum(r["vec_id"] in {i for _, i in exact[r["query_id"]]} for r in found)
    assert hits >= 0.9 * sum(map(len, exact.values()))
    assert vptree.report(vectors.limit(0)).count() == 0


def test_empty_documents(spark):
    empty, labels = frame(spark, [(1, "x")]).limit(0), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    items = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    for df in (toxicity.report(empty, labels), substrings.report(empty), jaccard.report(empty), licenses.report(empty), bpe.report(empty, PATH), decontaminate.report(empty, items), secrets.report(empty)):
        assert df.count() == 0


def test_pipeline(spark):
    import duckdb

    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    raw = duckdb.sql(f"select doc_id, text from '{folder}/documents.parquet'").fetchall()
    items = duckdb.sql(f"select item_id, text from '{folder}/benchmark.parquet'").fetchall()
    bad = {r["doc_id"] for r in toxicity.report(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")).where("predicted = 1").collect()}
    rows = [(i, t) for i, t in raw if i not in bad]
    rows = [(i, t) for (i, t), c in zip(rows, jaccard.brute_force(rows, 5, 80)) if c[2] == i]
    rows = [(i, t) for (i, t), r in zip(rows, decontaminate.brute_force([t for _, t in rows], items)) if not r[4]]
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert got.keys() == {i for i, _ in rows}
    library = Tokenizer.from_file(PATH)
    for i, text in rows:
        if not secrets.fixed_spans(text):
            assert got[i]["ids"] == library.encode(text, add_special_tokens=False).ids
