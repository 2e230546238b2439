import random
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from bourseflow.operators import news, ordering, prompts, words

COMPANIES = [
    {"symbol": "2330", "stock_name": "台積電", "avg_change": 1.39, "keywords": ["科技"]},
    {"symbol": "9999", "stock_name": "ACME", "avg_change": 2.0, "keywords": ["AI"]},
]


def articles(spark, rows):
    df = spark.createDataFrame(rows, "id long, content string, publish_at string")
    return df.select("id", "content", F.to_timestamp_ntz("publish_at").alias("publish_at")).withColumn(
        "news_date", F.to_date("publish_at")
    )


def test_keyword_is_lowered_but_the_article_is_not(spark):
    rows = [(1, "台積電 up", "2024-01-01 08:00:00"), (2, "ACME", "2024-01-01 08:00:00"), (3, "acme 2330", "2024-01-01 08:00:00"), (4, "科技 AI", "2024-01-01 08:00:00")]
    df = articles(spark, rows)
    assert sorted((r["id"], r["symbol"]) for r in news.match_companies(df, COMPANIES).collect()) == [
        (1, "2330"),
        (3, "2330"),
        (3, "9999"),
    ]
    folded = news.match_companies(df, COMPANIES, fold_content=True)
    assert (2, "9999") in {(r["id"], r["symbol"]) for r in folded.collect()}


def test_last_five_in_file_order(spark):
    rows = [(100 - i, f"台積電 {i}", f"2024-01-01 08:00:{i:02d}") for i in range(8)]
    rows += [(1, "台積電 tie a", "2024-01-01 08:00:07"), (0, "台積電 tie b", "2024-01-01 08:00:07")]
    digest = news.daily_digest(news.match_companies(articles(spark, rows), COMPANIES)).first()
    # equal times: the file lists the larger id first
    assert digest["articles"] == ["台積電 5", "台積電 6", "台積電 7", "台積電 tie a", "台積電 tie b"]
    assert digest["news_count"] == 5
    assert digest["context"].split(news.ARTICLE_SEPARATOR) == digest["articles"]


def test_url_can_carry_the_keyword(spark):
    """The match looks at the raw text, the digest at the cleaned one."""
    df = articles(spark, [(1, "see https://x.y/2330", "2024-01-01 08:00:00")])
    digest = news.daily_digest(news.match_companies(df, COMPANIES)).first()
    assert digest["articles"] == ["see"]


def test_company_rules_positive_first_and_unknown_company_fails(spark):
    texts = prompts.company_rule_texts(spark, {"台積電": {"positive": ["甲", "乙"], "negative": ["丙"]}})
    lines = texts.first()["company_rules"].split("\n")
    assert lines == [
        "如果新聞中有關於 台積電 甲的消息，則隔日股價可能上漲。",
        "如果新聞中有關於 台積電 乙的消息，則隔日股價可能上漲。",
        "如果新聞中有關於 台積電 丙的消息，則隔日股價可能下跌。",
    ]
    unknown = spark.createDataFrame([("ACME",)], "stock_name string")
    with pytest.raises(Exception, match="no rules for company ACME"):
        prompts.with_company_rules(unknown, texts).collect()


def test_prompt_is_cut_at_the_limit(spark):
    df = spark.createDataFrame([("a" * 8000,), ("b",)], "t string")
    got = prompts.with_prompt(df, F.col("t")).orderBy("t").collect()
    assert [(len(r["prompt"]), r["was_truncated"]) for r in got] == [(7500, True), (1, False)]


def test_one_automaton_finds_what_expressions_find(spark):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcB台") for _ in range(n))
    companies = [{"symbol": word(rng.randint(1, 4)), "stock_name": word(rng.randint(0, 5))} for _ in range(40)]
    rows = [(i, None if i == 3 else "" if i == 4 else word(rng.randint(1, 30))) for i in range(60)] + [(7, "abc")]
    df = spark.createDataFrame(rows, "id long, content string").repartition(4)
    for fold in (False, True):
        wanted, found = (f(df, companies, fold).select("id", "symbol", "stock_name").collect() for f in (news.match_companies, news.match_many))
        assert sorted(map(tuple, found)) == sorted(map(tuple, wanted)) and wanted
    assert news.match_many(df, []).count() == news.match_many(df.limit(0), companies).count() == 0


LABELLED = [
    (True, "2024-01-01 08:00:00", 5, "aa bb aa"),
    (True, "2024-01-01 08:00:00", 9, "cc"),
    (True, "2024-01-02 08:00:00", 1, "12 !"),
    (True, "2024-01-03 08:00:00", 2, "dd a"),
    (False, "2024-01-04 08:00:00", 3, "aa zz"),
    (None, "2024-01-05 08:00:00", 4, "no label"),
]


def labelled(spark):
    """News, and labels of two symbols: as listed, and all rising."""
    rows = [(moment, id_, text) for _, moment, id_, text in LABELLED]
    df = spark.createDataFrame(rows, "publish_at string, id long, content string")
    df = df.withColumns({"publish_at": F.to_timestamp_ntz("publish_at"), "news_date": F.to_date("publish_at")})
    days = {(symbol, moment[:10], up if symbol == "1" else True) for up, moment, _, _ in LABELLED for symbol in "12" if up is not None}
    labels = spark.createDataFrame(sorted(days), "symbol string, ds string, increase boolean")
    return df, labels.withColumn("ds", F.to_date("ds"))


def test_word_shares_and_difference(spark):
    news_rows, labels = labelled(spark)
    counts = words.labelled_counts(words.day_words(news_rows), labels)
    got = {(r["symbol"], r["increase"], r["word"]): r["share"] for r in words.shares(counts).collect()}
    assert got[("1", True, "aa")] == pytest.approx(200 / 6) and got[("1", False, "zz")] == 50.0
    assert got[("2", True, "aa")] == pytest.approx(300 / 8) and ("2", False, "zz") not in got
    diff = {(r["symbol"], r["word"]): r["diff"] for r in words.share_difference(counts).collect()}
    assert ("1", "a") not in diff and diff[("1", "zz")] == -50.0 and diff[("2", "zz")] == pytest.approx(100 / 8)
    assert diff[("1", "aa")] == pytest.approx(200 / 6 - 50) and diff[("1", "cc")] == pytest.approx(100 / 6)
    top = words.top_words(words.share_difference(counts), 2, rising=False).orderBy("symbol", F.desc("diff"), "word").collect()
    assert [(r["symbol"], r["word"]) for r in top] == [("1", "zz"), ("1", "aa"), ("2", "bb"), ("2", "cc")]
    profile = words.share_profile(words.shares(counts).where("symbol = '1' and increase")).orderBy("n").collect()
    assert [(r["n"], r["n_words"], r["first_word"], r["last_word"]) for r in profile] == [(1, 4, "a", "dd"), (2, 1, "aa", "aa")]


def test_another_segmenter(spark):
    news_rows, labels = labelled(spark)
    letters = words.day_words(news_rows, lambda c: F.regexp_extract_all(c, F.lit("[a-z]"), F.lit(0)))
    got = {r["word"]: r["n"] for r in words.labelled_counts(letters, labels.where("symbol = '1' and not increase")).collect()}
    assert got == {"a": 2, "z": 2}


def test_flat_pairs_cross_article_borders(spark):
    order = [F.col("publish_at").asc(), F.col("id").desc()]
    news_rows, labels = labelled(spark)
    found = words.flat_bigrams(news_rows, labels, order).collect()
    flat = ["cc", "aa", "bb", "aa", "dd", "a"]
    for symbol, texts in (("1", {True: flat, False: ["aa", "zz"]}), ("2", {True: [*flat, "aa", "zz"]})):
        expected = Counter((up, x + y) for up, tokens in texts.items() for x, y in zip(tokens, tokens[1:]))
        assert {(r["increase"], r["word"]): r["n"] for r in found if r["symbol"] == symbol} == dict(expected)


def test_flat_pairs_read_the_texts_once(spark, tmp_path, capsys):
    news_rows, labels = labelled(spark)
    news_rows.write.parquet(str(tmp_path / "news"))
    stored = spark.read.parquet(str(tmp_path / "news"))
    order = [F.col("publish_at").asc(), F.col("id").desc()]
    words.flat_bigrams(stored, labels, order).explain("formatted")
    assert str(tmp_path) not in capsys.readouterr().out  # what is left of the plan reads the stored counts and ends only


@pytest.mark.parametrize("n_ranges", [1, 3, 7])
def test_position_and_successor_with_a_hot_group(spark, n_ranges):
    rows = [("hot", i, f"v{i}") for i in range(200)] + [("cold", i, f"c{i}") for i in range(3)] + [("one", 5, "x")]
    df = spark.createDataFrame(rows, "g string, i int, v string").repartition(5)
    nexts = {
        (r["g"], r["i"]): r["nv"]
        for r in ordering.with_successor(df, "g", [F.col("i").asc()], "v", "nv", n_ranges).collect()
    }
    assert len(nexts) == len(rows)
    assert all(nexts[("hot", i)] == (f"v{i + 1}" if i < 199 else None) for i in range(200))
    assert nexts[("cold", 2)] is None and nexts[("cold", 0)] == "c1" and nexts[("one", 5)] is None
    placed = ordering.with_position(df, ["g", "i"], "pos", n_ranges).collect()
    assert [r["pos"] for r in sorted(placed, key=lambda r: (r["g"], r["i"]))] == list(range(len(rows)))


def test_rule_table(spark):
    phrases = spark.createDataFrame([("營收增加", True), ("營收下降", False)], "phrase string, rising boolean")
    news_rows, labels = labelled(spark)
    counts = words.labelled_counts(words.day_words(news_rows), labels.where("symbol = '1'"))
    table = words.rule_table(phrases, words.share_difference(counts), "2025-07-28", 1, 1).collect()
    contents = {r["content"] for r in table}
    assert {r["symbol"] for r in table if "新聞" in r["content"]} == {None}
    assert contents == {
        "如果新聞出現 營收增加 的情況，則股票隔日的收盤價可能 上漲",
        "如果新聞出現 營收下降 的情況，則股票隔日的收盤價可能 下跌",
        "如果關鍵字 bb 出現，則股票隔日的收盤價可能 上漲",  # bb, cc and dd tie; the word decides
        "如果關鍵字 zz 出現，則股票隔日的收盤價可能 下跌",
    }


def test_days_without_news(spark, prices):
    df = articles(spark, [(1, "x", "2024-01-30 08:00:00")])
    missing = {str(r["ds"]) for r in news.days_without_news(prices, df).collect()}
    assert "2024-01-30" not in missing and len(missing) == 6


def test_no_matching_news_gives_no_digest(spark):
    df = articles(spark, [(1, "nothing", "2024-01-30 08:00:00")])
    assert news.daily_digest(news.match_companies(df, COMPANIES)).count() == 0


def test_articles_sorted_by_time(spark):
    df = articles(spark, [(1, "台積電 b", "2024-01-30 09:00:00"), (2, "台積電 a", "2024-01-30 08:00:00")])
    kept = news.last_articles(news.match_companies(df, COMPANIES)).orderBy("pos").collect()
    assert [r["publish_at"] for r in kept] == [datetime(2024, 1, 30, 8), datetime(2024, 1, 30, 9)]


def test_a_long_article_is_not_copied_for_every_company_it_names(spark):
    companies = [{"symbol": f"x{i}y", "stock_name": f"x{i}y"} for i in range(3000)]
    text = " ".join(c["symbol"] for c in companies)
    rows = spark.createDataFrame([(1,)], "id long").select("id", F.concat(F.lit(text), F.repeat(F.lit(" long"), 250_000)).alias("content"))
    named = news.match_many(rows, companies)  # 3.7 GB of copies
    assert named.select("id", "symbol").distinct().count() == 3000


def test_counts_of_many_symbols_are_dealt_by_word_once(spark, capsys):
    rng = random.Random(5)
    days = [f"2024-01-{d:02d}" for d in range(1, 13)]
    rows = [(rng.choice(days), " ".join(rng.choice(["ab", "abc", "b", "zz", "zy", "longer-word"]) for _ in range(rng.randint(0, 9)))) for _ in range(60)]
    df = spark.createDataFrame(rows, "day string, content string").withColumn("news_date", F.to_date("day"))
    marks = [(f"s{s}" if s else None, day, rng.choice([True, False, None])) for s in range(45) for day in days for _ in range(1 + (s == 7))]
    labels = spark.createDataFrame(marks, "symbol string, day string, increase boolean").withColumn("ds", F.to_date("day"))
    expected = Counter()
    for symbol, day, up in marks:
        for other, text in rows:
            if up is not None and other == day:
                expected.update((symbol, up, w) for w in text.replace("-", " ").split())
    counted = words.day_words(df)
    counts = words.labelled_counts(counted, labels)
    assert Counter({(r["symbol"], r["increase"], r["word"]): r["n"] for r in counts.collect()}) == expected
    counts.explain()
    assert "hashpartitioning(symbol" not in capsys.readouterr().out
    pairs = {(r["symbol"], r["word"]): (r["n_rising"], r["n_falling"]) for r in words.labelled_counts(counted, labels, paired=True).collect()}
    assert pairs == {(s, w): (expected[s, True, w], expected[s, False, w]) for s, _, w in expected}
    differences = [{(r["symbol"], r["word"]): r["diff"] for r in words.share_difference(words.labelled_counts(counted, labels, paired)).collect()} for paired in (False, True)]
    assert differences[0] == differences[1] and None not in {s for s, _ in differences[0]}
    for rising in (True, False):
        top = words.top_words(words.share_difference(counts), 2, rising).collect()
        for symbol in {s for s, _ in differences[0]}:
            order = sorted((-d if rising else d, w) for (s, w), d in differences[0].items() if s == symbol)
            assert sorted((-r["diff"], r["word"]) for r in top if r["symbol"] == symbol) == order[:2]
    for heads in (False, True):
        profile = words.share_profile(words.shares(words.labelled_counts(counted, labels, heads=heads)))
        found = {(r["symbol"], r["increase"], r["n"]): (r["n_words"], r["first_word"], r["last_word"]) for r in profile.collect()}
        groups = {(s, up, n): sorted(w for (t, v, w), m in expected.items() if (t, v, m) == (s, up, n)) for (s, up, _), n in expected.items() if s}
        assert found == {k: (len(g), g[0], g[-1]) for k, g in groups.items()}


def test_only_the_last_articles_are_sorted_with_their_texts(spark, capsys):
    rng = random.Random(8)
    rows = [(i, f"台積電 {i}", f"2024-01-{rng.randint(28, 30)} 0{rng.randint(1, 4)}:00:00") for i in range(80)]
    matched = news.match_companies(articles(spark, rows), COMPANIES)
    digest = news.daily_digest(matched, 3)
    for r in digest.collect():
        order = sorted((m, -i, t) for i, t, m in rows if m[:10] == str(r["news_date"]))[-3:]
        assert r["articles"] == [t for *_, t in order] and r["news_count"] == 3
    digest.explain()
    plan = capsys.readouterr().out
    assert plan.index("Window") < plan.index("Join")  # rows are left out before the window over the texts


def many_labelled(spark, repeated=False):
    """Random articles, and labels of 23 symbols (one without name); some words of a pair meet in other pairs too."""
    rng = random.Random(11)
    days = [f"2024-01-{d:02d}" for d in range(1, 13)]
    texts = [(rng.choice([*days, None]), rng.choice(range(40)), " ".join(rng.choice(["ab", "abc", "c", "b", "zz", "台積"]) for _ in range(rng.randint(0, 9)))) for _ in range(60)]
    texts += [("2024-01-05", 59, None), ("2024-01-05", 58, "one")]
    moments = [(d, f"{d} 08:{i:02d}:00" if d else None, 1000 - i, t) for d, i, t in texts]
    moments = [(d, m, i * 100 + n, t) for n, (d, m, i, t) in enumerate(moments)]
    df = spark.createDataFrame(moments, "day string, moment string, id long, content string").repartition(3)
    df = df.withColumns({"news_date": F.to_date("day"), "publish_at": F.to_timestamp_ntz("moment")})
    marks = [(f"s{s}" if s else None, day, rng.choice([True, False, None])) for s in range(23) for day in days for _ in range(1 + (repeated and s == 7))]
    labels = spark.createDataFrame(marks, "symbol string, day string, increase boolean").withColumn("ds", F.to_date("day"))
    return moments, marks, df, labels


def tokens_of(text):
    out = []
    for run in (text or "").split():
        out += ["台", "台積", "積"] if run == "台積" else [run]
    return out


def profiles(counts):
    groups = {}
    for (symbol, up, word), n in counts.items():
        if symbol:
            groups.setdefault((symbol, up, n), []).append(word)
    return {k: (len(g), min(g), max(g)) for k, g in groups.items()}


def found_profile(counts):
    return {(r["symbol"], r["increase"], r["n"]): (r["n_words"], r["first_word"], r["last_word"]) for r in words.share_profile(words.shares(counts)).collect()}


@pytest.mark.parametrize("repeated", [False, True])
def test_flat_pairs_of_many_symbols_without_a_row_per_symbol_and_article(spark, repeated, monkeypatch):
    articles_, marks, df, labels = many_labelled(spark, repeated)
    expected = Counter()
    for symbol, up in {(s, up) for s, _, up in marks if up is not None}:
        times = Counter(day for s, day, u in marks if s == symbol and u is up)
        flat = [t for d, m, i, text in sorted(articles_, key=lambda a: (a[1] or "", -a[2])) for _ in range(times[d]) for t in tokens_of(text)]
        expected.update((symbol, up, x + y) for x, y in zip(flat, flat[1:]))
    order = [F.col("publish_at").asc(), F.col("id").desc()]
    listed, plain = [], words.with_successor
    monkeypatch.setattr(words, "with_successor", lambda rows, *a: (listed.append(rows.count()), plain(rows, *a))[1])
    found = words.flat_bigrams(df, labels, order)
    assert Counter({(r["symbol"], r["increase"], r["word"]): r["n"] for r in found.collect()}) == expected
    # every article with tokens once, and per symbol only the first and the last of a day
    assert listed[0] <= len(articles_) and listed[1] <= 2 * 12 * 23
    assert found_profile(words.flat_bigrams(df, labels, order, heads=True)) == profiles(expected)


def pair_counts(articles_, marks):
    expected = Counter()
    for symbol, day, up in marks:
        for d, _, _, text in articles_:
            if up is not None and d == day:
                tokens = tokens_of(text)
                expected.update((symbol, up, x + y) for x, y in zip(tokens, tokens[1:]))
    return expected


def test_profile_of_pairs_out_of_blocks(spark):
    articles_, marks, df, labels = many_labelled(spark, True)
    expected = pair_counts(articles_, marks)
    packed = words.day_bigrams(df, packed=True)
    assert {(r["symbol"], r["increase"], r["word"]): r["n"] for r in words.labelled_counts(packed, labels).collect()} == dict(expected)
    shares = words.shares(words.labelled_counts(packed, labels, heads=True))
    assert "word" not in shares.columns and shares.count() < len(expected)  # a row per count, not per word
    assert found_profile(words.labelled_counts(packed, labels, heads=True)) == profiles(expected)
    nothing = words.labelled_counts(packed, labels.limit(0), heads=True)
    assert words.share_profile(words.shares(nothing)).count() == 0


def test_top_pairs_out_of_blocks(spark):
    articles_, marks, df, labels = many_labelled(spark, True)
    counted = words.labelled_counts(words.day_bigrams(df), labels, paired=True)
    blocks = words.labelled_counts(words.day_bigrams(df, packed=True), labels, paired=True)
    assert {r["bucket"] for r in blocks.blocks.select("bucket").collect()} > {None}  # the counts went into blocks
    for rising in (True, False):
        for chars in (2, 4):
            wanted, found = (words.top_words(words.share_difference(c, chars), 3, rising).collect() for c in (counted, blocks))
            assert sorted(map(tuple, found)) == sorted(map(tuple, wanted)) and len(found) == 3 * 22


def test_blocks_of_a_task_that_holds_few_terms(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from bourseflow.operators import termblocks

    rng = random.Random(2)
    texts = [[rng.choice(["a", "ab", "b", "bc", "c", "", None]) for _ in range(rng.randint(0, 30))] for _ in range(50)]
    expected = Counter()
    for i, tokens in enumerate(texts):
        expected.update((x + y, 3 * (i % 4)) for x, y in zip(tokens, tokens[1:]) if x is not None and y is not None)
    for name, value in (("OPENED", 10), ("SUMS", 6), ("TALLIED", 2)):
        monkeypatch.setattr(termblocks, name, value)
    tables = []
    for begin in range(0, 50, 7):
        some = [t for text in texts[begin : begin + 7] for t in text]
        row = np.repeat(np.arange(begin, min(50, begin + 7)), [len(t) for t in texts[begin : begin + 7]])
        inside = np.flatnonzero(row[1:] == row[:-1])
        tables.append(pa.Table.from_batches([termblocks._blocks(pa.array(some, pa.string()), inside, 3 * (row[inside] % 4), 3)]))
    blocks = pa.concat_tables(tables)
    weights = termblocks.Weights.of(np.array([0, 3, 6]), np.array([[1, 0], [2, 1], [0, 1]]), 0)
    wanted = Counter()
    for (word, code), n in expected.items():
        for slot in (0, 1):
            wanted[slot, word] += n * ([1, 2, 0, 0], [0, 1, 1, 0])[slot][code // 3]
    rows, tallied, parts = {}, Counter(), 0
    for bucket in range(3):
        mine = blocks.filter(pa.compute.equal(blocks.column("bucket"), bucket))
        for opened in termblocks._opened(mine, weights):
            parts += 1
            for table in termblocks._rows(opened, weights):
                rows |= {(r["slot"], r["word"]): r["n"] for r in table.to_pylist()}
            for r in termblocks._tally(opened, weights).to_pylist():
                tallied[r["slot"], r["n"]] += r["n_words"]
    assert parts > 3 and rows == {k: n for k, n in wanted.items() if n}
    assert tallied == Counter((slot, n) for (slot, _), n in wanted.items() if n)
