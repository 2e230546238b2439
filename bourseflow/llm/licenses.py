"""License scan by diagonal voting, with DataFrame functions only.

Texts become words; every two neighbouring words are hashed, with their place,
and joined with the hashed word pairs of the license templates. A match of text
place p and template place t lies on the diagonal p - t; a text that holds the
template has many on one diagonal. Votes are counted per diagonal, neighbouring
diagonals are merged where words were put in or left out, and a span is
verified by its share of the template. Phrases of two or three words are
templates as well, verified word for word.

Only matches and one row per text leave the scan, so what is shuffled does not
grow with the text: rows with the same id and text are told from others by a
hash of the text.

Defined cases: null text is empty; repeated rows each get the same row; a word
is any run of letters, digits or characters beyond ASCII; texts are scanned
whole; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bourseflow.session import cut_lineage

#: Fixed phrases and labels.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
#: Usual license notices, as words.
NOTICES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl-2.0", "licensed under the gnu general public license version 2"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl-3.0", "licensed under the gnu affero general public license version 3"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nd", "licensed under cc by nd 4 0"),
    ("cc-by-4.0", "licensed under cc by 4 0"),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
#: Share of a notice's word pairs that a span must hold, and diagonals that are merged at most this far apart.
SHARE, DRIFT = 0.8, 2
#: Words between the starts of notices at different places.
APART = 8
_WORD = r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"


def templates(spark: SparkSession) -> DataFrame:
    """``template, label, base, n_pairs, place, w1, w2, th``: the word pairs of all templates."""
    rows = [(f"p{i}", label, True, text.split()) for i, (text, label) in enumerate(PHRASES)]
    rows += [(f"n{i}", label, False, text.split()) for i, (label, text) in enumerate(NOTICES)]
    frame = spark.createDataFrame(rows, "template string, label string, base boolean, words array<string>")
    pairs = frame.select("template", "label", "base", (F.size("words") - 1).alias("n_pairs"), F.posexplode(F.slice("words", F.lit(1), F.size("words") - 1)).alias("place", "w1"), "words")
    pairs = pairs.withColumn("w2", F.element_at("words", F.col("place") + 2)).drop("words")
    return pairs.withColumn("th", F.xxhash64("w1", "w2"))


def words_of(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(low, F.lit(_WORD), F.lit(1))


def vote(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Matches of word pairs, and one row per text (place -1), stored once.

    ``doc_id, text_hash, n_words, at`` and, for matches, the template's columns.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    words = docs.select(F.col(id_column).alias("doc_id"), F.xxhash64(text).alias("text_hash"), words_of(text).alias("words"))
    size = F.size("words")
    nothing = F.lit(None).cast("string")
    own = F.array(F.struct(nothing.alias("v1"), nothing.alias("v2")))
    pairs = F.arrays_zip(F.slice("words", F.lit(1), F.greatest(size - 1, F.lit(0))).alias("v1"), F.slice("words", F.lit(2), F.greatest(size - 1, F.lit(0))).alias("v2"))
    rows = words.select("doc_id", "text_hash", size.cast("bigint").alias("n_words"), F.posexplode(F.concat(own, pairs)).alias("at", "pair"))
    rows = rows.select("doc_id", "text_hash", "n_words", (F.col("at") - 1).cast("bigint").alias("at"), "pair.v1", "pair.v2")
    known = F.broadcast(templates(docs.sparkSession))  # the fixed rows above, some two hundred
    met = rows.withColumn("h", F.xxhash64("v1", "v2")).join(known, (F.col("h") == F.col("th")) & (F.col("v1") == F.col("w1")) & (F.col("v2") == F.col("w2")), "left")
    met = met.where("at < 0 or template is not null")
    return cut_lineage(met.select("doc_id", "text_hash", "n_words", "at", "template", "label", "base", "n_pairs", "place"))


def spans(votes: DataFrame, share: float = SHARE, drift: int = DRIFT) -> DataFrame:
    """Diagonals, merged and verified: ``doc_id, text_hash, label, base, start, coverage``.

    Repeated texts under the same id vote for the same places, so places are counted once.
    """
    key = ["doc_id", "text_hash", "template", "label", "base", "n_pairs"]
    once = votes.where("at >= 0").select(*key, "at", "place").distinct()
    diagonals = once.groupBy(*key, (F.col("at") - F.col("place")).alias("diagonal")).agg(F.count("*").alias("votes"), F.min("at").alias("first"))
    out = ["doc_id", "text_hash", "label", "base", "start", "coverage"]
    # every pair of a phrase must be there, so only a full diagonal is a place
    phrases = diagonals.where("base and votes = n_pairs").withColumns({"start": F.col("diagonal"), "coverage": F.lit(1.0)})
    order = Window.partitionBy("doc_id", "text_hash", "template").orderBy("diagonal")
    far = F.col("diagonal") - F.lag("diagonal").over(order) > drift
    parts = diagonals.where("not base").withColumn("new", F.coalesce(far, F.lit(True)).cast("int"))
    parts = parts.withColumn("part", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = parts.groupBy(*key, "part").agg(F.sum("votes").alias("votes"), F.min("first").alias("start"))
    notices = merged.withColumn("coverage", F.least(F.lit(1.0), F.col("votes") / F.col("n_pairs"))).where(F.col("coverage") >= share)
    # notices share words: of those that start within a few words of each other, the best covered stay
    near = Window.partitionBy("doc_id", "text_hash").orderBy("start")
    apart = F.coalesce(F.col("start") - F.lag("start").over(near) > APART, F.lit(True)).cast("int")
    placed = notices.withColumn("apart", apart).withColumn("at", F.sum("apart").over(near.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.max("coverage").over(Window.partitionBy("doc_id", "text_hash", "at"))
    notices = placed.withColumn("best", best).where(F.col("coverage") == F.col("best"))
    return phrases.select(out).unionByName(notices.select(out))


def report(docs: DataFrame, share: float = SHARE, drift: int = DRIFT) -> DataFrame:
    """The registered query: one row per document."""
    votes = vote(docs)
    listed = lambda labels: F.array_join(F.array_sort(F.collect_set(labels)), ",")
    found = spans(votes, share, drift).groupBy("doc_id", "text_hash").agg(
        F.count(F.when(F.col("base"), 1)).alias("n_base"),
        F.min(F.when(F.col("base"), F.col("start"))).alias("first_word"),
        F.max(F.when(F.col("base"), F.col("start"))).alias("last_word"),
        listed(F.when(F.col("base"), F.col("label"))).alias("base_labels"),
        listed(F.col("label")).alias("labels"),
        F.max("coverage").alias("score"),
    )
    found = found.withColumnsRenamed({"doc_id": "of", "text_hash": "hash_of"})
    texts = votes.where("at < 0").select("doc_id", "text_hash", "n_words")
    joined = texts.join(found, (F.col("text_hash") == F.col("hash_of")) & F.col("doc_id").eqNullSafe(F.col("of")), "left")
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0).cast("bigint")).alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
