"""Text expressions: cleaning, tokens, reply parsing, keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The character class of a URL, and the blanks that count as
# white space (Java's \s is ASCII only, so the wide ones are named).
URL_PATTERN = r"https?://[A-Za-z0-9\-._~:/?#\[\]@!$&'()*+,;=%]+"
OTHER_BLANKS = (
    r"\t\n\x0b\f\r\x{001c}-\x{001f}\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
BLANK = f"[ {OTHER_BLANKS}]"
# A run of blanks that is not already a single space; the look-ahead passes over
# printable ASCII without trying the wide class.
BLANK_RUN = f"(?![!-~])(?:[{OTHER_BLANKS}]{BLANK}*| {BLANK}+)"
CJK = r"\x{4e00}-\x{9fff}"
WORD_PATTERN = rf"^[{CJK}A-Za-z0-9]+$"
DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"


def strip_blank(text: Column) -> Column:
    """Trim every kind of white space; Spark's ``trim`` keeps line breaks."""
    return F.regexp_replace(text, rf"^{BLANK}+|{BLANK}+$", "")


def clean_text(text: Column) -> Column:
    """Drop URLs, turn each run of white space into one space, trim."""
    without_urls = F.regexp_replace(text, URL_PATTERN, "")
    return F.trim(F.regexp_replace(without_urls, BLANK_RUN, " "))


def blank_digits(text: Column) -> Column:
    """Digit runs (of any script) become one space."""
    return F.regexp_replace(text, r"(?U)\d+", " ")


def _cjk_grams(run: Column) -> Column:
    """All 1-, 2- and 3-character pieces of a run, by start position."""
    size = F.char_length(run)
    starts = F.sequence(F.lit(1), size)
    pieces = F.transform(
        starts,
        lambda i: F.transform(
            F.sequence(F.lit(1), F.least(F.lit(3), size - i + 1)),
            lambda length: F.substring(run, i, length),
        ),
    )
    return F.flatten(pieces)


def _tokens(text: Column, run_pattern: str, raw: Column) -> Column:
    """Runs of a text; the array work for Chinese runs is done only where ``raw`` has any."""
    runs = F.regexp_extract_all(text, F.lit(run_pattern), F.lit(0))
    split = F.flatten(
        F.transform(runs, lambda run: F.when(F.ascii(run) < 128, F.array(run)).otherwise(_cjk_grams(run)))
    )
    return F.when(raw.rlike(f"[{CJK}]"), split).otherwise(runs)


def words(text: Column) -> Column:
    """Tokens of a cleaned text: Latin runs whole, Chinese runs as 1-3-grams."""
    return _tokens(text, rf"[{CJK}]+|[A-Za-z0-9]+", text)


def article_words(content: Column) -> Column:
    """Tokens of a raw article without its URLs and numbers, in reading order.

    Same as ``words(blank_digits(clean_text(content)))`` in two passes: white
    space never is part of a token, and a digit only ever ends one.
    """
    return _tokens(F.regexp_replace(content, URL_PATTERN, ""), rf"[{CJK}]+|[A-Za-z]+", content)


def word_tokens(tokens: Column) -> Column:
    """Keep tokens made of letters and digits only (for tokens of another segmenter)."""
    return F.filter(tokens, lambda w: w.rlike(WORD_PATTERN))


def joined_pairs(tokens: Column, size: int = 2, step: int = 1) -> Column:
    """Sliding windows over the tokens, each joined without a separator.

    ``tokens`` should be a plain column: the lambda reads it for every window.
    """
    last_start = F.size(tokens) - F.lit(size)
    starts = F.when(last_start >= 0, F.sequence(F.lit(0), last_start, F.lit(step))).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(starts, lambda i: F.concat(*[F.get(tokens, i + j) for j in range(size)]))


def strip_think(reply: Column) -> Column:
    """Remove thinking blocks and surrounding white space."""
    return strip_blank(F.regexp_replace(reply, r"(?s)<think>.*?</think>", ""))


def parse_number(text: Column) -> Column:
    """Text to a finite double, else null."""
    number = strip_blank(text).try_cast("double")
    finite = ~F.isnan(number) & (F.abs(number) < F.lit(float("inf")))
    return F.when(finite, number)


def parse_number_reply(reply: Column) -> Column:
    """Score of a reply that holds the number alone."""
    return parse_number(strip_think(reply))


def parse_two_line_reply(reply: Column) -> tuple[Column, Column]:
    """Score and explanation of a reply ``number, newline, text``; null if either is missing."""
    parts = F.split(strip_think(reply), "\n", 2)
    complete = F.size(parts) == 2
    score = F.when(complete, parse_number(F.get(parts, F.lit(0))))
    return score, F.when(score.isNotNull(), F.get(parts, F.lit(1)))


def parse_boxed_reply(reply: Column) -> tuple[Column, Column]:
    """Older reply form: eight leading and one trailing character are wrapping."""
    inner = strip_blank(F.substring(reply, F.lit(9), F.greatest(F.char_length(reply) - 9, F.lit(0))))
    parts = F.split(inner, "\n")
    complete = F.size(parts) == 2
    return (
        F.when(complete, parse_number(F.get(parts, F.lit(0)))),
        F.when(complete, F.get(parts, F.lit(1))),
    )


def uuid5(name: Column, namespace_hex: str = DNS_NAMESPACE) -> Column:
    """Name-based UUID (version 5) of a string, in the JVM."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "UTF-8")))
    variant = F.conv(F.substring(digest, 17, 2), 16, 10).cast("int").bitwiseAND(63).bitwiseOR(128)
    return F.lower(
        F.concat(
            F.substring(digest, 1, 8),
            F.lit("-"),
            F.substring(digest, 9, 4),
            F.lit("-5"),
            F.substring(digest, 14, 3),
            F.lit("-"),
            F.hex(variant),
            F.substring(digest, 19, 2),
            F.lit("-"),
            F.substring(digest, 21, 12),
        )
    )


def parse_list_text(text: Column) -> Column:
    """Text of a Python list of strings -> array, without BOM marks and repeats."""
    items = F.from_json(text, "array<string>", {"allowSingleQuotes": "true"})
    return F.array_distinct(F.transform(items, lambda x: F.regexp_replace(x, r"\x{feff}", "")))


def numbered_lines(texts: Column, prefix: str = "新聞內容") -> Column:
    """``prefix0: text`` lines of an array of texts."""
    lines = F.transform(texts, lambda text, i: F.concat(F.lit(prefix), i.cast("string"), F.lit(": "), text))
    return F.array_join(lines, "\n")


def fill_template(template: str, **values: Column) -> Column:
    """Put columns into the ``{name}`` places of a template.

    The template is cut at its places once, on the driver, so text that comes
    out of a column is never searched for places again.
    """
    import re

    pieces = re.split(r"\{(\w+)\}", template)
    parts = [F.lit(piece) if i % 2 == 0 else values[piece].cast("string") for i, piece in enumerate(pieces)]
    return F.concat(*parts)
