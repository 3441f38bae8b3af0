"""Line-first quality rules, in built-in expressions only.

Every line of a text is judged by itself: it must end in punctuation, and must not be
navigation, boilerplate, shouting, symbols or one word over and over. Lines that fail go;
a document that loses too many of its words with them is rejected, and so is one that
fails the base rules (too few words, too many repeated three-word windows).
"""

from __future__ import annotations

import functools
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"

#: Symbols counted by the base; ends of a sentence; phrases of navigation and of boilerplate.
SYMBOLS = "#*$%&|<>"
ENDING = r"""[.!?:;…。！？]["'”’»)\]]*[\x20\x09-\x0D]*$"""
NAVIGATION = r"(?i)^[^\p{L}]*(home|menu|search|log ?in|sign (in|up)|next|previous|back to top|skip to content|read more|share|contact us|about us|site map)[^\p{L}]*$"
BOILERPLATE = r"(?i)(all rights reserved|licensed under|is licensed|general public license|copyright|privacy policy|terms of (use|service)|cookie|javascript|lorem ipsum|powered by|click here|subscribe to|sign up for)"


#: What each phrase of boilerplate begins with, and marks between items of navigation.
BOILERPLATE_STARTS = (
    "all rights reserved", "licensed under", "is licensed", "general public license", "copyright", "privacy policy", "terms of ", "cookie", "javascript",
    "lorem ipsum", "powered by", "click here", "subscribe to", "sign up for",
)
BARS = "|»›"


def _count(line: Column, pattern: str) -> Column:
    return F.regexp_count(line, F.lit(pattern))


def _any(conditions: Iterable[Column]) -> Column:
    return functools.reduce(lambda a, b: a | b, conditions)


def _words(line: Column) -> Column:
    """The words of a line; splitting at single spaces needs no pattern and is the usual case."""
    return F.array_remove(F.when(line.rlike(r"[\x09-\x0D]"), F.split(line, r"[\x20\x09-\x0D]+")).otherwise(F.split(line, " ")), "")


def _gate(text: Column) -> Column:
    """What the lines of a text can have at all: 1 for bars, 2 for boilerplate, 3 for both."""
    lower = F.lower(text)
    bars, boilerplate = _any(F.contains(text, F.lit(x)) for x in BARS), _any(F.contains(lower, F.lit(x)) for x in BOILERPLATE_STARTS)
    return F.when(bars, 1).otherwise(0) + F.when(boilerplate, 2).otherwise(0)


def good_line(line: Column, words: Column, gate: Column) -> Column:
    """Whether a line passes: cheap conditions first, and each count only where it can decide."""
    n = F.size(words)
    punctuation = _any(line.endswith(x) for x in ".!?:;") | line.rlike(ENDING)
    navigation = ((gate % 2 == 1) & (_count(line, f"[{BARS}]") >= 2)) | line.rlike(NAVIGATION)
    boilerplate = (gate >= 2) & line.rlike(BOILERPLATE)
    symbols = _count(line, r"[#*$%&<>{}~^=_\\@]") * 10 >= F.length(line)
    exclaiming = F.contains(line, F.lit("!!")) & (_count(line, "!!") * 5 >= n)
    capitals = _count(line, r"\p{Lu}")
    letters = lambda part: _count(part, r"\p{L}")
    # As many letters as decide are mostly found in a few characters.
    loud = (n >= 3) & (capitals > 0) & (capitals * 2 > letters(F.substring(line, F.lit(1), capitals * 8))) & (capitals * 2 > letters(line))
    # Parts between white space: the words, and an empty one at an end that is white space.
    first, last = line.rlike(r"^[\x20\x09-\x0D]"), line.rlike(r"[\x20\x09-\x0D]\z")
    kinds = F.size(F.array_distinct(words)) + F.when(first | last, 1).otherwise(0)
    monotone = (n >= 8) & (F.size(F.array_distinct(words)) * 4 < n + 2) & (kinds * 4 < n + first.cast("int") + last.cast("int"))
    return punctuation & ~navigation & ~symbols & ~exclaiming & ~monotone & ~boilerplate & ~loud


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 50, most_repeated: int = 50, least_kept: int = 50) -> DataFrame:
    """Base counts, verdicts and the cleaned text of each row of ``docs``.

    Columns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, n_kept_words, cleaned``. ``kept`` is false if ``base_failed`` or if
    less than ``least_kept`` percent of the words are on lines that pass. A null or empty
    text has zero counts, fails the base and is cleaned to the empty text; repeated rows
    come out repeated; an empty table gives an empty result; other columns are not read.
    Three-word windows are told apart by 64-bit hashes within one document.
    """
    # Each step uses the columns before it more than once, so that none is computed again per element.
    split = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).select(
        "doc_id",
        "text",
        F.filter(F.transform(F.split("text", "\n"), lambda line: F.struct(line.alias("line"), _words(line).alias("words"))), lambda x: F.size(x.words) > 0).alias("lines"),
        _gate(F.col("text")).alias("gate"),
    )
    parts = split.select(
        "doc_id",
        _count(F.col("text"), f"[{SYMBOLS}]").cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines.line"))).cast("bigint").alias("n_dup_lines"),
        F.flatten("lines.words").alias("words"),
        F.filter("lines", lambda x: good_line(x.line, x.words, F.col("gate"))).alias("good"),
    )
    hashed = parts.select(
        "doc_id", "n_symbols", "n_dup_lines",
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.size(F.flatten("good.words")).cast("bigint").alias("n_kept_words"),
        F.array_join("good.line", "\n").alias("cleaned"),
        F.transform(
            F.slice("words", F.lit(1), F.greatest(F.size("words") - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(F.col("words"), i + 1), F.get(F.col("words"), i + 2))
        ).alias("hashes"),
    )
    # Sorted with their places only in texts that repeat some.
    ordered = F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    counted = hashed.select("doc_id", "n_symbols", "n_dup_lines", "n_words", "word_chars", "n_kept_words", "cleaned", ordered.alias("windows"))
    same = lambda x, y: F.coalesce(x.h == y.h, F.lit(False))
    windows = F.col("windows")
    starts = counted.withColumn("starts", F.sort_array(F.transform(F.filter(windows, lambda x, k: same(x, F.get(windows, k - 1)) | same(x, F.get(windows, k + 1))), lambda x: x.i)))
    covered = F.aggregate(
        "starts",
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("total")),
        lambda a, x: F.struct(x.alias("last"), (a.total + F.least(F.lit(3), x - a.last)).alias("total")),
        lambda a: a.total,
    )
    done = starts.withColumn("n_repeat_words", F.when(F.col("windows").isNull(), F.lit(0).cast("bigint")).otherwise(covered))
    failed = (F.col("n_words") < least_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * most_repeated)
    kept = ~failed & (F.col("n_kept_words") * 100 >= F.col("n_words") * least_kept)
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), kept.alias("kept"), "n_kept_words", "cleaned")


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '{WORD}') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
p AS (SELECT r, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM (SELECT r, words, unnest(range(1, greatest(len(words) - 1, 1))) AS i FROM w)),
q AS (SELECT r, unnest([i, i + 1, i + 2]) AS place FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM p) WHERE n > 1),
n AS (SELECT r, count(DISTINCT place) AS n FROM q GROUP BY r),
l AS (SELECT r, line, len(regexp_extract_all(line, '{WORD}')) AS n, string_split_regex(line, '[\x20\x09-\x0D]+') AS parts FROM (SELECT r, unnest(lines) AS line FROM w)),
g AS (SELECT r, sum(n)::BIGINT AS n FROM l WHERE
        regexp_matches(line, '{ENDING.replace("'", "''")}')
        AND NOT (length(line) - length(translate(line, '|»›', '')) >= 2 OR regexp_matches(line, '{NAVIGATION}'))
        AND NOT regexp_matches(line, '{BOILERPLATE}')
        AND NOT ((length(line) - length(translate(line, '#*$%&<>{{}}~^=_\@', ''))) * 10 >= length(line))
        AND NOT (len(regexp_extract_all(line, '!!')) * 5 >= n OR (len(regexp_extract_all(line, '\p{{Lu}}')) * 2 > len(regexp_extract_all(line, '\p{{L}}')) AND n >= 3))
        AND NOT (len(list_distinct(parts)) * 4 < len(parts) AND n >= 8)
      GROUP BY r),
b AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
        (length(text) - length(translate(text, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(n.n, 0)::BIGINT AS n_repeat_words, coalesce(g.n, 0)::BIGINT AS n_kept_words
      FROM w LEFT JOIN n USING (r) LEFT JOIN g USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR n_repeat_words * 100 > n_words * 50 AS base_failed,
       NOT (n_words < 50 OR n_repeat_words * 100 > n_words * 50) AND n_kept_words * 100 >= n_words * 50 AS kept,
       n_kept_words
FROM b
"""
