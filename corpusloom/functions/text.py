"""Text expressions: cleaning, sentence and token rules, labels, exact rounding."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRIP = r"(?U)^\s+|\s+$"
SENTENCE = r"[^.!?…\n]+[.!?…]*"
WORD = r"[\p{L}\p{N}_]+"
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"


def strip(c: Column) -> Column:
    """Without white space at both ends, Unicode spaces and line feeds included."""
    return F.regexp_replace(c, F.lit(STRIP), F.lit(""))


def clean_text(c: Column) -> Column:
    """Null becomes empty, NUL characters go, ends are stripped."""
    return strip(F.translate(F.coalesce(c.cast("string"), F.lit("")), "\x00", ""))


def strip_punct(c: Column) -> Column:
    """Without the 32 ASCII punctuation characters; typographic quotes and dashes stay."""
    return F.translate(c, string.punctuation, "")


def sentence_array(c: Column) -> Column:
    """The sentences of a text in order, stripped, empty ones dropped; rule-based, so abbreviations split too."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(SENTENCE), F.lit(0))
    return F.filter(F.transform(found, strip), lambda s: s != "")


def token_array(c: Column) -> Column:
    """Words and single punctuation marks in order."""
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def contains_word(sentence: Column, word: Column) -> Column:
    """``sentence ILIKE %word%``; a plain substring search unless the word itself carries wildcards."""
    pattern = F.concat(F.lit("%"), word, F.lit("%"))
    plain = F.contains(F.lower(sentence), F.lower(word))
    return F.when(word.rlike(r"[%_\\]"), F.call_function("ilike", sentence, pattern)).otherwise(plain)


def contains_literal(sentence: Column, low: Column, word: str) -> Column:
    """The same for a word that is known when the plan is made; ``low`` is the sentence in small letters."""
    if any(c in word for c in "%_\\"):
        return F.call_function("ilike", sentence, F.lit(f"%{word}%"))
    return F.contains(low, F.lit(word.lower()))


def once(df: DataFrame, *columns: Column) -> DataFrame:
    """``df`` with further columns that are computed once a row: what reads them later doesn't repeat their expressions."""
    return df.select("*", F.inline(F.array(F.struct(*columns))))


def text_label(title: Column, author: Column, year: Column | None = None) -> Column:
    """``title (author)`` or ``title (author, year)``."""
    inner = [author] if year is None else [F.concat_ws(", ", author, year.cast("string"))]
    return F.concat(title, F.lit(" ("), *[F.coalesce(c, F.lit("")) for c in inner], F.lit(")"))


def ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator of whole numbers, rounded half up to two digits in integer arithmetic; null for a zero denominator."""
    n, d = numerator.cast("decimal(30,0)"), F.nullif(denominator.cast("decimal(18,0)"), F.lit(0).cast("decimal(18,0)"))
    return F.floor((n * 200 + d) / (d * 2)).cast("double") / 100
