"""Column functions on text. Everything runs in the JVM but Unicode composition, which Spark lacks: only the
values that may change under NFC are sent to Python."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Code points below U+0300 are always composed; of those above, the ranges left out here are too.
MAYBE_NOT_NFC = r"[\x{300}-\x{1FFF}\x{2000}\x{2001}\x{2126}\x{212A}\x{212B}\x{2329}\x{232A}\x{2ADC}\x{3000}-\x{10FFFF}]"
#: A run of anything but letters and numbers.
NOT_WORD = r"[^\p{L}\p{N}]+"
#: The same with the underscore kept, as the tokeniser of the index does it.
NOT_TOKEN = r"[^\p{L}\p{N}_]+"


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(StringType())
def _fold(s: pd.Series) -> pd.Series:
    def one(x):
        if x is None:
            return None
        return "".join(c for c in unicodedata.normalize("NFD", x) if unicodedata.category(c) != "Mn")

    return s.map(one)


def nfc(c: Column) -> Column:
    """NFC of a string column; null stays null."""
    return F.coalesce(_nfc(F.when(c.rlike(MAYBE_NOT_NFC), c)), c)


def strip_accents(c: Column) -> Column:
    """Decompose and drop the combining marks; null stays null."""
    return F.coalesce(_fold(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


def canonical_term(c: Column) -> Column:
    """Trimmed (all white space), NFC, lower case."""
    return F.lower(nfc(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")))


def normalize_text(c: Column, lower: bool = True, accents: bool = True) -> Column:
    """Lower case, NFC, everything but word characters to one blank, trimmed. ``accents=False`` drops diacritics."""
    c = F.lower(c) if lower else c
    c = nfc(c)
    c = c if accents else strip_accents(c)
    return F.trim(F.regexp_replace(c, NOT_TOKEN, " "))


def tokens(c: Column) -> Column:
    """Tokens of a normalised text; null and blank give an empty array."""
    c = F.coalesce(c, F.lit(""))
    return F.when(F.trim(c) == "", F.array().cast("array<string>")).otherwise(F.split(F.trim(c), " +"))


def keep_lengths(arr: Column, least: int = 2, most: int = 20) -> Column:
    return F.filter(arr, lambda t: F.length(t).between(least, most))


def drop_words(arr: Column, words: list[str]) -> Column:
    """Without the given words, repeats of other tokens kept. For bounded word lists."""
    if not words:
        return arr
    return F.filter(arr, lambda t: ~t.isin(words))


def source_key(c: Column) -> Column:
    """Name of a source as its partition: trimmed, blanks made ``_``, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, r"^\s+|\s+$", ""), r"\s+", "_"))


def snippet(c: Column, n: int = 120) -> Column:
    return F.concat(F.regexp_replace(F.substring(c, 1, n), "\n", " "), F.lit("..."))
