"""Column expressions on words, lines and n-grams of a text; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space is space and the five controls from tab to carriage return, nothing else.
SPACES = " \t\n\x0b\f\r"
SPLIT = r"[\x20\x09-\x0D]+"


def no_null(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """array<string> of the maximal runs of other characters; empty for a null text or one of white space."""
    bare = F.btrim(no_null(text), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPLIT))


def gram_hash(words_col: Column, at: Column, n: int) -> Column:
    """64-bit hash of the n words from the 0-based position `at`; no word contains white space, so hashing them one
    after another as separate values is as good as hashing the joined phrase."""
    return F.xxhash64(*(F.get(words_col, at + F.lit(k)) for k in range(n)))
