"""Sets and sorts of integer columns. Sets come back as (k, value) in ascending order, k from 0."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import entries as en


def values(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).cast("long").alias("value"))


def numbered(df: DataFrame) -> DataFrame:
    return en.ranked(df.select("value"), [F.col("value")]).select("k", "value")


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """All values of both, duplicates too."""
    return numbered(a.select("value").unionAll(b.select("value")))


def compact(a: DataFrame) -> DataFrame:
    return numbered(a.select("value").distinct())


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return numbered(a.select("value").union(b.select("value")).distinct())


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return numbered(a.select("value").intersect(b.select("value")))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return numbered(a.select("value").subtract(b.select("value")))


def destinations(a: DataFrame, result: DataFrame) -> DataFrame:
    """a with dst, each value's place in a set; -1 where it isn't there."""
    return a.join(result.select("value", F.col("k").alias("dst")), "value", "left").withColumn("dst", F.coalesce("dst", F.lit(-1).cast("long")))


def sort(df: DataFrame, keys: list[str], position: str = "k") -> DataFrame:
    """df with dst: where each row goes in a stable ascending sort by the keys."""
    return en.ranked(df, [*map(F.col, keys), F.col(position)], "dst")


def sort_unsigned(df: DataFrame, keys: list[str], bits: int = 64, position: str = "k") -> DataFrame:
    """As sort, for longs that hold unsigned numbers: negative ones are the largest."""
    if bits < 64:
        return sort(df, keys, position)
    flipped = [F.col(c).bitwiseXOR(F.lit(-(1 << 63))) for c in keys]
    return en.ranked(df, [*flipped, F.col(position)], "dst")
