"""Permutations as (src, dst): what stands at src goes to dst. Indices are those of the data that they are applied to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import PermutationError
from . import entries as en


def identity(spark, n: int, base: int = 0) -> DataFrame:
    return spark.range(base, n + base).select(F.col("id").alias("src"), F.col("id").alias("dst"))


def from_list(spark, values: list[int], base: int = 0) -> DataFrame:
    if sorted(values) != list(range(base, len(values) + base)):
        raise PermutationError("not a permutation")
    return spark.createDataFrame([(k + base, v) for k, v in enumerate(values)], "src long, dst long")


def is_valid(perm: DataFrame, n: int, base: int = 0) -> bool:
    r = perm.agg(F.count(F.lit(1)), F.countDistinct("src"), F.countDistinct("dst"), F.min(F.least("src", "dst")), F.max(F.greatest("src", "dst"))).first()
    return n == 0 or tuple(r) == (n, n, n, base, n - 1 + base)


def invert(perm: DataFrame) -> DataFrame:
    return perm.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def compose(a: DataFrame, b: DataFrame) -> DataFrame:
    """First a, then b."""
    return a.select("src", F.col("dst").alias("_via")).join(b.select(F.col("src").alias("_via"), "dst"), "_via").select("src", "dst")


def apply(perm: DataFrame, x: DataFrame, key: str = "i") -> DataFrame:
    """Moves the value at src to dst."""
    return x.withColumnRenamed(key, "src").join(perm, "src").withColumnRenamed("dst", key).select(*x.columns)


def scatter(entries: DataFrame, rows: DataFrame | None = None, columns: DataFrame | None = None) -> DataFrame:
    """Coordinate data: entry (i, j) becomes (rows[i], columns[j]); lines keep their positions."""
    return en.relabelled(entries, rows, columns).select(*entries.columns)


def gather(entries: DataFrame, rows: DataFrame | None = None, columns: DataFrame | None = None) -> DataFrame:
    """Array data: place (i, j) takes what stood at (rows[i], columns[j])."""
    return scatter(entries, None if rows is None else invert(rows), None if columns is None else invert(columns))


def by_parts(parts: DataFrame, base: int = 1) -> DataFrame:
    """Groups indices (idx from 0, part) by part, in order within: the permutation that a partition gives."""
    placed = en.ranked(parts.select("idx", "part"), [F.col("part"), F.col("idx")], "_k")
    return placed.select((F.col("idx") + base).alias("src"), (F.col("_k") + base).alias("dst"))
