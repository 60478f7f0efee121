"""Parts of indices, entries, matrices and vectors. Parts are numbered from 0; indices here are 0-based columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import storage
from ..errors import PartitionError
from ..meta import PartKind, Partitioning
from . import entries as en


def checked(x: Column, n: int) -> Column:
    return F.when((x >= 0) & (x < n), x).otherwise(F.raise_error(F.lit(f"index outside 0..{n - 1}")).cast("long"))


def part_of(x: Column, how: Partitioning | str, n: int, parts: int, sizes: list[int] | None = None, block: int = 1) -> Column:
    """Part of each index of 0..n-1: block (equal blocks or given sizes), cyclic, or cycles of blocks."""
    how = Partitioning(how)
    if parts <= 0:
        raise PartitionError("there must be a part at least")
    x = checked(x.cast("long"), n)
    if how is Partitioning.CYCLIC:
        part = x % parts
    elif how is Partitioning.BLOCK_CYCLIC:
        part = F.floor(x / block) % parts
    elif how is Partitioning.BLOCK:
        if sizes is None:
            part = F.floor(x / max(1, -(-n // parts)))
        else:
            if len(sizes) != parts or sum(sizes) != n:
                raise PartitionError("sizes of the parts don't add up")
            ends = [sum(sizes[: p + 1]) for p in range(parts)]
            part = F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e <= x))
    else:
        raise PartitionError("a custom partition is a table")
    return part.cast("int")


def custom(df: DataFrame, x: Column, table: DataFrame, name: str = "part") -> DataFrame:
    """Looks the part of each index up in table (idx, part)."""
    return df.withColumn("_idx", x).join(table.select(F.col("idx").alias("_idx"), F.col("part").alias(name)), "_idx", "left").drop("_idx")


def sized(df: DataFrame, x: Column, sizes: DataFrame, name: str = "part") -> DataFrame:
    """df with the part of each index x, counted from 0, of consecutive parts with given sizes: sizes is a table (part, size)
    of any length with parts numbered from 0; empty parts hold nothing. An index outside all parts stops the job.

    Where parts begin and the indices stand in one sorted line, and an index is in the last part that begins before it: a
    count over the line, whatever the sizes are and however often an index repeats."""
    starts = storage.written(en.prefix_sum(sizes.select("part", "size"), "part", F.col("size"), "_at"), "starts")
    total = starts.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    rows = df.select(checked(x.cast("long"), total).alias("_at"), F.lit(1).alias("_kind"), F.monotonically_increasing_id().alias("_tie"), F.struct(*df.columns).alias("_row"))
    kind = rows.schema["_row"].dataType
    begins = starts.select("_at", F.lit(0).alias("_kind"), F.col("part").cast("long").alias("_tie"), F.lit(None).cast(kind).alias("_row"))
    line = storage.written(en.ranked(rows.unionByName(begins), [F.col("_at"), F.col("_kind"), F.col("_tie")], "_k"), "line")
    counted = en.prefix_sum(line, "_k", 1 - F.col("_kind"), "_n").where("_kind = 1")
    return counted.select("_row.*", (F.col("_n") - 1).cast("int").alias(name))


def partition(entries: DataFrame, kind: PartKind | str, nrows: int, ncols: int, nnz: int, rows: dict | None = None, columns: dict | None = None, nonzeros: dict | None = None) -> DataFrame:
    """entries with `part`. rows, columns and nonzeros say how: arguments of part_of without x and n."""
    kind = PartKind(kind)
    i, j = F.col("i") - 1, F.col("j") - 1
    if kind is PartKind.NONZEROS:
        return entries.withColumn("part", part_of(F.col("k"), n=nnz, **nonzeros))
    if kind is PartKind.ROWS:
        return entries.withColumn("part", part_of(i, n=nrows, **rows))
    if kind is PartKind.COLUMNS:
        return entries.withColumn("part", part_of(j, n=ncols, **columns))
    if kind is PartKind.TWO_D:
        return entries.withColumn("part", part_of(i, n=nrows, **rows) * columns["parts"] + part_of(j, n=ncols, **columns))
    raise PartitionError("graph partitions are made by graphs.partition")


def sizes(parted: DataFrame, parts: int) -> DataFrame:
    """(part, size) of every part, also of empty ones."""
    counts = parted.groupBy("part").agg(F.count(F.lit(1)).alias("_n"))
    every = parted.sparkSession.range(parts).select(F.col("id").cast("int").alias("part"))
    return every.join(counts, "part", "left").select("part", F.coalesce("_n", F.lit(0).cast("long")).alias("size"))


def split(parted: DataFrame, parts: int) -> list[DataFrame]:
    """A frame for each part; dimensions stay, and so does the order within a part."""
    rest = [c for c in parted.columns if c != "part"]
    return [parted.where(F.col("part") == p).select(rest) for p in range(parts)]


def write_split(parted: DataFrame, path: str) -> None:
    """All parts in one pass, a folder each."""
    parted.write.partitionBy("part").parquet(path)
