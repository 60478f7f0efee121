"""Random matrices. Numbers come from a hash of seed and position, so a matrix doesn't depend on how it is partitioned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import IncompatibleError
from ..functions import cplx
from ..meta import Field, Symmetry


def uniform(seed: int, stream: str, position: Column) -> Column:
    """In [0, 1), from 53 bits."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(stream), position), 11).cast("double") / F.lit(float(1 << 53))


def between(seed: int, stream: str, position: Column, low: int, high: int) -> Column:
    """A whole number from low to high, both included."""
    return (F.floor(uniform(seed, stream, position) * (high - low + 1)) + low).cast("long")


def value(field: Field, seed: int, k: Column, low: int, high: int) -> Column | None:
    whole = lambda s: between(seed, s, k, low, high)
    if field is Field.PATTERN:
        return None
    if field is Field.COMPLEX:
        return cplx.cx(whole("re").cast("double"), whole("im").cast("double"))
    return whole("re") if field is Field.INTEGER else whole("re").cast("double")


def uniform_matrix(spark: SparkSession, nrows: int, ncols: int, nnz: int, field: Field | str = "real", symmetry: Symmetry | str = "general", low: int = 0, high: int = 1, seed: int = 0) -> DataFrame:
    """(k, i, j, a): nnz entries at random places, which may repeat. Symmetric kinds keep to the lower triangle; a skew
    diagonal is 0, a hermitian one real."""
    field, symmetry = Field(field), Symmetry(symmetry)
    if symmetry is not Symmetry.GENERAL and nrows != ncols:
        raise IncompatibleError("a symmetric matrix must be square")
    if symmetry is Symmetry.HERMITIAN and field is not Field.COMPLEX:
        raise IncompatibleError("a hermitian matrix is complex")
    k = F.col("id")
    i, j = between(seed, "i", k, 1, nrows), between(seed, "j", k, 1, ncols)
    if symmetry is not Symmetry.GENERAL:
        i, j = F.greatest(i, j), F.least(i, j)
    a = value(field, seed, k, low, high)
    df = spark.range(nnz).select(k.alias("k"), i.alias("i"), j.alias("j"), *([] if a is None else [a.alias("a")]))
    if a is None or symmetry in (Symmetry.GENERAL, Symmetry.SYMMETRIC):
        return df
    on = F.col("i") == F.col("j")
    if symmetry is Symmetry.SKEW:
        zero = cplx.lit(0) if field is Field.COMPLEX else F.lit(0)
        return df.withColumn("a", F.when(on, zero).otherwise(F.col("a")))
    return df.withColumn("a", F.when(on, cplx.cx(F.col("a.re"), F.lit(0.0))).otherwise(F.col("a")))


def uniform_array(spark: SparkSession, nrows: int, ncols: int = 1, field: Field | str = "real", low: int = 0, high: int = 1, seed: int = 0) -> DataFrame:
    """(k, a) of a dense matrix or vector."""
    return spark.range(nrows * ncols).select(F.col("id").alias("k"), value(Field(field), seed, F.col("id"), low, high).alias("a"))


def block_diagonal(spark: SparkSession, blocks: int, rows: int, columns: int, nonzeros: int | None = None, field: Field | str = "real", row_offset: int = 0, column_offset: int = 0, low: int = 0, high: int = 1, seed: int = 0) -> DataFrame:
    """(k, i, j, a): full blocks along the diagonal, or ones with so many random entries. Entries stay in their block."""
    each = rows * columns if nonzeros is None else nonzeros
    k = F.col("id")
    block = F.expr(f"id div {max(1, each)}")
    if nonzeros is None:
        within = k % each
        r, c = F.floor(within / columns), within % columns
    else:
        r, c = between(seed, "i", k, 0, rows - 1), between(seed, "j", k, 0, columns - 1)
    a = value(Field(field), seed, k, low, high)
    i, j = block * (rows + row_offset) + r + 1, block * (columns + column_offset) + c + 1
    return spark.range(blocks * each).select(k.alias("k"), i.cast("long").alias("i"), j.cast("long").alias("j"), *([] if a is None else [a.alias("a")]))
