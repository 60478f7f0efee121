"""Vector operators: (i, a) with i 0-based; a full vector has every index, a packed one some.

Complex values are struct<re, im>. Scalars come back as one-row DataFrames, so that nothing runs before it is asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import IncompatibleError
from ..functions import cplx

INTEGERS = ("tinyint", "smallint", "int", "bigint")


def kind_of(x: DataFrame) -> str:
    return dict(x.dtypes)["a"]


def is_complex(x: DataFrame) -> bool:
    return kind_of(x).startswith("struct")


def vector(table: DataFrame, i: str | Column, a: str | Column) -> DataFrame:
    col = lambda c: c if isinstance(c, Column) else F.col(c)
    return table.select(col(i).cast("long").alias("i"), col(a).alias("a"))


def constant(spark, n: int, value=0.0) -> DataFrame:
    """A full vector of n equal values."""
    return spark.range(n).select(F.col("id").alias("i"), (cplx.lit(value) if isinstance(value, complex) else F.lit(value)).alias("a"))


def same_field(x: DataFrame, y: DataFrame) -> None:
    if is_complex(x) != is_complex(y):
        raise IncompatibleError("fields differ")


def real_only(*of: DataFrame) -> None:
    if any(is_complex(x) for x in of):
        raise IncompatibleError("not for complex values")


def times(a: Column, alpha, kind: str) -> Column:
    """alpha * a in a's type; integers are truncated, as the type demands."""
    if kind.startswith("struct"):
        return cplx.mul(a, cplx.lit(alpha)) if isinstance(alpha, complex) else cplx.scale(a, F.lit(alpha))
    if isinstance(alpha, complex):
        raise IncompatibleError("a complex scalar needs complex values")
    if alpha == 1:
        return a
    return (a * F.lit(alpha)).cast(kind)


def plus(a: Column, b: Column, kind: str) -> Column:
    return cplx.add(a, b) if kind.startswith("struct") else (a + b).cast(kind)


def nothing(kind: str) -> Column:
    return cplx.lit(0) if kind.startswith("struct") else F.lit(0).cast(kind)


def scal(x: DataFrame, alpha) -> DataFrame:
    """alpha x; a real alpha scales both parts of complex values."""
    return x if alpha == 1 and not isinstance(alpha, complex) else x.withColumn("a", times(F.col("a"), alpha, kind_of(x)))


def keys_of(x: DataFrame) -> list[str]:
    return ["i", "j"] if "j" in x.columns else ["i"]


def paired(x: DataFrame, y: DataFrame, how: str = "inner") -> DataFrame:
    """The keys with _x and _y; works for vectors and for matrices of one pattern."""
    same_field(x, y)
    keys = keys_of(x)
    return y.select(*keys, F.col("a").alias("_y")).join(x.select(*keys, F.col("a").alias("_x")), keys, how)


def axpy(x: DataFrame, y: DataFrame, alpha=1.0) -> DataFrame:
    """alpha x + y, place by place. Both have the same pattern; a place that only y has stays, one of x alone is lost."""
    k = kind_of(y)
    both = paired(x, y, "left")
    return both.select(*keys_of(y), F.coalesce(plus(times(F.col("_x"), alpha, k), F.col("_y"), k), F.col("_y")).alias("a"))


#: Values in a row of a blocked vector: half a megabyte of doubles.
BLOCK = 1 << 16


def blocked(x: DataFrame, size: int = BLOCK) -> DataFrame:
    """(b, values): a full vector as rows of so many values in order, the last one shorter. What joins blocks moves and
    looks up a row for each block instead of one for each value."""
    each = x.groupBy(F.floor(F.col("i") / size).cast("long").alias("b")).agg(F.array_sort(F.collect_list(F.struct("i", "a"))).alias("_v"))
    return each.select("b", F.transform("_v", lambda v: v["a"]).alias("values"))


def unblocked(blocks: DataFrame, size: int = BLOCK) -> DataFrame:
    """(i, a) of a blocked vector."""
    return blocks.select("b", F.posexplode("values").alias("_k", "a")).select((F.col("b") * size + F.col("_k")).alias("i"), "a")


def axpy_blocks(x: DataFrame, y: DataFrame, alpha=1.0) -> DataFrame:
    """alpha x + y of full vectors in equal blocks."""
    k = dict(y.dtypes)["values"].removeprefix("array<").removesuffix(">")
    if k != dict(x.dtypes)["values"].removeprefix("array<").removesuffix(">"):
        raise IncompatibleError("fields differ")
    both = y.withColumnRenamed("values", "_y").join(x.withColumnRenamed("values", "_x"), "b")
    return both.select("b", F.zip_with("_x", "_y", lambda p, q: plus(times(p, alpha, k), q, k)).alias("values"))


def aypx(x: DataFrame, y: DataFrame, alpha=1.0) -> DataFrame:
    """alpha y + x."""
    k = kind_of(y)
    both = paired(x, y, "left")
    return both.select(*keys_of(y), plus(times(F.col("_y"), alpha, k), F.coalesce("_x", nothing(k)), k).alias("a"))


def added(x: DataFrame, y: DataFrame, alpha=1.0) -> DataFrame:
    """alpha x + y for any two patterns."""
    k = kind_of(y)
    keys = keys_of(y)
    both = scal(x, alpha).select(*keys, "a").unionByName(y.select(*keys, "a"))
    if k.startswith("struct"):
        return both.groupBy(*keys).agg(F.sum("a.re").alias("re"), F.sum("a.im").alias("im")).select(*keys, cplx.cx(F.col("re"), F.col("im")).alias("a"))
    return both.groupBy(*keys).agg(F.sum("a").cast(k).alias("a"))


def copy(x: DataFrame, y: DataFrame) -> DataFrame:
    """y's pattern with the values of x."""
    return paired(x, y).select(*keys_of(y), F.col("_x").alias("a"))


def swap(x: DataFrame, y: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Frames don't change, so swapping is naming."""
    return y, x


def dot(x: DataFrame, y: DataFrame) -> DataFrame:
    """Sum of products (Frobenius for matrices); real and integer fields."""
    real_only(x, y)
    return paired(x, y).agg(F.coalesce(F.sum(F.col("_x") * F.col("_y")).cast("double"), F.lit(0.0)).alias("dot"))


def complex_dot(x: DataFrame, y: DataFrame, conjugate: bool) -> DataFrame:
    """re and im of sum x y, with x conjugated or not."""
    both = paired(x, y)
    left = F.col("_x")
    if not is_complex(x):
        p = cplx.cx(left * F.col("_y"), F.lit(0.0))
    else:
        p = cplx.mul(cplx.conj(left) if conjugate else left, F.col("_y"))
    return both.select(p.alias("p")).agg(F.coalesce(F.sum("p.re"), F.lit(0.0)).alias("re"), F.coalesce(F.sum("p.im"), F.lit(0.0)).alias("im"))


def dotu(x: DataFrame, y: DataFrame) -> DataFrame:
    return complex_dot(x, y, False)


def dotc(x: DataFrame, y: DataFrame) -> DataFrame:
    return complex_dot(x, y, True)


def magnitude(x: DataFrame) -> Column:
    return cplx.abs1(F.col("a")) if is_complex(x) else F.abs("a")


def nrm2(x: DataFrame) -> DataFrame:
    """Euclidean norm; Frobenius for matrices."""
    square = F.col("a.re") * F.col("a.re") + F.col("a.im") * F.col("a.im") if is_complex(x) else F.col("a").cast("double") * F.col("a")
    return x.agg(F.sqrt(F.coalesce(F.sum(square), F.lit(0.0))).alias("nrm2"))


def asum(x: DataFrame) -> DataFrame:
    return x.agg(F.coalesce(F.sum(magnitude(x)).cast("double"), F.lit(0.0)).alias("asum"))


def iamax(x: DataFrame, position: str = "i") -> DataFrame:
    """The first position of the largest magnitude; 0 for an empty vector."""
    best = F.max_by(F.col(position), F.struct(magnitude(x), -F.col(position)))
    return x.agg(F.coalesce(best, F.lit(0).cast("long")).alias("iamax"))


def usdot(x: DataFrame, y: DataFrame) -> DataFrame:
    """Packed x with full y."""
    return dot(x, y)


def usdotu(x: DataFrame, y: DataFrame) -> DataFrame:
    return dotu(x, y)


def usdotc(x: DataFrame, y: DataFrame) -> DataFrame:
    return dotc(x, y)


def usaxpy(x: DataFrame, y: DataFrame, alpha=1.0) -> DataFrame:
    """y plus alpha times packed x."""
    return axpy(x, y, alpha)


def usga(x: DataFrame, y: DataFrame) -> DataFrame:
    """Packed x takes y's values at its places; repeated places are each filled."""
    return x.drop("a").join(y.select("i", "a"), "i", "left").select(*x.columns)


def usgz(x: DataFrame, y: DataFrame) -> tuple[DataFrame, DataFrame]:
    """usga, and y with zeros at the places of x."""
    places = x.select("i").distinct().withColumn("_hit", F.lit(True))
    zeroed = y.join(places, "i", "left").withColumn("a", F.when(F.col("_hit"), nothing(kind_of(y))).otherwise(F.col("a"))).drop("_hit")
    return usga(x, y), zeroed


def ussc(x: DataFrame, y: DataFrame) -> DataFrame:
    """y with packed x's values at its places."""
    both = paired(x, y, "left")
    return both.select("i", F.coalesce("_x", "_y").alias("a"))


def usscga(x: DataFrame, z: DataFrame) -> DataFrame:
    """Packed z takes packed x's values where x has the place and 0 where it hasn't."""
    k = kind_of(x)
    return z.drop("a").join(x.select("i", "a"), "i", "left").withColumn("a", F.coalesce("a", nothing(k))).select(*z.columns)


def set_values(x: DataFrame, values: DataFrame) -> DataFrame:
    return x.drop("a").join(values.select("i", "a"), "i").select(*x.columns)


def get_values(x: DataFrame) -> DataFrame:
    """One row with the values in order of position, for vectors that fit one; others give blocked() rows."""
    return x.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "a"))), lambda e: e["a"]).alias("values"))


def split(x: DataFrame, parts: DataFrame, n: int) -> list[DataFrame]:
    """The pieces of a vector; parts is (i, part)."""
    both = x.join(parts, "i")
    return [both.where(F.col("part") == p).select(*x.columns) for p in range(n)]
