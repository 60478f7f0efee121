"""Matrix-vector and matrix-matrix products.

A product is a join on the inner index and a sum by the outer ones: partial sums are made before the shuffle, and Spark
broadcasts the vector where its size allows it and splits skewed join partitions where it doesn't."""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import storage
from ..errors import IncompatibleError
from ..functions import cplx
from ..meta import Symmetry, Transposition
from . import entries as en
from . import vectors as ve


def oriented(a: DataFrame, trans: Transposition | str, symmetry: Symmetry | str) -> DataFrame:
    """Entries of op(A) with implied ones."""
    trans = Transposition(trans)
    full = en.expand_symmetry(a, symmetry)
    if "a" not in full.columns:
        full = full.withColumn("a", F.lit(1.0))
    return full if trans is Transposition.NONE else en.transpose(full, conjugate=trans is Transposition.CONJ and ve.is_complex(full))


def product_sum(df: DataFrame, keys: list[str], x: str, y: str, is_complex: bool) -> DataFrame:
    if not is_complex:
        return df.groupBy(*keys).agg(F.sum(F.col(x) * F.col(y)).alias("a"))
    p = df.select(*keys, cplx.mul(F.col(x), F.col(y)).alias("p"))
    return p.groupBy(*keys).agg(F.sum("p.re").alias("re"), F.sum("p.im").alias("im")).select(*keys, cplx.cx(F.col("re"), F.col("im")).alias("a"))


def combined(product: DataFrame, given: DataFrame | None, alpha, beta) -> DataFrame:
    """alpha product + beta given. With beta 0 (or nothing given) only places with a product appear; else all of both."""
    out = ve.scal(product, alpha)
    if given is None or beta == 0:
        return out
    keys = ve.keys_of(product)
    kind = ve.kind_of(out)
    old = ve.scal(given, beta).select(*keys, F.col("a").alias("_old"))
    zero = ve.nothing(kind)
    both = out.join(old, keys, "full")
    return both.select(*keys, ve.plus(F.coalesce("a", zero), F.coalesce(F.col("_old") if kind.startswith("struct") else F.col("_old").cast(kind), zero), kind).alias("a"))


def gemv(a: DataFrame, x: DataFrame, y: DataFrame | None = None, alpha=1.0, beta=0.0, trans: Transposition | str = "notrans", symmetry: Symmetry | str = "general") -> DataFrame:
    """alpha op(A) x + beta y as (i, a), with 1-based indices everywhere. Integers are summed before they are scaled."""
    full = oriented(a, trans, symmetry)
    if ve.is_complex(full) != ve.is_complex(x):
        raise IncompatibleError("A and x differ in field")
    joined = full.select("i", F.col("j").alias("_in"), F.col("a").alias("_a")).join(x.select(F.col("i").alias("_in"), F.col("a").alias("_x")), "_in")
    return combined(product_sum(joined, ["i"], "_a", "_x", ve.is_complex(x)), y, alpha, beta)


#: Consecutive inner indices that are multiplied in one task, where there are enough of them for all tasks.
INNER = 1 << 13


def inner_block(right: DataFrame) -> tuple[int, int]:
    """How many consecutive inner indices, the rows of the right operand, make a block: so many that there are some blocks
    a task at least, and not many more blocks than Spark makes partitions. And how many partitions they are dealt to, which
    Spark must not put together, as their products need more room than they do."""
    spark = right.sparkSession
    most = right.agg(F.max("i")).first()[0] or 1
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    block = max(1, ceil(most / (4 * partitions)), min(INNER, ceil(most / (3 * spark.sparkContext.defaultParallelism))))
    return block, min(partitions, most // block + 1)


def summed(left: DataFrame, right: DataFrame, block: int, partitions: int, *on: str) -> DataFrame:
    """(i, j, a): the sums of products of (i, _in, _a) and (_in, j, _b) that meet in _in and in `on`, stored. Blocks of
    consecutive inner indices meet in one task each, which adds up their products before they are shuffled: neighbours
    have places in common more often than indices that a hash deals to one task, and how many of them meet doesn't depend
    on how many tasks there are."""

    def dealt(df: DataFrame) -> DataFrame:
        return df.withColumn("_block", F.expr(f"_in div {block}")).repartition(partitions, "_block", *on)

    # Spark deals both sides anew if they have fewer partitions than its setting says
    with storage.settings(left.sparkSession, {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.shuffle.partitions": str(partitions)}):
        joined = dealt(left).join(dealt(right), ["_block", *on, "_in"])
        return storage.written(product_sum(joined, ["i", "j"], "_a", "_b", dict(left.dtypes)["_a"].startswith("struct")), "products")


def gemm(a: DataFrame, b: DataFrame, c: DataFrame | None = None, alpha=1.0, beta=0.0, trans_a: Transposition | str = "notrans", trans_b: Transposition | str = "notrans", symmetry: Symmetry | str = "general", assembled: bool = False) -> DataFrame:
    """alpha op(A) op(B) + beta C as entries; A may be of a symmetric kind. For sparse operands.

    Entries of one place are added up before the join, as n of them on both sides would meet n**2 times; assembled=True
    says that there are none and saves these two shuffles."""
    left, right = oriented(a, trans_a, symmetry), oriented(b, trans_b, "general")
    if ve.is_complex(left) != ve.is_complex(right):
        raise IncompatibleError("A and B differ in field")
    block, partitions = inner_block(right)
    if not assembled:
        left, right = en.assemble(left), en.assemble(right)
    left, right = left.select("i", F.col("j").alias("_in"), F.col("a").alias("_a")), right.select(F.col("i").alias("_in"), "j", F.col("a").alias("_b"))
    return combined(summed(left, right, block, partitions), c, alpha, beta)


#: Products that one inner index may make in one task.
HEAVY = 1 << 20


def spread(left: DataFrame, right: DataFrame, heavy: int = HEAVY) -> tuple[DataFrame, DataFrame]:
    """Both operands (i, _in, _a) and (_in, j, _b) with _p and _q, on which they meet as well. An inner index of m entries
    on the left and n on the right makes m n products; beyond `heavy` they are spread over a grid of g times g tasks, g
    squared times heavy being m n: an entry on the left goes to all of one row of the grid, which its i decides, one on the
    right to all of a column. So 2 g copies are dealt out for m n products, and no task makes many more than others."""
    m = left.groupBy("_in").agg(F.count(F.lit(1)).alias("_m"))
    n = right.groupBy("_in").agg(F.count(F.lit(1)).alias("_n"))
    products = F.col("_m").cast("double") * F.col("_n")
    large = storage.written(m.join(n, "_in").where(products > heavy).select("_in", F.ceil(F.sqrt(products / heavy)).cast("int").alias("_g")), "heavy")

    def dealt(df: DataFrame, own: str, outer: str, every: str) -> DataFrame:
        g = F.coalesce("_g", F.lit(1))
        with_g = df.join(large, "_in", "left")
        return with_g.withColumn(own, F.pmod(F.xxhash64(outer), g).cast("int")).withColumn(every, F.explode(F.sequence(F.lit(0), g - 1))).drop("_g")

    return dealt(left, "_p", "i", "_q"), dealt(right, "_q", "j", "_p")


#: Products of one inner index from which on its rows and columns are multiplied in square tiles of the result.
DENSE, SIDE = 1 << 22, 1 << 10


def in_tiles(left: DataFrame, right: DataFrame, given: DataFrame) -> DataFrame:
    """(i, j, a): given plus the products of (i, _in, _a) and (_in, j, _b), without repeated entries. As many products as
    places would be shuffled if they were summed by place; a tile of the result is made in one task instead, from the
    entries of its rows and columns and from what is given there. An entry goes to the tiles in which its inner index
    meets something."""
    is_complex = ve.is_complex(given)
    at, within = lambda c: F.expr(f"({c} - 1) div {SIDE}"), lambda c: ((F.col(c) - 1) % SIDE).cast("int")
    none = F.lit(0).cast("int")
    rows_at = left.groupBy("_in").agg(F.collect_set(at("i")).alias("_t"))
    columns_at = right.groupBy("_in").agg(F.collect_set(at("j")).alias("_t"))

    def line(kind: int, bi, bj, r, c, inner, value: str) -> list:
        re, im = (F.col(value)["re"], F.col(value)["im"]) if is_complex else (F.col(value), F.lit(0.0))
        return [bi.alias("_bi"), bj.alias("_bj"), F.lit(kind).alias("_kind"), r.alias("_r"), c.alias("_c"), inner.alias("_in"), re.alias("_re"), im.alias("_im")]

    each = F.explode("_t")
    lines = left.join(columns_at, "_in").select("*", each.alias("_bj")).select(*line(0, at("i"), F.col("_bj"), within("i"), none, F.col("_in"), "_a"))
    lines = lines.unionByName(right.join(rows_at, "_in").select("*", each.alias("_bi")).select(*line(1, F.col("_bi"), at("j"), none, within("j"), F.col("_in"), "_b")))
    lines = lines.unionByName(given.select(*line(2, at("i"), at("j"), within("i"), within("j"), F.lit(0).cast("long"), "a")))

    def work(key, rows):
        bi, bj = (k.as_py() for k in key)
        kind, r, c, inner, re, im = (rows[n].to_numpy() for n in ("_kind", "_r", "_c", "_in", "_re", "_im"))
        a = re + 1j * im if is_complex else re
        out, hit = np.zeros((SIDE, SIDE), a.dtype), np.zeros((SIDE, SIDE), bool)
        old = kind == 2
        out[r[old], c[old]], hit[r[old], c[old]] = a[old], True
        sides = []
        for side in (0, 1):
            own = np.flatnonzero(kind == side)
            own = own[np.argsort(inner[own], kind="stable")]
            sides.append((own, inner[own]))
        for k in np.intersect1d(sides[0][1], sides[1][1]):
            x, y = (own[slice(*np.searchsorted(of, [k, k + 1]))] for own, of in sides)
            place = np.ix_(r[x], c[y])
            out[place] += np.multiply.outer(a[x], a[y])
            hit[place] = True
        i, j = np.nonzero(hit)
        v = out[i, j]
        v = pa.StructArray.from_arrays([pa.array(v.real.copy()), pa.array(v.imag.copy())], names=["re", "im"]) if is_complex else pa.array(v)
        return pa.table({"i": i + bi * SIDE + 1, "j": j + bj * SIDE + 1, "a": v})

    return lines.groupBy("_bi", "_bj").applyInArrow(work, f"i long, j long, a {ve.kind_of(given)}")


def gemm_grid(a: DataFrame, b: DataFrame, c: DataFrame | None = None, alpha=1.0, beta=0.0, trans_a: Transposition | str = "notrans", trans_b: Transposition | str = "notrans", symmetry: Symmetry | str = "general", assembled: bool = False, heavy: int = HEAVY, dense: int = DENSE) -> DataFrame:
    """gemm for sparse operands with frequent inner indices: the same result, in tasks of even size. It costs two counts of
    the operands more. Inner indices of more than `dense` products are multiplied by tiles of the result (double values)."""
    left, right = oriented(a, trans_a, symmetry), oriented(b, trans_b, "general")
    is_complex = ve.is_complex(left)
    if is_complex != ve.is_complex(right):
        raise IncompatibleError("A and B differ in field")
    block, partitions = inner_block(right)
    if not assembled:
        left, right = storage.written(en.assemble(left), "left"), storage.written(en.assemble(right), "right")
    left, right = left.select("i", F.col("j").alias("_in"), F.col("a").alias("_a")), right.select(F.col("i").alias("_in"), "j", F.col("a").alias("_b"))
    full = None
    if all(kind in ("double", "struct<re:double,im:double>") for kind in (dict(left.dtypes)["_a"], dict(right.dtypes)["_b"])):
        counts = (df.groupBy("_in").agg(F.count(F.lit(1)).alias(n)) for df, n in ((left, "_m"), (right, "_n")))
        full = storage.written(next(counts).join(next(counts), "_in").where(F.col("_m").cast("double") * F.col("_n") > dense).select("_in"), "dense")
        if full.isEmpty():
            full = None
    thin = (left, right) if full is None else tuple(df.join(full, "_in", "left_anti") for df in (left, right))
    product = summed(*spread(*thin, heavy), block, partitions, "_p", "_q")
    if full is not None:
        product = in_tiles(*(df.join(full, "_in", "left_semi") for df in (left, right)), product)
    return combined(product, c, alpha, beta)


def tiles(m: DataFrame, rows: int, name: str) -> DataFrame:
    """(bi, bj, entries) of square tiles: places within the tile and values."""
    at = lambda c: F.expr(f"({c} - 1) div {rows}")
    inner = F.struct(((F.col("i") - 1) % rows).cast("int").alias("r"), ((F.col("j") - 1) % rows).cast("int").alias("c"), F.col("a").cast("double").alias("v"))
    return m.groupBy(at("i").alias("bi"), at("j").alias("bj")).agg(F.collect_list(inner).alias(name))


def gemm_dense(a: DataFrame, b: DataFrame, c: DataFrame | None = None, alpha=1.0, beta=0.0, trans_a: Transposition | str = "notrans", trans_b: Transposition | str = "notrans", symmetry: Symmetry | str = "general", tile: int = 256) -> DataFrame:
    """gemm for dense real operands: tiles are joined on the inner block and multiplied with NumPy, the products of tiles
    are summed by Spark. A tile holds tile**2 values at most (more only where entries repeat)."""
    left, right = tiles(oriented(a, trans_a, symmetry), tile, "_x"), tiles(oriented(b, trans_b, "general"), tile, "_y")
    pairs = left.select("bi", F.col("bj").alias("_in"), "_x").join(right.select(F.col("bi").alias("_in"), "bj", "_y"), "_in").select("bi", "bj", "_x", "_y")

    def filled(cells: pa.Array) -> np.ndarray:
        out = np.zeros((tile, tile))
        np.add.at(out, tuple(np.asarray(cells.field(k)) for k in ("r", "c")), np.asarray(cells.field("v")))
        return out

    def multiply(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                p = filled(batch.column(2)[k].values) @ filled(batch.column(3)[k].values)
                r, s = np.nonzero(p)
                yield pa.RecordBatch.from_arrays([pa.array(r + batch.column(0)[k].as_py() * tile + 1), pa.array(s + batch.column(1)[k].as_py() * tile + 1), pa.array(p[r, s])], names=["i", "j", "a"])

    partial = pairs.mapInArrow(multiply, "i long, j long, a double")
    return combined(partial.groupBy("i", "j").agg(F.sum("a").alias("a")), c, alpha, beta)


class Prepared:
    """A matrix laid out once for many products: partitioned by column and kept, so that only vectors move. For vectors that
    stay where they are as well, see halo.Product, which has the same methods."""

    keys = ["i"]

    def __init__(self, a: DataFrame, partitions: int, trans: Transposition | str = "notrans", symmetry: Symmetry | str = "general"):
        self.a = oriented(a, trans, symmetry).repartition(partitions, "j").persist()

    def gemv(self, x: DataFrame, y: DataFrame | None = None, alpha=1.0, beta=0.0) -> DataFrame:
        return gemv(self.a, x, y, alpha, beta)

    def placed(self, x: DataFrame) -> DataFrame:
        return x

    def written(self, df: DataFrame) -> DataFrame:
        return storage.written(df, "prepared")

    def close(self) -> None:
        self.a.unpersist()


def flops(operation: str, nnz: int, is_complex: bool = False, k: int = 1) -> int:
    """Floating-point operations that an operation counts as: by stored values, for gemm by m n k (nnz = m n)."""
    per = {"scal": (1, 6), "axpy": (2, 8), "aypx": (2, 8), "dot": (2, 8), "nrm2": (2, 4), "asum": (1, 2), "gemv": (3, 10), "gemm": (3, 10)}
    return per[operation][is_complex] * nnz * k
