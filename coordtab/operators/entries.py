"""Operators on entries: a matrix is (i, j, a), a file's data (k, i, j, a) with the storage position k from 0.

Indices are 1-based as in files, unless a function says otherwise. Entries of one place add up."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import storage
from ..errors import IncompatibleError, SizeError
from ..functions import cplx, morton
from ..meta import Field, Sorting, Symmetry

#: Rows of one block of a prefix sum.
BLOCK = 1 << 16
#: Keys for each partition of a range sort in the sample that bounds its ranges (Spark takes 100).
SAMPLE = 20


def matrix(table: DataFrame, i: str | Column, j: str | Column, a: str | Column | None = None, k: str | Column | None = None, base: int = 0) -> DataFrame:
    """Entries from any table with integer keys; base is the smallest key (files have 1)."""
    col = lambda c: c if isinstance(c, Column) else F.col(c)
    names = [] if k is None else [col(k).cast("long").alias("k")]
    names += [(col(i).cast("long") + (1 - base)).alias("i"), (col(j).cast("long") + (1 - base)).alias("j")]
    return table.select(*names, *([] if a is None else [col(a).alias("a")]))


def from_compressed(pointers: DataFrame, values: DataFrame) -> DataFrame:
    """Entries from compressed rows: pointers (i, first, last), values (k, j, a) with first <= k < last. A long row is
    written out in blocks, in several tasks. Few pointers may stand for many places, which Spark's estimate of their size
    doesn't show: they are never broadcast."""
    count = int(pointers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first, last = F.shiftright(F.col("first"), 16), F.shiftright(F.col("last") - 1, 16)
    blocks = pointers.where(F.col("first") < F.col("last")).select("i", "first", "last", F.explode(F.sequence(first, last)).alias("_b"))
    start = F.col("_b") * BLOCK
    rows = blocks.repartition(count, "i", "_b").select("i", F.explode(F.sequence(F.greatest("first", start), F.least("last", start + BLOCK) - 1)).alias("k"))
    return rows.hint("merge").join(values.hint("merge"), "k").select("k", "i", "j", "a")


def from_dense(table: DataFrame, row: str, values: str) -> DataFrame:
    """Entries from one array column a row."""
    return table.select((F.col(row).cast("long") + 1).alias("i"), F.posexplode(values).alias("j", "a")).select("i", (F.col("j").cast("long") + 1).alias("j"), "a")


def array_places(df: DataFrame, ncols: int) -> DataFrame:
    """(i, j, a) from the row-major positions k of an array."""
    return df.select((F.expr(f"k div {ncols}") + 1).alias("i"), (F.col("k") % ncols + 1).alias("j"), "a")


def triangular_places(df: DataFrame, strict: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(i, j, a), after columns to keep, from positions in the packed lower triangle, row by row (without the diagonal if
    strict)."""
    k = F.col("k").cast("double")
    row = F.floor((F.sqrt(8 * k + 1) - 1) / 2).cast("long")
    first = lambda r: F.shiftright(r * (r + 1), 1)
    row = F.when(first(row) > F.col("k"), row - 1).when(first(row + 1) <= F.col("k"), row + 1).otherwise(row)
    return df.select(*keep, (row + (2 if strict else 1)).alias("i"), (F.col("k") - first(row) + 1).alias("j"), "a")


def dense(entries: DataFrame, nrows: int, ncols: int) -> DataFrame:
    """(k, i, j, a) of all places in row-major order; places without entry get 0, duplicates are summed."""
    spark = entries.sparkSession
    places = spark.range(nrows * ncols).select(F.col("id").alias("k"), (F.expr(f"id div {ncols}") + 1).alias("i"), (F.col("id") % ncols + 1).alias("j"))
    return places.join(assemble(entries), ["i", "j"], "left").select("k", "i", "j", F.coalesce("a", F.lit(0)).alias("a"))


def set_constant(entries: DataFrame, value) -> DataFrame:
    """Every stored value becomes value (a complex one where the field is complex)."""
    kind = dict(entries.dtypes)["a"]
    new = cplx.lit(value) if kind.startswith("struct") else F.lit(value).cast(kind)
    return entries.withColumn("a", new)


def set_zero(entries: DataFrame) -> DataFrame:
    return set_constant(entries, 0)


def set_values(entries: DataFrame, values: DataFrame) -> DataFrame:
    """Values by position: values is (k, a)."""
    return entries.drop("a").join(values.select("k", "a"), "k")


def gathered(entries: DataFrame, lines: DataFrame) -> DataFrame:
    """Copies of lines: lines is (k, src), and line k of the result is line src."""
    return lines.join(entries.withColumnRenamed("k", "src"), "src").drop("src")


def transpose(entries: DataFrame, conjugate: bool = False) -> DataFrame:
    """i and j change roles; nothing moves."""
    rest = [c for c in entries.columns if c not in ("i", "j", "a")]
    a = [] if "a" not in entries.columns else [(cplx.conj(F.col("a")) if conjugate else F.col("a")).alias("a")]
    return entries.select(*rest, F.col("j").alias("i"), F.col("i").alias("j"), *a)


def transpose_array(df: DataFrame, nrows: int, ncols: int) -> DataFrame:
    """(k, a) of the transposed array, in its row-major order."""
    return df.select(((F.col("k") % ncols) * nrows + F.expr(f"k div {ncols}")).alias("k"), "a")


def expand_symmetry(entries: DataFrame, symmetry: Symmetry | str) -> DataFrame:
    """Adds the implied entries of symmetric kinds, in one scan."""
    symmetry = Symmetry(symmetry)
    if symmetry is Symmetry.GENERAL:
        return entries.select("i", "j", *(["a"] if "a" in entries.columns else []))
    kind = dict(entries.dtypes).get("a")
    i, j = F.col("i"), F.col("j")
    if kind is None:
        both = F.when(i == j, F.array(F.struct(i, j))).otherwise(F.array(F.struct(i, j), F.struct(j.alias("i"), i.alias("j"))))
    else:
        a = F.col("a")
        negative = cplx.scale(a, -1) if kind.startswith("struct") else -a
        other = {Symmetry.SYMMETRIC: lambda: a, Symmetry.SKEW: lambda: negative, Symmetry.HERMITIAN: lambda: cplx.conj(a)}[symmetry]()
        both = F.when(i == j, F.array(F.struct(i, j, a))).otherwise(F.array(F.struct(i, j, a), F.struct(j.alias("i"), i.alias("j"), other.alias("a"))))
    return entries.select(F.explode(both).alias("e")).select("e.*")


def nonzeros(entries: DataFrame, symmetry: Symmetry | str = Symmetry.GENERAL) -> DataFrame:
    """One row: stored (size), diagonal, nonzeros with the implied ones."""
    d = F.sum((F.col("i") == F.col("j")).cast("long"))
    full = F.count(F.lit(1)) if Symmetry(symmetry) is Symmetry.GENERAL else 2 * F.count(F.lit(1)) - F.coalesce(d, F.lit(0))
    return entries.agg(F.count(F.lit(1)).alias("stored"), F.coalesce(d, F.lit(0)).alias("diagonal"), full.alias("nonzeros"))


def diagonal(entries: DataFrame) -> DataFrame:
    return entries.where(F.col("i") == F.col("j"))


def in_bounds(entries: DataFrame, nrows: int, ncols: int) -> DataFrame:
    """The same entries; a job fails at the first index out of bounds."""
    ok = F.col("i").between(1, nrows) & F.col("j").between(1, ncols)
    stop = F.raise_error(F.concat(F.lit("index out of bounds: "), F.col("i"), F.lit(" "), F.col("j"))).cast("long")
    return entries.withColumn("i", F.when(ok, F.col("i")).otherwise(stop))


def assemble(entries: DataFrame, order: Sorting | str | None = None) -> DataFrame:
    """Entries of one place become one, their values added up (patterns: kept once). Partial sums are made before the
    shuffle. With an order the result has its position k as well."""
    if "a" not in entries.columns:
        out = entries.select("i", "j").distinct()
    elif dict(entries.dtypes)["a"].startswith("struct"):
        out = entries.groupBy("i", "j").agg(F.sum("a.re").alias("re"), F.sum("a.im").alias("im")).select("i", "j", cplx.cx(F.col("re"), F.col("im")).alias("a"))
    else:
        out = entries.groupBy("i", "j").agg(F.sum("a").alias("a"))
    if order is None:
        return out
    if Sorting(order) in (Sorting.UNSORTED, Sorting.PERMUTE):
        raise IncompatibleError("assembly needs an order")
    return ranked(out, sort_keys(order)).select("k", *out.columns)


def prefix_sum(df: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """Adds the sum of value over the rows before, in order of an integer key without large gaps. Windows hold BLOCK keys;
    the sums of blocks, one row for BLOCK keys, are summed in one window."""
    block = F.shiftright(F.col(key), 16)
    cut = df.withColumn("_block", block).withColumn("_value", value)
    blocks = cut.groupBy("_block").agg(F.sum("_value").alias("_sum"))
    before = blocks.select("_block", (F.sum("_sum").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))).alias("_before"))
    within = F.sum("_value").over(Window.partitionBy("_block").orderBy(key).rowsBetween(Window.unboundedPreceding, -1))
    return cut.join(before, "_block").withColumn(name, F.coalesce(within, F.lit(0)) + F.coalesce("_before", F.lit(0))).drop("_block", "_value", "_before")


def ranked(df: DataFrame, keys: list[Column], name: str = "k") -> DataFrame:
    """Adds the position (from 0) in the order of the keys, which must be total for a fixed result. A range partitioning
    sorts; the sizes of its partitions, a number each, give the offsets. These stand in the plan, as a broadcast of a few
    rows takes a megabyte, and the sample of the keys that Spark takes on the driver is a small one."""
    with storage.settings(df.sparkSession, {"spark.sql.execution.rangeExchange.sampleSizePerPartition": str(SAMPLE)}):
        placed = storage.written(df.repartitionByRange(*keys).sortWithinPartitions(*keys).select("*", F.spark_partition_id().alias("_ranked_p"), F.monotonically_increasing_id().alias("_ranked_m")), "ranked")
    sizes = dict(placed.groupBy("_ranked_p").agg(F.count(F.lit(1))).collect())  # a row a partition
    before = accumulate((sizes.get(p, 0) for p in range(max(sizes, default=0))), initial=0)
    offset = F.get(F.split(F.lit(",".join(map(str, before))), ",").cast("array<long>"), F.col("_ranked_p"))
    offset = F.coalesce(offset, F.lit(0).cast("long"))
    local = F.col("_ranked_m").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn(name, offset + local).drop("_ranked_p", "_ranked_m")


def sort_keys(order: Sorting | str) -> list[Column]:
    order = Sorting(order)
    if order is Sorting.ROW:
        return [F.col("i"), F.col("j")]
    if order is Sorting.COLUMN:
        return [F.col("j"), F.col("i")]
    if order is Sorting.MORTON:
        return [morton.encode32(F.col("i") - 1, F.col("j") - 1)]
    raise IncompatibleError(f"{order} has no keys")


def sort(entries: DataFrame, order: Sorting | str, perm: DataFrame | None = None) -> DataFrame:
    """(k, i, j, a, src): line src moves to position k; a stable sort. `permute` takes perm (k, dst), `unsorted` moves
    nothing."""
    order = Sorting(order)
    if order is Sorting.UNSORTED:
        return entries.withColumn("src", F.col("k"))
    if order is Sorting.PERMUTE:
        if perm is None:
            raise IncompatibleError("a permutation is needed")
        return entries.withColumnRenamed("k", "src").join(perm.withColumnRenamed("k", "src"), "src").withColumnRenamed("dst", "k")
    return ranked(entries.withColumnRenamed("k", "src"), [*sort_keys(order), F.col("src")])


def sort_permutation(entries: DataFrame, order: Sorting | str, perm: DataFrame | None = None) -> DataFrame:
    """(k, dst): where each line goes."""
    return sort(entries, order, perm).select(F.col("src").alias("k"), F.col("k").alias("dst"))


def compact(entries: DataFrame) -> DataFrame:
    """Adjacent lines of one place become one; (k, i, j, a, lines). A line starts a run if the line before, found by a
    join on the position, has another place."""
    before = entries.select((F.col("k") + 1).alias("k"), F.col("i").alias("_i"), F.col("j").alias("_j"))
    starts = entries.join(before, "k", "left").withColumn("_new", (F.coalesce((F.col("i") != F.col("_i")) | (F.col("j") != F.col("_j")), F.lit(True))).cast("long"))
    runs = prefix_sum(starts, "k", F.col("_new"), "_runs").withColumn("_run", F.col("_runs") + F.col("_new") - 1)
    sums = [F.sum("a").alias("a")] if "a" in entries.columns else []
    return runs.groupBy(F.col("_run").alias("k")).agg(F.min("i").alias("i"), F.min("j").alias("j"), *sums, F.count(F.lit(1)).alias("lines"))


def compact_map(entries: DataFrame) -> DataFrame:
    """(k, dst): the line (1-based) that each line goes into."""
    before = entries.select((F.col("k") + 1).alias("k"), F.col("i").alias("_i"), F.col("j").alias("_j"))
    starts = entries.join(before, "k", "left").withColumn("_new", (F.coalesce((F.col("i") != F.col("_i")) | (F.col("j") != F.col("_j")), F.lit(True))).cast("long"))
    return prefix_sum(starts, "k", F.col("_new"), "_runs").select("k", (F.col("_runs") + F.col("_new")).alias("dst"))


def pointers(entries: DataFrame, n: int, along: str = "i") -> DataFrame:
    """(i, first, last) for each of n rows: where its entries stand once they are grouped by row. along="j": columns."""
    counts = entries.groupBy(F.col(along).alias("i")).agg(F.count(F.lit(1)).alias("_n"))
    rows = entries.sparkSession.range(1, n + 1).select(F.col("id").alias("i")).join(counts, "i", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    return prefix_sum(rows, "i", F.col("_n"), "first").select("i", "first", (F.col("first") + F.col("_n")).alias("last"))


def compressed(entries: DataFrame, along: str = "i") -> DataFrame:
    """(k, i, j, a, src): entries grouped by row in storage order, with the line that each came from."""
    return ranked(entries.withColumnRenamed("k", "src"), [F.col(along), F.col("src")])


def checked_same(x: DataFrame, y: DataFrame) -> None:
    if dict(x.dtypes)["a"].startswith("struct") != dict(y.dtypes)["a"].startswith("struct"):
        raise IncompatibleError("fields differ")


def relabelled(entries: DataFrame, rows: DataFrame | None = None, columns: DataFrame | None = None) -> DataFrame:
    """Index maps of an output: rows and columns are (src, dst)."""
    out = entries
    if rows is not None:
        out = out.join(rows.toDF("i", "_to"), "i").withColumn("i", F.col("_to")).drop("_to")
    if columns is not None:
        out = out.join(columns.toDF("j", "_to"), "j").withColumn("j", F.col("_to")).drop("_to")
    return out


def local_numbers(entries: DataFrame, along: str = "i") -> DataFrame:
    """(src, dst): the distinct indices numbered from 1 in ascending order."""
    return ranked(entries.select(F.col(along).alias("src")).distinct(), [F.col("src")], "_k").select("src", (F.col("_k") + 1).alias("dst"))


def field_of(entries: DataFrame) -> Field:
    kind = dict(entries.dtypes).get("a")
    if kind is None:
        return Field.PATTERN
    return Field.COMPLEX if kind.startswith("struct") else Field.INTEGER if kind in ("int", "bigint", "smallint", "tinyint") else Field.REAL


def checked_square(nrows: int, ncols: int) -> None:
    if nrows != ncols:
        raise SizeError("a square matrix is needed")
