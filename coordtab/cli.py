"""Command line: `python -m coordtab.cli PROGRAM ...`, one program for each operation on Matrix Market files.

Files are read by Spark from any path that it knows; `-` is standard input, which is put into the shared folder first. In
axpy, scal, gemv and gemm a number may stand before the files: the factor alpha. Results go to --output (a folder of text
files) or, without it, to standard output."""

from __future__ import annotations

import argparse
import sys
import time
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import storage
from .errors import IncompatibleError, MatrixError
from .meta import Field, Kind, Layout, MatrixBackend, Meta, Ordering, Overlap, Partitioning, PartKind, Precision, Sorting, Symmetry, Transposition, VectorBackend
from .operators import entries as en
from .operators import generate, graphs, products, solver, spy
from .operators import partitioning as pt
from .operators import vectors as ve
from .sources import mtx


def scalar(text: str):
    z = complex(text.replace("i", "j"))
    return z if z.imag else z.real


def emit(args, m: Meta, data: DataFrame) -> None:
    if args.quiet:
        data.write.format("noop").mode("overwrite").save()
    elif args.output:
        mtx.write(m, data, args.output, args.format)
    else:
        print("\n".join([m.header_line(), *(c.removesuffix("\n") for c in m.comments), m.size_line()]))
        for r in mtx.lines_of(m, data, args.format).orderBy("k").toLocalIterator():
            print(r["value"])


def emit_vector(args, n: int, x: DataFrame, integer: bool = False) -> None:
    """x has 0-based i."""
    field = Field.INTEGER if integer else Field.COMPLEX if ve.is_complex(x) else Field.REAL
    emit(args, Meta(n, kind=Kind.VECTOR, layout=Layout.ARRAY, field=field), x.select(F.col("i").alias("k"), "a"))


def matrix(spark, args, path: str) -> tuple[Meta, DataFrame]:
    m, data = mtx.read_matrix(spark, path, args.precision)
    if m.kind is not Kind.MATRIX:
        raise IncompatibleError("a matrix is needed")
    return m, data


def full(m: Meta, x: DataFrame) -> DataFrame:
    """A vector with every index."""
    if m.layout is Layout.ARRAY:
        return x
    return ve.axpy(x, ve.constant(x.sparkSession, m.nrows, 0j if ve.is_complex(x) else 0.0))


def repeated(args, operation):
    """Runs a lazy operation args.repeat times; with -v each run is timed."""
    out = operation()
    for _ in range(args.repeat - 1 if args.repeat > 1 else 0):
        began = time.perf_counter()
        out.write.format("noop").mode("overwrite").save()
        if args.verbose:
            print(f"{time.perf_counter() - began:.6f} seconds", file=sys.stderr)
    return out


def pair(spark, args) -> tuple[Meta, DataFrame, DataFrame]:
    mx, x = (mtx.read_vector if mtx.meta(spark, args.x)[0].kind is Kind.VECTOR else mtx.read_matrix)(spark, args.x, args.precision)
    if args.y:
        _, y = (mtx.read_vector if mx.kind is Kind.VECTOR else mtx.read_matrix)(spark, args.y, args.precision)
    else:
        y = None
    return mx, x, y


def run_axpy(spark, args):
    m, x, y = pair(spark, args)
    y = ve.scal(x, 0.0) if y is None else y
    out = repeated(args, lambda: ve.axpy(x, y, args.alpha))
    if m.kind is Kind.VECTOR:
        return emit_vector(args, m.nrows, out, m.field is Field.INTEGER) if m.layout is Layout.ARRAY else emit(args, m, en.ranked(out.withColumn("i", F.col("i") + 1), [F.col("i")]))
    return emit(args, replace(m, layout=Layout.COORDINATE, nnz=out.count()), en.ranked(out, [F.col("i"), F.col("j")]))


def run_dot(spark, args):
    m, x, y = pair(spark, args)
    y = en.set_constant(x, 1) if y is None else y
    out = repeated(args, lambda: ve.dotc(x, y) if m.field is Field.COMPLEX else ve.dot(x, y)).first()
    print(*out)


def run_nrm2(spark, args):
    args.y = None
    _, x, _ = pair(spark, args)
    print(repeated(args, lambda: ve.nrm2(x)).first()[0])


def run_scal(spark, args):
    m, data = mtx.read(spark, args.x, args.precision)
    emit(args, m, repeated(args, lambda: ve.scal(data, args.alpha)))


def run_gemv(spark, args):
    m, a = matrix(spark, args, args.A)
    rows, columns = (m.nrows, m.ncols) if args.trans is Transposition.NONE else (m.ncols, m.nrows)
    one, zero = (1 + 0j, 0j) if m.field is Field.COMPLEX else (1.0, 0.0)
    x = full(*mtx.read_vector(spark, args.x, args.precision)) if args.x else ve.constant(spark, columns, one)
    y = full(*mtx.read_vector(spark, args.y, args.precision)) if args.y else ve.constant(spark, rows, zero)
    up = lambda v: v.withColumn("i", F.col("i") + 1)
    out = repeated(args, lambda: products.gemv(a, up(x), up(y), args.alpha, 1.0, args.trans, m.symmetry))
    emit_vector(args, rows, out.withColumn("i", F.col("i") - 1), m.field is Field.INTEGER)


def run_gemm(spark, args):
    (ma, a), (mb, b) = matrix(spark, args, args.A), matrix(spark, args, args.B)
    c = matrix(spark, args, args.C)[1] if args.C else None
    rows = ma.nrows if args.A_trans is Transposition.NONE else ma.ncols
    columns = mb.ncols if args.B_trans is Transposition.NONE else mb.nrows
    tiled = MatrixBackend(args.matrix_type) in (MatrixBackend.DENSE, MatrixBackend.BLAS) and ma.field is Field.REAL
    product = products.gemm_dense if tiled else products.gemm
    out = repeated(args, lambda: product(a, b, c, args.alpha, 1.0, args.A_trans, args.B_trans, ma.symmetry))
    emit(args, Meta(rows, columns, layout=Layout.ARRAY, field=ma.field), en.dense(out, rows, columns))


def run_cg(spark, args):
    m, a = matrix(spark, args, args.A)
    b = full(*mtx.read_vector(spark, args.b, args.precision)) if args.b else ve.constant(spark, m.nrows, 1.0)
    up = lambda v: v.withColumn("i", F.col("i") + 1)
    x0 = up(full(*mtx.read_vector(spark, args.x0, args.precision))) if args.x0 else None
    found = solver.cg(a, up(b), x0, args.atol, args.rtol, args.max_iterations, m.symmetry, restart=args.restart)
    if args.verbose or args.progress:
        print(f"{found.iterations} iterations, |b| {found.b_norm}, |r| {found.residual_norm} from {found.first_residual_norm}", file=sys.stderr)
    emit_vector(args, m.nrows, found.x.withColumn("i", F.col("i") - 1))
    return 0 if found.converged else 1


def run_info(spark, args):
    for name, v in mtx.info(spark, args.A).first().asDict().items():
        print(f"{name}: {v}")


def how(args, of: str) -> dict:
    return {"how": getattr(args, f"{of}_part_type"), "parts": getattr(args, f"{of}_parts"), "block": getattr(args, f"{of}_blksize")}


def own_method(name: str) -> None:
    """Says what is done in place of a package."""
    print(f"{name}: made by this library's own partition (runs of a breadth-first order, improved by exchanges), not by that package", file=sys.stderr)


def run_partition(spark, args):
    m, a = matrix(spark, args, args.A)
    if args.part_type in (PartKind.METIS, PartKind.SCOTCH):
        own_method(args.part_type)
        out = graphs.partition_entries(a, m.nrows, m.ncols, args.nz_parts)
    else:
        out = pt.partition(a, args.part_type, m.nrows, m.ncols, m.data_lines, how(args, "row"), how(args, "column"), how(args, "nz"))
    for path, of in ((args.row_part_path, "row"), (args.column_part_path, "column")):
        if path:
            n = m.nrows if of == "row" else m.ncols
            part = spark.range(n).select(F.col("id").alias("k"), pt.part_of(F.col("id"), n=n, **how(args, of)).alias("a"))
            mtx.write(Meta(n, kind=Kind.VECTOR, layout=Layout.ARRAY, field=Field.INTEGER), part, path)
    emit(args, Meta(m.data_lines, kind=Kind.VECTOR, layout=Layout.ARRAY, field=Field.INTEGER), out.select("k", F.col("part").alias("a")))


def run_rand(spark, args):
    field, symmetry = Field(args.field), Symmetry(args.symmetry)
    low, high = args.min, args.max
    if args.generator == "blkdiag":
        data = generate.block_diagonal(spark, args.blocks, args.rows, args.columns, args.nonzeros, field, args.row_offset, args.column_offset, low, high, args.seed)
        m = Meta(args.blocks * (args.rows + args.row_offset), args.blocks * (args.columns + args.column_offset), data.count(), field=field)
    elif Layout(args.layout) is Layout.ARRAY:
        vector = args.columns is None
        data = generate.uniform_array(spark, args.rows, 1 if vector else args.columns, field, low, high, args.seed)
        m = Meta(args.rows, -1 if vector else args.columns, kind=Kind.VECTOR if vector else Kind.MATRIX, layout=Layout.ARRAY, field=field)
    else:
        data = generate.uniform_matrix(spark, args.rows, args.columns or args.rows, args.nonzeros, field, symmetry, low, high, args.seed)
        m = Meta(args.rows, args.columns or args.rows, args.nonzeros, field=field, symmetry=symmetry)
    emit(args, m, data)


def index_map(spark, path: str) -> DataFrame:
    """A permutation file: line k holds where index k goes, all from 1."""
    _, x = mtx.read_vector(spark, path)
    return x.select((F.col("i") + 1).alias("src"), F.col("a").cast("long").alias("dst"))


def write_map(perm: DataFrame | None, n: int, path: str | None) -> None:
    if path and perm is not None:
        mtx.write(Meta(n, kind=Kind.VECTOR, layout=Layout.ARRAY, field=Field.INTEGER), perm.select((F.col("src") - 1).alias("k"), F.col("dst").alias("a")), path)


def run_reorder(spark, args):
    m, a = matrix(spark, args, args.A)
    given = args.ordering is Ordering.CUSTOM
    if args.ordering in (Ordering.METIS, Ordering.SCOTCH):
        own_method(args.ordering)
    rows = index_map(spark, args.rowperm_path) if given and args.rowperm_path else None
    columns = index_map(spark, args.colperm_path) if given and args.colperm_path else None
    out, rows, columns = graphs.reorder(a, m.nrows, m.ncols, args.ordering, rows, columns, args.rcm_starting_vertex or None, args.parts)
    if not given:
        write_map(rows, m.nrows, args.rowperm_path)
        write_map(columns, m.ncols, args.colperm_path)
    emit(args, replace(m, comments=(*m.comments, f"% reordered: {args.ordering}\n")), out)


def run_sort(spark, args):
    m, a = matrix(spark, args, args.A)
    perm = None
    if args.sorting is Sorting.PERMUTE:
        perm = index_map(spark, args.perm_path).select((F.col("src") - 1).alias("k"), (F.col("dst") - 1).alias("dst"))
    out = en.sort(a, args.sorting, perm)
    if args.perm_path and args.sorting is not Sorting.PERMUTE:
        write_map(out.select((F.col("src") + 1).alias("src"), (F.col("k") + 1).alias("dst")), m.data_lines, args.perm_path)
    emit(args, m, out)


def run_split(spark, args):
    m, a = matrix(spark, args, args.A)
    _, parts = mtx.read_vector(spark, args.parts)
    n = (parts.agg(F.max("a")).first()[0] or 0) + 1
    joined = a.join(parts.select(F.col("i").alias("k"), F.col("a").cast("int").alias("part")), "k").persist()
    for p, piece in enumerate(pt.split(joined, int(n))):
        mtx.write(replace(m, nnz=piece.count()), en.ranked(piece.withColumnRenamed("k", "_k"), [F.col("_k")]), args.output_path.replace("%p", str(p)), args.format)
    joined.unpersist()


def run_spy(spark, args):
    m, a = matrix(spark, args, args.A)
    texts = {k: v for k, v in (("Title", args.title), ("Author", args.author), ("Description", args.description), ("Copyright", args.copyright)) if v}
    spy.draw(a, m.nrows, m.ncols, args.output_path, args.max_width, args.max_height, m.symmetry, foreground=int(args.fgcolor.lstrip("#"), 16), background=int(args.bgcolor.lstrip("#"), 16), gamma=args.gamma, texts=texts)


def run_transpose(spark, args):
    m, data = mtx.read(spark, args.A, args.precision)
    if m.kind is Kind.MATRIX and m.symmetry == "general":
        data = en.transpose(data) if m.layout is Layout.COORDINATE else en.transpose_array(data, m.nrows, m.ncols)
    elif m.symmetry == "skew-symmetric":
        data = data.withColumn("a", -F.col("a"))
    emit(args, m.transposed(), data)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="coordtab", description=__doc__)
    programs = top.add_subparsers(dest="program", required=True)

    def program(name: str, run, *positional: str, alpha: bool = False):
        p = programs.add_parser(name)
        p.set_defaults(run=run, files=[x.rstrip("?") for x in positional], needed=[x for x in positional if not x.endswith("?")], takes_alpha=alpha, fail=p.error)
        if alpha:
            p.add_argument("--alpha", type=scalar, default=1.0)
            p.add_argument("first", nargs="?", metavar="alpha", help="a number; may be left out")
        for x in positional:
            p.add_argument(x.rstrip("?"), **({"nargs": "?"} if x.endswith("?") or alpha else {}))
        p.add_argument("-z", "--gzip", "--gunzip", "--ungzip", action="store_true", help="standard input is compressed; of files Spark tells by their names")
        p.add_argument("--partition", type=Partitioning, default=Partitioning.BLOCK, help="accepted; Spark deals rows out by hash, and results don't depend on it")
        p.add_argument("--blksize", type=int, default=1, help="as --partition")
        p.add_argument("--precision", type=Precision, default=Precision.DOUBLE)
        p.add_argument("--format")
        p.add_argument("--output")
        p.add_argument("--repeat", type=int, default=1)
        p.add_argument("--matrix-type", type=MatrixBackend, default=MatrixBackend.CSR)
        p.add_argument("--vector-type", type=VectorBackend, default=VectorBackend.BASE)
        p.add_argument("-q", "--quiet", action="store_true")
        p.add_argument("-v", "--verbose", action="store_true")
        return p

    program("axpy", run_axpy, "x", "y?", alpha=True)
    program("dot", run_dot, "x", "y?")
    program("nrm2", run_nrm2, "x")
    program("scal", run_scal, "x", alpha=True)
    p = program("gemv", run_gemv, "A", "x?", "y?", alpha=True)
    p.add_argument("--trans", type=Transposition, default=Transposition.NONE)
    p.add_argument("--overlap", type=Overlap, default=Overlap.NONE)
    p = program("gemm", run_gemm, "A", "B", "C?", alpha=True)
    p.add_argument("--A-trans", type=Transposition, default=Transposition.NONE)
    p.add_argument("--B-trans", type=Transposition, default=Transposition.NONE)
    p = program("cg", run_cg, "A", "b?", "x0?")
    p.add_argument("--atol", type=float, default=0.0)
    p.add_argument("--rtol", type=float, default=1e-6)
    p.add_argument("--max-iterations", type=int, default=100)
    p.add_argument("--restart", type=int, default=0)
    p.add_argument("--progress", type=int, default=0)
    program("info", run_info, "A")
    p = program("partition", run_partition, "A")
    p.add_argument("--part-type", type=PartKind, default=PartKind.ROWS)
    for of in ("nz", "row", "column"):
        p.add_argument(f"--{of}-parts", type=int, default=1)
        p.add_argument(f"--{of}-part-type", type=Partitioning, default=Partitioning.BLOCK)
        p.add_argument(f"--{of}-blksize", type=int, default=1)
    p.add_argument("--row-part-path")
    p.add_argument("--column-part-path")
    p = program("rand", run_rand)
    p.add_argument("--generator", choices=("uniform", "blkdiag"), default="uniform")
    p.add_argument("--layout", default="coordinate")
    p.add_argument("--field", default="real")
    p.add_argument("--symmetry", default="general")
    for name, default in (("rows", 1), ("columns", None), ("nonzeros", None), ("blocks", 1), ("row-offset", 0), ("column-offset", 0), ("min", 0), ("max", 1), ("seed", 0)):
        p.add_argument(f"--{name}", type=int, default=default)
    p = program("reorder", run_reorder, "A")
    p.add_argument("--ordering", type=Ordering, default=Ordering.RCM)
    p.add_argument("--rowperm-path")
    p.add_argument("--colperm-path")
    p.add_argument("--rcm-starting-vertex", type=int, default=0)
    p.add_argument("--parts", type=int, default=1)
    p = program("sort", run_sort, "A")
    p.add_argument("--sorting", type=Sorting, default=Sorting.ROW)
    p.add_argument("--perm-path")
    program("split", run_split, "A", "parts").add_argument("--output-path", default="out%p.mtx")
    p = program("spy", run_spy, "A")
    p.add_argument("--output-path", default="out.png")
    p.add_argument("--max-width", type=int, default=1000)
    p.add_argument("--max-height", type=int, default=1000)
    p.add_argument("--fgcolor", default="#000000")
    p.add_argument("--bgcolor", default="#FFFFFF")
    p.add_argument("--gamma", type=float)
    for name in ("title", "author", "description", "copyright"):
        p.add_argument(f"--{name}")
    program("transpose", run_transpose, "A")
    return top


def factor_first(args) -> None:
    """Takes the first argument for alpha if it is a number, and for a file otherwise."""
    given = [args.first, *(getattr(args, x) for x in args.files)]
    try:
        args.alpha = scalar(given[0] or "")
        given = given[1:]
    except ValueError:
        if given.pop() is not None:
            args.fail("too many files")
    for name, value in zip(args.files, given):
        setattr(args, name, value)
    for name in args.needed:
        if getattr(args, name) is None:
            args.fail(f"{name} is needed")


def spooled(spark: SparkSession, source, gzip: bool) -> str:
    """A file of the shared folder with what the stream holds."""
    path = storage.new_path(spark, "input") + (".mtx.gz" if gzip else ".mtx")
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    try:
        while part := source.read(1 << 20):
            out.write(bytearray(part))
    finally:
        out.close()
    return path


def main(argv: list[str] | None = None, spark: SparkSession | None = None, stdin=None) -> int:
    args = parser().parse_args(argv)
    if args.takes_alpha:
        factor_first(args)
    spark = spark or SparkSession.builder.appName(f"coordtab {args.program}").getOrCreate()
    read = None
    for name in args.files:
        if getattr(args, name) == "-":
            read = read or spooled(spark, stdin or sys.stdin.buffer, args.gzip)
            setattr(args, name, read)
    try:
        return args.run(spark, args) or 0
    except MatrixError as e:
        print(f"{args.program}: {e.code}: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
