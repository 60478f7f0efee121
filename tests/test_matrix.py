"""Small inputs with known results."""

import gzip
import io
import math
import random

import pytest
from pyspark.sql import functions as F

from coordtab import cli
from coordtab.errors import FormatError, HeaderError, IncompatibleError, PartitionError, PermutationError, SizeError
from coordtab.functions import cplx, morton, numfmt
from coordtab.meta import Field, Kind, Layout, Meta, Sorting, Symmetry, header_of, parse_enum, size_of, valid_comment
from coordtab.operators import entries as en
from coordtab.operators import generate, graphs, integers, products, solver, spy
from coordtab.operators import partitioning as pt
from coordtab.operators import permutations as pe
from coordtab.operators import vectors as ve
from coordtab.sources import mtx
from coordtab.streaming import assemble as streaming


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()] if order else [tuple(r) for r in df.collect()]


def mat(spark, values, positions=False):
    kind = "k long, i long, j long, a double" if positions else "i long, j long, a double"
    data = [(k, i, j, float(a)) if positions else (i, j, float(a)) for k, (i, j, a) in enumerate(values)]
    return spark.createDataFrame(data, kind)


def dense(spark, table):
    return mat(spark, [(i + 1, j + 1, v) for i, r in enumerate(table) for j, v in enumerate(r)])


def vec(spark, values, base=0, at=None):
    return spark.createDataFrame([(at[k] if at else k + base, float(v)) for k, v in enumerate(values)], "i long, a double")


def cvec(spark, values, base=0):
    return spark.createDataFrame([(k + base, (complex(v).real, complex(v).imag)) for k, v in enumerate(values)], "i long, a struct<re:double,im:double>")


def values(df):
    return [r["a"] for r in df.orderBy("i").collect()]


def cvalues(df):
    return [complex(r["a"]["re"], r["a"]["im"]) for r in df.orderBy("i").collect()]


def test_headers_and_sizes():
    assert header_of("%%MatrixMarket matrix coordinate real general\n")["symmetry"] is Symmetry.GENERAL
    for bad in ("%%MatrixMarket Matrix coordinate real general", "%%MatrixMarket matrix  coordinate real general", "%%MatrixMarket matrix array pattern general", "% no"):
        with pytest.raises(HeaderError):
            header_of(bad)
    assert size_of("3 4 5\n", Kind.MATRIX, Layout.COORDINATE) == {"nrows": 3, "ncols": 4, "nnz": 5}
    with pytest.raises(SizeError):
        size_of("3  4", Kind.MATRIX, Layout.ARRAY)
    m = Meta(3, 3, layout=Layout.ARRAY, symmetry=Symmetry.SYMMETRIC)
    assert (m.data_lines, Meta(3, 3, layout=Layout.ARRAY, symmetry=Symmetry.SKEW).data_lines, Meta(2, 3, layout=Layout.ARRAY).data_lines) == (6, 3, 6)
    with pytest.raises(SizeError):
        Meta(2, 3, layout=Layout.ARRAY, symmetry=Symmetry.SYMMETRIC).data_lines  # noqa: B018
    assert Meta(2, 3, 4).concatenated(Meta(2, 3, 5)).nnz == 9 and Meta(2, 3, 4).transposed().nrows == 3
    with pytest.raises(IncompatibleError):
        Meta(2, 3, 4).concatenated(Meta(3, 3, 5))
    assert parse_enum(Sorting, "row-major,rest", ",") == (Sorting.ROW, "rest")
    with pytest.raises(HeaderError):
        valid_comment("no percent\n")


def test_number_formats(spark):
    assert str(numfmt.parse("%+8.3e")) == "%+8.3e"
    for bad in ("%*d", "%ld", "%g %g", "x", "%d"):
        with pytest.raises(FormatError):
            numfmt.parse(bad)
    df = spark.createDataFrame([(1.5,), (1e-7,), (100000000.0,)], "a double")
    assert [r[0] for r in df.select(numfmt.formatted(F.col("a"), numfmt.parse("%g"))).collect()] == ["1.5", "1e-07", "1e+08"]


MATRIX = "%%MatrixMarket matrix coordinate real general\n% comment\n3 3 2\n3 2 1.5\n2 3 1.5"


def write(path, text):
    path.write_text(text)
    return str(path)


def test_read_texts(spark, tmp_path):
    m, data = mtx.read(spark, write(tmp_path / "a.mtx", MATRIX))
    assert (m.nrows, m.ncols, m.nnz, m.comments) == (3, 3, 2, ("% comment\n",))
    assert rows(data, "k") == [(0, 3, 2, 1.5), (1, 2, 3, 1.5)]
    m, data = mtx.read(spark, write(tmp_path / "v.mtx", "%%MatrixMarket vector coordinate real general\n% comment\n3 2\n3 1.5\n2 1.5"))
    assert m.ncols == -1 and rows(data, "k") == [(0, 3, 1.5), (1, 2, 1.5)]
    _, data = mtx.read(spark, write(tmp_path / "c.mtx", "%%MatrixMarket matrix array complex general\n1 2\n1 -2\n3.5 4e1\n"))
    assert [(r.k, r.a.re, r.a.im) for r in data.orderBy("k").collect()] == [(0, 1.0, -2.0), (1, 3.5, 40.0)]
    m, data = mtx.read(spark, write(tmp_path / "p.mtx", "%%MatrixMarket matrix coordinate pattern symmetric\n2 2 1\n2 1\n"), "single")
    assert data.columns == ["k", "i", "j"] and rows(data) == [(0, 2, 1)]
    for bad in ("3 4 1.5", "0 1 1.5", "1 1", "1 1 x", "1  1 1"):
        with pytest.raises(Exception, match="bounds|data line"):
            mtx.read(spark, write(tmp_path / "bad.mtx", f"%%MatrixMarket matrix coordinate real general\n3 3 1\n{bad}\n"))[1].collect()
    with pytest.raises(HeaderError):
        mtx.counted(*mtx.read(spark, write(tmp_path / "few.mtx", MATRIX.replace("3 3 2", "3 3 4"))))


def test_round_trips(spark, tmp_path):
    data = mat(spark, [(1, 2, 0.1), (3, 1, -2.5), (2, 2, 1e300)], positions=True)
    for k, options in enumerate(({}, {"compression": "gzip"}, {"single": False})):
        path = str(tmp_path / f"o{k}")
        mtx.write(Meta(3, 2, 3, comments=("% c\n",)), data, path, fmt="%.17g", **options)
        m, back = mtx.read(spark, path)
        assert m.comments == ("% c\n",) and rows(back, "k") == rows(data, "k")
    assert mtx.info(spark, path).first()["rows"] == 3
    many = generate.uniform_array(spark, 200_000, low=0, high=10**6, seed=2).where("k < 150000 or a > 0").repartition(3)
    m = Meta(many.count(), kind=Kind.VECTOR, layout=Layout.ARRAY)
    mtx.write(m, en.ranked(many.withColumnRenamed("k", "_k"), [F.col("_k")]), str(tmp_path / "parts"), single=False)
    assert len(list((tmp_path / "parts").glob("part-*"))) > 1 and mtx.counted(*mtx.read(spark, str(tmp_path / "parts"))).agg(F.max("k")).first()[0] == m.nrows - 1
    tri = mat(spark, [], positions=True).select("k", "a").unionByName(spark.range(6).select(F.col("id").alias("k"), F.col("id").cast("double").alias("a")))
    assert rows(en.triangular_places(tri), "a") == [(1, 1, 0.0), (2, 1, 1.0), (2, 2, 2.0), (3, 1, 3.0), (3, 2, 4.0), (3, 3, 5.0)]
    assert rows(en.triangular_places(tri, strict=True), "a")[:3] == [(2, 1, 0.0), (3, 1, 1.0), (3, 2, 2.0)]


def test_sort_transpose_assemble(spark):
    nine = mat(spark, [(k // 3 + 1, k % 3 + 1, k + 1) for k in range(9)], positions=True)
    assert [r["a"] for r in en.sort(nine, "column-major").orderBy("k").collect()] == [1, 4, 7, 2, 5, 8, 3, 6, 9]
    assert [r["a"] for r in en.transpose_array(nine.where("k < 6").select("k", "a"), 2, 3).orderBy("k").collect()] == [1, 4, 2, 5, 3, 6]
    given = mat(spark, [(2, 2, 2), (2, 1, -2), (1, 2, -2), (1, 1, 2), (2, 2, 2), (2, 3, -2), (3, 2, -2), (3, 3, 2)], positions=True)
    expected = [(1, 1, 2), (1, 2, -2), (2, 1, -2), (2, 2, 4), (2, 3, -2), (3, 2, -2), (3, 3, 2)]
    assert rows(en.assemble(given.drop("k"), "row-major").drop("k"), "i", "j") == expected
    assert rows(en.compact(en.sort(given, "row-major").drop("src")).drop("k", "lines"), "i", "j") == expected
    assert [r.dst for r in en.compact_map(en.sort(given, "row-major").drop("src")).orderBy("k").collect()] == [1, 2, 3, 4, 4, 5, 6, 7]
    twice = mat(spark, [(2, 2, 1), (1, 1, 1), (1, 1, 1), (2, 2, 1), (2, 2, 1), (2, 2, 1), (2, 2, 1), (1, 1, 1)])
    assert rows(en.assemble(twice), "i") == [(1, 1, 3), (2, 2, 5)]
    assert rows(en.assemble(en.assemble(twice)), "i") == rows(en.assemble(twice), "i")
    assert rows(en.transpose(en.transpose(given)), "k") == rows(given, "k")
    with pytest.raises(IncompatibleError):
        en.assemble(twice, "unsorted")
    perm = spark.createDataFrame([(k, 8 - k) for k in range(9)], "k long, dst long")
    assert [r["a"] for r in en.sort(nine, "permute", perm).orderBy("k").collect()] == list(range(9, 0, -1))
    assert rows(en.pointers(given, 4), "i") == [(1, 0, 2), (2, 2, 6), (3, 6, 8), (4, 8, 8)]
    back = en.from_compressed(en.pointers(given, 3), en.compressed(given).select("k", "j", "a"))
    assert rows(back.select("i", "j", "a"), "i", "j", "a") == rows(given.select("i", "j", "a"), "i", "j", "a")


def test_prefix_sum_over_blocks(spark):
    df = spark.range(200_000).select(F.col("id").alias("k"))
    out = en.prefix_sum(df, "k", F.lit(2), "before")
    assert out.where(F.col("before") != 2 * F.col("k")).count() == 0 and out.count() == 200_000


def test_morton(spark):
    grid = spark.range(16).select(F.expr("id div 4").alias("x"), (F.col("id") % 4).alias("y"))
    codes = grid.withColumn("m", morton.encode32(F.col("x"), F.col("y")))
    assert [r.m for r in codes.orderBy("x", "y").collect()] == [0, 1, 4, 5, 2, 3, 6, 7, 8, 9, 12, 13, 10, 11, 14, 15]
    back = codes.select("x", "y", *(c.alias(n) for c, n in zip(morton.decode32(F.col("m")), "rc")))
    assert all(r.x == r.r and r.y == r.c for r in back.collect())


def test_partitions(spark):
    nine = mat(spark, [(k // 3 + 1, k % 3 + 1, k + 1) for k in range(9)], positions=True)
    out = pt.partition(nine, "nonzeros", 3, 3, 9, nonzeros={"how": "block", "parts": 2, "sizes": [3, 6]})
    assert [r.part for r in out.orderBy("k").collect()] == [0, 0, 0, 1, 1, 1, 1, 1, 1] and rows(pt.sizes(out, 2), "part") == [(0, 3), (1, 6)]
    two = {"how": "block", "parts": 2, "sizes": [2, 1]}
    out = pt.partition(nine, "2d", 3, 3, 9, rows=two, columns=two)
    assert [r.part for r in out.orderBy("k").collect()] == [0, 0, 1, 0, 0, 1, 2, 2, 3] and [r.size for r in pt.sizes(out, 4).orderBy("part").collect()] == [4, 2, 2, 1]
    assert sum(p.count() for p in pt.split(out, 4)) == 9
    one = spark.createDataFrame([(x,) for x in (0, 2, 1, 4, 3)], "x long").select(pt.part_of(F.col("x"), "block", 5, 1).alias("part"))
    assert rows(pt.sizes(one, 1)) == [(0, 5)]
    ids = spark.range(8)
    assert [r[0] for r in ids.select(pt.part_of(F.col("id"), "block-cyclic", 8, 2, block=2)).collect()] == [0, 0, 1, 1, 0, 0, 1, 1]
    assert [r[0] for r in ids.select(pt.part_of(F.col("id"), "cyclic", 8, 3)).collect()] == [0, 1, 2, 0, 1, 2, 0, 1]
    with pytest.raises(PartitionError):
        pt.part_of(F.col("id"), "block", 8, 0)
    with pytest.raises(Exception, match="outside"):
        ids.select(pt.part_of(F.col("id"), "cyclic", 5, 3)).collect()


def test_vectors(spark):
    x, y = vec(spark, [1, 1, 1, 2, 3]), vec(spark, [2, 1, 0, 2, 1])
    assert values(ve.axpy(x, y, 2.0)) == [4, 3, 2, 6, 7] and values(ve.aypx(x, y, 2.0)) == [5, 3, 1, 6, 5]
    assert ve.nrm2(x).first()[0] == 4 and ve.asum(vec(spark, [-1, 1, 1, 2, 3])).first()[0] == 8
    assert ve.iamax(vec(spark, [-1, 1, 3, 2, 3])).first()[0] == 2 and ve.iamax(x.limit(0)).first()[0] == 0
    at = [0, 3, 5, 6, 9]
    px, full = vec(spark, [1, 1, 1, 2, 3], at=at), vec(spark, [2, 0, 0, 1, 0, 0, 2, 0, 0, 1, 0, 0])
    assert ve.usdot(px, full).first()[0] == 10
    assert values(ve.usaxpy(px, full, 2.0)) == [4, 0, 0, 3, 0, 2, 6, 0, 0, 7, 0, 0]
    assert values(ve.usga(px, full)) == [2, 1, 0, 2, 1]
    gathered, zeroed = ve.usgz(px, full)
    assert values(gathered) == [2, 1, 0, 2, 1] and values(zeroed) == [0] * 12
    assert values(ve.ussc(px, full)) == [1, 0, 0, 1, 0, 1, 2, 0, 0, 3, 0, 0]
    z = vec(spark, [0] * 5, at=[0, 1, 5, 6, 9])
    assert values(ve.usscga(vec(spark, [1, 4, 6, 7, 10], at=at), z)) == [1, 0, 6, 7, 10]
    assert values(ve.scal(x, 1)) == [1, 1, 1, 2, 3] and values(ve.copy(y, x)) == [2, 1, 0, 2, 1]
    assert ve.swap(x, y) == (y, x)
    whole = spark.createDataFrame([(0, 3), (1, -3)], "i long, a long")
    assert values(ve.scal(whole, 0.5)) == [1, -1]
    c, d = cvec(spark, [1 + 2j, 3 - 1j]), cvec(spark, [2 - 1j, 1j])
    assert cvalues(ve.scal(c, 2j)) == [-4 + 2j, 2 + 6j] and cvalues(ve.axpy(c, d, 1j)) == [0 + 0j, 1 + 4j]
    assert tuple(ve.dotu(c, d).first()) == (5.0, 6.0) and tuple(ve.dotc(c, d).first()) == (-1.0, -2.0)
    assert ve.asum(c).first()[0] == 7 and ve.nrm2(c).first()[0] == pytest.approx(math.sqrt(15)) and ve.iamax(c).first()[0] == 1
    with pytest.raises(IncompatibleError):
        ve.dot(c, d)
    with pytest.raises(IncompatibleError):
        ve.axpy(x, c)
    assert ve.get_values(y).first()[0] == [2, 1, 0, 2, 1]
    assert values(ve.set_values(x, y)) == [2, 1, 0, 2, 1] and values(ve.added(px, vec(spark, [5], at=[3]))) == [1, 6, 1, 2, 3]


A3, B3, C3 = [[1, 2, 0], [4, 5, 6], [7, 8, 9]], [[3, 2, 2], [2, 1, 0], [1, 0, 0]], [[1, 2, 0], [0, 1, 2], [2, 0, 1]]


def table(df):
    out = [[0] * 3 for _ in range(3)]
    for r in df.collect():
        out[r["i"] - 1][r["j"] - 1] = r["a"]
    return out


def test_gemv(spark):
    a, x, y = dense(spark, A3), vec(spark, [3, 2, 1], 1), vec(spark, [1, 0, 2], 1)
    assert values(products.gemv(a, x, y, 2.0, 3.0)) == [17, 56, 98]
    assert values(products.gemv(a, x, y, 2.0, 3.0, "trans")) == [39, 48, 48]
    upper = mat(spark, [(1, 1, 1), (1, 2, 2), (2, 2, 5), (2, 3, 6), (3, 3, 9)])
    assert values(products.gemv(upper, x, y, 2.0, 3.0, symmetry="symmetric")) == [17, 44, 48]
    prepared = products.Prepared(a, 2)
    assert values(prepared.gemv(x, y, 2.0, 3.0)) == [17, 56, 98]
    prepared.close()
    c = [(1, 1, 1 + 2j), (1, 2, 3 + 4j), (2, 1, 5 + 6j), (2, 2, 7 + 8j)]
    ca = spark.createDataFrame([(i, j, (z.real, z.imag)) for i, j, z in c], "i long, j long, a struct<re:double,im:double>")
    cx, cy = cvec(spark, [3 + 1j, 1 + 2j], 1), cvec(spark, [1, 2 + 2j], 1)
    assert cvalues(products.gemv(ca, cx, cy, 2.0, 3.0)) == [-5 + 34j, 6 + 96j]
    assert cvalues(products.gemv(ca, cx, cy, 2.0, 3.0, "trans")) == [-9 + 46j, -2 + 80j]
    assert cvalues(products.gemv(ca, cx, cy, 2.0, 3.0, "conjtrans")) == [47 - 2j, 78]
    assert cvalues(products.gemv(ca, cx, cy, 2j, 3 + 1j)) == [-31 - 7j, -86 + 8j]
    assert cvalues(products.gemv(ca, cx, cy, 2j, 3 + 1j, "trans")) == [-43 - 11j, -70]


@pytest.mark.parametrize("multiply", [products.gemm, lambda *a, **k: products.gemm_dense(*a, **k, tile=2)])
def test_gemm(spark, multiply):
    a, b, c = dense(spark, A3), dense(spark, B3), dense(spark, C3)
    assert table(multiply(a, b, c, 2.0, 3.0)) == [[17, 14, 4], [56, 29, 22], [98, 44, 31]]
    assert table(multiply(a, b, c, 2.0, 3.0, "trans")) == [[39, 18, 4], [48, 21, 14], [48, 12, 3]]
    by_hand = [[2 * sum(A3[i][k] * B3[j][k] for k in range(3)) + 3 * C3[i][j] for j in range(3)] for i in range(3)]
    assert table(multiply(a, b, c, 2.0, 3.0, trans_b="trans")) == by_hand


def test_symmetric_expansion_equals_general(spark):
    low = generate.uniform_matrix(spark, 20, 20, 60, symmetry="symmetric", low=1, high=9)
    x = generate.uniform_array(spark, 20, low=1, high=5).select((F.col("k") + 1).alias("i"), "a")
    assert values(products.gemv(low, x, symmetry="symmetric")) == values(products.gemv(en.expand_symmetry(low, "symmetric"), x))
    h = spark.createDataFrame([(2, 1, (1.0, 2.0))], "i long, j long, a struct<re:double,im:double>")
    assert [(r.i, r.j, r.a.re, r.a.im) for r in en.expand_symmetry(h, "hermitian").collect()] == [(2, 1, 1.0, 2.0), (1, 2, 1.0, -2.0)]
    assert en.nonzeros(mat(spark, [(1, 1, 1), (2, 1, 1)]), "symmetric").first()["nonzeros"] == 3


def test_permutations(spark):
    perm = pe.from_list(spark, [1, 0, 2, 3, 4])
    assert values(pe.apply(perm, vec(spark, [0, 255, 30, 1, 2]))) == [255, 0, 30, 1, 2]
    perm = pe.from_list(spark, [1, 0, 3, 4, 2])
    assert values(pe.apply(perm, vec(spark, [0, 255, 30, 1, 2]))) == [255, 0, 2, 30, 1]
    assert rows(pe.compose(perm, pe.invert(perm)), "src") == rows(pe.identity(spark, 5), "src")
    assert pe.is_valid(perm, 5) and not pe.is_valid(perm, 4)
    with pytest.raises(PermutationError):
        pe.from_list(spark, [0, 0, 1])
    nine = mat(spark, [(k // 3 + 1, k % 3 + 1, k + 1) for k in range(9)])
    assert [r["a"] for r in pe.gather(nine, pe.from_list(spark, [2, 1, 3], 1)).orderBy("i", "j").collect()] == [4, 5, 6, 1, 2, 3, 7, 8, 9]


GRAPH = [(1, 2, 1), (1, 3, 2), (2, 1, 3), (2, 4, 4), (3, 1, 5), (3, 4, 6), (3, 5, 7), (4, 2, 8), (4, 3, 9), (5, 3, 10)]


@pytest.mark.parametrize("local", [10**6, 0])
def test_rcm(spark, local):
    a = mat(spark, GRAPH, positions=True)
    perm, same = graphs.rcm(a, 5, 5, 1, local)
    assert [r.dst for r in perm.orderBy("src").collect()] == [5, 3, 4, 2, 1] and same is perm
    out = pe.scatter(a, perm, perm)
    assert rows(out, "k")[0] == (0, 5, 3, 1.0) and rows(out, "k")[9] == (9, 1, 4, 10.0)
    rows_, columns = graphs.rcm(a.where("i < 4"), 3, 5, None, local)
    assert pe.is_valid(rows_, 3, 1) and pe.is_valid(columns, 5, 1)


def test_components_are_ordered_at_once(spark):
    """Three paths, a cycle and vertices without neighbours, ordered on the driver and by levels in Spark."""
    edges = [(k, k + 4) for k in range(1, 33)] + [(50, 51), (51, 52), (52, 50), (60, 41)]
    a = spark.createDataFrame([(k, i, j, 1.0) for k, (i, j) in enumerate(edges)], "k long, i long, j long, a double")
    for start in (None, 51):
        assert rows(graphs.rcm(a, 64, 64, start)[0], "src") == rows(graphs.rcm(a, 64, 64, start, 0)[0], "src")
    path = spark.createDataFrame([(k, k + 1, k + 2, 1.0) for k in range(34)], "k long, i long, j long, a double")
    assert [r.level for r in graphs.levels(graphs.adjacency(path, 35, 35), 1).orderBy("v").collect()] == list(range(35))


def test_exchanges_lower_the_cut_and_keep_sizes(spark):
    """Four clusters whose vertices are dealt out in turn."""
    rng = random.Random(4)
    edges = {(min(i, j), max(i, j)) for _ in range(900) for c in [rng.randrange(4)] for i, j in [(1 + c + 4 * rng.randrange(20), 1 + c + 4 * rng.randrange(20))] if i != j}
    edges |= {(1 + rng.randrange(40), 41 + rng.randrange(40)) for _ in range(30)}
    a = spark.createDataFrame([(k, i, j, 1.0) for k, (i, j) in enumerate(sorted(edges))], "k long, i long, j long, a double")
    near = graphs.adjacency(a, 80, 80)
    before = spark.createDataFrame([(v, (v - 1) // 20) for v in range(1, 81)], "v long, part int")
    after = graphs.refined(near, before)
    assert [r["count"] for r in after.groupBy("part").count().orderBy("part").collect()] == [20] * 4
    assert graphs.cut_of(near, after) < 0.8 * graphs.cut_of(near, before)
    order = graphs.order_of(near, 80, None).select("v", (F.col("pos") * 4 / 80).cast("int").alias("part"))
    assert graphs.cut_of(near, graphs.partition(a, 80, 80, 4)) <= graphs.cut_of(near, order)


def test_frontier_order_agrees_with_local(spark):
    a = generate.uniform_matrix(spark, 30, 30, 40, "pattern", seed=3)
    assert rows(graphs.rcm(a, 30, 30)[0], "src") == rows(graphs.rcm(a, 30, 30, None, 0)[0], "src")


@pytest.mark.parametrize("smallest, local", [(3, 12), (8, 0)])
def test_dissection_in_spark_agrees_with_local(spark, smallest, local):
    a = generate.uniform_matrix(spark, 40, 40, 36, "pattern", seed=11).unionByName(mat(spark, [(i, i + 1, 0) for i in range(1, 12)], positions=True).select("k", "i", "j"))
    expected = rows(graphs.dissection(a, 40, 40, smallest)[0], "src")
    got = graphs.dissection(a, 40, 40, smallest, local)[0]
    assert pe.is_valid(got, 40, 1) and rows(got, "src") == expected


def test_orders_and_parts_of_graphs(spark):
    a = generate.uniform_matrix(spark, 60, 60, 150, "pattern", seed=5)
    for ordering in ("nd", "metis", "scotch", "rcm"):
        _, perm, _ = graphs.reorder(a, 60, 60, ordering, parts=3)
        assert pe.is_valid(perm, 60, 1)
    assert graphs.reorder(a, 60, 60, "default")[1] is None
    parted = graphs.partition(a, 60, 60, 3)
    assert rows(pt.sizes(parted, 3), "part") == [(0, 20), (1, 20), (2, 20)]
    assert graphs.edge_cut(a, 60, 60, parted).first()[0] < 150
    assert graphs.edge_cut(a, 60, 60, graphs.partition(a, 60, 60, 1)).first()[0] == 0
    assert graphs.partition_entries(a, 60, 60, 3).count() == 150


def test_cg(spark):
    a = mat(spark, [(1, 1, 2), (1, 2, -1), (2, 1, -1), (2, 2, 2)])
    s = solver.cg(a, vec(spark, [1, 0], 1), atol=1e-15, rtol=1e-15, max_iterations=10)
    assert s.converged and values(s.x) == pytest.approx([2 / 3, 1 / 3], abs=1e-12) and s.b_norm == 1
    n = 10
    poisson = mat(spark, [(i, i, 2) for i in range(1, n)] + [(i + 1, i, -1) for i in range(1, n - 1)])
    b = vec(spark, [math.sin(2 * math.pi * i / n) / n**2 for i in range(1, n)], 1)
    s = solver.cg(poisson, b, rtol=1e-10, symmetry="symmetric", restart=3)
    assert s.converged
    assert values(products.gemv(poisson, s.x, symmetry="symmetric")) == pytest.approx(values(b), abs=1e-9)


def test_integer_sets(spark):
    s = lambda *v: spark.createDataFrame([(x,) for x in v], "value long")
    got = lambda df: [r.value for r in df.orderBy("k").collect()]
    assert got(integers.compact(s(0, 2, 2, 2, 4, 6, 6, 8, 10, 12, 14))) == [0, 2, 4, 6, 8, 10, 12, 14]
    a, b = s(0, 2, 4, 6, 8, 10, 12, 14), s(0, 1, 2, 4, 5, 6, 8, 9, 12)
    assert got(integers.union(a, b)) == [0, 1, 2, 4, 5, 6, 8, 9, 10, 12, 14]
    assert got(integers.intersection(a, b)) == [0, 2, 4, 6, 8, 12] and got(integers.difference(a, b)) == [10, 14]
    assert len(got(integers.merge(a, b))) == 17
    assert {(r.value, r.dst) for r in integers.destinations(a, integers.intersection(a, b)).collect()} >= {(10, -1), (12, 5)}
    longs = spark.createDataFrame([(0, -1), (1, 5), (2, 0), (3, 5)], "k long, a long")
    assert [r.dst for r in integers.sort_unsigned(longs, ["a"]).orderBy("k").collect()] == [3, 1, 0, 2]


def test_generators(spark):
    skew = generate.uniform_matrix(spark, 5, 5, 200, symmetry="skew-symmetric", low=1, high=3)
    assert skew.where("i < j").count() == 0 and skew.where("i = j and a <> 0").count() == 0 and skew.where("i <> j and not a between 1 and 3").count() == 0
    herm = generate.uniform_matrix(spark, 5, 5, 200, "complex", "hermitian", 1, 3)
    assert herm.where("i = j and a.im <> 0").count() == 0
    block = generate.block_diagonal(spark, 4, 3, 2, nonzeros=5)
    assert block.count() == 20 and block.where("(i - 1) div 3 <> (j - 1) div 2").count() == 0
    assert rows(generate.uniform_matrix(spark, 9, 9, 50, seed=1), "k") == rows(generate.uniform_matrix(spark, 9, 9, 50, seed=1).repartition(3), "k")
    with pytest.raises(IncompatibleError):
        generate.uniform_matrix(spark, 5, 5, 2, "real", "hermitian")


def test_pictures(spark, tmp_path):
    assert spy.picture_size(100, 7, 40, 40) == (7, 40) and spy.picture_size(200, 100, 50, 50) == (25, 50) and spy.picture_size(100, 100, 50, 40) == (50, 40)
    a = mat(spark, [(1, 1, 1), (4, 2, 1)])
    assert set(rows(spy.pixels(a, 4, 4, 8, 8, "symmetric"))) == {(0, 0), (1, 3), (3, 1)}
    spy.draw(a, 4, 4, str(tmp_path / "x.png"), gamma=0.5, texts={"Title": "t"})
    data = (tmp_path / "x.png").read_bytes()
    assert data.startswith(b"\x89PNG") and b"gAMA" in data and b"tEXtTitle" in data


def test_stream(spark, tmp_path):
    mat(spark, [(1, 1, 1), (1, 1, 2), (2, 1, 5)]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("i long, j long, a double").parquet(str(tmp_path / "in"))
    q = streaming.assembled(stream).writeStream.outputMode("complete").format("memory").queryName("assembled_test").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("assembled_test"), "i") == [(1, 1, 3.0), (2, 1, 5.0)]


def test_blocked_vectors(spark):
    x = spark.range(10).select(F.col("id").alias("i"), F.col("id").cast("double").alias("a"))
    b = ve.blocked(x, 4)
    assert {r.b: r["values"] for r in b.collect()} == {0: [0, 1, 2, 3], 1: [4, 5, 6, 7], 2: [8, 9]}
    assert rows(ve.unblocked(ve.axpy_blocks(b, ve.blocked(ve.scal(x, 2.0), 4), 3.0), 4), "i") == [(k, 5.0 * k) for k in range(10)]
    z = x.withColumn("a", cplx.cx(F.col("a"), F.lit(1.0)))
    assert ve.unblocked(ve.axpy_blocks(ve.blocked(z, 4), ve.blocked(z, 4), 1j), 4).where("i = 2").first().a == (1.0, 3.0)
    with pytest.raises(IncompatibleError):
        ve.axpy_blocks(b, ve.blocked(z, 4))


def test_programs(spark, tmp_path, capsys):
    a = write(tmp_path / "a.mtx", "%%MatrixMarket matrix coordinate real general\n3 3 5\n1 1 1\n1 2 2\n2 2 5\n3 3 9\n3 1 7\n")
    x = write(tmp_path / "x.mtx", "%%MatrixMarket vector array real general\n3\n3\n2\n1\n")

    def run(*args):
        code = cli.main(list(args), spark)
        return code, capsys.readouterr().out.split("\n")[:-1]

    assert run("gemv", a, x, "--alpha", "2")[1][2:] == ["14", "20", "60"]
    assert run("dot", x)[1] == ["6.0"] and run("nrm2", x)[1][0].startswith("3.74")
    assert run("axpy", x, x, "--alpha", "2")[1][2:] == ["9", "6", "3"] and run("scal", x, "--alpha", "3")[1][2:] == ["9", "6", "3"]
    assert run("transpose", a)[1][2:4] == ["1 1 1", "2 1 2"] and run("sort", a, "--sorting", "column-major")[1][2:4] == ["1 1 1", "3 1 7"]
    assert run("info", a)[1][4] == "rows: 3" and run("partition", a, "--row-parts", "3", "--row-part-type", "cyclic")[1][2:] == ["0", "0", "1", "2", "2"]
    assert run("reorder", a)[0] == 0 and run("gemm", a, a)[1][2:5] == ["1", "12", "0"]
    s = write(tmp_path / "s.mtx", "%%MatrixMarket matrix coordinate real symmetric\n2 2 3\n1 1 2\n2 1 -1\n2 2 2\n")
    assert run("cg", s, "--format", "%.3f")[1][2:] == ["1.000", "1.000"]
    assert len(run("rand", "--rows", "4", "--nonzeros", "6")[1]) == 8 and len(run("rand", "--generator", "blkdiag", "--rows", "2", "--columns", "2", "--blocks", "3")[1]) == 14
    p = write(tmp_path / "p.mtx", "%%MatrixMarket vector array integer general\n5\n0\n1\n1\n0\n1\n")
    assert run("split", a, p, "--output-path", str(tmp_path / "out%p"))[0] == 0 and mtx.read(spark, str(tmp_path / "out1"))[0].nnz == 3
    assert run("spy", a, "--output-path", str(tmp_path / "s.png"))[0] == 0
    assert run("gemv", x)[0] == 2
    assert run("gemv", "2", a, x)[1][2:] == ["14", "20", "60"] and run("scal", "-3", x)[1][2:] == ["-9", "-6", "-3"]
    assert run("axpy", "2", x, x)[1][2:] == ["9", "6", "3"] and run("gemm", "2", a, a)[1][2:5] == ["2", "24", "0"]
    with pytest.raises(SystemExit):
        run("gemv", "2")


def test_programs_read_standard_input(spark, capsys):
    data = b"%%MatrixMarket vector array real general\n3\n3\n2\n1\n"
    assert cli.main(["dot", "-", "-"], spark, io.BytesIO(data)) == 0 and capsys.readouterr().out == "14.0\n"
    assert cli.main(["nrm2", "-z", "-"], spark, io.BytesIO(gzip.compress(data))) == 0 and capsys.readouterr().out.startswith("3.74")


def test_any_number_of_comments(spark, tmp_path):
    path = write(tmp_path / "c.mtx", "%%MatrixMarket vector array real general\n" + "% c\n" * 300_000 + "2\n5\n6\n")
    m, data = mtx.read(spark, path)
    assert len(m.comments) == 300_000 and [r.a for r in data.orderBy("k").collect()] == [5.0, 6.0]
    with pytest.raises(HeaderError):
        mtx.read(spark, write(tmp_path / "d.mtx", "%%MatrixMarket vector array real general\n% c\n"))


@pytest.mark.parametrize("spec", ["%d", "%5d", "%-5d", "%05d", "%+d", "% d", "%+05d", "%-05d", "%#d", "%.3d", "% +4d"])
def test_integers_are_formatted_as_in_c(spark, spec):
    values = [0, 7, -7, 123456, -(1 << 62)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "a long").select("a", numfmt.formatted(F.col("a"), numfmt.parse(spec, True)).alias("t"))
    assert {r.a: r.t for r in df.collect()} == {v: spec % v for v in values} | {None: None}


def test_complex_helpers(spark):
    z = spark.range(1).select(cplx.mul(cplx.lit(1 + 2j), cplx.lit(3 - 1j)).alias("z"), cplx.coalesced(cplx.conj(cplx.lit(1j))).alias("c")).first()
    assert (z.z.re, z.z.im, z.c.im) == (5.0, 5.0, -1.0)
    assert en.field_of(spark.range(1).select(F.lit(1).alias("a"))) is Field.INTEGER
