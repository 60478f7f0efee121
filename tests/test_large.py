"""Structures for large inputs: multilevel partitions, separators, plans for repeated products, tiles, the data source,
lookups in sized parts and exact assembly of streams."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from coordtab import storage
from coordtab.errors import HeaderError, IncompatibleError, PartitionError
from coordtab.functions import cplx
from coordtab.operators import entries as en
from coordtab.operators import graphs, halo, multilevel, products, solver, tiles
from coordtab.operators import partitioning as pt
from coordtab.operators import vectors as ve
from coordtab.sources import datasource, mtx
from coordtab.meta import Field, Meta
from coordtab.streaming import assemble


def grid(spark, rows, columns):
    """The graph of a grid as entries."""
    at = lambda r, c: r * columns + c + 1
    edges = [(at(r, c), at(r, c + 1)) for r in range(rows) for c in range(columns - 1)] + [(at(r, c), at(r + 1, c)) for r in range(rows - 1) for c in range(columns)]
    return spark.createDataFrame([(k, i, j, 1.0) for k, (i, j) in enumerate(edges)], "k long, i long, j long, a double")


# ---------------------------------------------------------------- multilevel partitions


def test_multilevel_partition_of_a_grid(spark):
    n = 20 * 16
    a = grid(spark, 20, 16)
    parted = multilevel.partition(a, n, n, 4)
    sizes = [r["count"] for r in parted.groupBy("part").count().collect()]
    assert parted.count() == parted.select("v").distinct().count() == n
    assert len(sizes) == 4 and max(sizes) <= max(-(-n // 4), int(n * 1.03 / 4))
    edges = storage.written(graphs.adjacency(a, n, n), "edges")
    flat = graphs.partition(a, n, n, 4)
    assert graphs.cut_of(edges, parted) <= graphs.cut_of(edges, flat)


def test_contraction_keeps_weights(spark):
    """A star, a path, isolated vertices and two pieces: weights add up, pieces stay apart, levels shrink by a third."""
    pairs = [(1, k) for k in range(2, 40)] + [(k, k + 1) for k in range(41, 80)]
    edges = spark.createDataFrame([(x, y, 1, 1, 1) for p in pairs for x, y in (p, p[::-1])], "src long, dst long, w long, a long, b long")
    vertices = spark.createDataFrame([(v, 0 if v <= 40 else 1, 1) for v in range(1, 101)], "v long, piece long, w long")
    level = multilevel.Level(vertices, edges, 100)
    ahead = multilevel.contracted(level, 4, 1)
    assert ahead.n <= 67 and ahead.vertices.agg(F.sum("w")).first()[0] == 100
    up = {r.v: r.to for r in ahead.up.collect()}
    assert set(up) == set(range(1, 101)) and all((v <= 40) == (t <= 40) for v, t in up.items())
    between = sum(up[x] != up[y] for x, y in pairs)
    assert ahead.edges.agg(F.sum("w")).first()[0] == 2 * between
    assert ahead.edges.where("src = dst").isEmpty() and ahead.vertices.agg(F.max("w")).first()[0] == 2


def test_partitions_of_odd_graphs(spark):
    none = spark.createDataFrame([], "k long, i long, j long, a double")
    assert multilevel.partition(none, 0, 0, 3).count() == 0
    assert sorted(r["count"] for r in multilevel.partition(none, 10, 10, 3).groupBy("part").count().collect()) == [3, 3, 4]
    wide = multilevel.partition(grid(spark, 2, 2), 6, 4, 2)  # a bipartite graph of 6 rows and 4 columns
    assert sorted(r["count"] for r in wide.groupBy("part").count().collect()) == [5, 5]
    with pytest.raises(PartitionError):
        multilevel.partition(none, 10, 10, 0)


@pytest.mark.parametrize("seed", range(3))
def test_covers_are_smallest(spark, seed):
    rng = random.Random(seed)
    border = {(rng.randrange(7), 100 + rng.randrange(7)) for _ in range(rng.randrange(1, 18))}
    found = {r.v for r in multilevel.cover(spark.createDataFrame(sorted(border), "x long, y long")).collect()}
    assert all(x in found or y in found for x, y in border)
    ends = sorted({v for e in border for v in e})
    least = next(k for k in range(len(ends) + 1) if any(all(x in c or y in c for x, y in border) for c in map(set, itertools.combinations(ends, k))))
    assert len(found) == least


def fill(edges, order):
    """Entries below the diagonal of the factor that an elimination in this order makes."""
    near = {v: set() for v in order}
    for x, y in edges:
        near[x].add(y)
        near[y].add(x)
    place, count = {v: k for k, v in enumerate(order)}, 0
    for v in order:
        later = {w for w in near[v] if place[w] > place[v]}
        count += len(later)
        for w in later:
            near[w] |= later - {w}
    return count


def test_dissection_by_separators(spark):
    n = 14 * 14
    a = grid(spark, 14, 14)
    edges = graphs.adjacency(a, n, n).select("src", "dst")
    vertices = spark.range(1, n + 1).select(F.col("id").alias("v"), F.lit(0).cast("long").alias("piece"))
    sides = multilevel.halves(vertices, edges)
    ends = edges.join(sides.toDF("src", "_a"), "src").join(sides.toDF("dst", "_b"), "dst")
    assert ends.where("_a = 0 AND _b = 1").isEmpty()
    sizes = {r.side: r["count"] for r in sides.groupBy("side").count().collect()}
    assert sizes[2] <= 20 and max(sizes[0], sizes[1]) <= 0.55 * n + 1  # a middle level has 14 vertices at least
    rows, columns = multilevel.dissection(a, n, n, smallest=60)
    place = {r.src: r.dst for r in rows.collect()}
    assert sorted(place) == sorted(place.values()) == list(range(1, n + 1)) and rows is columns
    pairs = [(r.i, r.j) for r in a.collect()]
    assert fill(pairs, sorted(place, key=place.get)) < fill(pairs, range(1, n + 1))


# ---------------------------------------------------------------- repeated products


def owners(spark, n, parts):
    return spark.range(1, n + 1).select(F.col("id").alias("i"), F.floor((F.col("id") - 1) * parts / n).cast("int").alias("part"))


def band(spark, n):
    return spark.range(1, n + 1).select(F.explode(F.array(*(F.struct(F.col("id").alias("i"), (F.col("id") + d).alias("j"), F.lit(v).alias("a")) for d, v in ((0, 4.0), (-1, -1.0), (1, -1.0))))).alias("e")).select("e.*").where(F.col("j").between(1, n))


def test_a_laid_out_product_moves_only_what_others_need(spark):
    n = 600
    a, x = band(spark, n), spark.range(1, n + 1).select(F.col("id").alias("i"), (F.col("id") % 7).cast("double").alias("a"))
    plan = halo.Product(a, owners(spark, n, 4), 4)
    placed = plan.placed(x)
    with halo.in_place(spark):
        text = plan.gemv(placed)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and "Broadcast" not in text  # the values on their way
    moved = plan.routes.volume().collect()
    assert sorted((r.part, r.to, r.n) for r in moved) == sorted((p, p + d, 1) for p in range(4) for d in (-1, 1) if 0 <= p + d < 4)
    y = plan.written(plan.gemv(placed))
    expected = products.gemv(a, x)
    assert y.select("i", "a").exceptAll(expected).isEmpty() and y.count() == n
    again = plan.written(plan.gemv(y))  # the result is laid out like x
    assert again.select("i", "a").exceptAll(products.gemv(a, expected)).isEmpty()
    plan.close()


def test_products_of_other_kinds(spark):
    rng = random.Random(2)
    a = spark.createDataFrame([(rng.randrange(1, 20), rng.randrange(1, 9), (float(rng.randrange(5)), float(rng.randrange(5)))) for _ in range(60)], "i long, j long, a struct<re: double, im: double>")
    x = spark.createDataFrame([(k, (float(k), 1.0)) for k in range(1, 9)], "i long, a struct<re: double, im: double>")
    plan = halo.Product(a, owners(spark, 19, 3), 3, columns=owners(spark, 8, 3))
    y = plan.written(plan.gemv(plan.placed(x)))
    key = lambda df: sorted((r.i, r.a.re, r.a.im) for r in df.collect())
    assert key(y) == key(products.gemv(a, x))
    with pytest.raises(IncompatibleError):
        plan.gemv(plan.placed(x.withColumn("a", F.lit(1.0))))
    plan.close()


def test_repeated_scatter(spark):
    rng = random.Random(4)
    places = rng.sample(range(200), 80)
    x = spark.createDataFrame([(rng.randrange(4), i, float(i)) for i in places], "part int, i long, a double")
    wanted = sorted({(rng.randrange(4), rng.randrange(200)) for _ in range(150)})
    plan = halo.Scatter(x, spark.createDataFrame(wanted, "part int, i long"), 4)
    for factor in (1.0, -3.0):
        stored = halo.bucketed(x.withColumn("a", F.col("a") * factor), 4, "i")
        got = sorted(tuple(r) for r in plan.run(stored).select("part", "i", "a").collect())
        assert got == [(p, i, factor * i if i in places else 0.0) for p, i in wanted]
    plan.close()
    with pytest.raises(IncompatibleError):
        halo.Scatter(x.unionByName(x), x, 4)


def test_conjugate_gradients_in_parts(spark):
    n = 300
    a, x = band(spark, n), spark.range(1, n + 1).select(F.col("id").alias("i"), (F.col("id") % 11).cast("double").alias("a"))
    found = solver.cg(a, products.gemv(a, x), rtol=1e-12, owners=owners(spark, n, 3), partitions=3, restart=5)
    assert found.converged
    worst = found.x.join(x.toDF("i", "_x"), "i").agg(F.max(F.abs(F.col("a") - F.col("_x"))), F.count(F.lit(1))).first()
    assert worst[0] < 1e-9 and worst[1] == n


# ---------------------------------------------------------------- tiles and grids


def test_tiles(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(1, 50), rng.randrange(1, 30), float(rng.randrange(1, 9))) for _ in range(400)]
    a = spark.createDataFrame(rows, "i long, j long, a double")
    cut = tiles.tiled(a, 8)
    for r in cut.collect():
        assert len(r.first) == 9 and r.first[0] == 0 and r.first[-1] == len(r.j) == len(r.a) and list(r.first) == sorted(r.first)
    assert tiles.entries_of(cut, 8).exceptAll(en.assemble(a)).isEmpty() and tiles.entries_of(cut, 8).count() == en.assemble(a).count()
    x = spark.range(29).select(F.col("id").alias("i"), (F.col("id") % 5).cast("double").alias("a"))
    up = x.withColumn("i", F.col("i") + 1)
    y = spark.range(1, 61).select(F.col("id").alias("i"), F.lit(2.0).alias("a"))
    for trans in ("notrans", "trans"):
        v = up if trans == "notrans" else y
        blocks = ve.blocked(v.withColumn("i", F.col("i") - 1), 8)
        got = tiles.gemv(tiles.tiled(a, 8, trans), blocks, y, alpha=2.0, beta=3.0, size=8)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, products.gemv(a, v, y, alpha=2.0, beta=3.0, trans=trans).collect()))
    assert tiles.tiled(a.limit(0), 8).count() == 0
    with pytest.raises(IncompatibleError):
        tiles.tiled(a.withColumn("a", cplx.cx(F.col("a"), 0.0)))


def test_heavy_inner_indices_are_spread(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(1, 300), 5 if rng.random() < 0.4 else rng.randrange(1, 60), float(rng.randrange(9))) for _ in range(3_000)]
    a = spark.createDataFrame(rows, "i long, j long, a double")
    left, right = en.assemble(a), en.assemble(a)
    l, r = products.spread(left.select("i", F.col("j").alias("_in"), F.col("a").alias("_a")), right.select(F.col("j").alias("_in"), F.col("i").alias("j"), F.col("a").alias("_b")), heavy=1_000)
    each = l.join(r, ["_in", "_p", "_q"]).groupBy("_in", "_p", "_q").count()
    heaviest = each.agg(F.max("count")).first()[0]
    alone = left.groupBy("j").count().agg(F.max("count")).first()[0] ** 2
    assert alone > 20_000 and heaviest < 3_000
    got, expected = products.gemm_grid(a, a, trans_b="trans", heavy=1_000), products.gemm(a, a, trans_b="trans")
    assert got.exceptAll(expected).isEmpty() and got.count() == expected.count()
    z = a.withColumn("a", cplx.cx(F.col("a"), 1.0))
    got, expected = (f(z, z, trans_b="conjtrans") for f in (lambda *x, **o: products.gemm_grid(*x, heavy=500, **o), products.gemm))
    assert sorted((r.i, r.j, r.a.re, r.a.im) for r in got.collect()) == sorted((r.i, r.j, r.a.re, r.a.im) for r in expected.collect())


# ---------------------------------------------------------------- data source


@pytest.fixture
def source(spark):
    datasource.register(spark)
    return spark.read.format("mtx")


def test_source_round_trip(spark, source, tmp_path):
    data = spark.range(5_000).select((F.col("id") % 90 + 1).alias("i"), (F.col("id") * 7 % 40 + 1).alias("j"), (F.col("id") / 8).alias("a")).repartition(3)
    path = str(tmp_path / "m")
    data.write.format("mtx").option("rows", 90).option("columns", 40).mode("append").save(path)
    back = source.option("split", 999).load(path)
    assert back.dtypes == [("i", "bigint"), ("j", "bigint"), ("a", "double")] and back.rdd.getNumPartitions() > 20
    assert back.exceptAll(data).isEmpty() and back.count() == 5_000
    meta, lines = mtx.read(spark, path)  # the same file for the other reader
    assert (meta.nrows, meta.ncols, meta.nnz) == (90, 40, 5_000) and lines.drop("k").exceptAll(data).isEmpty()
    few = back.where("i = 7 AND j > 3 AND a < 400").where(F.col("j").isin(13, 23, 27))
    assert few.exceptAll(data.where("i = 7 AND j in (13, 23, 27) AND a < 400")).isEmpty() and few.count() > 0
    with pytest.raises(Exception, match="mode overwrite"):
        data.write.format("mtx").option("rows", 90).option("columns", 40).mode("append").save(path)
    data.limit(3).write.format("mtx").option("rows", 90).option("columns", 40).mode("overwrite").save(path)
    assert source.load(path).count() == 3


@pytest.mark.parametrize("field, kind", [("integer", "long"), ("pattern", None), ("complex", "struct")])
def test_source_fields(spark, source, tmp_path, field, kind):
    base = spark.range(40).select(F.col("id").alias("k"), (F.col("id") + 1).alias("i"), (40 - F.col("id")).alias("j"))
    value = {"integer": F.col("k") * 3 - 50, "complex": cplx.cx(F.col("k").cast("double"), -F.col("k") / 4)}.get(field)
    data = base if value is None else base.withColumn("a", value)
    path = str(tmp_path / "m")
    mtx.write(Meta(40, 40, 40, field=Field(field), comments=("% one\n", "%\n")), data, path, fmt="%.17g" if field == "complex" else None)
    assert sorted(map(str, source.load(path).collect())) == sorted(map(str, data.drop("k").collect()))


def test_source_refuses(spark, source, tmp_path):
    for name, text in (("array", "%%MatrixMarket matrix array real general\n1 1\n2.5\n"), ("bounds", "%%MatrixMarket matrix coordinate pattern general\n2 2 1\n1 3\n"), ("empty", "")):
        (tmp_path / name).write_text(text)
    with pytest.raises(Exception, match="coordinate files"):
        source.load(str(tmp_path / "array")).count()
    with pytest.raises(Exception, match="out of bounds"):
        source.load(str(tmp_path / "bounds")).collect()
    with pytest.raises(HeaderError):
        datasource.heading(*(lambda s, p: (s, datasource.files_of(s, p)))(*datasource.located(str(tmp_path / "empty"))))


# ---------------------------------------------------------------- lookups and streams


def test_sized_parts(spark):
    rng = random.Random(9)
    sizes = [rng.choice([0, 0, 1, 2, 700]) for _ in range(300)]
    n = sum(sizes)
    ends = np.cumsum(sizes)
    at = [rng.randrange(n) for _ in range(2_000)] + [0, n - 1] + [5] * 500
    table = spark.createDataFrame(list(enumerate(sizes)), "part long, size long")
    got = pt.sized(spark.createDataFrame([(x, k) for k, x in enumerate(at)], "x long, part int"), F.col("x"), table, "owner").collect()
    assert len(got) == len(at) and all(r.owner == int(np.searchsorted(ends, r.x, "right")) and r.part is not None for r in got)
    with pytest.raises(Exception, match="index outside"):
        pt.sized(spark.createDataFrame([(n,)], "x long"), F.col("x"), table).count()


def test_a_stream_that_is_stopped_and_repeated_adds_nothing_twice(spark, tmp_path):
    rng = random.Random(10)
    rows = [(rng.randrange(6), rng.randrange(4), rng.randrange(100)) for _ in range(900)]
    for k in range(9):
        spark.createDataFrame(rows[k * 100 : k * 100 + 100], "i long, j long, a long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("i long, j long, a long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    class Failing(assemble.Table):
        """Stops after a batch is written and before Spark knows it."""

        def add(self, batch, number):
            super().add(batch, number)
            if number in stops:
                stops.discard(number)
                raise RuntimeError("stopped")

    stops = {1, 3, 4, 8}
    table = Failing(spark, str(tmp_path / "table"), compact=3)
    for _ in range(5):
        query = assemble.into_table(stream(), table, str(tmp_path / "checkpoint"))
        try:
            query.awaitTermination()
        except Exception as e:  # noqa: BLE001
            assert "stopped" in str(e)
    assert not stops and table.whole("upto")
    expected = spark.createDataFrame(rows, "i long, j long, a long").groupBy("i", "j").agg(F.sum("a").alias("a"))
    assert table.read().exceptAll(expected).isEmpty() and table.read().count() == expected.count()


# ---------------------------------------------------------------- deep searches


def test_deep_searches_go_on_by_blocks(spark, monkeypatch):
    """A long narrow grid, a path apart and single vertices, their numbers shuffled in part: the rules of the driver's
    form, in far fewer tables than there are levels."""
    n, columns = 330, 3
    at = lambda k: (k * 7 % 60 if k < 60 else k) + 1
    edges = [(at(k), at(k + 1)) for k in range(269) if k % columns < columns - 1] + [(at(k), at(k + columns)) for k in range(267)]
    edges += [(k, k + 1) for k in range(280, 320)]
    a = spark.createDataFrame([(k, i, j, 1.0) for k, (i, j) in enumerate(edges)], "k long, i long, j long, a double")
    near = storage.written(graphs.adjacency(a, n, n), "edges")
    expected = [sorted(tuple(r) for r in f.collect()) for f in (graphs.levels(near, 1), graphs.order_of(near, n, 1))]
    for name, value in (("DEEP", 4), ("BLOCK", 100), ("BAND", 60)):
        monkeypatch.setattr(graphs, name, value)
    tables, written = [], storage.written
    monkeypatch.setattr(storage, "written", lambda df, name: tables.append(name) or written(df, name))
    got = sorted(tuple(r) for r in graphs.levels(near, 1, 0).collect())
    assert len(tables) < 60 and got == expected[0]
    assert sorted(tuple(r) for r in graphs.order_of(near, n, 1, 0).collect()) == expected[1]
