"""Steps whose cost must not outgrow their input: plans, packed products and pieces that few rows stand for."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from coordtab.operators import entries as en


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_few_pointers_of_long_rows_are_not_broadcast(spark):
    n = 3 * en.BLOCK + 5
    pointers = spark.createDataFrame([(1, 0, 4), (2, 4, 4), (3, 4, n - 1), (4, n - 1, n)], "i long, first long, last long")
    values = spark.range(n).select(F.col("id").alias("k"), (F.col("id") % 7).alias("j"), F.col("id").alias("a"))
    got = en.from_compressed(pointers, values)
    assert "Broadcast" not in plan_of(got)
    rows = got.groupBy("i").agg(F.count(F.lit(1)), F.min("k"), F.max("k"), F.sum("a")).collect()
    assert sorted(map(tuple, rows)) == [(1, 4, 0, 3, 6), (3, n - 5, 4, n - 2, sum(range(4, n - 1))), (4, 1, n - 1, n - 1, n - 1)]


def test_triangular_places_of_large_positions(spark):
    rows = [1, 1_999, 2_000, 4_242, 10**6, 10**8]
    k = [r * (r - 1) // 2 + d for r in rows for d in (0, r - 1)]
    got = en.triangular_places(spark.createDataFrame([(v, v) for v in k], "k long, a long"), keep=("k",)).orderBy("k").collect()
    assert [(r.i, r.j) for r in got] == [(1, 1), (1, 1), *((r, j) for r in rows[1:] for j in (1, r))]


@pytest.mark.parametrize("cells", [8, 1 << 20])
@pytest.mark.parametrize("rows", [1, 3, 7, 1_000])
def test_tiles_in_batches_of_any_size(monkeypatch, rows, cells):
    """Tiles of many batches and many tiles of one batch: nothing is lost, nothing comes twice."""
    import pyarrow as pa

    from coordtab.operators import tiles

    monkeypatch.setattr(tiles, "CELLS", cells)
    rng, size = random.Random(3), 4
    entries = {(rng.randrange(40), rng.randrange(50)): float(k + 1) for k in range(300)}
    cut = sorted((i // size, j // size, i % size, j % size, a) for (i, j), a in entries.items())
    kinds = zip(("_bi", "_bj", "_r", "_c", "_a"), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64()))
    table = pa.table({name: pa.array([r[k] for r in cut], kind) for k, (name, kind) in enumerate(kinds)})
    made = pa.Table.from_batches(list(tiles.packed(size)(table.to_batches(max_chunksize=rows)))).combine_chunks()
    places = list(zip(made["bi"].to_pylist(), made["bj"].to_pylist()))
    assert len(places) == len(set(places)) == len({(bi, bj) for bi, bj, *_ in cut})
    found = {}
    for bi, bj, first, j, a in zip(*(made[c].to_pylist() for c in ("bi", "bj", "first", "j", "a"))):
        found |= {(bi * size + r, bj * size + j[k]): a[k] for r in range(size) for k in range(first[r], first[r + 1])}
    assert found == entries
    x = [float(k % 5 + 1) for k in range(43)]  # the last block is short, and some tiles lie beyond it
    blocks = pa.array([x[bj * size : (bj + 1) * size] for _, bj in places], pa.list_(pa.float64()))
    y, expected = {}, {}
    for out in tiles.multiplied(size)(made.select(["bi", "first", "j", "a"]).append_column("_x", blocks).to_batches(max_chunksize=rows)):
        for i, a in zip(*(c.to_pylist() for c in out.columns)):
            y[i] = y.get(i, 0) + a
    for (i, j), a in entries.items():
        if j < 43:
            expected[i + 1] = expected.get(i + 1, 0) + a * x[j]
    assert y == expected


def test_texts_are_marked_before_they_are_shuffled(spark, monkeypatch):
    """A semi join with the wanted ids would be pushed below the test of marks, so that all texts were shuffled to it."""
    from coordtab.llm import neardup, store

    plans = {}

    def written(df, name):
        plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString())
        return kept(df, name)

    kept = store.written
    monkeypatch.setattr(store, "written", written)
    text = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(1, text), (2, text + " x"), (3, "other words"), (3, text + " y"), (4, None)], "doc_id long, text string")
    assert {(r._id, r._n, r._component) for r in neardup.grouped(docs, 2).collect()} == {(1, 59, 1), (2, 60, 1), (3, 1, 1), (3, 60, 1), (4, 0, 4)}
    joins = [line for line in plans["sets"].splitlines() if "Join" in line]
    assert not any("LeftSemi" in line for line in joins) and "_m" in joins[1]


def test_entries_of_tiles_in_slices(spark, monkeypatch):
    from coordtab.operators import tiles

    monkeypatch.setattr(tiles, "CELLS", 16)
    given = [(1, 1, 2.0), (9, 30, 3.0), (10, 30, 4.0), (40, 2, 5.0), (40, 3, 6.0)]
    a = spark.createDataFrame(given, "i long, j long, a double").repartition(1)
    assert sorted(map(tuple, tiles.entries_of(tiles.tiled(a, 4), 4).collect())) == given


def grid_edges(spark, side):
    n = side * side
    pairs = [(v, v + d) for v in range(1, n + 1) for d in (1, side) if v + d <= n and (d > 1 or v % side)]
    return n, spark.createDataFrame(pairs + [(b, a) for a, b in pairs], "src long, dst long")


def test_halves_of_a_small_graph_take_few_tables(spark, monkeypatch):
    """Levels within the driver's bound aren't contracted by jobs, and no separator is larger than a middle level."""
    from coordtab import storage
    from coordtab.operators import multilevel

    made = []
    monkeypatch.setattr(storage, "written", lambda df, name, kept=storage.written: made.append(name) or kept(df, name))
    n, edges = grid_edges(spark, 30)
    vertices = spark.range(1, n + 1).select(F.col("id").alias("v"), F.lit(0).cast("long").alias("piece"))
    side = {r.v: r.side for r in multilevel.halves(vertices, edges).collect()}
    assert len(side) == n and all({side[e.src], side[e.dst]} != {0, 1} for e in edges.collect())
    assert list(side.values()).count(2) <= 30 and max(list(side.values()).count(k) for k in (0, 1)) <= 495
    assert len(made) < 50 and "match" not in made


def test_smallest_covers_on_the_driver(spark, monkeypatch):
    from coordtab.operators import multilevel

    rng = random.Random(5)
    for _ in range(3):
        border = sorted({(rng.randrange(12), 100 + rng.randrange(12)) for _ in range(18)})
        sizes = []
        for most in (1_000, 0):
            monkeypatch.setattr(multilevel, "DRIVER_EDGES", most)
            found = {r.v for r in multilevel.cover(spark.createDataFrame(border, "x long, y long")).collect()}
            assert all(x in found or y in found for x, y in border)
            sizes.append(len(found))
        assert sizes[0] == sizes[1]


def test_dense_levels_are_improved_within_their_bound():
    from coordtab.operators import multilevel

    rng = np.random.default_rng(2)
    group, weight = np.repeat([0, 1, 2], 40), np.ones(120, np.int64)
    a, b = np.triu_indices(120, 1)
    tied = rng.random(len(a)) < np.where(group[a] == group[b], 0.6, 0.05)
    src, dst = np.r_[a[tied], b[tied]], np.r_[b[tied], a[tied]]
    level = multilevel.Small(src, dst, np.ones(len(src), np.int64), weight)
    start = np.where(rng.random(120) < 0.2, rng.integers(0, 3, 120), group)
    cap = max(level.cap(3, 1.1), int(np.bincount(start).max()))
    got = multilevel.shifted(level, start, 3, cap)
    assert level.cut(got) < level.cut(start) and np.bincount(got).max() <= cap


def test_rounds_of_exchanges_broadcast_no_vertices(spark, monkeypatch):
    from coordtab import storage
    from coordtab.operators import graphs

    plans = []

    def written(df, name):
        plans.append((name, plan_of(df)))
        return kept(df, name)

    kept = storage.written
    monkeypatch.setattr(storage, "written", written)
    n, edges = grid_edges(spark, 8)
    parted = spark.range(1, n + 1).select(F.col("id").alias("v"), (F.col("id") % 2).cast("int").alias("part"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    assert graphs.refined(edges, parted, 2).count() == n
    rounds = [plan for name, plan in plans if name == "parts"]
    assert rounds and all(plan.count("BroadcastHashJoin") <= 2 for plan in rounds)  # those of a row a pair of parts
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before


def test_positions_come_without_broadcasts(spark):
    """Each broadcast of a few rows takes a megabyte of the driver, and orders by levels need many positions."""
    df = spark.range(5_000).select((F.col("id") * 7_919 % 5_003).alias("v"))
    got = en.ranked(df, [F.col("v")])
    assert "Broadcast" not in plan_of(got)
    assert [r.k for r in got.orderBy("v").collect()] == list(range(5_000))
    assert en.ranked(df.limit(0), [F.col("v")]).collect() == []


@pytest.mark.parametrize("partitions", [3, 40])
def test_products_of_near_inner_indices_are_added_up_before_the_shuffle(spark, monkeypatch, partitions):
    """400 inner indices in 40 groups, each of which makes the same 25 places: blocks of them stay together."""
    import re

    from coordtab import storage
    from coordtab.operators import products

    a = spark.range(400 * 5).select((F.col("id") % 5 + F.expr("id div 50") * 5 + 1).alias("i"), (F.expr("id div 5") + 1).alias("j"), F.lit(1.0).alias("a"))
    got = products.gemm(a, a, trans_b="trans", assembled=True)
    assert got.count() == 40 * 25 and got.where("a <> 10").isEmpty()
    plans, written = [], storage.written
    monkeypatch.setattr(storage, "written", lambda df, name: plans.append(plan_of(df)) or written(df, name))
    left, right = a.select("i", F.col("j").alias("_in"), F.col("a").alias("_a")), a.select(F.col("j").alias("_in"), F.col("i").alias("j"), F.col("a").alias("_b"))
    products.summed(left.hint("merge"), right, 10, partitions)
    dealt = re.findall(r"hashpartitioning\(([^)]*)\)", plans[0])
    assert sorted(re.sub(r"#\d+L?", "", d) for d in dealt) == sorted([f"_block, {partitions}"] * 2 + [f"i, j, {partitions}"])


@pytest.mark.parametrize("side", [4, 64])
def test_dense_inner_indices_are_multiplied_in_tiles(spark, monkeypatch, side):
    """Products of frequent inner indices aren't shuffled by place; zeros, infinities and complex values stay what they are."""
    from coordtab.functions import cplx
    from coordtab.operators import products

    monkeypatch.setattr(products, "SIDE", side)
    rng = random.Random(5)
    places = {(rng.randrange(1, 90), 5 if rng.random() < 0.3 else rng.randrange(1, 40)) for _ in range(600)}
    rows = [(i, j, float(rng.randrange(-2, 3))) for i, j in sorted(places)]
    a = spark.createDataFrame(rows, "i long, j long, a double")
    got, expected = products.gemm_grid(a, a, trans_b="trans", heavy=100, dense=400), products.gemm(a, a, trans_b="trans")
    assert "FlatMapGroupsInArrow" in plan_of(got)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))
    z = a.withColumn("a", cplx.cx(F.col("a"), F.col("i").cast("double")))
    got, expected = (sorted((r.i, r.j, r.a.re, r.a.im) for r in df.collect()) for df in (products.gemm_grid(z, z, trans_b="conjtrans", heavy=100, dense=400), products.gemm(z, z, trans_b="conjtrans")))
    assert got == expected
    far = spark.createDataFrame([(1, 5, float("inf")), (2, 5, 1.0), (70, 5, 3.0), (70, 6, 1.0)], "i long, j long, a double")
    got, expected = products.gemm_grid(far, far, trans_b="trans", heavy=1, dense=1), products.gemm(far, far, trans_b="trans")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))


def test_rounds_leave_the_edges_where_they_are(spark, monkeypatch):
    """Edges beyond the driver's bound stand in buckets of src: levels, places and exchanges shuffle what they find only."""
    from coordtab import storage
    from coordtab.operators import graphs

    plans = []
    monkeypatch.setattr(storage, "written", lambda df, name, kept=storage.written: plans.append((name, plan_of(df))) or kept(df, name))
    monkeypatch.setattr(graphs, "FEW", 2)
    side = 3
    n = side * side
    pairs = [(k, v, v + d) for k, (v, d) in enumerate((v, d) for v in range(1, n + 1) for d in (1, side) if v + d <= n and (d > 1 or v % side))]
    a = spark.createDataFrame(pairs, "k long, i long, j long")
    edges = graphs.stored(a, n, n, 0)
    spread = {r.v: r.pos for r in graphs.order_of(edges, n, None, 0).collect()}
    assert spread == {r.v: r.pos for r in graphs.order_of(graphs.stored(a, n, n), n, None).collect()}
    parted = storage.written(spark.createDataFrame([(v, v % 2) for v in range(1, n + 1)], "v long, part int"), "start")
    before = graphs.cut_of(edges, parted)
    assert graphs.cut_of(edges, graphs.refined(edges, parted, 1)) <= before
    assert {"first", "ties"} <= {name for name, _ in plans}
    for plan in (plan for name, plan in plans if name in ("first", "ties")):
        assert "Bucketed: true" in plan and "Exchange hashpartitioning(src#" not in plan.split("FileScan parquet spark_catalog")[0]


def test_levels_of_large_pieces_are_separators_too(spark, monkeypatch):
    """The halves by levels of a grid, a path, a cycle and two vertices in one piece without an edge, in Spark and on the driver."""
    from coordtab.operators import multilevel

    n, grid = grid_edges(spark, 6)
    line = [(v, v + 1) for v in range(101, 109)] + [(v, v + 1) for v in range(201, 209)] + [(201, 209)]
    edges = grid.unionByName(spark.createDataFrame(line + [(b, a) for a, b in line], "src long, dst long"))
    pieces = [(v, 0) for v in range(1, n + 1)] + [(v, 1) for v in range(101, 110)] + [(v, 2) for v in range(201, 210)] + [(301, 3), (302, 3)]
    vertices = spark.createDataFrame(pieces, "v long, piece long")
    got, expected = (sorted(map(tuple, f(vertices, edges, 1.1).collect())) for f in (multilevel.spread_level_halves, multilevel.level_halves))
    assert got == expected and {p for _, p, _ in got} == {0, 1, 2}


def test_halves_of_a_large_graph_are_none_larger_than_a_level(spark, monkeypatch):
    from coordtab.operators import multilevel

    n, edges = grid_edges(spark, 8)
    vertices = spark.range(1, n + 1).select(F.col("id").alias("v"), F.lit(0).cast("long").alias("piece"))
    cut = spark.range(1, n + 1).select(F.col("id").alias("v"), (F.col("id") % 2).alias("part"))  # a poor one: stripes
    monkeypatch.setattr(multilevel, "cut_up", lambda *_: cut)
    monkeypatch.setattr(multilevel.graphs, "fits", lambda edges, most: False)
    side = {r.v: r.side for r in multilevel.halves(vertices, edges).collect()}
    assert len(side) == n and all({side[e.src], side[e.dst]} != {0, 1} for e in edges.collect())
    assert list(side.values()).count(2) <= 8


def test_links_leave_the_edges_where_they_are(spark, monkeypatch):
    from coordtab import storage
    from coordtab.operators import graphs, multilevel

    plans = []
    monkeypatch.setattr(storage, "written", lambda df, name, kept=storage.written: plans.append((name, plan_of(df))) or kept(df, name))
    one = F.lit(1).cast("long")
    n, edges = grid_edges(spark, 4)
    edges = storage.bucketed(edges.select("src", "dst", "src", one.alias("w")).toDF("src", "dst", "_", "w").drop("_"), "src", "edges")
    parted = spark.range(1, n + 1).select(F.col("id").alias("v"), F.floor((F.col("id") - 1) / 8).alias("part"))
    with storage.settings(spark, storage.NO_BROADCASTS):
        got = sorted(map(tuple, multilevel.links(multilevel.Level(parted, edges, n), parted).collect()))
    near: dict = {}
    for e in edges.collect():
        key = (e.src, (e.src - 1) // 8, (e.dst - 1) // 8)
        near[key] = near.get(key, 0) + 1
    assert got == sorted((*key, k) for key, k in near.items())
    scan = next(line for line in dict(plans)["links"].splitlines() if "spark_catalog" in line)
    assert "Bucketed: true" in scan
