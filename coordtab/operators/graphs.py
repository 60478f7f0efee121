"""The graph of a matrix, and orderings and partitions made from it.

Vertices are 1-based. A square matrix gives the graph of A + A'; another one the bipartite graph of rows and columns, with
columns numbered after the rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import storage
from ..errors import PartitionError
from ..meta import Ordering
from . import entries as en
from . import permutations as pe

#: Graphs of up to so many edges are ordered on the driver (some 100 MB); larger ones level by level in Spark.
LOCAL_EDGES = 1_000_000
#: Levels after which a search is taken for a deep one and goes on by blocks of vertices with consecutive numbers, a task each.
DEEP, BLOCK = 16, 1 << 18
#: Edges between levels that are put in order in one task, if there is more than one level of them.
BAND = 1_000_000
#: Vertices of a level up to which a search in Spark names them in its condition, so that no join is made.
FEW = 1_000


def adjacency(entries: DataFrame, nrows: int, ncols: int, dealt: bool = False) -> DataFrame:
    """(src, dst, rank): each edge in both directions, without loops; rank is the order in which src meets dst: first its
    row's entries in storage order, then its column's. dealt: partitioned by src."""
    k = F.col("k") if "k" in entries.columns else F.monotonically_increasing_id()
    i, j = F.col("i"), F.col("j") + (0 if nrows == ncols else nrows)
    both = F.array(F.struct(i.alias("src"), j.alias("dst"), F.lit(0).alias("side"), k.alias("k")), F.struct(j.alias("src"), i.alias("dst"), F.lit(1).alias("side"), k.alias("k")))
    edges = entries.select(F.explode(both).alias("e")).select("e.*").where(F.col("src") != F.col("dst"))
    if dealt:
        edges = edges.repartition(int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")), "src")
    first = [F.min(F.when(F.col("side") == side, F.col("k"))).alias(f"_k{side}") for side in (0, 1)]  # sums of structs would be sorted
    met = edges.groupBy("src", "dst").agg(F.min("side").alias("side"), *first)
    return met.select("src", "dst", F.struct("side", F.when(F.col("side") == 0, F.col("_k0")).otherwise(F.col("_k1")).alias("k")).alias("rank"))


def stored(entries: DataFrame, nrows: int, ncols: int, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """adjacency(), written; beyond local_edges in buckets of src, so that the rounds that join by it don't move the edges."""
    if entries.count() <= local_edges:
        return storage.written(adjacency(entries, nrows, ncols), "edges")
    return storage.bucketed(adjacency(entries, nrows, ncols, dealt=True), "src", "edges", dealt=True)


def by_source(edges: DataFrame) -> DataFrame:
    """Edges in buckets of src."""
    return edges if "_table" in vars(edges) else storage.bucketed(edges, "src", "edges")


def degrees(edges: DataFrame, n: int) -> DataFrame:
    counts = edges.groupBy("src").agg(F.count(F.lit(1)).alias("_d"))
    return edges.sparkSession.range(1, n + 1).select(F.col("id").alias("v")).join(counts.withColumnRenamed("src", "v"), "v", "left").select("v", F.coalesce("_d", F.lit(0).cast("long")).alias("degree"))


class Fronts:
    """Levels of a search, each a table. Neighbours of one level stand on it or next to it, so a new level is held against
    the last two only; older ones are put together now and then."""

    def __init__(self, first: DataFrame):
        self.old: DataFrame | None = None
        self.new = [first]

    @property
    def last(self) -> DataFrame:
        return self.new[-1]

    def recent(self) -> DataFrame:
        return self.last.select("v") if len(self.new) == 1 else self.new[-2].select("v").unionByName(self.last.select("v"))

    def add(self, front: DataFrame) -> None:
        self.new.append(front)
        if len(self.new) == 32:
            gone = ([self.old] if self.old is not None else []) + self.new[:-2]
            self.old = storage.written(united(gone), "seen")
            storage.drop(*gone)
            del self.new[:-2]

    def all(self) -> DataFrame:
        return united(([self.old] if self.old is not None else []) + self.new)


def unseen(ahead: DataFrame, found: Fronts) -> DataFrame:
    """The rows of ahead whose v is on no recent level. An anti join would be pushed below the join with the edges, so that
    all of them were shuffled by dst for every level."""
    seen = found.recent().withColumn("_seen", F.lit(True)).hint("shuffle_hash")
    return ahead.join(seen, "v", "left").where("_seen IS NULL").drop("_seen")


def united(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def fits(edges: DataFrame, local_edges: int) -> bool:
    return edges.count() <= 2 * local_edges


@storage.without_broadcasts
def levels(edges: DataFrame, root: int, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(v, level): the breadth-first levels of all vertices that root reaches."""
    if fits(edges, local_edges):
        at = Local(edges, 0).levels(root)
        return edges.sparkSession.createDataFrame(pa.table({"v": pa.array(at.keys(), pa.int64()), "level": pa.array(at.values(), pa.int32())}))
    return levels_from(edges, edges.sparkSession.createDataFrame([(root,)], "v long"))


def first_levels(edges: DataFrame, starts: list[int]) -> tuple[dict[int, int], bool]:
    """The first levels from starts, as long as they are of FEW vertices, and whether these are all."""
    at, front, depth = dict.fromkeys(starts, 0), starts, 0
    while front and depth < DEEP:
        near = edges.where(f"src IN ({', '.join(map(str, front))})").select("dst").distinct()
        ahead = [r["dst"] for r in near.limit(3 * FEW + 1).collect()]  # those of the last two levels among them
        new = [v for v in ahead if v not in at]
        if len(ahead) > 3 * FEW or len(new) > FEW:
            break
        front = new
        if front:
            depth += 1
            at.update(dict.fromkeys(front, depth))
    return at, not front


def levels_from(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(v, level): the breadth-first levels of all vertices that are reached from the starts (v), which are one level."""
    spark = edges.sparkSession
    roots = [r["v"] for r in starts.select("v").distinct().limit(FEW + 1).collect()]
    if len(roots) <= FEW:
        at, whole = first_levels(edges, roots)
        known = pa.table({"v": pa.array(at.keys(), pa.int64()), "level": pa.array(at.values(), pa.int32())})
        found, depth = Fronts(storage.written(spark.createDataFrame(known), "front")), max(at.values(), default=0)
        if whole:
            return found.all()
    else:
        found, depth = Fronts(storage.written(starts.select("v", F.lit(0).alias("level")).distinct(), "front")), 0
    while True:
        if depth == DEEP:
            return deep_levels(edges, found.all(), depth)
        depth += 1
        ahead = edges.join(found.last.hint("shuffle_hash"), F.col("v") == F.col("src")).select(F.col("dst").alias("v")).distinct()
        ahead = unseen(ahead, found)
        front = storage.written(ahead.withColumn("level", F.lit(depth)), "front")
        if front.isEmpty():
            return found.all()
        found.add(front)


def least_degree_last(edges: DataFrame, root: int) -> tuple[int, int, int]:
    """Depth of the levels from root, the vertex of least degree (then least number) on the last level, and how many
    vertices are reached."""
    at = levels(edges, root, 0)
    depth, reached = at.agg(F.max("level"), F.count(F.lit(1))).first()
    degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("_d"))
    last = at.where(F.col("level") == depth).join(degree, F.col("v") == F.col("src"), "left")
    return depth, last.agg(F.min_by("v", F.struct(F.coalesce("_d", F.lit(0)), "v"))).first()[0], reached


@storage.without_broadcasts
def pseudo_peripheral(edges: DataFrame, start: int = 1, local_edges: int = LOCAL_EDGES) -> int:
    """From start on to the end of ever deeper level structures."""
    if fits(edges, local_edges):
        return Local(edges, 0).peripheral(start)
    return peripheral_of(edges, start)[0]


def peripheral_of(edges: DataFrame, start: int) -> tuple[int, int]:
    """The same by levels in Spark, and how many vertices start reaches."""
    edges = by_source(edges)
    depth, far, reached = least_degree_last(edges, start)
    while True:
        deeper, further, _ = least_degree_last(edges, far)
        if deeper <= depth:
            return far, reached
        depth, far = deeper, further


class Local:
    """A graph on the driver, with the same rules as the relational functions."""

    def __init__(self, edges: DataFrame, n: int):
        self.n = n
        self.near: dict[int, list[int]] = {}
        found = edges.orderBy("src", "rank" if "rank" in edges.columns else "dst").select("src", "dst").toArrow()  # bounded by LOCAL_EDGES
        for src, dst in zip(found["src"].to_pylist(), found["dst"].to_pylist()):
            self.near.setdefault(src, []).append(dst)

    def degree(self, v: int) -> int:
        return len(self.near.get(v, ()))

    def ends(self, root: int) -> tuple[int, int]:
        seen, front, depth = {root}, [root], 0
        while True:
            ahead = sorted({w for v in front for w in self.near.get(v, ())} - seen)
            if not ahead:
                return depth, min(front, key=lambda v: (self.degree(v), v))
            seen.update(ahead)
            front, depth = ahead, depth + 1

    def levels(self, root: int) -> dict[int, int]:
        at = {root: 0}
        todo = [root]
        for v in todo:
            for w in self.near.get(v, ()):
                if w not in at:
                    at[w] = at[v] + 1
                    todo.append(w)
        return at

    def peripheral(self, start: int) -> int:
        depth, far = self.ends(start)
        while True:
            deeper, further = self.ends(far)
            if deeper <= depth:
                return far
            depth, far = deeper, further

    def order(self, root: int | None) -> list[int]:
        """Vertices level by level: each vertex's new neighbours with the larger degrees first, equal ones in the order of
        meeting; a new component starts at its smallest number."""
        out: list[int] = []
        seen: set[int] = set()
        roots = iter(range(1, self.n + 1))
        root = root or (self.peripheral(1) if self.n else None)
        while root is not None:
            seen.add(root)
            out.append(root)
            at = len(out) - 1
            while at < len(out):
                new = [w for w in self.near.get(out[at], ()) if w not in seen]
                seen.update(new)
                out += sorted(new, key=lambda w: -self.degree(w))
                at += 1
            root = next((v for v in roots if v not in seen), None)
        return out


def block_of(v: str):
    return F.expr(f"{v} div {BLOCK}")


def local_levels():
    """Makes a function that gives (v, level) of the vertices of one block (v, level, new) that get a lower level from the
    new ones, by edges within it."""

    def work(key, edges, vertices):
        inner = [edges[c].to_numpy() for c in ("src", "dst")]
        v, far = vertices["v"].to_numpy(), np.iinfo(np.int64).max
        ids = np.unique(np.concatenate([v, *inner]))
        before, given = np.full(len(ids), far), np.full(len(ids), far)
        for values, column in ((before, "level"), (given, "new")):
            values[np.searchsorted(ids, v)] = vertices[column].cast(pa.int64()).fill_null(far).to_numpy()
        src, dst = (np.searchsorted(ids, e) for e in inner)
        dst = dst[np.argsort(src, kind="stable")]
        first = np.concatenate([[0], np.cumsum(np.bincount(src, minlength=len(ids)))])
        level = np.minimum(before, given)
        source = np.flatnonzero((given < far) & (given == level))
        source = source[np.argsort(given[source], kind="stable")]
        at = given[source]
        front, k, value = source[:0], 0, 0
        while len(front) or k < len(source):
            value = value if len(front) else int(at[k])
            upto = int(np.searchsorted(at, value, "right"))
            own = source[k:upto]
            front, k = np.concatenate([front, own[level[own] == value]]), upto
            count = first[front + 1] - first[front]
            ahead = dst[np.repeat(first[front] - (np.cumsum(count) - count), count) + np.arange(count.sum())]
            front = np.unique(ahead[level[ahead] > value + 1])
            value += 1
            level[front] = value
        less = np.flatnonzero(level < before)
        return pa.table({"v": pa.array(ids[less], pa.int64()), "level": pa.array(level[less], pa.int32())})

    return work


def deep_levels(edges: DataFrame, known: DataFrame, depth: int) -> DataFrame:
    """(v, level) of all that is reached, from the known levels up to depth. In a round, levels go over edges from block to
    block, and blocks that get lower ones follow them through, a task each: as many rounds as a shortest path changes
    blocks, not as many as it has edges."""
    ends = edges.select("src", "dst", block_of("src").alias("_b"), (block_of("src") == block_of("dst")).alias("_inner"))
    inner, outer = storage.written(ends.where("_inner").drop("_inner"), "inner"), storage.written(ends.where("NOT _inner").select("src", "dst"), "outer")
    state = storage.written(known.select("v", "level"), "state")
    moved, own = state.where(F.col("level") == depth), True
    gone: list[DataFrame] = []
    while True:
        sent = moved.join(outer, F.col("v") == F.col("src")).groupBy(F.col("dst").alias("v")).agg((F.min("level") + 1).alias("new"))
        news = sent.join(state, "v", "left").where("level IS NULL OR new < level").select("v", "new")
        if own:  # the front has been met by nobody yet
            news, own = news.unionByName(moved.select("v", F.col("level").alias("new"))), False
        news = storage.written(news, "news")
        if news.isEmpty():
            storage.drop(news, inner, outer, *gone)
            return state
        blocks = storage.written(news.select(block_of("v").alias("_b")).distinct(), "blocks")
        here = state.join(news, "v", "full").withColumn("_b", block_of("v")).join(blocks, "_b", "left_semi")
        near = inner.join(blocks, "_b", "left_semi")
        lower = near.groupBy("_b").cogroup(here.groupBy("_b")).applyInArrow(local_levels(), "v long, level int")
        lower = storage.written(lower, "lower")
        ahead = state.join(lower.toDF("v", "_l"), "v", "full").select("v", F.coalesce("_l", "level").alias("level"))
        ahead = storage.written(ahead, "state")
        storage.drop(news, blocks, state, *gone)
        state, moved, gone = ahead, lower, [lower]


def in_order():
    """Makes a function that gives (v, level, at) of the vertices of some levels in their order, counted from 0, from the
    edges that lead to them: (src, dst, level, less, r0, r1, bfs), where bfs is the place of src if it stands before these levels."""

    def work(key, edges):
        src, dst, level, less, r0, r1 = (edges[c].to_numpy() for c in ("src", "dst", "level", "less", "r0", "r1"))
        known = edges["bfs"].fill_null(-1).to_numpy()
        ids = np.unique(dst)
        place = np.full(len(ids) + 1, -1)
        to = np.searchsorted(ids, dst)
        by = np.minimum(np.searchsorted(ids, src), len(ids) - 1)
        rows = np.argsort(level, kind="stable")
        bounds = np.flatnonzero(np.r_[True, np.diff(level[rows]) != 0, True]) if len(rows) else np.array([0])
        start, count = int(known.max(initial=0)) + 1, 0
        out_v, out_level = [], []
        for low, high in zip(bounds[:-1], bounds[1:]):
            e = rows[low:high]
            before = np.where(known[e] >= 0, known[e], place[by[e]])
            e = e[np.lexsort((r1[e], r0[e], before, to[e]))]
            e = e[np.r_[True, to[e][1:] != to[e][:-1]]]  # the first neighbour of each
            before = np.where(known[e] >= 0, known[e], place[by[e]])
            e = e[np.lexsort((r1[e], r0[e], less[e], before))]
            place[to[e]] = start + count + np.arange(len(e))
            count += len(e)
            out_v.append(dst[e])
            out_level.append(level[e])
        join = lambda arrays, kind: pa.array(np.concatenate(arrays) if arrays else [], kind)
        return pa.table({"v": join(out_v, pa.int64()), "level": join(out_level, pa.int32()), "at": pa.array(np.arange(count), pa.int64())})

    return work


def deep_search(edges: DataFrame, found: DataFrame, degree: DataFrame | None, depth: int, count: int) -> DataFrame:
    """searched() beyond depth, where count vertices were placed before: levels first, then the places, for as many levels
    at once as have BAND edges between them; wider levels by joins. Places depend on those of the level before, so
    that bands follow each other; a task holds one of them."""
    at = deep_levels(edges, found, depth)
    names = edges.schema["rank"].dataType.names
    down = edges.join(at.toDF("src", "_up"), "src").join(at.toDF("dst", "level"), "dst").where((F.col("level") == F.col("_up") + 1) & (F.col("level") > depth))
    less = down.withColumn("less", F.lit(0).cast("long")) if degree is None else down.join(degree.select(F.col("v").alias("dst"), (-F.col("degree")).alias("less")), "dst")
    line = less.select("src", "dst", "level", "less", *(F.col(f"rank.{name}").cast("long").alias(r) for name, r in zip(names, ("r0", "r1"))))
    line = storage.written(line.repartitionByRange("level"), "down")
    bands: list[list[int]] = []
    room = 0
    for r in line.groupBy("level").count().orderBy("level").collect():  # a row a level
        if bands and r["count"] <= room:
            bands[-1][1], room = r["level"], room - r["count"]
        else:
            bands.append([r["level"], r["level"]])
            room = BAND - r["count"]
    done, front = [found], storage.written(found.where(F.col("level") == depth).select("v", "bfs"), "front")
    for low, high in bands:
        rows = line.where(F.col("level").between(low, high)).join(front.select(F.col("v").alias("src"), "bfs"), "src", "left")
        if low < high:
            placed = rows.groupBy(F.lit(0).alias("_one")).applyInArrow(in_order(), "v long, level int, at long")
        else:
            first = rows.groupBy(F.col("dst").alias("v")).agg(F.min(F.struct("bfs", "r0", "r1")).alias("_m"), F.min("less").alias("less"))
            placed = en.ranked(first.select("v", F.lit(low).alias("level"), F.col("_m.bfs").alias("_p"), "less", F.col("_m.r0").alias("_r"), F.col("_m.r1").alias("_s")), [F.col(c) for c in ("_p", "less", "_r", "_s")], "at")
        placed = storage.written(placed.select("v", "level", (F.col("at") + count).alias("bfs")), "band")
        count += placed.count()
        done.append(placed)
        front = placed.where(F.col("level") == high)
    storage.drop(line, at)
    return united([d.select("v", "level", "bfs") for d in done])


def searched(edges: DataFrame, starts: DataFrame, degree: DataFrame | None, count: int) -> DataFrame:
    """(v, level, bfs): a breadth-first search from all starts (v, bfs) at once. A new vertex belongs to the first of its
    neighbours on the level before and is placed by (that one's place, degree from large to small if given, order of
    meeting); places of new vertices are counted from count."""
    found, depth = Fronts(storage.written(starts.select("v", F.lit(0).alias("level"), "bfs"), "front")), 0
    while True:
        if depth == DEEP:
            return deep_search(edges, found.all(), degree, depth, count)
        depth += 1
        ahead = edges.join(found.last.hint("shuffle_hash"), F.col("v") == F.col("src")).select(F.col("dst").alias("v"), "bfs", "rank")
        ahead = unseen(ahead, found)
        # stored, as what is ranked is computed twice: for the sample of its keys, too
        first = storage.written(ahead.groupBy("v").agg(F.min(F.struct("bfs", "rank")).alias("_m")), "first")
        table, first = first, first.withColumn("degree", F.lit(0)) if degree is None else first.join(degree, "v")
        placed = en.ranked(first.select("v", "degree", F.col("_m.bfs").alias("_p"), F.col("_m.rank").alias("_r")), [F.col("_p"), -F.col("degree"), F.col("_r")], "_k")
        front = storage.written(placed.select("v", F.lit(depth).alias("level"), (F.col("_k") + count).alias("bfs")), "front")
        storage.drop(table)
        new = front.count()
        if not new:
            return found.all()
        found.add(front)
        count += new


def frontier_order(edges: DataFrame, n: int, root: int | None) -> DataFrame:
    """(v, pos) by the same rules, a few joins for each level of all components at once: a new vertex belongs to the first
    of its neighbours on the level before, and is placed by (that one's position, degree from large to small, order of
    meeting). The component of the root comes first, then the others by their least vertices, from which they start."""
    spark = edges.sparkSession
    if not n:
        return spark.createDataFrame([], "v long, pos long")
    edges = by_source(edges)
    degree = storage.bucketed(degrees(edges, n), "v", "degrees")
    reached = 0
    if not root:
        root, reached = peripheral_of(edges, 1)
    if reached == n:  # one component, whose places follow each other
        found = searched(edges, storage.written(spark.createDataFrame([(root, 0)], "v long, bfs long"), "start"), degree, n)
        return found.select("v", F.when(F.col("bfs") == 0, F.lit(0).cast("long")).otherwise(F.col("bfs") - n + 1).alias("pos"))
    at = components_within(edges, spark.range(1, n + 1).select(F.col("id").alias("v"), F.lit(0).cast("long").alias("piece"), (F.col("id") - 1).alias("pos")))
    home = at.where(F.col("v") == root).first()["comp"]
    starts = at.where(F.col("pos") == F.when(F.col("comp") == home, root - 1).otherwise(F.col("comp")))
    found = searched(edges, starts.select("v", F.col("comp").alias("bfs")), degree, n).select("v", "bfs")
    order = found.join(at.select("v", "comp"), "v").select("v", (F.col("comp") != home).cast("int").alias("_later"), "comp", "bfs")
    return en.ranked(order, [F.col("_later"), F.col("comp"), F.col("bfs")], "pos").select("v", "pos")


@storage.without_broadcasts
def order_of(edges: DataFrame, n: int, root: int | None, local_edges: int = LOCAL_EDGES) -> DataFrame:
    edges = edges if "_stored" in vars(edges) else storage.written(edges, "edges")
    if edges.count() > 2 * local_edges or n > local_edges:
        return frontier_order(edges, n, root)
    found = Local(edges, n).order(root)
    return edges.sparkSession.createDataFrame([(v, k) for k, v in enumerate(found)], "v long, pos long")


@storage.without_broadcasts
def rcm(entries: DataFrame, nrows: int, ncols: int, start: int | None = None, local_edges: int = LOCAL_EDGES) -> tuple[DataFrame, DataFrame]:
    """Row and column permutations (src, dst) of the reverse Cuthill-McKee order; one and the same for square matrices."""
    square = nrows == ncols
    n = nrows if square else nrows + ncols
    order = order_of(stored(entries, nrows, ncols, local_edges), n, start, local_edges)
    perm = order.select(F.col("v").alias("src"), (F.lit(n) - F.col("pos")).alias("dst"))
    return (perm, perm) if square else separated(perm, nrows)


def separated(perm: DataFrame, nrows: int) -> tuple[DataFrame, DataFrame]:
    """A permutation of a bipartite graph's vertices as one of rows and one of columns, in the same order."""
    rows = en.ranked(perm.where(F.col("src") <= nrows), [F.col("dst")], "_k").select("src", (F.col("_k") + 1).alias("dst"))
    columns = en.ranked(perm.where(F.col("src") > nrows), [F.col("dst")], "_k").select((F.col("src") - nrows).alias("src"), (F.col("_k") + 1).alias("dst"))
    return rows, columns


@storage.without_broadcasts
def partition(entries: DataFrame, nrows: int, ncols: int, parts: int, local_edges: int = LOCAL_EDGES, edges: DataFrame | None = None, order: DataFrame | None = None) -> DataFrame:
    """(v, part): vertices in parts of equal size (one apart at most) with few edges between parts: runs of a
    breadth-first order, in which neighbours stand close, then exchanges of vertices between parts. It isn't the
    partition of any particular package. edges, order: what stored() and order_of() gave, if they are known."""
    if parts <= 0:
        raise PartitionError("there must be a part at least")
    n = nrows if nrows == ncols else nrows + ncols
    if parts == 1:
        return entries.sparkSession.range(1, n + 1).select(F.col("id").alias("v"), F.lit(0).alias("part"))
    edges = stored(entries, nrows, ncols, local_edges) if edges is None else edges
    order = order_of(edges, n, None, local_edges) if order is None else order
    return refined(edges, storage.written(order.select("v", F.floor(F.col("pos") * parts / n).cast("int").alias("part")), "parts"))


#: Rounds of exchanges after which a partition is taken as it is.
EXCHANGES = 8


@storage.without_broadcasts
def cut_of(edges: DataFrame, parted: DataFrame) -> int:
    ends = edges.where(F.col("src") < F.col("dst")).join(parted.toDF("src", "_a"), "src").join(parted.toDF("dst", "_b"), "dst")
    return ends.agg(F.count_if(F.col("_a") != F.col("_b"))).first()[0]


def ties(edges: DataFrame, parted: DataFrame) -> tuple[DataFrame, int]:
    """(v, _own, _to, _n): how many neighbours each vertex has in each part, and the edges between parts. An edge stands in
    both directions, so that the part of its src tells those of dst where they have a neighbour."""
    near = edges.join(parted.toDF("src", "_to").hint("shuffle_hash"), "src").groupBy(F.col("dst").alias("v"), "_to").agg(F.count(F.lit(1)).alias("_n"))
    near = storage.written(near.join(parted.toDF("v", "_own"), "v").select("v", "_own", "_to", "_n"), "ties")
    return near, near.agg(F.coalesce(F.sum(F.when(F.col("_own") != F.col("_to"), F.col("_n"))), F.lit(0))).first()[0] // 2


@storage.without_broadcasts
def refined(edges: DataFrame, parted: DataFrame, rounds: int = EXCHANGES) -> DataFrame:
    """(v, part) with the same sizes and no more edges between parts. In a round, each vertex names the other part that
    holds most of its neighbours and what moving there gains; between two parts those of one side and of the other are
    paired by falling gain, and pairs with a gain in all change sides. A hash lets about half of the vertices take part, as
    neighbours that move at once spoil each other's gain; a round that doesn't lower the cut is undone."""
    (near, best), failed = ties(edges, parted), 0
    few = (parted.agg(F.max("part")).first()[0] or 0) < 1_000  # then there are a million pairs of parts at most
    for k in range(rounds):
        of = near.where(F.pmod(F.xxhash64(F.lit(k), "v"), F.lit(2)) == 0)
        wish = of.groupBy("v", "_own").agg(F.sum(F.when(F.col("_to") == F.col("_own"), F.col("_n")).otherwise(0)).alias("_in"), F.max(F.when(F.col("_to") != F.col("_own"), F.struct("_n", (-F.col("_to")).alias("_t")))).alias("_m"))
        wish = wish.where(F.col("_m").isNotNull()).select("v", "_own", (-F.col("_m._t")).alias("_to"), (F.col("_m._n") - F.col("_in")).alias("_gain"))
        # numbered within each pair of parts and direction; ties by vertex
        wish = storage.written(en.ranked(wish, [F.col("_own"), F.col("_to"), -F.col("_gain"), F.col("v")], "_k"), "wish")
        first = wish.groupBy("_own", "_to").agg(F.min("_k").alias("_first"))
        wish = wish.join(F.broadcast(first) if few else first, ["_own", "_to"]).withColumn("_k", F.col("_k") - F.col("_first"))
        back = wish.select(F.col("_own").alias("_to"), F.col("_to").alias("_own"), "_k", F.col("_gain").alias("_other"))
        moves = wish.join(back, ["_own", "_to", "_k"]).where(F.col("_gain") + F.col("_other") > 0).select("v", "_to")
        ahead = storage.written(parted.join(moves, "v", "left").select("v", F.coalesce("_to", "part").alias("part")), "parts")
        then, cut = ties(edges, ahead)
        if cut < best:
            storage.drop(parted, near)
            parted, near, best, failed = ahead, then, cut, 0
            continue
        storage.drop(ahead, then)
        failed += 1
        if failed == 2:
            break
    storage.drop(near)
    return parted


def edge_cut(entries: DataFrame, nrows: int, ncols: int, parted: DataFrame) -> DataFrame:
    """One row: edges between parts."""
    edges = adjacency(entries, nrows, ncols).where(F.col("src") < F.col("dst"))
    ends = edges.join(parted.toDF("src", "_a"), "src").join(parted.toDF("dst", "_b"), "dst")
    return ends.agg(F.count_if(F.col("_a") != F.col("_b")).alias("edge_cut"))


def partition_entries(entries: DataFrame, nrows: int, ncols: int, parts: int) -> DataFrame:
    """entries with the part of their row."""
    return entries.join(partition(entries, nrows, ncols, parts).toDF("i", "part"), "i")


def partition_order(entries: DataFrame, nrows: int, ncols: int, parts: int) -> tuple[DataFrame, DataFrame]:
    """Rows grouped by part, in order within; columns likewise (as the rows where the matrix is square)."""
    found = partition(entries, nrows, ncols, parts).select((F.col("v") - 1).alias("idx"), "part")
    if nrows == ncols:
        perm = pe.by_parts(found)
        return perm, perm
    return separated(pe.by_parts(found), nrows)


def dissected(near: dict[int, list[int]], own: list[int], smallest: int) -> list[int]:
    """The order of a piece: its vertices as they stand, cut up until no part has more than smallest."""
    out: list[int] = []
    todo: list[tuple[bool, list[int]]] = [(False, own)]
    while todo:  # the last piece is done first, and the result is turned round
        final, own = todo.pop()
        if final or len(own) <= smallest:
            out += reversed(own)
            continue
        inside = set(own)
        first = [own[0]]
        level = {own[0]: 0}
        for v in first:
            for w in near.get(v, ()):
                if w in inside and w not in level:
                    level[w] = level[v] + 1
                    first.append(w)
        if len(first) < len(own):  # another component
            todo += [(False, [v for v in own if v not in level]), (False, first)]
            continue
        deepest = level[first[-1]]
        if deepest < 2:
            out += reversed(own)
            continue
        middle = min(max(1, level[first[len(first) // 2]]), deepest - 1)
        todo += [(False, [v for v in first if level[v] < middle]), (False, [v for v in first if level[v] > middle]), (True, [v for v in first if level[v] == middle])]
    return out[::-1]


def local_components():
    """Makes a function that gives (v, rep): the smallest vertex that each end of these edges is joined to by them."""

    def work(key, edges):
        ids, ends = np.unique(np.concatenate([edges[c].to_numpy() for c in ("src", "dst")]), return_inverse=True)
        src, dst = ends.reshape(2, -1)
        rep = np.arange(len(ids))
        while len(src):
            np.minimum.at(rep, np.maximum(rep[src], rep[dst]), np.minimum(rep[src], rep[dst]))
            while (rep[rep] != rep).any():
                rep = rep[rep]
            apart = rep[src] != rep[dst]
            src, dst = src[apart], dst[apart]
        return pa.table({"v": pa.array(ids, pa.int64()), "rep": pa.array(ids[rep], pa.int64())})

    return work


def components_within(inner: DataFrame, own: DataFrame) -> DataFrame:
    """own (v, piece, pos) with the least pos of a vertex's component within its piece as comp."""
    ends = inner.select("src", "dst", block_of("src").alias("_b")).where(F.col("_b") == block_of("dst"))
    joined = storage.written(ends.groupBy("_b").applyInArrow(local_components(), "v long, rep long"), "joined")
    of = storage.written(own.join(joined, "v", "left").select("v", "piece", "pos", F.coalesce("rep", "v").alias("rep")), "of")
    to = of.select("v", "rep")
    between = inner.select("src", "dst").where(block_of("src") != block_of("dst")).join(to.toDF("src", "_s"), "src").join(to.toDF("dst", "_d"), "dst")
    between = storage.written(between.select(F.col("_s").alias("src"), F.col("_d").alias("dst")).distinct(), "between")
    table = storage.written(of.groupBy(F.col("rep").alias("v")).agg(F.min("pos").alias("comp")), "components")
    at = table
    while True:
        least = between.join(at.select(F.col("v").alias("src"), "comp"), "src").groupBy(F.col("dst").alias("v")).agg(F.min("comp").alias("_c"))
        ahead = at.join(least, "v", "left").select("v", F.least("comp", "_c").alias("comp"), (F.col("_c") < F.col("comp")).alias("_moved"))
        before, table = table, storage.written(ahead, "components")
        storage.drop(before)
        at = table.drop("_moved")
        if table.where("_moved").isEmpty():
            out = storage.written(of.join(at.toDF("rep", "comp"), "rep").select("v", "piece", "pos", "comp"), "components")
            storage.drop(joined, of, between, table)
            return out


def levels_within(inner: DataFrame, at: DataFrame) -> DataFrame:
    """(v, level, bfs): the breadth-first order from the first vertex of each component, in the order of meeting; all
    components at once."""
    return searched(inner, at.where(F.col("pos") == F.col("comp")).select("v", F.col("pos").alias("bfs")), None, at.agg(F.max("pos")).first()[0] + 1)


def cut_pieces(inner: DataFrame, own: DataFrame, smallest: int) -> DataFrame:
    """One step of dissected for pieces (v, piece, pos) of more than smallest vertices; piece is the least pos in it, and
    the result (v, piece, pos, final) fills the same places."""
    at = components_within(inner, own)
    met = storage.written(at.join(levels_within(inner, at), "v"), "met")
    # the components of a piece are split off one by one, the first going last, until what is left is small
    comps = met.groupBy("piece", "comp").agg(F.count(F.lit(1)).alias("n"), F.max("level").alias("deepest"))
    line = storage.written(en.ranked(comps, [F.col("piece"), F.col("comp")], "_k"), "line")
    line = storage.written(en.prefix_sum(line, "_k", F.col("n"), "before"), "line")
    whole = line.groupBy("piece").agg(F.min("before").alias("_from"), F.sum("n").alias("_n"))
    line = line.join(whole, "piece").withColumn("left", F.col("_n") - (F.col("before") - F.col("_from"))).withColumn("tail", F.col("left") <= smallest)
    line = line.withColumn("cut", ~F.col("tail") & (F.col("n") > smallest) & (F.col("deepest") >= 2)).select("piece", "comp", "n", "deepest", "tail", "cut", (F.col("left") == F.col("n")).alias("alone"))
    line = storage.written(line, "line")
    counts = met.groupBy("comp", "level").agg(F.count(F.lit(1)).alias("_c")).withColumn("_upto", F.sum("_c").over(Window.partitionBy("comp").orderBy("level")))
    half = counts.join(line.where("cut").select("comp", "n", "deepest"), "comp").where(F.col("_upto") > F.floor(F.col("n") / 2)).groupBy("comp", "deepest").agg(F.min("level").alias("_l"))
    middle = half.select("comp", F.least(F.greatest(F.lit(1), F.col("_l")), F.col("deepest") - 1).alias("middle"))
    to = met.join(line, ["piece", "comp"]).join(middle, "comp", "left")
    part = F.when(~F.col("cut"), 0).when(F.col("level") < F.col("middle"), 0).when(F.col("level") > F.col("middle"), 1).otherwise(2)
    shallow = ~F.col("tail") & ~F.col("cut")
    to = to.select(
        "v", "piece", F.when(F.col("tail"), F.lit(-1 << 62)).otherwise(-F.col("comp")).alias("_c"), part.alias("_part"),
        F.when(F.col("tail") | F.col("alone") & shallow, F.col("pos")).otherwise(F.col("bfs")).alias("_o"),
        (F.col("tail") | shallow | (part == 2)).alias("final"),
    )
    to = storage.written(en.ranked(to, [F.col("piece"), F.col("_c"), F.col("_part"), F.col("_o")], "_k"), "cut")
    to = to.join(to.groupBy("piece").agg(F.min("_k").alias("_from")), "piece").withColumn("pos", F.col("piece") + F.col("_k") - F.col("_from"))
    to = storage.written(to.select("v", "piece", "_c", "_part", "pos", "final"), "cut")
    starts = to.groupBy("piece", "_c", "_part").agg(F.min("pos").alias("_start"))
    return storage.written(to.join(starts, ["piece", "_c", "_part"]).select("v", F.col("_start").alias("piece"), "pos", "final"), "pieces")


def frontier_dissection(edges: DataFrame, n: int, smallest: int, local_edges: int) -> DataFrame:
    """(src, dst) by the same rules: all pieces too large for the driver are cut at once, a few joins for each level of
    their level structures; the others are dissected on the driver, as many at once as fit."""
    spark = edges.sparkSession
    done = spark.createDataFrame([], "v long, pos long")
    own = spark.range(1, n + 1).select(F.col("id").alias("v"), F.lit(0).cast("long").alias("piece"), (F.col("id") - 1).alias("pos"))
    inner = by_source(edges).select("src", "dst", "rank", F.lit(0).cast("long").alias("piece"))
    cut = None
    while True:
        if cut is not None:
            inside = inner.select("src", "dst", "rank").join(own.select(F.col("v").alias("dst"), F.col("piece").alias("_other")), "dst").join(own.select(F.col("v").alias("src"), "piece"), "src")
            inner = storage.bucketed(inside.where(F.col("piece") == F.col("_other")).drop("_other"), "src", "inner", dealt=True)
        sizes = own.groupBy("piece").agg(F.count(F.lit(1)).alias("n")).join(inner.groupBy("piece").agg(F.count(F.lit(1)).alias("m")), "piece", "left")
        sizes = storage.written(sizes.select("piece", "n", F.coalesce("m", F.lit(0).cast("long")).alias("m")), "sizes")
        large = (F.col("n") > smallest) & ((F.col("m") > 2 * local_edges) | (F.col("n") > local_edges))
        small = sizes.where((F.col("n") <= smallest)).select("piece")
        done = storage.written(done.unionByName(own.join(small, "piece", "left_semi").select("v", "pos")), "done")
        lots = en.ranked(sizes.where(~large & (F.col("n") > smallest)), [F.col("piece")], "_k")
        lots = en.prefix_sum(storage.written(lots, "lots"), "_k", F.col("n") + F.col("m"), "before")
        lots = storage.written(lots.select("piece", F.floor(F.col("before") / max(1, local_edges)).alias("lot")), "lots")
        for r in lots.select("lot").distinct().orderBy("lot").toLocalIterator():
            done = storage.written(done.unionByName(on_driver(inner, own, lots.where(F.col("lot") == r["lot"]).select("piece"), smallest)), "done")
        big = sizes.where(large).select("piece")
        if big.isEmpty():
            return done.select(F.col("v").alias("src"), (F.col("pos") + 1).alias("dst"))
        if not sizes.where(~large).isEmpty():
            inner = storage.bucketed(inner.join(big, "piece", "left_semi"), "src", "inner")
        cut = cut_pieces(inner, storage.written(own.join(big, "piece", "left_semi").select("v", "piece", "pos"), "own"), smallest)
        done = storage.written(done.unionByName(cut.where("final").select("v", "pos")), "done")
        own = cut.where(~F.col("final")).drop("final")


def on_driver(inner: DataFrame, own: DataFrame, pieces: DataFrame, smallest: int) -> DataFrame:
    """(v, pos) of some pieces that fit together."""
    near: dict[int, list[int]] = {}
    for r in inner.join(pieces, "piece", "left_semi").orderBy("src", "rank").select("src", "dst").collect():
        near.setdefault(r["src"], []).append(r["dst"])
    held: dict[int, list[int]] = {}
    for r in own.join(pieces, "piece", "left_semi").orderBy("pos").collect():
        held.setdefault(r["piece"], []).append(r["v"])
    return inner.sparkSession.createDataFrame([(v, piece + k) for piece, vs in held.items() for k, v in enumerate(dissected(near, vs, smallest))], "v long, pos long")


@storage.without_broadcasts
def dissection(entries: DataFrame, nrows: int, ncols: int, smallest: int = 8, local_edges: int = LOCAL_EDGES) -> tuple[DataFrame, DataFrame]:
    """Nested dissection: a middle level of a breadth-first level structure separates the rest in two, which come first,
    each dissected in turn; the separator comes last. Graphs beyond local_edges are cut in Spark by the same rules until
    the pieces fit on the driver."""
    square = nrows == ncols
    n = nrows if square else nrows + ncols
    edges = stored(entries, nrows, ncols, local_edges)
    if edges.count() > 2 * local_edges or n > local_edges:
        perm = frontier_dissection(edges, n, smallest, local_edges)
    else:
        found = dissected(Local(edges, n).near, list(range(1, n + 1)), smallest)
        perm = entries.sparkSession.createDataFrame([(v, k + 1) for k, v in enumerate(found)], "src long, dst long")
    return (perm, perm) if square else separated(perm, nrows)


def reorder(entries: DataFrame, nrows: int, ncols: int, ordering: Ordering | str, rows: DataFrame | None = None, columns: DataFrame | None = None, start: int | None = None, parts: int = 1) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """The permuted entries with the row and column permutations (None where nothing moves)."""
    ordering = Ordering(ordering)
    if ordering is Ordering.DEFAULT:
        return entries, None, None
    if ordering is Ordering.RCM:
        rows, columns = rcm(entries, nrows, ncols, start)
    elif ordering is Ordering.ND:
        rows, columns = dissection(entries, nrows, ncols)
    elif ordering in (Ordering.METIS, Ordering.SCOTCH):
        rows, columns = partition_order(entries, nrows, ncols, parts)
    return pe.scatter(entries, rows, columns), rows, columns


def bandwidth(entries: DataFrame) -> DataFrame:
    return entries.agg(F.coalesce(F.max(F.abs(F.col("i") - F.col("j"))), F.lit(0)).alias("bandwidth"))
