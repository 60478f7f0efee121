"""Partitions and separators of large graphs by way of ever coarser ones.

A level is a weighted graph: vertices (v, piece, w) and edges (src, dst, w, a, b), each in both directions, with the weights
a and b of its ends. Pieces are graphs of their own without edges between them, which are all cut at once. Vertices are
matched along heavy edges and contracted until few are left; these are cut, and the cut is carried back level by level and
improved at each. Levels of more than DRIVER_EDGES are joins and sums in Spark; the first one within it reaches the driver,
whatever the size of the finest, which contracts it further, to some COARSEST vertices a part, as jobs of so few rows would
take longer to start than to run. Else a number or two a round reach it. Where contraction ends beyond DRIVER_EDGES as there
are many parts or pieces, that graph is cut in Spark as well, by runs of a breadth-first order."""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import storage
from ..errors import PartitionError
from . import entries as en
from . import graphs

#: Vertices a part at which contraction ends, and the share by which a level must be smaller than the one before.
COARSEST, SHRINK = 200, 0.9
#: Edges of a graph that is cut on the driver, and starts that are tried there.
DRIVER_EDGES, STARTS = 1_000_000, 6
#: Rounds of proposals a level, of moves, and of exchanges at the end; passes over a level on the driver that isn't the coarsest.
PROPOSALS, MOVES, EXCHANGES, PASSES = 2, 4, 3, 3
#: Squares of degrees in all up to which vertices of a level on the driver are moved one by one.
WORK = 5_000_000
#: Classes into which the moves of one gain to one part are divided, of which whole ones are made.
CLASSES = 64
#: How much heavier than the mean a part may be.
BALANCE = 1.03

EDGE = ["src", "dst", "w", "a", "b"]


@dataclass
class Level:
    vertices: DataFrame
    edges: DataFrame
    n: int
    #: (v, to) from the level below, None for the finest
    up: DataFrame | None = None

    def drop(self) -> None:
        storage.drop(self.vertices, self.edges, self.up)


def matched(level: Level, limit: int, seed: int) -> DataFrame:
    """(v, to): vertices in pairs, to being the smaller number of both; who finds no mate stays alone.

    In a round, each free vertex names its free neighbour of the heaviest edge (equal ones by a hash of the edge, the same
    from both ends, so that choices are often mutual); who name each other are a pair. Those left over are paired with one
    that has the same heaviest neighbour, which also serves the many neighbours of a hub; vertices without edges likewise.
    No pair is heavier than limit."""
    light = level.edges.where(F.col("a") + F.col("b") <= limit)
    taken: list[DataFrame] = []
    for k in range(PROPOSALS):
        key = F.struct("w", F.xxhash64(F.lit(seed + k), F.least("src", "dst"), F.greatest("src", "dst")).alias("h"), "dst")
        best = light.groupBy("src").agg(F.max(key).alias("_m")).select("src", F.col("_m.dst").alias("dst"))
        best = storage.written(best, "choice")
        pairs = best.join(best.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"])
        taken.append(storage.written(pairs.select(F.col("src").alias("v"), F.least("src", "dst").alias("to")), "pairs"))
        storage.drop(best)
        if k + 1 < PROPOSALS:
            gone = taken[-1].select("v")
            ahead = storage.written(light.join(gone.toDF("src"), "src", "left_anti").join(gone.toDF("dst"), "dst", "left_anti").select(EDGE), "light")
            if light is not level.edges:
                storage.drop(light)
            light = ahead
    storage.drop(light)
    pairs = graphs.united(taken)
    hubs = level.edges.groupBy(F.col("src").alias("v")).agg(F.max(F.struct("w", "dst")).alias("_m")).select("v", F.col("_m.dst").alias("hub"))
    alone = level.vertices.join(pairs, "v", "left_anti").join(hubs, "v", "left").select("v", "piece", "w", F.coalesce("hub", F.lit(-1)).alias("hub"))
    placed = storage.written(en.ranked(alone, [F.col("piece"), F.col("hub"), F.col("v")], "_k"), "alone")
    placed = placed.join(placed.groupBy("piece", "hub").agg(F.min("_k").alias("_first")), ["piece", "hub"])
    # two neighbours in the list of a hub: an even place and the next
    pair = placed.withColumn("_pair", F.floor((F.col("_k") - F.col("_first")) / 2)).groupBy("piece", "hub", "_pair").agg(F.min("v").alias("x"), F.max("v").alias("y"), F.sum("w").alias("w"))
    both = F.when((F.col("w") <= limit) & (F.col("x") != F.col("y")), F.array(F.struct(F.col("x").alias("v"), F.col("x").alias("to")), F.struct(F.col("y").alias("v"), F.col("x").alias("to"))))
    each = F.when(F.col("x") == F.col("y"), F.array(F.struct(F.col("x").alias("v"), F.col("x").alias("to")))).otherwise(F.array(F.struct(F.col("x").alias("v"), F.col("x").alias("to")), F.struct(F.col("y").alias("v"), F.col("y").alias("to"))))
    rest = pair.select(F.explode(F.coalesce(both, each)).alias("e")).select("e.*")
    out = storage.written(pairs.unionByName(rest), "match")
    storage.drop(placed, *taken)
    return out


def contracted(level: Level, limit: int, seed: int) -> Level:
    """The graph of the pairs: weights of vertices and of parallel edges add up, edges within a pair go."""
    up = matched(level, limit, seed)
    both = level.vertices.join(up, "v").groupBy(F.col("to").alias("v")).agg(F.min("piece").alias("piece"), F.sum("w").alias("w"))
    vertices = storage.written(both, "vertices")
    to = storage.written(up.join(vertices.select(F.col("v").alias("to"), "w"), "to").select("v", "to", "w"), "to")
    ends = level.edges.select("src", "dst", "w").join(to.toDF("src", "_s", "a"), "src").join(to.toDF("dst", "_d", "b"), "dst").where(F.col("_s") != F.col("_d"))
    edges = ends.groupBy(F.col("_s").alias("src"), F.col("_d").alias("dst"), "a", "b").agg(F.sum("w").alias("w")).select(EDGE)
    out = Level(vertices, storage.bucketed(edges, "src", "edges"), vertices.count(), up)
    storage.drop(to)
    return out


Near = dict[int, dict[int, int]]


def grown(near: Near, weight: dict[int, int], own: list[int], parts: int, start: int) -> dict[int, int]:
    """Parts that grow one after the other: the next vertex is the one most tied to the part so far."""
    out: dict[int, int] = {}
    left, rest = dict.fromkeys(own), sum(weight[v] for v in own)
    for p in range(parts - 1):
        target, load = rest / (parts - p), 0
        tie: dict[int, int] = {}
        heap = [(0, start)]
        while left and load < target:
            while heap and (heap[0][1] not in left or -heap[0][0] < tie.get(heap[0][1], 0)):
                heapq.heappop(heap)
            v = heapq.heappop(heap)[1] if heap else next(iter(left))
            if load and load + weight[v] - target > target - load:
                break
            del left[v]
            out[v] = p
            load += weight[v]
            for w, n in near.get(v, {}).items():
                if w in left:
                    tie[w] = tie.get(w, 0) + n
                    heapq.heappush(heap, (-tie[w], w))
        rest -= load
        start = next((v for _, v in sorted(heap) if v in left), next(iter(left), start))
    return out | dict.fromkeys(left, parts - 1)


def climbed(near: Near, weight: dict[int, int], part: dict[int, int], parts: int, cap: int, passes: int | None = None) -> int:
    """Moves vertices one by one, each once a pass, the largest gain first even where it is a loss, and goes back to the
    best state; until a pass gains nothing (or for so many passes). Changes part, returns the cut."""
    load = [0] * parts
    for v, p in part.items():
        load[p] += weight[v]

    def wishes(v: int) -> list[tuple[int, int, int]]:
        ties: dict[int, int] = {}
        for w, n in near.get(v, {}).items():
            ties[part[w]] = ties.get(part[w], 0) + n
        inside = ties.pop(part[v], 0)
        return [(inside - n, v, p) for p, n in ties.items()]

    while True:
        heap = [x for v in part for x in wishes(v)]
        heapq.heapify(heap)
        moves, total, best, length, done = [], 0, 0, 0, set()
        while heap and len(moves) - length < 200:
            loss, v, to = heapq.heappop(heap)
            if v in done or (loss, v, to) not in wishes(v) or load[to] + weight[v] > max(cap, load[part[v]]):
                continue
            moves.append((v, part[v]))
            load[part[v]] -= weight[v]
            load[to] += weight[v]
            part[v] = to
            done.add(v)
            total -= loss
            if total > best and load[to] <= cap:
                best, length = total, len(moves)
            for w in near.get(v, ()):
                if w not in done:
                    for x in wishes(w):
                        heapq.heappush(heap, x)
        for v, back in reversed(moves[length:]):
            load[part[v]] -= weight[v]
            load[back] += weight[v]
            part[v] = back
        passes = passes and passes - 1
        if not best or passes == 0:
            return sum(n for v, ws in near.items() for w, n in ws.items() if part[v] != part[w]) // 2


@dataclass
class Small:
    """A level on the driver: vertices are 0 to len(weight) - 1."""

    src: np.ndarray
    dst: np.ndarray
    w: np.ndarray
    weight: np.ndarray

    def near(self) -> Near:
        out: Near = {}
        for s, d, w in zip(self.src.tolist(), self.dst.tolist(), self.w.tolist()):
            out.setdefault(s, {})[d] = w
        return out

    def cut(self, part: np.ndarray) -> int:
        return int(self.w[part[self.src] != part[self.dst]].sum()) // 2

    def cap(self, parts: int, balance: float) -> int:
        total = int(self.weight.sum())
        return max(-(-total // parts), int(total * balance / parts)) + int(self.weight.max()) // 2


def folded(level: Small, limit: int, seed: int, part: np.ndarray) -> tuple[Small, np.ndarray]:
    """The graph of pairs, found by the same rules as in matched() within each part, and the pair of each vertex."""
    n = len(level.weight)
    to, free = np.arange(n), np.ones(n, bool)
    key = np.random.default_rng(seed).permutation(n)
    tie = np.minimum(key[level.src], key[level.dst]) * n + np.maximum(key[level.src], key[level.dst])
    order = np.lexsort((tie, level.w, level.src))  # the last edge of a vertex is its heaviest
    order = order[part[level.src[order]] == part[level.dst[order]]]
    src, dst = level.src[order], level.dst[order]
    hub = np.full(n, -1)
    hub[src] = dst  # of repeated places the last one stays
    keep = level.weight[src] + level.weight[dst] <= limit
    for _ in range(PROPOSALS):
        src, dst = src[keep], dst[keep]
        choice = np.full(n, -1)
        choice[src] = dst
        v = np.flatnonzero(choice >= 0)
        v = v[choice[choice[v]] == v]
        to[v] = np.minimum(v, choice[v])
        free[v] = False
        keep = free[src] & free[dst]
    alone = np.flatnonzero(free)
    alone = alone[np.lexsort((hub[alone], part[alone]))]
    first = np.r_[True, (hub[alone][1:] != hub[alone][:-1]) | (part[alone][1:] != part[alone][:-1])][: len(alone)]
    place = np.arange(len(alone))
    place = place - np.maximum.accumulate(np.where(first, place, 0))
    second = np.flatnonzero(place % 2 == 1)
    second = second[level.weight[alone[second]] + level.weight[alone[second - 1]] <= limit]
    to[alone[second]] = alone[second - 1]
    names, up = np.unique(to, return_inverse=True)
    m = len(names)
    weight = np.zeros(m, np.int64)
    np.add.at(weight, up, level.weight)
    inside = up[level.src] != up[level.dst]
    pairs, at = np.unique(up[level.src[inside]] * m + up[level.dst[inside]], return_inverse=True)
    w = np.zeros(len(pairs), np.int64)
    np.add.at(w, at, level.w[inside])
    return Small(pairs // m, pairs % m, w, weight), up


def shifted(level: Small, part: np.ndarray, parts: int, cap: int) -> np.ndarray:
    """improved() on the driver, for levels with too many edges to move vertices one by one."""
    best, failed = level.cut(part), 0
    for k in range(2 * MOVES):
        room = cap - np.bincount(part, level.weight, parts)
        tied, at = np.unique(level.src * parts + part[level.dst], return_inverse=True)
        n = np.bincount(at, level.w, len(tied))
        v, to = tied // parts, tied % parts
        inside = np.zeros(len(part))
        inside[v[to == part[v]]] = n[to == part[v]]
        gain, weight = n - inside[v], level.weight[v]
        able = (to > part[v] if k % 2 == 0 else to < part[v]) & ((gain > 0) | (gain == 0) & (room[to] - weight > room[part[v]]))
        v, to, gain = v[able], to[able], gain[able]
        order = np.lexsort((gain, v))
        order = order[np.r_[v[order][1:] != v[order][:-1], True][: len(order)]]  # the largest gain of each
        order = order[np.lexsort((v[order], -gain[order], to[order]))]
        v, to = v[order], to[order]
        upto = np.cumsum(level.weight[v])
        first = np.flatnonzero(np.r_[True, to[1:] != to[:-1]][: len(to)])
        start = np.repeat(upto[first] - level.weight[v[first]], np.diff(np.r_[first, len(to)]))
        going = upto - start <= room[to]
        ahead = part.copy()
        ahead[v[going]] = to[going]
        now = level.cut(ahead)
        if now < best:
            part, best, failed = ahead, now, 0
        else:
            failed += 1
            if failed == 2:
                break
    return part


def cycle(level: Small, parts: int, balance: float, few: int, seed: int, part: np.ndarray | None = None) -> np.ndarray:
    """The part of each vertex of one piece: contracted until few are left, cut there by the best of a few starts, and
    improved at each level on the way back. A given part is kept on the way down instead, and its cut gets no heavier."""
    limit = max(2, int(level.weight.max()), ceil(1.5 * int(level.weight.sum()) / few))
    stack, ups, held = [level], [], np.zeros(len(level.weight), np.int64) if part is None else part
    while len(stack[-1].weight) > few:
        ahead, up = folded(stack[-1], limit, seed + len(stack), held)
        if len(ahead.weight) > SHRINK * len(stack[-1].weight):
            break
        stack.append(ahead)
        ups.append(up)
        below, held = held, np.zeros(len(ahead.weight), np.int64)
        held[up] = below

    def improved_at(small: Small, found: np.ndarray) -> np.ndarray:
        if int((np.bincount(small.src, minlength=1) ** 2).sum()) > WORK:
            return shifted(small, found, parts, small.cap(parts, balance))
        at = dict(enumerate(found.tolist()))
        climbed(small.near(), dict(enumerate(small.weight.tolist())), at, parts, small.cap(parts, balance), passes)
        return np.array([at[v] for v in range(len(found))], np.int64)

    last = stack[-1]
    own = list(range(len(last.weight)))
    passes = None if len(level.src) < DRIVER_EDGES else PASSES
    tries = [held]
    if part is None:
        near, weight = last.near(), dict(enumerate(last.weight.tolist()))
        every = [grown(near, weight, own, parts, own[k * len(own) // STARTS]) for k in range(STARTS)]
        tries = [np.array([at[v] for v in own], np.int64) for at in every]
    found = min((improved_at(last, at) for at in tries), key=last.cut)
    for finer, up in zip(stack[-2::-1], ups[::-1]):
        found = improved_at(finer, found[up])
    return found


def small_cut(level: Small, parts: int, balance: float, few: int) -> np.ndarray:
    """The part of each vertex of one piece: the best of some cycles, more of them the fewer edges there are, and what
    further cycles within its parts make of it."""
    tries = min(STARTS, 1 + 3 * DRIVER_EDGES // max(1, 2 * len(level.src)))
    best = min((cycle(level, parts, balance, few, 100 * k) for k in range(tries)), key=level.cut)
    for k in range(tries):
        best = min(best, cycle(level, parts, balance, few, 100 * k + 50, best), key=level.cut)
    return best


def driver_cut(level: Level, parts: int, balance: float, coarsest: int = COARSEST) -> DataFrame:
    """(v, part) of a graph of DRIVER_EDGES at most, piece by piece."""
    vertices = level.vertices.select("piece", "v", "w").orderBy("piece", "v").toArrow()
    edges = level.edges.select("src", "dst", "w").orderBy("src", "dst").toArrow()
    piece, v, weight = (np.asarray(vertices[c].to_numpy(), np.int64) for c in ("piece", "v", "w"))
    by_name = np.argsort(v, kind="stable")
    src, dst = (by_name[np.searchsorted(v[by_name], edges[c].to_numpy())] for c in ("src", "dst"))
    w = np.asarray(edges["w"].to_numpy(), np.int64)
    order = np.argsort(src, kind="stable")
    src, dst, w = src[order], dst[order], w[order]
    starts = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])
    part = np.zeros(len(v), np.int64)
    for low, high in zip(starts, [*starts[1:], len(v)]):
        a, b = np.searchsorted(src, [low, high])
        part[low:high] = piece[low] * parts + small_cut(Small(src[a:b] - low, dst[a:b] - low, w[a:b], weight[low:high]), parts, balance, coarsest * parts)
    found = pa.table({"v": v, "part": part})
    return storage.written(level.vertices.sparkSession.createDataFrame(found), "parts")


def spread_cut(level: Level, parts: int) -> DataFrame:
    """(v, part) of a coarsest graph of any size: each piece is cut into runs of equal weight of a breadth-first order that takes
    heavy edges first. The parts of piece p are numbered from p * parts."""
    numbered = storage.written(en.ranked(level.vertices, [F.col("piece"), F.col("v")], "_k").withColumn("_n", F.col("_k") + 1), "numbered")
    number = numbered.select("v", "_n")
    edges = level.edges.join(number.toDF("src", "_s"), "src").join(number.toDF("dst", "_d"), "dst").select(F.col("_s").alias("src"), F.col("_d").alias("dst"), F.struct((-F.col("w")).alias("w"), F.col("_d").alias("k")).alias("rank"))
    order = graphs.order_of(edges, level.n, None).toDF("_n", "pos")
    line = storage.written(en.ranked(numbered.join(order, "_n").select("v", "piece", "w", "pos"), [F.col("piece"), F.col("pos")], "_k"), "line")
    line = storage.written(en.prefix_sum(line, "_k", F.col("w"), "_upto"), "line")
    whole = line.groupBy("piece").agg(F.min("_upto").alias("_from"), F.sum("w").alias("_all"))
    middle = F.col("_upto") - F.col("_from") + F.col("w") / 2
    out = line.join(whole, "piece").select("v", (F.col("piece") * parts + F.least(F.floor(middle * parts / F.col("_all")), F.lit(parts - 1))).cast("long").alias("part"))
    return storage.written(out, "parts")


def loads(vertices: DataFrame, parted: DataFrame, parts: int, balance: float, slack: int = 0) -> DataFrame:
    """(part, piece, load, room): weights of all parts, empty ones too, and how much more they may take (slack: above the
    bound)."""
    held = vertices.join(parted, "v").groupBy("part").agg(F.sum("w").alias("load"))
    caps = vertices.groupBy("piece").agg(F.sum("w").alias("_all"))
    cap = F.greatest(F.ceil(F.col("_all") / parts), F.floor(F.col("_all") * balance / parts))
    every = caps.select("piece", cap.alias("cap"), F.explode(F.sequence(F.col("piece") * parts, F.col("piece") * parts + parts - 1)).alias("part"))
    return every.join(held, "part", "left").select("part", "piece", F.coalesce("load", F.lit(0)).alias("load"), (F.col("cap") + slack - F.coalesce("load", F.lit(0))).alias("room"))


def within(df: DataFrame, group: list[str], order: list, weight: str, name: str) -> DataFrame:
    """df with the weight before each row in the order of its group. All groups are one sorted line, so that a large one
    fills several tasks."""
    line = storage.written(en.ranked(df, [*map(F.col, group), *order], "_k"), "line")
    line = storage.written(en.prefix_sum(line, "_k", F.col(weight), "_upto"), "line")
    return line.join(line.groupBy(*group).agg(F.min("_upto").alias("_from")), group).withColumn(name, F.col("_upto") - F.col("_from")).drop("_k", "_upto", "_from")


def links(level: Level, parted: DataFrame) -> DataFrame:
    """(v, own, to, n): how much each vertex is tied to each part that it has neighbours in. Edges stand in both directions,
    so that the part of src tells dst, and buckets of src needn't be moved to be joined."""
    near = level.edges.join(parted.toDF("src", "to").hint("shuffle_hash"), "src").groupBy(F.col("dst").alias("v"), "to").agg(F.sum("w").alias("n"))
    return storage.written(near.join(parted.toDF("v", "own"), "v").select("v", "own", "to", "n"), "links")


def improved(level: Level, parted: DataFrame, parts: int, balance: float, slack: int = 0, rounds: int = MOVES) -> DataFrame:
    """(v, part) with a cut that is no heavier. In a round, vertices at a border go to the part that most of their edges
    lead to, if they gain by it, or gain nothing and leave a heavier part; up in one round, down in the next, so that
    neighbours don't change places; into each part, the largest gains first, as long as there is room. A round that doesn't
    lower the cut is undone, and after one such in either direction all is done."""
    best, kept, failed = None, parted, 0
    for k in range(rounds + 1):
        near = links(level, parted)
        cut = near.agg(F.coalesce(F.sum(F.when(F.col("own") != F.col("to"), F.col("n"))), F.lit(0))).first()[0]
        if best is None or cut < best:
            if kept is not parted:
                storage.drop(kept, held)
            best, kept, failed, held = cut, parted, 0, near
        else:
            storage.drop(parted, near)
            parted, near, failed = kept, held, failed + 1
        if failed == 2 or k == rounds or not cut:
            break
        load = storage.written(loads(level.vertices, parted, parts, balance, slack), "loads")
        up = F.col("to") > F.col("own") if k % 2 == 0 else F.col("to") < F.col("own")
        wish = near.groupBy("v", "own").agg(F.coalesce(F.sum(F.when(F.col("to") == F.col("own"), F.col("n"))), F.lit(0)).alias("_in"), F.max(F.when(up, F.struct("n", "to"))).alias("_m"))
        wish = wish.where(F.col("_m").isNotNull()).select("v", "own", F.col("_m.to").alias("to"), (F.col("_m.n") - F.col("_in")).alias("gain")).where(F.col("gain") >= 0)
        size = load.select(F.col("part").alias("own"), F.col("load").alias("_from_load"))
        wish = wish.join(level.vertices.select("v", "w"), "v").join(size, "own").join(load.select(F.col("part").alias("to"), F.col("load").alias("_to_load"), "room"), "to")
        wish = wish.where((F.col("w") <= F.col("room")) & ((F.col("gain") > 0) | (F.col("_from_load") > F.col("_to_load") + F.col("w"))))
        # a row for each part, gain and one of CLASSES hashes: as many of them as fit, from the largest gain on
        wish = wish.select("v", "w", "to", "room", "gain", F.pmod(F.xxhash64(F.lit(k), "v"), F.lit(CLASSES)).alias("class"))
        classes = wish.groupBy("to", "room", "gain", "class").agg(F.sum("w").alias("_w"))
        upto = F.sum("_w").over(Window.partitionBy("to").orderBy(F.desc("gain"), "class"))
        fit = classes.withColumn("_upto", upto).where(F.col("_upto") <= F.col("room")).select("to", "gain", "class")
        moves = wish.join(fit, ["to", "gain", "class"]).select("v", "to")
        parted = storage.written(parted.join(moves, "v", "left").select("v", F.coalesce("to", "part").alias("part")), "parts")
        storage.drop(load)
    storage.drop(held)
    return kept


def balanced(level: Level, parted: DataFrame, parts: int, balance: float) -> DataFrame:
    """(v, part) of unit weights with no part above its bound: what is too much of a part, those least tied to it, fills
    the room of the others of its piece."""
    load = storage.written(loads(level.vertices, parted, parts, balance), "loads")
    over = load.where(F.col("room") < 0).select("part", (-F.col("room")).alias("_excess"))
    if over.isEmpty():
        return parted
    near = links(level, parted)
    tied = near.groupBy("v").agg(F.sum(F.when(F.col("own") == F.col("to"), F.col("n")).otherwise(-F.col("n"))).alias("_tie"))
    held = parted.join(over, "part").join(level.vertices, "v").join(tied, "v", "left").select("v", "part", "piece", "w", "_excess", F.coalesce("_tie", F.lit(0)).alias("_tie"))
    going = within(held, ["part"], [F.col("_tie"), F.col("v")], "w", "_ahead").where(F.col("_ahead") < F.col("_excess")).select("v", "piece", "w")
    going = within(going, ["piece"], [F.col("v")], "w", "_at")
    rooms = load.where(F.col("room") > 0).withColumn("_low", F.sum("room").over(Window.partitionBy("piece").orderBy("part")) - F.col("room"))  # a row a part
    to = going.join(rooms.select("piece", F.col("part").alias("to"), "_low", "room"), "piece").where((F.col("_at") >= F.col("_low")) & (F.col("_at") < F.col("_low") + F.col("room"))).select("v", "to")
    out = storage.written(parted.join(to, "v", "left").select("v", F.coalesce("to", "part").alias("part")), "parts")
    storage.drop(near, load)
    return out


def small(level: Level) -> bool:
    return level.n <= DRIVER_EDGES and level.edges.count() <= 2 * DRIVER_EDGES


@storage.without_broadcasts
def cut_up(vertices: DataFrame, edges: DataFrame, parts: int, balance: float = BALANCE, coarsest: int = COARSEST) -> DataFrame:
    """(v, part): each piece of vertices (v, piece) in parts of equal size, the heaviest at most balance times the mean
    (rounded up), with few edges (src, dst), given in both directions, between them. The parts of piece p are numbered from
    p * parts."""
    unit = F.lit(1).cast("long")
    every = edges.select("src", "dst", unit.alias("w"), unit.alias("a"), unit.alias("b"))
    stored = "_table" in vars(edges)
    finest = Level(storage.written(vertices.select("v", "piece", unit.alias("w")), "vertices"), every if stored else storage.written(every, "edges"), 0)
    finest.n = finest.vertices.count()
    if not stored and not small(finest):
        table, finest.edges = finest.edges, storage.bucketed(finest.edges, "src", "edges")
        storage.drop(table)
    few = coarsest * parts * max(1, finest.vertices.select("piece").distinct().count())
    limit = max(2, ceil(1.5 * finest.n / few))
    stack = [finest]
    while not (fits := small(stack[-1])) and stack[-1].n > few:
        ahead = contracted(stack[-1], limit, len(stack))
        stack.append(ahead)
        if ahead.n > SHRINK * stack[-2].n:
            fits = small(ahead)
            break
    last = stack[-1]
    parted = driver_cut(last, parts, balance, coarsest) if fits else spread_cut(last, parts)
    while True:
        level = stack.pop()
        # coarse vertices need room to move: a part may be too heavy by one of them until they are taken apart
        slack = level.vertices.agg(F.max("w")).first()[0] if stack else 0
        parted = improved(level, parted, parts, balance, slack)
        if not stack:
            break
        down = storage.written(level.up.join(parted.withColumnRenamed("v", "to"), "to").select("v", "part"), "parts")
        storage.drop(parted)
        level.drop()
        parted = down
    even = balanced(level, parted, parts, balance)
    if even is not parted:
        parted = improved(level, even, parts, balance)
    parted = graphs.refined(level.edges, parted, EXCHANGES)  # where parts are full, vertices can still change places
    level.drop()
    return parted


def partition(entries: DataFrame, nrows: int, ncols: int, parts: int, balance: float = BALANCE, edges: DataFrame | None = None) -> DataFrame:
    """(v, part): the vertices of the graph of a matrix in parts of equal size with few edges between them. edges: what
    graphs.stored() gave, if it is known."""
    if parts <= 0:
        raise PartitionError("there must be a part at least")
    n = nrows if nrows == ncols else nrows + ncols
    vertices = entries.sparkSession.range(1, n + 1).select(F.col("id").alias("v"), F.lit(0).cast("long").alias("piece"))
    if not n:
        return vertices.select("v", F.lit(0).alias("part"))
    edges = graphs.stored(entries, nrows, ncols) if edges is None else edges
    return cut_up(vertices, edges, parts, balance).select("v", F.col("part").cast("int").alias("part"))


# ---------------------------------------------------------------- separators


def greedy_pairs(border: DataFrame) -> DataFrame:
    """(x, y): a matching of border (x, y) that no edge can be added to. In rounds, each x names the y of the smallest hash
    and each y takes one of them."""
    pairs: list[DataFrame] = []
    while True:
        wish = border.groupBy("x").agg(F.min(F.struct(F.xxhash64("x", "y").alias("h"), "y")).alias("_m")).select("x", F.col("_m.y").alias("y"))
        new = storage.written(wish.groupBy("y").agg(F.min("x").alias("x")).select("x", "y"), "pairs")
        if new.isEmpty():
            return graphs.united([*pairs, new])
        pairs.append(new)
        border = storage.written(border.join(new.select("x"), "x", "left_anti").join(new.select("y"), "y", "left_anti"), "border")


def alternating(border: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The trees of alternating paths from all unpaired x: reached x (x, root), reached y (y, x, root, depth) with the x
    before, and the ends (y, root) of augmenting paths, one a tree, or None. A y belongs to the first tree that reaches it
    (of the smallest root in a round), so that trees, and paths of different trees, have no vertex in common."""
    xs = [storage.written(border.select("x").distinct().join(pairs.select("x"), "x", "left_anti").select("x", F.col("x").alias("root")), "xs")]
    ys: list[DataFrame] = []
    seen = None
    depth = 0
    ends: list[DataFrame] = []
    while True:
        ahead = xs[-1].join(border, "x")
        if seen is not None:
            ahead = ahead.join(seen, "y", "left_anti")
        new = storage.written(ahead.groupBy("y").agg(F.min(F.struct("root", "x")).alias("_m")).select("y", F.col("_m.x").alias("x"), F.col("_m.root").alias("root"), F.lit(depth).alias("depth")), "ys")
        ys.append(new)
        if new.isEmpty():
            break
        seen = graphs.united(ys).select("y")
        free = storage.written(new.join(pairs.select("y"), "y", "left_anti").groupBy("root").agg(F.min("y").alias("y")), "ends")
        if not free.isEmpty():
            ends.append(free)
            break
        xs.append(storage.written(new.select("y", "root").join(pairs, "y").select("x", "root"), "xs"))
        depth += 1
    return graphs.united(xs), graphs.united(ys), ends[0] if ends else None


def maximum_pairs(border: DataFrame) -> DataFrame:
    """A maximum matching: a greedy one, enlarged along shortest augmenting paths, those of all trees at once, until there
    are none."""
    pairs = greedy_pairs(border)
    while True:
        _, ys, ends = alternating(border, pairs)
        if ends is None:
            return pairs
        at, added, taken = ends.select("y"), [], []
        while True:  # back from the ends, each path by one x and one y
            step = storage.written(at.join(ys, "y").select("x", "y"), "path")
            if step.isEmpty():
                break
            added.append(step)
            before = storage.written(step.select("x").join(pairs, "x").select("x", "y"), "path")
            taken.append(before)
            at = before.select("y")
        pairs = storage.written(pairs.join(graphs.united(taken), ["x", "y"], "left_anti").unionByName(graphs.united(added)), "pairs")


def small_cover(near: dict[int, list[int]]) -> list[int]:
    """cover() of a border on the driver: x and the y of each. Paths are sought from all unpaired x at once, by depth."""
    mate_x: dict[int, int] = {}
    mate_y: dict[int, int] = {}
    while True:
        front = [x for x in near if x not in mate_x]
        root, before = {x: x for x in front}, {}
        ends: dict[int, int] = {}
        while front and not ends:
            ahead = []
            for x in front:
                for y in near[x]:
                    if y in before:
                        continue
                    before[y] = x
                    if y not in mate_y:
                        ends.setdefault(root[x], y)
                    else:
                        root[mate_y[y]] = root[x]
                        ahead.append(mate_y[y])
            front = ahead
        if not ends:
            return [x for x in near if x not in root] + list(before)
        for y in ends.values():  # trees have no vertex in common
            while y is not None:
                x = before[y]
                y_next = mate_x.get(x)
                mate_x[x], mate_y[y] = y, x
                y = y_next


@storage.without_broadcasts
def cover(border: DataFrame) -> DataFrame:
    """(v): a smallest set of vertices that touches every edge of a bipartite border (x, y): the x that no alternating
    path from an unpaired x reaches, and the y that one does. Borders of DRIVER_EDGES at most are covered on the driver."""
    border = storage.written(border.select("x", "y").distinct(), "border")
    if border.count() <= DRIVER_EDGES:
        table = border.orderBy("x", "y").toArrow()
        near: dict[int, list[int]] = {}
        for x, y in zip(*(table[c].to_pylist() for c in ("x", "y"))):
            near.setdefault(x, []).append(y)
        return border.sparkSession.createDataFrame(pa.table({"v": pa.array(small_cover(near), pa.int64())}))
    pairs = maximum_pairs(border)
    xs, ys, _ = alternating(border, pairs)
    left = border.select("x").distinct().join(xs.select("x"), "x", "left_anti").select(F.col("x").alias("v"))
    return storage.written(left.unionByName(ys.select(F.col("y").alias("v"))), "cover")


def level_halves(vertices: DataFrame, edges: DataFrame, balance: float) -> DataFrame:
    """(v, _piece, _level_side) of the connected pieces of a graph of DRIVER_EDGES at most: their smallest levels between halves
    within the bound, of the level structure from a peripheral vertex, and what stands before and behind."""
    table = vertices.select("piece", "v").orderBy("piece", "v").toArrow()
    pieces: dict[int, list[int]] = {}
    for piece, v in zip(table["piece"].to_pylist(), table["v"].to_pylist()):
        pieces.setdefault(piece, []).append(v)
    local = graphs.Local(edges, 0)
    out: dict[str, list[int]] = {"v": [], "_piece": [], "_level_side": []}
    for piece, own in pieces.items():
        at = local.levels(local.peripheral(own[0]))
        if len(at) < len(own):
            continue
        bound, sizes = max(-(-len(own) // 2), int(len(own) * balance / 2)), np.bincount(list(at.values()))
        upto = np.cumsum(sizes)
        able = np.flatnonzero((upto - sizes <= bound) & (len(own) - upto <= bound))
        middle = int(able[np.argmin(sizes[able])])  # the level with the median vertex at least
        out["v"] += at.keys()
        out["_piece"] += [piece] * len(own)
        out["_level_side"] += [2 if k == middle else int(k > middle) for k in at.values()]
    kinds = {"v": pa.int64(), "_piece": pa.int64(), "_level_side": pa.int32()}
    return vertices.sparkSession.createDataFrame(pa.table({c: pa.array(x, kinds[c]) for c, x in out.items()}))


def spread_level_halves(vertices: DataFrame, edges: DataFrame, balance: float) -> DataFrame:
    """level_halves() of a graph of any size, by searches of all pieces at once."""
    own = storage.written(vertices.select("v", "piece"), "own")
    edges = graphs.by_source(edges.select("src", "dst"))
    degree = edges.groupBy(F.col("src").alias("v")).agg(F.count(F.lit(1)).alias("_d"))
    whole = own.groupBy("piece").agg(F.count(F.lit(1)).alias("_all"), F.min("v").alias("v"))
    roots = storage.written(whole.select("piece", "v", F.lit(-1).alias("depth")), "roots")
    while True:  # from each root to the end of ever deeper level structures
        at = storage.written(graphs.levels_from(edges, roots.select("v")).join(own, "v").select("v", "piece", "level"), "levels")
        deepest = storage.written(at.groupBy("piece").agg(F.max("level").alias("_deep")), "deepest")
        last = at.join(deepest, "piece").where(F.col("level") == F.col("_deep")).join(degree, "v", "left")
        far = last.groupBy("piece", "_deep").agg(F.min(F.struct(F.coalesce("_d", F.lit(0)).alias("d"), "v")).alias("_m"))
        deeper = F.col("_deep") > F.col("depth")
        ahead = roots.join(far, "piece").select("piece", F.when(deeper, F.col("_m.v")).otherwise(F.col("v")).alias("v"), F.greatest("_deep", "depth").alias("depth"), deeper.alias("_deeper"))
        roots = storage.written(ahead, "roots")
        if roots.where("_deeper").isEmpty():
            break
        storage.drop(at, deepest)
    sizes = storage.written(at.groupBy("piece", "level").agg(F.count(F.lit(1)).alias("_n")), "sizes")
    upto = sizes.withColumn("_upto", F.sum("_n").over(Window.partitionBy("piece").orderBy("level")))  # a row a level
    bound = F.greatest(F.ceil(F.col("_all") / 2), F.floor(F.col("_all") * balance / 2))
    reached = sizes.groupBy("piece").agg(F.sum("_n").alias("_reached"))
    able = upto.join(whole.drop("v"), "piece").join(reached, "piece").where((F.col("_reached") == F.col("_all")) & (F.col("_upto") - F.col("_n") <= bound) & (F.col("_all") - F.col("_upto") <= bound))
    middle = able.groupBy("piece").agg(F.min(F.struct("_n", "level")).alias("_m")).select("piece", F.col("_m.level").alias("_middle"))
    side = F.when(F.col("level") == F.col("_middle"), 2).otherwise((F.col("level") > F.col("_middle")).cast("int"))
    return at.join(middle, "piece").select("v", F.col("piece").alias("_piece"), side.alias("_level_side"))


@storage.without_broadcasts
def halves(vertices: DataFrame, edges: DataFrame, balance: float = 1.1) -> DataFrame:
    """(v, side): each piece of vertices (v, piece) in two halves, sides 0 and 1, that no edge joins, and the separator
    between them, side 2: a smallest cover of the edges that a cut into two parts leaves between them, or a level of a
    breadth-first level structure where that is smaller."""
    parted = cut_up(vertices, edges, 2, balance).select("v", (F.col("part") % 2).cast("int").alias("side"))
    ends = edges.select("src", "dst").join(parted.toDF("src", "_a"), "src").join(parted.toDF("dst", "_b"), "dst")
    border = ends.where((F.col("_a") == 0) & (F.col("_b") == 1)).select(F.col("src").alias("x"), F.col("dst").alias("y"))
    between = cover(border).withColumn("_cover", F.lit(2))
    out = storage.written(parted.join(between, "v", "left").select("v", F.coalesce("_cover", "side").alias("side")), "halves")
    by_level = level_halves if graphs.fits(edges, DRIVER_EDGES) else spread_level_halves
    both = storage.written(out.join(by_level(vertices, edges, balance), "v", "left"), "both")
    less = both.where("_piece IS NOT NULL").groupBy("_piece").agg((F.count_if(F.col("_level_side") == 2) < F.count_if(F.col("side") == 2)).alias("_less"))
    return storage.written(both.join(less, "_piece", "left").select("v", F.when(F.col("_less"), F.col("_level_side")).otherwise(F.col("side")).alias("side")), "halves")


@storage.without_broadcasts
def dissection(entries: DataFrame, nrows: int, ncols: int, smallest: int = 1_000, balance: float = 1.1) -> tuple[DataFrame, DataFrame]:
    """Row and column permutations (src, dst) of a nested dissection by smallest separators: in each piece of more than
    `smallest` vertices the halves come first, each dissected in turn, and their separator last. All pieces of a depth are
    cut at once. Pieces that are small enough, and separators, keep the order of their vertices' numbers."""
    square = nrows == ncols
    n = nrows if square else nrows + ncols
    spark = entries.sparkSession
    edges = storage.written(graphs.adjacency(entries, nrows, ncols).select("src", "dst"), "edges")
    zero = F.lit(0).cast("long")
    # a piece's number is the place of its first vertex in the order that is being made
    own = storage.written(spark.range(1, n + 1).select(F.col("id").alias("v"), zero.alias("piece")), "own")
    done: list[DataFrame] = []
    inner = edges
    while True:
        large = own.groupBy("piece").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > smallest).select("piece")
        large = storage.written(large, "large")
        done.append(storage.written(own.join(large, "piece", "left_anti"), "done"))
        if large.isEmpty():
            break
        rest = storage.written(own.join(large, "piece", "left_semi"), "rest")
        at = rest.select("v", "piece")
        inside = inner.join(at.toDF("src", "_p"), "src").join(at.toDF("dst", "_q"), "dst").where(F.col("_p") == F.col("_q")).select("src", "dst")
        inner = storage.written(inside, "inner")
        numbers = storage.written(en.ranked(large, [F.col("piece")], "_k"), "numbers")  # pieces counted from 0, as parts are numbered by them
        cut = halves(rest.join(numbers, "piece").select("v", F.col("_k").alias("piece")), inner, balance)
        sides = storage.written(rest.join(cut, "v"), "sides")
        sizes = sides.groupBy("piece", "side").agg(F.count(F.lit(1)).alias("_n"))
        starts = sizes.withColumn("_start", F.col("piece") + F.sum("_n").over(Window.partitionBy("piece").orderBy("side")) - F.col("_n"))  # three rows a piece
        placed = sides.join(starts.drop("_n"), ["piece", "side"]).select("v", F.col("_start").alias("piece"), "side")
        placed = storage.written(placed, "placed")
        done.append(storage.written(placed.where("side = 2").select("v", "piece"), "done"))
        own = placed.where("side < 2").select("v", "piece")
    order = en.ranked(graphs.united([d.select("v", "piece") for d in done]), [F.col("piece"), F.col("v")], "_k")
    perm = order.select(F.col("v").alias("src"), (F.col("_k") + 1).alias("dst"))
    return (perm, perm) if square else graphs.separated(perm, nrows)
