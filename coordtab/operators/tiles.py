"""Matrices as tiles of compressed rows, multiplied with vector blocks by NumPy.

A tile (bi, bj, first, j, a) covers SIZE rows and columns: row r of it has the entries from first[r] to first[r + 1], with
their columns in j (within the tile) and their values in a. A vector block (b, values) holds SIZE values in order. A product
joins tiles and blocks, a row each instead of one for each entry, and sums by row of the result. Worth it where tiles are
full (bands, blocks, dense columns); a tile of a scattered matrix holds few entries and costs its pointers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import IncompatibleError
from ..meta import Symmetry, Transposition
from . import entries as en
from . import vectors as ve
from .products import combined, oriented

#: Rows and columns of a tile: four million entries, 50 MB, at most.
SIZE = 1 << 11

TILE = "bi long, bj long, first array<int>, j array<int>, a array<double>"


#: Cells (tiles times their rows) and entries that a worker lays out at once, or one tile.
CELLS = 1 << 20


def packed(size: int):
    """Tiles from entries (_bi, _bj, _r, _c, _a) in order; the last tile of a batch waits for the next one."""
    step = max(1, CELLS // size)

    def lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))

    def laid(pieces: list[list[np.ndarray]]):
        bi, bj, r, c, a = map(np.concatenate, zip(*pieces))
        at = np.flatnonzero(np.concatenate([[True], (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])]))
        upto = np.append(at, len(bi))
        for k in range(0, len(at), step):
            own = upto[k : k + step + 1]
            lo, hi, t = own[0], own[-1], len(own) - 1
            tile = np.repeat(np.arange(t), np.diff(own))
            first = np.zeros((t, size + 1), np.int32)
            np.cumsum(np.bincount(tile * size + r[lo:hi], minlength=t * size).reshape(t, size), axis=1, out=first[:, 1:])
            inside = lists(first.ravel(), np.arange(t + 1) * (size + 1), pa.int32()), lists(c[lo:hi], own - lo, pa.int32()), lists(a[lo:hi], own - lo, pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(bi[own[:-1]]), pa.array(bj[own[:-1]]), *inside], names=["bi", "bj", "first", "j", "a"])

    def work(batches):
        held: list[list[np.ndarray]] = []
        for batch in batches:
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(new[0]):
                continue
            other = np.flatnonzero((new[0] != new[0][-1]) | (new[1] != new[1][-1]))
            if len(other):
                last = other[-1] + 1
                yield from laid([*held, [c[:last] for c in new]])
                held = [[c[last:] for c in new]]
            else:
                if held and (held[0][0][0], held[0][1][0]) != (new[0][0], new[1][0]):
                    yield from laid(held)
                    held = []
                held.append(new)
        if held:
            yield from laid(held)

    return work


def slices(size: int):
    """Makes a function that cuts a batch of tiles so that a slice has CELLS cells and entries, or is one tile: the slice,
    the row that each entry stands in, counted on from tile to tile, the entries of each tile, their columns and values."""
    most = CELLS

    def cut(batch: pa.RecordBatch):
        total = np.cumsum(np.diff(batch.column("j").offsets.to_numpy()) + size)
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, "right")))
            part = batch.slice(lo, hi - lo)
            first, j, a = (part.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("first", "j", "a"))
            first = first.reshape(hi - lo, size + 1)
            yield part, np.repeat(np.arange((hi - lo) * size), np.diff(first, axis=1).ravel()), first[:, -1], j, a
            lo = hi

    return cut


def tiled(a: DataFrame, size: int = SIZE, trans: Transposition | str = "notrans", symmetry: Symmetry | str = "general", assembled: bool = False) -> DataFrame:
    """Tiles of op(A) for real and integer values. Entries of one place are added up first, which bounds a tile by size
    squared entries; assembled=True says that there are none."""
    full = oriented(a, trans, symmetry)
    if ve.is_complex(full):
        raise IncompatibleError("tiles hold real values")
    if not assembled:
        full = en.assemble(full)
    at = lambda c: F.expr(f"({c} - 1) div {size}")
    place = lambda c: ((F.col(c) - 1) % size).cast("int")
    cut = full.select(at("i").alias("_bi"), at("j").alias("_bj"), place("i").alias("_r"), place("j").alias("_c"), F.col("a").cast("double").alias("_a"))
    return cut.repartition("_bi", "_bj").sortWithinPartitions("_bi", "_bj", "_r", "_c").mapInArrow(packed(size), TILE)


def entries_of(tiles: DataFrame, size: int = SIZE) -> DataFrame:
    """(i, j, a) of tiles."""
    cut = slices(size)

    def work(batches):
        for batch in batches:
            for part, row, count, j, a in cut(batch):
                bi, bj = (np.repeat(part.column(b).to_numpy(), count) * size + 1 for b in ("bi", "bj"))
                yield pa.RecordBatch.from_arrays([pa.array(bi + row % size), pa.array(bj + j), pa.array(a)], names=["i", "j", "a"])

    return tiles.select("bi", "bj", "first", "j", "a").mapInArrow(work, "i long, j long, a double")


def multiplied(size: int):
    """Rows of tile times block that aren't empty; tiles of one row of tiles that follow each other are summed at once."""
    cut = slices(size)

    def work(batches):
        for batch in batches:
            for part, row, count, j, a in cut(batch):
                bi = part.column("bi").to_numpy()
                run = np.cumsum(np.concatenate([[0], bi[1:] != bi[:-1]]))
                x, n = part.column("_x").flatten().to_numpy(zero_copy_only=False), np.diff(part.column("_x").offsets.to_numpy())
                near = j < np.repeat(n, count)  # columns beyond the vector's end meet nothing
                value = a[near] * x[(np.repeat(np.cumsum(n) - n, count) + j)[near]]
                cell = (np.repeat(run, count) * size + row % size)[near]
                cells = int(run[-1] + 1) * size
                hit = np.flatnonzero(np.bincount(cell, minlength=cells))
                i = bi[np.searchsorted(run, hit // size)] * size + hit % size + 1
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(np.bincount(cell, value, cells)[hit])], names=["i", "a"])

    return work


def gemv(tiles: DataFrame, x: DataFrame, y: DataFrame | None = None, alpha=1.0, beta=0.0, size: int = SIZE) -> DataFrame:
    """alpha A x + beta y as (i, a) with 1-based i: x is a full vector (b, values) in blocks of the tiles' size, with b from
    0. Only rows with entries appear where nothing is added."""
    met = tiles.join(x.select(F.col("b").alias("bj"), F.transform("values", lambda v: v.cast("double")).alias("_x")), "bj")
    rows = met.select("bi", "first", "j", "a", "_x").mapInArrow(multiplied(size), "i long, a double")
    return combined(rows.groupBy("i").agg(F.sum("a").alias("a")), y, alpha, beta)
