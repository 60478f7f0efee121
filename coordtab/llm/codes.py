"""Compression of vectors into codes: a codebook for each of PARTS consecutive parts of a vector, in whole numbers.

Components are floor(256 x), so that all distances are exact. The nearest entry of a codebook is found by annular norm
pruning: entries are sorted by norm; the entry nearest in norm gives a first distance d, and as |x - c| is never below
the difference of the norms, only entries with norms from |x| - d to |x| + d, found by binary search, can be as near. That
annulus, its ends included, is evaluated exactly.

The codebooks (PARTS x ENTRIES parts of vectors, of one size at any number of vectors) stand on the driver and go to the
tasks; each round's sums are made in tasks first and then by part and entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store

PARTS, ENTRIES, ROUNDS = 16, 64, 2
SCALE = 256
#: Beyond it (after scaling), squared distances could leave 64 bits.
LARGEST = 1 << 28
#: Vectors whose annuli are evaluated at once.
CHUNK = 4096


def whole(vectors: pa.Array, dim: int, parts: int) -> np.ndarray:
    """(vectors, parts, width) of floor(256 x); a length that parts don't divide is filled up with zeros."""
    flat = np.asarray(vectors.flatten(), dtype=np.float64).reshape(len(vectors), dim)
    out = np.floor(flat * SCALE)
    if len(out) and np.abs(out).max() > LARGEST:
        raise ValueError(f"components of {LARGEST // SCALE} or more can't be compressed")
    width = -(-dim // parts)
    return np.pad(out, ((0, 0), (0, width * parts - dim))).astype(np.int64).reshape(len(vectors), parts, width)


class Annuli:
    """A codebook (entries, width), its entries sorted by norm."""

    def __init__(self, book: np.ndarray):
        norms = np.sqrt((book * book).sum(axis=1).astype(np.float64))
        self.order = np.argsort(norms, kind="stable")
        self.norms, self.entries = norms[self.order], book[self.order]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each row of x (of equal ones the lowest) and its squared distance."""
        norm = np.sqrt((x * x).sum(axis=1).astype(np.float64))
        at = np.minimum(np.searchsorted(self.norms, norm), len(self.norms) - 1)
        below = np.maximum(at - 1, 0)
        at = np.where(np.abs(self.norms[below] - norm) < np.abs(self.norms[at] - norm), below, at)
        d = np.sqrt(((x - self.entries[at]) ** 2).sum(axis=1).astype(np.float64))
        slack = 1e-9 * (norm + d) + 1e-9  # roots are rounded
        low = np.searchsorted(self.norms, norm - d - slack, "left")
        high = np.searchsorted(self.norms, norm + d + slack, "right")
        count = high - low
        first = np.cumsum(count) - count
        row = np.repeat(np.arange(len(x)), count)
        entry = np.arange(count.sum()) - np.repeat(first - low, count)
        squares = ((x[row] - self.entries[entry]) ** 2).sum(axis=1)
        least = np.minimum.reduceat(squares, first)
        index = np.where(squares == least[row], self.order[entry], len(self.order))
        return np.minimum.reduceat(index, first), least


def assigned(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes (vectors, parts) and squared distances of the nearest entries."""
    index, square = np.empty(x.shape[:2], np.int64), np.empty(x.shape[:2], np.int64)
    for p in range(x.shape[1]):
        annuli = Annuli(books[p])
        for k in range(0, len(x), CHUNK):
            index[k : k + CHUNK, p], square[k : k + CHUNK, p] = annuli.nearest(x[k : k + CHUNK, p])
    return index, square


def entry_sums(books: np.ndarray, dim: int):
    """_part, _entry, _n, _sums of each batch: how many parts are nearest to an entry, and their sum by component."""
    parts, entries, width = books.shape

    def work(batches):
        total, n = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            x = whole(batch.column(0), dim, parts)
            index, _ = assigned(x, books)
            for p in range(parts):
                np.add.at(total[p], index[:, p], x[:, p])
                n[p] += np.bincount(index[:, p], minlength=entries)
        p, e = np.nonzero(n)
        if len(p):
            yield pa.RecordBatch.from_pydict({"_part": pa.array(p, pa.int32()), "_entry": pa.array(e, pa.int32()), "_n": pa.array(n[p, e]), "_sums": pa.array(list(total[p, e]), pa.list_(pa.int64()))})

    return work


def moved(kept: DataFrame, vector: str, books: np.ndarray, dim: int) -> np.ndarray:
    """The codebooks after a round: each entry that is nearest to some part becomes the floor of these parts' mean."""
    width = books.shape[2]
    partial = kept.select(vector).mapInArrow(entry_sums(books, dim), "_part int, _entry int, _n long, _sums array<long>")
    sums = partial.groupBy("_part", "_entry").agg(F.sum("_n").alias("_n"), *(F.sum(F.get("_sums", F.lit(q))).alias(f"_s{q}") for q in range(width)))
    new = books.copy()
    for r in sums.collect():  # a row for each entry of the codebooks
        new[r["_part"], r["_entry"]] = [r[f"_s{q}"] // r["_n"] for q in range(width)]
    return new


def usable(vector: str):
    x = F.col(vector)
    return x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))


def trained(kept: DataFrame, dim: int, ident: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts, entries, width) of usable vectors of length dim. They start as the parts of the rows with the
    smallest ids (null ids last, equal ids by their vectors); with fewer rows than entries there are as many as rows."""
    first = kept.select(ident, vector).orderBy(F.col(ident).asc_nulls_last(), vector).limit(entries).collect()
    seed = whole(pa.array([r[1] for r in first], pa.list_(pa.float64())), dim, parts)
    books = np.ascontiguousarray(seed.transpose(1, 0, 2))
    for _ in range(rounds):
        books = moved(kept, vector, books, dim)
    return books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components as decimal numbers, by part, entry and place within the part, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


@store.keeps_columns
def compressed(vectors: DataFrame, ident: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """The usable rows of vectors with _code (binary, an index for each part), _error (squared distances summed over the
    parts), _label_error (errors summed over equal labels, nulls together) and _books (digest of the codebooks).

    Left out are rows whose vector is null, empty, or holds null, infinite or undefined components, and those of another
    length than the usable row of the smallest id, which have no place in the codebooks. Components of 2**20 or more stop
    the job. Null and repeated ids and repeated rows are coded like others; other columns pass through. Without usable
    rows the result is empty."""
    if entries > 256:
        raise ValueError("an index has one byte")
    store.ship(vectors.sparkSession)
    kept = vectors.where(usable(vector))
    first = kept.select(ident, vector).orderBy(F.col(ident).asc_nulls_last(), vector).select(F.size(vector)).first()
    dim = first[0] if first else 0
    kept = kept.where(F.size(vector) == dim)
    books = trained(kept, dim, ident, vector, parts, entries, rounds) if dim else np.zeros((parts, 1, 0), np.int64)

    def coded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            index, square = assigned(whole(batch, dim, parts), books)
            codes = pa.array([row.tobytes() for row in index.astype(np.uint8)], pa.binary())
            yield pa.StructArray.from_arrays([codes, pa.array(square.sum(axis=1))], ["code", "error"])

    out = kept.withColumn("_coded", F.arrow_udf(coded, "code binary, error long")(F.col(vector)))
    out = store.written(out.withColumns({"_code": F.col("_coded.code"), "_error": F.col("_coded.error")}).drop("_coded"), "coded")  # read twice
    sums = out.groupBy(F.col(label).alias("_of")).agg(F.sum("_error").alias("_label_error"))
    return out.join(sums, F.col(label).eqNullSafe(F.col("_of"))).drop("_of").withColumn("_books", F.lit(digest(books)))
