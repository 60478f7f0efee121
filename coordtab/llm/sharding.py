"""Sharding by minimax contiguous partition.

Documents of equal text form one atomic group. Groups stand in the order of the 64-bit hash of their text. The smallest
capacity for which a greedy walk over the ordered group sizes needs no more than n_shards shards is found by binary
search, and the order is cut there.

No list of all groups is ever gathered. The order is first summed in 65,536 blocks (the top 16 bits of the hash), which
the driver holds. A block with one group is atomic. Over these blocks the binary search is run twice: once with cuts
allowed anywhere inside a block of many groups (no true partition can do better: a lower bound), once with cuts only
between blocks (such a partition exists: an upper bound). While the bounds differ, only the blocks that a cut can fall
into are summed again by more hash bits. When they meet, the capacity is the exact minimum. The driver holds at most
some 100,000 numbers whatever the input.

Among all partitions of that capacity the cuts nearest to even ones are taken, so that the last shards aren't short.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import store, words

BLOCK_BITS = 16
#: Blocks that one round of refinement may ask for.
ROUND_BLOCKS = 1 << 16
#: Added to the bytes of each text.
OVERHEAD = 16


@dataclass
class Segments:
    """Consecutive ranges of the hash order: first hash (as an unsigned 64-bit rank), bits that are fixed, bytes,
    largest group, groups, rows."""

    first: np.ndarray
    bits: np.ndarray
    size: np.ndarray
    largest: np.ndarray
    groups: np.ndarray
    rows: np.ndarray

    def sorted(self) -> Segments:
        by = np.argsort(self.first, kind="stable")
        return Segments(*(getattr(self, k)[by] for k in self.__dataclass_fields__))

    @property
    def atomic(self) -> np.ndarray:
        return self.groups <= 1


def size_of(text: str) -> Column:
    return F.octet_length(words.no_null(F.col(text))).cast("long") + OVERHEAD


def text_hash(text: str) -> Column:
    """Hash of a text; a null text is not an empty one."""
    return F.when(F.col(text).isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(F.col(text)))


def rank_bits(bits: int) -> Column:
    """The top bits of the hash as a number that ascends with the signed hash, from 0."""
    return F.shiftright(F.col("_h"), 64 - bits) + F.lit(1 << (bits - 1)).cast("long")


def segments_of(groups: DataFrame, bits: int) -> Segments:
    """One segment for each value of the top bits; bits is 16 at first, so the result has 65,536 rows at most."""
    rows = (
        groups.groupBy(rank_bits(bits).alias("b"))
        .agg(F.sum("_bytes"), F.max("_bytes"), F.count(F.lit(1)), F.sum("_rows"))
        .toPandas()
    )
    n = [rows.iloc[:, k].to_numpy(dtype=np.int64) for k in range(5)]
    first = n[0].astype(np.uint64) << np.uint64(64 - bits)
    return Segments(first, np.full(len(rows), bits), *n[1:]).sorted()


def refined(groups: DataFrame, seg: Segments, which: np.ndarray) -> Segments:
    """Replaces the segments at `which` by finer ones."""
    spark = groups.sparkSession
    parts = []
    for bits in np.unique(seg.bits[which]):
        own = which[seg.bits[which] == bits]
        more = min(64 - int(bits), max(1, int(np.log2(max(2, ROUND_BLOCKS // len(which))))))
        firsts = [int(x >> np.uint64(64 - int(bits))) for x in seg.first[own]]
        asked = spark.createDataFrame([(x,) for x in firsts], "b long")  # at most the blocks that the driver holds
        within = groups.join(F.broadcast(asked), rank_bits(int(bits)) == F.col("b"), "left_semi")
        fine = int(bits) + more
        if fine < 64:
            parts.append(segments_of(within, fine))
            continue
        rows = within.select("_h", "_bytes", "_rows").toPandas()  # all bits are known: single groups
        h = rows["_h"].to_numpy(dtype=np.int64).view(np.uint64) ^ np.uint64(1 << 63)
        one = rows["_bytes"].to_numpy(dtype=np.int64)
        parts.append(Segments(h, np.full(len(rows), 64), one, one, np.ones(len(rows), np.int64), rows["_rows"].to_numpy(dtype=np.int64)))
    keep = np.ones(len(seg.first), bool)
    keep[which] = False
    return Segments(*(np.concatenate([getattr(seg, k)[keep], *(getattr(p, k) for p in parts)]) for k in Segments.__dataclass_fields__)).sorted()


def walk_whole(ends: np.ndarray, capacity: int, n_shards: int) -> list[int]:
    """Ends (in bytes) of greedy shards of whole segments; ends[0] is 0. Stays where a segment doesn't fit."""
    cuts, at = [], 0
    for _ in range(n_shards):
        at = int(ends[np.searchsorted(ends, at + capacity, "right") - 1])
        cuts.append(at)
    return cuts


def walk_loose(ends: np.ndarray, atomic: np.ndarray, capacity: int, n_shards: int) -> list[int]:
    """As walk_whole, but cuts may fall anywhere within segments of many groups."""
    cuts, at, total = [], 0, int(ends[-1])
    for _ in range(n_shards):
        at = min(at + capacity, total)
        k = int(np.searchsorted(ends, at, "right") - 1)
        if at < total and atomic[k]:
            at = int(ends[k])
        cuts.append(at)
    return cuts


def least(low: int, high: int, fits) -> int:
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


def minimax(groups: DataFrame, n_shards: int) -> tuple[int, Segments]:
    """The smallest feasible capacity, and segments fine enough that cuts between them reach it. groups: _h, _bytes,
    _rows, a row for each group."""
    seg = segments_of(groups, BLOCK_BITS)
    while True:
        ends = np.concatenate([[0], np.cumsum(seg.size)]).astype(np.int64)
        total = int(ends[-1])
        floor = max(int(seg.largest.max(initial=0)), -(-total // n_shards))
        low = least(floor, max(total, floor), lambda c: walk_loose(ends, seg.atomic, c, n_shards)[-1] == total)
        high = least(low, max(total, low), lambda c: walk_whole(ends, c, n_shards)[-1] == total)
        if low == high:
            return high, seg
        early, late = walk_whole(ends, low, n_shards), walk_loose(ends, seg.atomic, high, n_shards)
        hit = np.zeros(len(seg.first), bool)
        for a, b in zip(early, late):
            hit |= (ends[1:] > a) & (ends[:-1] < max(b, a + 1))
        seg = refined(groups, seg, np.flatnonzero(hit & ~seg.atomic))


def even_cuts(seg: Segments, capacity: int, n_shards: int) -> list[int]:
    """Indexes of segments at which shards 1, 2, ... start: of all cuts that keep to the capacity, from the left those
    nearest to even shares."""
    ends = np.concatenate([[0], np.cumsum(seg.size)]).astype(np.int64)
    total, n = int(ends[-1]), len(seg.size)
    earliest, at = [0] * (n_shards + 1), n
    earliest[n_shards] = n
    for k in range(n_shards - 1, 0, -1):  # the rest must fit into the shards that are left
        at = int(np.searchsorted(ends, ends[at] - capacity, "left"))
        earliest[k] = at
    cuts, at = [], 0
    for k in range(1, n_shards):
        latest = int(np.searchsorted(ends, ends[at] + capacity, "right") - 1)
        want = int(np.searchsorted(ends, k * total / n_shards, "left"))
        if want and want <= n and ends[want] - k * total / n_shards > k * total / n_shards - ends[want - 1]:
            want -= 1
        at = min(max(want, earliest[k], at), latest)
        cuts.append(at)
    return cuts


def signed(first: np.uint64) -> int:
    return int(np.uint64(first) ^ np.uint64(1 << 63)) - (1 << 64) * (int(np.uint64(first) ^ np.uint64(1 << 63)) >= 1 << 63)


def shard_column(groups: DataFrame, n_shards: int, h: Column) -> tuple[Column, Segments]:
    """An int column that gives the shard of the hash h, and the segments."""
    capacity, seg = minimax(groups, n_shards)
    column = F.lit(0)
    for at in even_cuts(seg, capacity, n_shards):
        if at < len(seg.first):
            column = column + (h >= F.lit(signed(seg.first[at])).cast("long")).cast("int")
        # else: a shard without rows, behind all of them
    return column.cast("int"), seg


def grouped(rows: DataFrame) -> DataFrame:
    return rows.groupBy("_h").agg(F.sum("_size").alias("_bytes"), F.count(F.lit(1)).alias("_rows"))


@store.keeps_columns
def assign_shards(docs: DataFrame, n_shards: int = 40, text: str = "text", shard: str = "shard") -> DataFrame:
    """docs with an int column `shard` (replaced if docs has one). Texts aren't shuffled: their hash decides.

    Nulls: a null text counts 0 bytes, and all null texts are one group. Empty texts are another group. An empty table
    stays empty. Repeated rows and ids are separate rows of one group. With fewer groups than shards some shards get
    no row. Other columns pass through, whatever their names."""
    sized = docs.select(text_hash(text).alias("_h"), size_of(text).alias("_size"))
    column, _ = shard_column(store.written(grouped(sized), "groups"), n_shards, text_hash(text))
    return docs.withColumn(shard, column)


def shard_slots(docs: DataFrame, n_shards: int = 40, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row; the law is `bytes`.

    Slots number the rows of a shard without gaps. No task numbers a whole shard: rows are counted by cells of (shard,
    hash block, salt), the driver turns the counts (some 130,000 at most, as blocks with many rows get at most so many
    salts in all) into first slots, and windows number within cells."""
    crc = F.crc32(words.no_null(F.col(text)).cast("binary"))
    base = docs.select(F.col(ident).alias("doc_id"), size_of(text).alias("_size"), crc.alias("text_crc32"), text_hash(text).alias("_h"))
    base = store.written(base, "sized")
    groups = grouped(base.select("_h", "_size"))
    column, seg = shard_column(groups, n_shards, F.col("_h"))

    total = int(seg.rows.sum())
    per_cell = max(10_000, -(-total // ROUND_BLOCKS))
    block_rows: dict[int, int] = {}
    for first, n in zip(seg.first, seg.rows):
        block_rows[int(first >> np.uint64(48))] = block_rows.get(int(first >> np.uint64(48)), 0) + int(n)
    wide = [(b, -(-n // per_cell)) for b, n in block_rows.items() if n > per_cell]
    spark = docs.sparkSession
    salts = spark.createDataFrame(wide, "_b long, _n long")
    celled = (
        base.select("*", F.col("_metadata.row_index").alias("_row"))  # the place in a written file: rows may be equal in all else
        .withColumn("_b", rank_bits(BLOCK_BITS))
        .join(F.broadcast(salts), "_b", "left")
        .withColumn("_s", F.when(F.col("_n").isNull(), F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64("doc_id", "_row"), F.col("_n"))))
        .withColumn("shard", column)
    )
    cells = celled.groupBy("shard", "_b", "_s").count().toPandas().sort_values(["shard", "_b", "_s"])
    cells["_first"] = cells.groupby("shard")["count"].cumsum() - cells["count"]
    firsts = spark.createDataFrame(cells[["shard", "_b", "_s", "_first"]].astype("int64").values.tolist(), "shard int, _b long, _s long, _first long")
    number = F.row_number().over(Window.partitionBy("shard", "_b", "_s").orderBy("_h", "doc_id"))
    return (
        celled.join(F.broadcast(firsts), ["shard", "_b", "_s"])
        .select(
            "doc_id", F.col("_size").alias("size"), "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("_first") + number - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )
