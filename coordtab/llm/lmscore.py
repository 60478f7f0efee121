"""Stupid-backoff scores of documents under an n-gram model of the whole corpus.

Every document is scored under the counts of all others: its own n-grams are subtracted first. With c' such counts and N'
the number of other words, a word w after a history h of up to ORDER - 1 words has

    S(w | h) = c'(h w) / c'(h)         if c'(h w) > 0
             = BACKOFF * S(w | h without its first word) otherwise,
    S(w)     = c'(w) / N'              if c'(w) > 0, else FLOOR / N',

and the document's score is the mean of log S over its words.

N-grams are told apart by 64-bit hashes, and by nothing else: of d distinct ones each shares its hash with another by a
chance of d / 2^64, which for 6 billion is 3e-10, and those that do add up their counts. A hit without its history, which
only that can give, is a miss.

The count table is partitioned by the hash of the n-gram. Documents are dealt by hash into chunks of some CHUNK_BYTES. A
chunk's distinct n-grams of all orders are packed, sorted, into a row for each partition of the count table; a
partition adds up what all chunks hold and answers each chunk with the totals in the chunk's order; the chunk joins the
answers to its n-grams and sums up per document. What is shuffled are the texts once (compressed) and some 6 bytes for each distinct
n-gram of a chunk. Both numbers of groups grow with the corpus, so that a group's size doesn't, nor does a task's; an
n-gram that is everywhere is one entry a chunk. The rows between chunks and partitions are never more than the n-grams
that chunks hold: where there are so many of both that a row holds one n-gram, this is the plain join, at its cost.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytestream, store, words

ORDER = 3
BACKOFF = 0.4
FLOOR = 0.5
CHUNK_BYTES = 8_000_000


def grams_of(texts: list[str | None], order: int) -> list[list[np.ndarray]]:
    """For each text the 64-bit hashes of its 1-grams, 2-grams, ... in order of place. A-Z are lowered."""
    data = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    return [[bytestream.mix(bytestream.gram_hashes(h, n) + np.uint64(n)) for n in range(1, order + 1)] for h in bytestream.word_hashes(data)]


def squeezed(texts: pa.Array) -> pa.Array:
    """Texts as they are shuffled."""
    return pa.array([None if t is None else zlib.compress(t.encode("utf-8", "surrogatepass"), 1) for t in texts.to_pylist()], pa.binary())


def texts_of(column: pa.ChunkedArray) -> list[str | None]:
    return [None if x is None else zlib.decompress(x).decode("utf-8", "surrogatepass") for x in column.to_pylist()]


def bucket_of(g: np.ndarray, buckets: int) -> np.ndarray:
    """The partition of the count table; ascends with the hash."""
    return ((g >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def bucket_start(b: int, buckets: int) -> np.uint64:
    """No hash of the partition is smaller."""
    return np.uint64((((b << 32) + buckets - 1) // buckets) << 32)


def packed_hashes(g: np.ndarray) -> bytes:
    """Ascending hashes as steps of as many bytes as the widest takes, byte by byte of all; the highest bytes are mostly
    small and coded by frequency."""
    steps = np.diff(g, prepend=np.uint64(0)).astype("<u8")
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    planes = steps.view(np.uint8).reshape(-1, 8)[:, :width].T
    coder = zlib.compressobj(1, zlib.DEFLATED, -15, 8, zlib.Z_HUFFMAN_ONLY)
    return struct.pack("<BQ", width, len(g)) + planes[:-1].tobytes() + coder.compress(planes[-1].tobytes()) + coder.flush()


def unpacked_hashes(data: bytes) -> np.ndarray:
    width, n = struct.unpack_from("<BQ", data)
    at = 9 + (width - 1) * n
    planes = np.zeros((n, 8), np.uint8)
    planes[:, : width - 1] = np.frombuffer(data, np.uint8, (width - 1) * n, 9).reshape(width - 1, n).T
    planes[:, width - 1] = np.frombuffer(zlib.decompress(data[at:], -15), np.uint8)
    return np.cumsum(planes.view("<u8")[:, 0], dtype=np.uint64)


def packed_counts(c: np.ndarray) -> tuple[bytes, bytes]:
    """One byte each, and the large ones apart."""
    large = np.flatnonzero(c >= 255)
    return zlib.compress(np.minimum(c, 255).astype(np.uint8).tobytes(), 1), np.concatenate([large, c[large]]).astype(np.int64).tobytes()


def unpacked_counts(small: bytes, large: bytes) -> np.ndarray:
    c = np.frombuffer(zlib.decompress(small), np.uint8).astype(np.int64)
    more = np.frombuffer(large, np.int64).reshape(2, -1)
    c[more[0]] = more[1]
    return c


PACKED = pa.schema([("_chunk", pa.int32()), ("_bucket", pa.int32()), ("_hashes", pa.binary()), ("_small", pa.binary()), ("_large", pa.binary())])
PACKED_DDL = "_chunk int, _bucket int, _hashes binary, _small binary, _large binary"


def parts_of(distinct: np.ndarray, buckets: int):
    """(bucket, from, to) of the partitions that the ascending hashes touch."""
    b = bucket_of(distinct, buckets).astype(np.int64)
    cut = np.flatnonzero(np.diff(b, prepend=-1))
    return zip(b[cut].tolist(), cut.tolist(), np.append(cut[1:], len(b)).tolist())


def table_of(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], PACKED.field(k).type) for k in range(5)], schema=PACKED)


def ask(order: int, buckets: int):
    def work(group: pa.Table) -> pa.Table:
        grams = [g for t in grams_of(texts_of(group.column("_text")), order) for g in t]
        flat = np.concatenate(grams)
        del grams
        distinct, count = np.unique(flat, return_counts=True)
        del flat
        chunk, rows = group.column("_chunk")[0].as_py(), []
        for b, i, j in parts_of(distinct, buckets):
            rows.append((chunk, b, packed_hashes(distinct[i:j] - bucket_start(b, buckets)), *packed_counts(count[i:j])))
        return table_of(rows)

    return work


def answer(group: pa.Table) -> pa.Table:
    """Adds up one partition of the count table and gives each chunk what the other chunks hold of its n-grams."""
    hashes = [unpacked_hashes(x) for x in group.column("_hashes").to_pylist()]
    counts = [unpacked_counts(*x) for x in zip(group.column("_small").to_pylist(), group.column("_large").to_pylist())]
    distinct, place = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.bincount(place, np.concatenate(counts), len(distinct)).astype(np.int64)
    rows, at = [], 0
    bucket = group.column("_bucket")[0].as_py()
    for chunk, h, c in zip(group.column("_chunk").to_pylist(), hashes, counts):
        rows.append((chunk, bucket, b"", *packed_counts(total[place[at : at + len(h)]] - c)))
        at += len(h)
    return table_of(rows)


SCORED_DDL = "_id long, _words long, _logprob double, _score double"


def elsewhere(distinct: np.ndarray, answers: pa.Table, buckets: int) -> np.ndarray:
    """What the other chunks hold of each n-gram."""
    given = {b: x for b, *x in zip(*(answers.column(k).to_pylist() for k in (1, 3, 4)))}
    out = np.zeros(len(distinct), np.int64)
    for b, i, j in parts_of(distinct, buckets):
        out[i:j] = unpacked_counts(*given[b])
    return out


def firsts(sorted_: np.ndarray) -> np.ndarray:
    """Where a new value begins."""
    out = np.ones(len(sorted_), bool)
    out[1:] = sorted_[1:] != sorted_[:-1]
    return out


def others(flat: np.ndarray, owner: np.ndarray, answers: pa.Table, buckets: int) -> np.ndarray:
    """For each n-gram at a place: how often all documents but its own hold it."""
    order = np.argsort(flat, kind="stable")  # owners ascend, so each n-gram's places stay in their order
    g = flat[order]
    new = firsts(g)
    g = g[new]
    own = new | firsts(owner[order])
    places = np.diff(np.append(np.flatnonzero(new), len(flat)))
    rest = np.repeat(elsewhere(g, answers, buckets) + places, places)
    length = np.diff(np.append(np.flatnonzero(own), len(flat)))
    rest -= np.repeat(length, length)
    out = np.empty(len(flat), np.int64)
    out[order] = rest
    return out


def score(order: int, buckets: int, n_total: int, backoff: float, floor: float):
    def work(docs: pa.Table, answers: pa.Table) -> pa.Table:
        ids = docs.column(1)
        grams = grams_of(texts_of(docs.column(2)), order)
        lengths = np.array([len(g[0]) for g in grams], np.int64)
        counts = [np.maximum(lengths - k, 0) for k in range(order)]
        flat = np.concatenate([g[k] for g in grams for k in range(order)] or [np.empty(0, np.uint64)])
        del grams
        per_doc = np.sum(counts, axis=0)
        rest = others(flat, np.repeat(np.arange(len(lengths), dtype=np.int32), per_doc), answers, buckets)
        del flat
        n = int(lengths.sum())
        owner = np.repeat(np.arange(len(lengths)), lengths)
        inside = np.arange(n) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        base = np.cumsum(per_doc) - per_doc

        def at(k: int, where: np.ndarray) -> np.ndarray:
            """Counts of the (k + 1)-grams that start at the given words."""
            d = owner[where]
            return rest[base[d] + sum((counts[x][d] for x in range(k)), np.zeros(len(d), np.int64)) + inside[where]]

        every = np.arange(n)
        one = at(0, every)
        found = np.where(one > 0, one, floor) / np.maximum(n_total - lengths, 1)[owner]
        for k in range(1, order):  # the k + 1 words that end here start k places before
            end = np.flatnonzero(inside >= k)
            whole = at(k, end - k)
            history = at(k - 1, end - k)
            hit = (whole > 0) & (history > 0)
            found[end] *= backoff
            found[end[hit]] = whole[hit] / history[hit]
        sums = np.bincount(owner, np.log(found), len(lengths))
        mean = pa.array(np.divide(sums, lengths, out=np.zeros(len(lengths)), where=lengths > 0), mask=lengths == 0)
        return pa.table({"_id": ids.cast(pa.int64()), "_words": pa.array(lengths), "_logprob": pa.array(sums), "_score": mean})

    return work


def scored(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, floor: float = FLOOR, chunk_bytes: int = CHUNK_BYTES, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """_id, _words, _logprob (natural, summed), _score (mean; null without words) of each row.

    A null, empty or blank text has no words and a sum of 0. Words are case-folded in A-Z. Rows are documents of their own
    even if they share id and text: one's words count for the other. A null id is kept. Where a document is alone, all
    its words take the floor. An empty table gives an empty one; other columns are ignored."""
    spark = docs.sparkSession
    store.ship(spark)
    sums = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.col(text)).cast("long")).alias("b"), F.sum(F.size(words.words(F.col(text)))).alias("w")).first()
    n_total = int(sums["w"] or 0)
    groups = max(1, -(-int(sums["b"] or 0) // chunk_bytes), sums["n"] // 20_000)
    chunk = F.pmod(F.xxhash64(F.col(ident), F.col(text)), F.lit(groups)).cast("int")
    dealt = docs.select(chunk.alias("_chunk"), F.col(ident).cast("long").alias("_id"), F.arrow_udf(squeezed, "binary")(F.col(text)).alias("_text"))
    # a partition for each group, so that none share a task however large the corpus is
    dealt = dealt.repartitionById(groups, F.col("_chunk"))
    asked = dealt.groupBy("_chunk").applyInArrow(ask(order, groups), PACKED_DDL).repartitionById(groups, F.col("_bucket"))
    answered = asked.groupBy("_bucket").applyInArrow(answer, PACKED_DDL).toDF("_chunk2", "_bucket", "_hashes", "_small", "_large")
    return dealt.groupBy("_chunk").cogroup(answered.repartitionById(groups, F.col("_chunk2")).groupBy("_chunk2")).applyInArrow(score(order, groups, n_total, backoff, floor), SCORED_DDL)
