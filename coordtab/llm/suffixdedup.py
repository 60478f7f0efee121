"""Removal of repeated passages by a logarithmic family of suffix indexes.

Every byte is removed that a string of WIDTH bytes covers which also starts anywhere else. To find these strings without
indexing each position, the index is sparse: of every window of WIDTH bytes the suffix is indexed that starts at the
window's anchor, the leftmost of its KEY-byte strings with the smallest hash. Equal windows have equal anchors at equal
places, so two equal windows always meet at suffixes that begin with the same KEY bytes. About one position in 150 is an
anchor.

An entry holds a fingerprint of the suffix's first KEY bytes, one of its whole surroundings (all bytes that a window with
this anchor can cover), and where it stands. Entries are ordered by fingerprint, not by text, which serves as well to
find equals. New batches of documents get their sorted runs, which are merge-scanned against all existing levels for
suffixes that begin alike; then runs of equal size are merged, so that n batches leave about log2(n) levels.

Entries with a hit are judged on all bytes. Where the whole surroundings occur twice, all of them are covered. Where an entry's
surroundings are unique but its beginning isn't (the ends of a repeated passage), the surroundings are fetched, and the
hashes of all their windows are compared within the group of entries that begin alike; a group of more than HOT different
surroundings is compared by a shuffle of its window hashes instead of in one task. Strings count as equal if two 64-bit
hashes agree, one of their beginning and one of the whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytestream, store, words

WIDTH, KEY = 400, 100
BATCHES = 4
#: Bytes that are indexed at once.
CHUNK = 1 << 20
HOT = 4_000
ENTRY = "_h long, _c long, _key long, _pos long, _l int, _r int"


def row_key(docs: DataFrame, ident: str, text: str) -> Column:
    """Tells rows apart; rows that are equal in id and text share it, and the same is removed from them. The hashes are
    compared with longer ones of all rows first: where rows that differ share one, they are hashed anew."""
    key, tried = F.xxhash64(F.col(ident), F.col(text)), 0
    while True:
        other = F.md5(F.concat_ws("|", F.col(ident).cast("string"), F.lit(""), F.isnull(ident).cast("string"), F.isnull(text).cast("string"), F.col(text)).cast("binary"))
        each = docs.select(key.alias("_k"), other.alias("_o")).groupBy("_k").agg(F.min("_o").alias("_a"), F.max("_o").alias("_b"))
        shared = [r["_k"] for r in each.where(F.col("_a") != F.col("_b")).select("_k").collect()]  # n**2 / 2**65 of n rows
        if not shared:
            return key
        tried += 1
        key = F.when(key.isin(shared), F.xxhash64(F.lit(tried), F.col(ident), F.col(text))).otherwise(key)


def leftmost_minima(h: np.ndarray, valid: np.ndarray, span: int) -> np.ndarray:
    """For each valid q the place of the leftmost smallest of h[q:q+span], ascending and without repeats."""
    n = len(h)
    bits = max(1, int(n).bit_length())
    key = (h >> np.uint64(bits) << np.uint64(bits)) | np.arange(n, dtype=np.uint64)
    rows = -(-n // span) + 1
    padded = np.full(rows * span, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = key
    blocks = padded.reshape(rows, span)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[:n], ahead[span - 1 : span - 1 + n])[valid]
    at = (least & np.uint64((1 << bits) - 1)).astype(np.int64)
    return at[np.flatnonzero(np.diff(at, prepend=-1))]


def anchors(pre: np.ndarray, starts: np.ndarray, ends: np.ndarray, lo: int, hi: int, width: int, key: int):
    """Entries of the documents at [start, end) of a stream with prefix sums pre, for windows that begin in [lo, hi):
    document, place, left and right reach, both fingerprints."""
    span = width - key + 1
    h = bytestream.window_hashes(pre, key)
    valid = np.zeros(len(h) + 1, np.int64)
    first, last = np.maximum(starts, lo), np.minimum(ends - width + 1, hi)
    own = last > first
    np.add.at(valid, first[own], 1)
    np.add.at(valid, last[own], -1)
    q = np.flatnonzero(np.cumsum(valid)[:-1] > 0)
    if not len(q):
        return None
    at = leftmost_minima(h, q, span)
    doc = np.searchsorted(starts, at, "right") - 1
    left = np.minimum(width - key, at - starts[doc])
    right = np.minimum(width, ends[doc] - at)
    c = bytestream.mix(bytestream.span_hashes(pre, at - left, at + right) + left.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return doc, at, left, right, h[at], c


def entries_of(texts: list[bytes], width: int, key: int):
    """doc, pos, left, right, h, c arrays of a list of texts; short ones are hashed together, long ones in parts."""
    out = []

    def many(group: list[int]):
        sizes = np.array([len(texts[k]) for k in group], np.int64)
        ends = np.cumsum(sizes)
        found = anchors(bytestream.prefix(np.frombuffer(b"".join(texts[k] for k in group), np.uint8)), ends - sizes, ends, 0, 1 << 62, width, key)
        if found is not None:
            doc, at, *rest = found
            out.append((np.array(group)[doc], at - (ends - sizes)[doc], *rest))

    def long(k: int):
        seen = -1
        for a in range(0, max(1, len(texts[k]) - width + 1), CHUNK):
            low = max(0, a - width)
            part = np.frombuffer(texts[k], np.uint8)[low : a + CHUNK + 2 * width]
            found = anchors(bytestream.prefix(part), np.array([0]), np.array([len(part)]), a - low, a - low + CHUNK, width, key)
            if found is not None:
                doc, at, *rest = found
                new = at + low > seen
                seen = int(at[-1]) + low
                out.append(tuple(x[new] for x in (doc + k, at + low, *rest)))

    group, size = [], 0
    for k, t in enumerate(texts):
        if len(t) < width:
            continue
        if len(t) > CHUNK:
            long(k)
            continue
        if size + len(t) > CHUNK:
            many(group)
            group, size = [], 0
        group.append(k)
        size += len(t)
    if group:
        many(group)
    return [np.concatenate(x) for x in zip(*out)] if out else None


def encoded(column) -> list[bytes]:
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


def slices(batches, rows: int = 200):
    """Smaller batches, for work that turns rows into Python objects."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def index_entries(width: int, key: int):
    schema = pa.schema([("_h", pa.int64()), ("_c", pa.int64()), ("_key", pa.int64()), ("_pos", pa.int64()), ("_l", pa.int32()), ("_r", pa.int32())])

    def work(batches):
        for batch in slices(batches, 2_000):
            found = entries_of(encoded(batch.column(1)), width, key)
            if found is None:
                continue
            doc, pos, left, right, h, c = found
            keys = np.asarray(batch.column(0))[doc]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h.view(np.int64), c.view(np.int64), keys, pos, left.astype(np.int32), right.astype(np.int32))], schema=schema)

    return work


class Family:
    """Levels of sorted entries. A level of rank r holds 2**r batches."""

    def __init__(self):
        self.levels: list[tuple[int, DataFrame, str]] = []
        self.hits: list[DataFrame] = []

    @staticmethod
    def run(entries: DataFrame) -> tuple[DataFrame, str]:
        # sorted by ranges of all columns, so that a beginning that millions of entries share fills several partitions
        path = store.new_path(entries.sparkSession, "level")
        keys = ["_h", "_c", "_key", "_pos"]
        entries.repartitionByRange(*keys).sortWithinPartitions(*keys).write.parquet(path)
        return entries.sparkSession.read.schema(entries.schema).parquet(path), path

    def add(self, batch: DataFrame) -> None:
        new, path = self.run(batch)
        spark = new.sparkSession
        found = new.groupBy("_h").count().where(F.col("count") > 1).select("_h")
        for _, level, _ in self.levels:  # one row for each beginning on both sides
            found = found.unionByName(new.select("_h").distinct().join(level.select("_h").distinct(), "_h", "left_semi"))
        self.hits.append(store.written(found, "hits"))
        self.levels.append((0, new, path))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (rank, a, old_a), (_, b, old_b) = self.levels[-2:]
            merged, path = self.run(a.unionByName(b))
            self.levels[-2:] = [(rank + 1, merged, path)]
            store.remove(spark, old_a)
            store.remove(spark, old_b)

    def repeated(self) -> DataFrame:
        """All entries whose beginning occurs more than once."""
        every = hit = None
        for _, level, _ in self.levels:
            every = level if every is None else every.unionByName(level)
        for h in self.hits:
            hit = h if hit is None else hit.unionByName(h)
        # the hits are a table of their own, so that Spark can split what a frequent one joins with
        return every.join(store.written(hit.distinct(), "hits"), "_h", "left_semi")


def surroundings(batches):
    """_key, _text, _want (list of _h, _c, _pos, _l, _r, _n): the bytes around each wanted entry."""
    schema = pa.schema([("_h", pa.int64()), ("_c", pa.int64()), ("_key", pa.int64()), ("_pos", pa.int64()), ("_l", pa.int32()), ("_single", pa.bool_()), ("_bytes", pa.binary())])
    for batch in slices(batches):
        out = []
        for key, text, want in zip(batch.column(0).to_pylist(), encoded(batch.column(1)), batch.column(2).to_pylist()):
            for w in want:
                p = w["_pos"]
                out.append((w["_h"], w["_c"], key, p, w["_l"], w["_n"] == 1, text[p - w["_l"] : p + w["_r"]]))
        for k in range(0, len(out), 10_000):
            part = out[k : k + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in part], schema.field(j).type) for j in range(len(schema))], schema=schema)


def window_keys(data: list[bytes], left: np.ndarray, width: int, key: int):
    """For all contexts: the hash of each window that holds the anchor, with its offset mixed in; owner; start."""
    sizes = np.array([len(x) for x in data], np.int64)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    count = np.maximum(0, np.minimum(left, sizes - width) + 1)
    owner = np.repeat(np.arange(len(data)), count)
    start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    pre = bytestream.prefix(np.frombuffer(b"".join(data), np.uint8))
    at = begins[owner] + start
    h = bytestream.span_hashes(pre, at, at + width)
    return bytestream.mix(h + (left[owner] - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), owner, start


SPAN = "_key long, _a long, _b long"


def runs(owner: np.ndarray, start: np.ndarray, width: int):
    """First and last of each run of consecutive starts of one owner, as (owner, from, to)."""
    if not len(owner):
        return owner, start, start
    cut = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(start, prepend=-9) != 1))
    last = np.append(cut[1:], len(owner)) - 1
    return owner[cut], start[cut], start[last] + width


def compare(width: int, key: int):
    """Spans of windows that two entries of a group share, for the entries with unique surroundings."""

    def work(group: pa.Table) -> pa.Table:
        data = group.column("_bytes").to_pylist()
        left = np.asarray(group.column("_l")).astype(np.int64)
        single = np.asarray(group.column("_single"))
        keys, pos = np.asarray(group.column("_key")), np.asarray(group.column("_pos"))
        hashes, owner, start = [], [], []
        for k in range(0, len(data), 2_000):
            h, o, s = window_keys(data[k : k + 2_000], left[k : k + 2_000], width, key)
            hashes.append(h)
            owner.append(o + k)
            start.append(s)
        h, owner, start = (np.concatenate(x) for x in (hashes, owner, start))
        order = np.argsort(h)
        same = np.flatnonzero(h[order][1:] == h[order][:-1])
        twin = np.zeros(len(h), bool)
        twin[order[same]] = twin[order[same + 1]] = True
        twin &= single[owner]
        o, a, b = runs(owner[twin], start[twin], width)
        base = pos[o] - left[o]
        return pa.table({"_key": pa.array(keys[o], pa.int64()), "_a": pa.array(base + a, pa.int64()), "_b": pa.array(base + b, pa.int64())})

    return work


def all_windows(width: int, key: int):
    """A row for each window of an entry of a hot group."""

    def work(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            for k in range(0, t.num_rows, 2_000):
                part = t.slice(k, 2_000)
                left = np.asarray(part.column("_l")).astype(np.int64)
                h, o, s = window_keys(part.column("_bytes").to_pylist(), left, width, key)
                a = np.asarray(part.column("_pos"))[o] - left[o] + s
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(part.column("_h"))[o]), pa.array(h.view(np.int64)), pa.array(np.asarray(part.column("_key"))[o]), pa.array(a, pa.int64()), pa.array(np.asarray(part.column("_single"))[o])], names=["_h", "_w", "_key", "_a", "_single"])

    return work


def removed(batches):
    """_key, _text, _spans: what is left of each text."""
    schema = pa.schema([("_key", pa.int64()), ("_removed", pa.int64()), ("_runs", pa.int64()), ("_sha_left", pa.string()), ("_left", pa.binary())])
    for batch in slices(batches):
        out = []
        for key, text, spans in zip(batch.column(0).to_pylist(), encoded(batch.column(1)), batch.column(2).to_pylist()):
            merged: list[list[int]] = []
            for s in sorted((x["_a"], x["_b"]) for x in spans):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append(list(s))
            kept, at = [], 0
            for a, b in merged:
                kept.append(text[at:a])
                at = b
            left = b"".join([*kept, text[at:]])
            out.append((key, len(text) - len(left), len(merged), hashlib.sha256(left).hexdigest(), left))
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], schema.field(j).type) for j in range(5)], schema=schema)


def spans_of(rows: DataFrame, width: int, key: int, batches: int, hot: int) -> DataFrame:
    """_key, _a, _b: byte ranges of rows (_key, _text) that are covered; they overlap."""
    spark = rows.sparkSession
    store.ship(spark)
    path = store.new_path(spark, "entries")
    entries = rows.select("_key", "_text").mapInArrow(index_entries(width, key), ENTRY)
    entries.withColumn("_batch", F.pmod(F.xxhash64("_key"), F.lit(batches)).cast("int")).write.partitionBy("_batch").parquet(path)
    stored = spark.read.schema(ENTRY + ", _batch int").parquet(path)
    family = Family()
    for k in range(batches):
        family.add(stored.where(F.col("_batch") == k).drop("_batch"))
    found = store.written(family.repeated(), "repeated")
    for _, _, level in family.levels:
        store.remove(spark, level)
    store.remove(spark, path)

    wholes = found.groupBy("_h", "_c").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("_key", "_pos", "_l", "_r")).alias("_e"))
    groups = wholes.groupBy("_h").agg(F.count(F.lit(1)).alias("_k"), F.min("_n").alias("_least"))
    wholes = store.written(wholes.join(groups, "_h"), "wholes")
    whole = found.join(wholes.where(F.col("_n") > 1).select("_h", "_c"), ["_h", "_c"], "left_semi").where(F.col("_l") + F.col("_r") >= width)
    spans = whole.select("_key", (F.col("_pos") - F.col("_l")).alias("_a"), (F.col("_pos") + F.col("_r")).alias("_b"))

    open_ = wholes.where((F.col("_k") > 1) & (F.col("_least") == 1) & (F.col("_e._l") + F.col("_e._r") >= width))
    want = open_.groupBy(F.col("_e._key").alias("_key")).agg(F.collect_list(F.struct("_h", "_c", "_e._pos", "_e._l", "_e._r", "_n")).alias("_want"))
    want = store.written(want, "want")  # a row for each text, as long as its number of entries
    texts = store.marked(rows, F.col("_key"), want.select("_key")).join(want, "_key").dropDuplicates(["_key"])
    ctx = texts.select("_key", "_text", "_want").mapInArrow(surroundings, "_h long, _c long, _key long, _pos long, _l int, _single boolean, _bytes binary")
    ctx = store.written(ctx, "surroundings")
    large = groups.where(F.col("_k") > hot).select("_h")
    few = ctx.join(large, "_h", "left_anti").groupBy("_h").applyInArrow(compare(width, key), SPAN)
    spans = spans.unionByName(few)
    if not large.isEmpty():
        each = ctx.join(large, "_h", "left_semi").mapInArrow(all_windows(width, key), "_h long, _w long, _key long, _a long, _single boolean")
        twice = each.groupBy("_h", "_w").count().where(F.col("count") > 1).select("_h", "_w")
        many = each.where("_single").join(twice, ["_h", "_w"], "left_semi")
        spans = spans.unionByName(many.select("_key", "_a", (F.col("_a") + width).alias("_b")))
    return spans


@store.keeps_columns
def deduplicated(docs: DataFrame, width: int = WIDTH, key: int = KEY, batches: int = BATCHES, hot: int = HOT, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with _n_bytes, _n_removed, _n_spans (maximal removed runs), _sha (SHA-256 of what is kept) and _kept (those
    bytes; null where nothing is removed).

    A null text is an empty one. Texts of under `width` bytes keep all. Rows that are equal in id and text are two
    places, so nothing of them is kept if they are long enough; null ids are ids like others. Strings are judged on the
    input. Cuts may fall within a character: _kept is binary. An empty table stays empty; other columns pass through."""
    t = words.no_null(F.col(text))
    key_of = row_key(docs, ident, text)
    rows = docs.select(key_of.alias("_key"), t.alias("_text"))
    spans = store.written(spans_of(rows, width, key, batches, hot), "spans")
    listed = store.written(spans.groupBy("_key").agg(F.collect_set(F.struct("_a", "_b")).alias("_spans")), "listed")
    texts = store.marked(rows, F.col("_key"), listed.select("_key")).join(listed, "_key").dropDuplicates(["_key"])
    cut = texts.select("_key", "_text", "_spans").mapInArrow(removed, "_key long, _removed long, _runs long, _sha_left string, _left binary")
    base = docs.withColumn("_key", key_of).withColumn("_n_bytes", F.octet_length(t).cast("long")).withColumn("_sha_all", F.sha2(t.cast("binary"), 256))
    return (
        base.join(cut, "_key", "left")
        .withColumns({"_n_removed": F.coalesce("_removed", F.lit(0).cast("long")), "_n_spans": F.coalesce("_runs", F.lit(0).cast("long")), "_sha": F.coalesce("_sha_left", "_sha_all"), "_kept": F.col("_left")})
        .drop("_key", "_sha_all", "_removed", "_runs", "_sha_left", "_left")
    )
