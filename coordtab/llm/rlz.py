"""Removal of repeated passages of words by relative Lempel-Ziv parsing.

Every word is removed that a window of WIDTH words covers which also starts in a document with a smaller id. Reference
blocks are not all text: of every window the KEY words with the smallest hash are its anchor (about one position in 18 is
one), and windows that are equal have equal anchors at equal places. What can match at an anchor is the text around it, all
words that a window with this anchor can cover. Texts around equal anchors meet in one block, which is the reference that
they are parsed against; a document is parsed against every block that an anchor of it is in.

Texts around an anchor that are equal as a whole are one factor; only those of the smallest id go on. In a block these are
put one after the other, by id, and indexed by a suffix array. Each is factored greedily: the next factor is the longest
run of words that starts in a smaller document. It is found in suffix order, where it is shared with the nearest suffix
above or below that stands in a smaller document. Factors of WIDTH words or more are duplicates. A window that is repeated but
lies in no factor crosses exactly one boundary, as a factor that starts within it reaches its end at least, so windows across
a boundary that end within the second factor are looked up as well: no repeated window is missed.

Anchors with more than HOT surroundings left (a phrase that a large part of all documents has) aren't parsed in one
block: their windows are dealt out by hash, the smallest id of each is found by partial minima, and windows of which there
is but one are dealt out no further.

Words and runs of words count as equal if 64-bit hashes of them agree.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytestream, store, words
from .suffixdedup import anchors, encoded, runs, slices

WIDTH, KEY = 50, 16
#: Words that are indexed at once.
CHUNK = 1 << 17
#: Surroundings of an anchor, and of all anchors of a block, that are parsed together (some 84 words each).
HOT, BLOCK = 8_000, 4_000
#: Factors are cut at so many words; a power of two, and at least WIDTH.
LONGEST = 64

ENTRY = "_h long, _c long, _id long, _key long, _pos long, _l int, _r int"
CONTEXT = "_block long, _id long, _key long, _at long, _l int, _words array<long>"
SPAN = "_id long, _key long, _a long, _b long"


def prefix(h: np.ndarray) -> np.ndarray:
    """Prefix sums of words' hashes for span_hashes and window_hashes."""
    out = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * bytestream.powers(bytestream.BASE, len(h)), out=out[1:])
    return out


def entries_of(texts: list[np.ndarray], width: int, key: int):
    """doc, pos, left, right, h, c of the anchors of texts given as their words' hashes; long ones are cut into parts that
    overlap by a window and its surroundings."""
    out = []

    def parts():
        for k, t in enumerate(texts):
            for a in range(0, max(0, len(t) - width + 1), CHUNK):
                low = max(0, a - width)
                yield k, low, a, t[low : a + CHUNK + 2 * width]

    def flush(group):
        sizes = np.array([len(x[3]) for x in group], np.int64)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        found = anchors(prefix(np.concatenate([x[3] for x in group])), starts, ends, 0, 1 << 62, width, key)
        if found is None:
            return
        part, at, *rest = found
        doc, low, first = (np.array([x[q] for x in group], np.int64)[part] for q in range(3))
        pos = at - starts[part] + low
        own = (pos >= first) & (pos < first + CHUNK + width)  # those of the overlap are whole in the part before
        out.append(tuple(x[own] for x in (doc, pos, *rest)))

    group, size = [], 0
    for x in parts():
        if group and size + len(x[3]) > CHUNK:
            flush(group)
            group, size = [], 0
        group.append(x)
        size += len(x[3])
    if group:
        flush(group)
    return [np.concatenate(x) for x in zip(*out)] if out else None


def index_entries(width: int, key: int):
    schema = pa.schema([("_h", pa.int64()), ("_c", pa.int64()), ("_id", pa.int64()), ("_key", pa.int64()), ("_pos", pa.int64()), ("_l", pa.int32()), ("_r", pa.int32())])

    def work(batches):
        for batch in slices(batches, 500):
            found = entries_of(bytestream.word_hashes(encoded(batch.column(2))), width, key)
            if found is None:
                continue
            doc, pos, left, right, h, c = found
            ids, keys = np.asarray(batch.column(0))[doc], np.asarray(batch.column(1))[doc]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h.view(np.int64), c.view(np.int64), ids, keys, pos, left.astype(np.int32), right.astype(np.int32))], schema=schema)

    return work


def surroundings(batches):
    """_id, _key, _text, _want (list of _block, _pos, _l, _r): the words' hashes around each wanted anchor."""
    schema = pa.schema([("_block", pa.int64()), ("_id", pa.int64()), ("_key", pa.int64()), ("_at", pa.int64()), ("_l", pa.int32()), ("_words", pa.list_(pa.int64()))])
    for batch in slices(batches, 200):
        hashes = bytestream.word_hashes(encoded(batch.column(2)))
        for ident, key, h, want in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), hashes, batch.column(3).to_pylist()):
            for k in range(0, len(want), 2_000):
                some = want[k : k + 2_000]
                cut = [h[w["_pos"] - w["_l"] : w["_pos"] + w["_r"]].view(np.int64) for w in some]
                n = len(some)
                yield pa.RecordBatch.from_arrays([pa.array([w["_block"] for w in some]), pa.array([ident] * n), pa.array([key] * n), pa.array([w["_pos"] - w["_l"] for w in some]), pa.array([w["_l"] for w in some], pa.int32()), pa.array(cut, pa.list_(pa.int64()))], schema=schema)


def gram_classes(stream: np.ndarray) -> list[np.ndarray]:
    """For 1, 2, 4, ... LONGEST words: a number for the run of so many words from each place, ordered like the runs; runs
    that would pass the end are cut there. The last one is the rank of suffixes by their first LONGEST words."""
    level = np.unique(stream, return_inverse=True)[1].astype(np.int32)
    out, step = [level], 1
    while step < LONGEST:
        pair = level * (np.int64(level.max()) + 2)
        pair[:-step] += level[step:] + 1
        level = np.unique(pair, return_inverse=True)[1].astype(np.int32)
        out.append(level)
        step *= 2
    return out


def nearest_smaller(owner: np.ndarray) -> np.ndarray:
    """For each place the nearest one before it with a smaller owner, -1 if there is none: places point ever further back,
    all at once, past those that aren't smaller."""
    before = np.arange(len(owner)) - 1
    open_ = np.flatnonzero(before >= 0)
    while len(open_):
        open_ = open_[owner[before[open_]] >= owner[open_]]
        before[open_] = before[before[open_]]
        open_ = open_[before[open_] >= 0]
    return before


def longest_earlier(stream: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each place of a stream the words, LONGEST at most, that also start in a smaller owner."""
    levels = gram_classes(stream)
    order = np.argsort(levels[-1], kind="stable")
    held = owner[order]
    n = len(order)
    least = np.zeros(n, np.int64)
    for near in (nearest_smaller(held), n - 1 - nearest_smaller(held[::-1])[::-1]):
        has = np.flatnonzero((near >= 0) & (near < n))
        x, y = order[has], order[near[has]]
        length = np.zeros(len(x), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            inside = (x + length < n) & (y + length < n)
            same = inside & (levels[k][np.minimum(x + length, n - 1)] == levels[k][np.minimum(y + length, n - 1)])
            length[same] += 1 << k
        np.maximum.at(least, x, np.minimum(length, LONGEST))
    return least


def factors(length: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the factors of a greedy parse of each text at [begin, end); all texts are parsed in step."""
    found, at = [], begins.copy()
    left = np.flatnonzero(at < ends)
    while len(left):
        step = np.maximum(length[at[left]], 1)
        found.append((at[left], at[left] + step))
        at[left] += step
        left = left[at[left] < ends[left]]
    if not found:
        return begins[:0], begins[:0]
    start, end = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(start)
    return start[order], end[order]


def repeated_windows(start: np.ndarray, end: np.ndarray, length: np.ndarray, text: np.ndarray, width: int) -> np.ndarray:
    """The starts of windows that are repeated, given the factors in order and the text (a number) of each place: those
    within a factor, and those across a boundary that end within the factor after it."""
    hit = np.zeros(len(length) + 1, np.int64)
    whole = end - start >= width
    np.add.at(hit, start[whole], 1)
    np.add.at(hit, end[whole] - width + 1, -1)
    inside = np.cumsum(hit)[:-1] > 0
    joined = np.flatnonzero(text[start[1:]] == text[start[:-1]])
    first = np.maximum(start[joined], end[joined] - width + 1)
    last = np.minimum(end[joined] - 1, end[joined + 1] - width)
    count = np.maximum(0, last - first + 1)
    across = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    inside[across[length[across] >= width]] = True
    return np.flatnonzero(inside)


def parse(width: int):
    """Spans of the texts of a block that also start in texts of smaller ids."""

    def work(group: pa.Table) -> pa.Table:
        ids = np.asarray(group.column("_id"))
        order = np.argsort(ids, kind="stable")
        group, ids = group.take(pa.array(order)), ids[order]
        lists = group.column("_words").combine_chunks()
        sizes = np.asarray(lists.value_lengths()).astype(np.int64)
        n = len(sizes)
        ends = np.cumsum(sizes) + np.arange(n)  # one place after each text, with a word of its own
        begins = ends - sizes
        text = np.repeat(np.arange(n), sizes + 1)
        words_ = np.zeros(len(text), np.int64)
        inner = np.ones(len(text), bool)
        inner[ends] = False
        words_[inner] = np.asarray(lists.flatten())
        stream = np.unique(words_, return_inverse=True)[1].astype(np.int64) + n
        stream[ends] = np.arange(n)
        length = longest_earlier(stream, ids[text])
        start, end = factors(length, begins, ends)
        at = repeated_windows(start, end, length, text, width)
        o, a, b = runs(text[at], at - begins[text[at]], width)
        base = np.asarray(group.column("_at"))[o]
        return pa.table({"_id": pa.array(ids[o], pa.int64()), "_key": pa.array(np.asarray(group.column("_key"))[o], pa.int64()), "_a": pa.array(base + a, pa.int64()), "_b": pa.array(base + b, pa.int64())})

    return work


def all_windows(width: int):
    """A row for each window around a hot anchor: hash, row, start."""

    def work(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 2_000):
                part = batch.slice(k, 2_000)
                lists = part.column(4)
                sizes = np.asarray(lists.value_lengths()).astype(np.int64)
                ends = np.cumsum(sizes)
                left = np.asarray(part.column(3)).astype(np.int64)
                count = np.maximum(0, np.minimum(left, sizes - width) + 1)  # windows that hold the anchor
                owner = np.repeat(np.arange(part.num_rows), count)
                start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                pre = prefix(np.asarray(lists.flatten()).view(np.uint64))
                at = (ends - sizes)[owner] + start
                h = bytestream.span_hashes(pre, at, at + width)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.asarray(part.column(0))[owner]), pa.array(np.asarray(part.column(1))[owner]), pa.array(np.asarray(part.column(2))[owner] + start)], names=["_w", "_id", "_key", "_a"])

    return work


def spans_of(rows: DataFrame, width: int, key: int, hot: int, block: int) -> DataFrame:
    """_id, _key, _a, _b: ranges of words of rows (_id, _key, _text) that are covered; they overlap."""
    spark = rows.sparkSession
    store.ship(spark)
    own = rows.where(F.col("_id").isNotNull())
    entries = store.written(own.select("_id", "_key", "_text").mapInArrow(index_entries(width, key), ENTRY), "entries")
    shared = entries.groupBy("_h").agg(F.min("_id").alias("_x"), F.max("_id").alias("_y")).where(F.col("_x") < F.col("_y")).select("_h")
    shared = store.written(shared, "shared")
    # what no other document has is left out before anything is dealt out, but for a few that a bit takes for others
    found = store.marked(entries, F.col("_h"), shared).where(F.col("_l") + F.col("_r") >= width)
    wholes = found.groupBy("_h", "_c").agg(F.min("_id").alias("_first")).join(shared, "_h", "left_semi")
    met = store.written(found.join(store.written(wholes, "wholes"), ["_h", "_c"]), "met")
    spans = met.where(F.col("_id") > F.col("_first")).select("_id", "_key", (F.col("_pos") - F.col("_l")).alias("_a"), (F.col("_pos") + F.col("_r")).alias("_b"))

    open_ = met.where(F.col("_id") == F.col("_first"))
    groups = open_.groupBy("_h").agg(F.count(F.lit(1)).alias("_k"), F.min("_id").alias("_x"), F.max("_id").alias("_y"))
    groups = store.written(groups.where(F.col("_x") < F.col("_y")).select("_h", "_k"), "groups")
    sizes = groups.agg(F.coalesce(F.sum(F.when(F.col("_k") <= hot, F.col("_k"))), F.lit(0)).alias("n"), F.count_if(F.col("_k") > hot).alias("hot")).first()
    blocks = max(1, -(-sizes["n"] // block))
    dealt = groups.select("_h", F.when(F.col("_k") > hot, -1).otherwise(F.pmod(F.xxhash64("_h"), F.lit(blocks))).cast("long").alias("_block"))
    want = open_.join(dealt, "_h").groupBy("_id", "_key")
    want = store.written(want.agg(F.collect_set(F.struct("_block", "_pos", "_l", "_r")).alias("_want")), "want")  # a row for each text, as long as its number of anchors
    texts = store.marked(own, F.col("_key"), want.select("_key")).join(want, ["_id", "_key"]).dropDuplicates(["_id", "_key"])
    around = store.written(texts.select("_id", "_key", "_text", "_want").mapInArrow(surroundings, CONTEXT), "surroundings")

    spans = spans.unionByName(around.where("_block >= 0").groupBy("_block").applyInArrow(parse(width), SPAN))
    if sizes["hot"]:
        each = around.where("_block < 0").select("_id", "_key", "_at", "_l", "_words").mapInArrow(all_windows(width), "_w long, _id long, _key long, _a long")
        first = each.groupBy("_w").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last")).where(F.col("_first") < F.col("_last"))
        first = store.written(first.select("_w", "_first"), "first")
        many = store.marked(each, F.col("_w"), first.select("_w")).join(first, "_w").where(F.col("_id") > F.col("_first"))
        spans = spans.unionByName(many.select("_id", "_key", "_a", (F.col("_a") + width).alias("_b")))
    return spans


def joined(lists):
    """Number of words in lists of them, and SHA-256 of the words joined by one space."""
    n, sha = 0, hashlib.sha256()
    for some in lists:
        if some:
            sha.update(b" " * (n > 0) + b" ".join(some))
            n += len(some)
    return n, sha.hexdigest()


def kept_words(text: bytes, spans: list[dict]):
    """Lists of the words outside the spans."""
    edges = np.array(sorted([(s["_a"], 1) for s in spans] + [(s["_b"], -1) for s in spans]))
    place, depth = edges[:, 0], np.cumsum(edges[:, 1])
    at = 0
    for some in bytestream.word_lists(text):
        where = np.searchsorted(place, np.arange(at, at + len(some)), "right") - 1
        yield [some[k] for k in np.flatnonzero((where < 0) | (depth[where] == 0))]
        at += len(some)


def removed(batches):
    """_id, _key, _text, _spans: what is left of each text."""
    schema = pa.schema([("_id", pa.int64()), ("_key", pa.int64()), ("_n_kept", pa.int64()), ("_sha", pa.string()), ("_kept", pa.string())])
    for batch in slices(batches):
        out = []
        for ident, key, text, spans in zip(*(c.to_pylist() for c in batch.columns[:2]), encoded(batch.column(2)), batch.column(3).to_pylist()):
            left = list(kept_words(text, spans))
            out.append((ident, key, *joined(left), b" ".join(b" ".join(x) for x in left if x).decode()))
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], schema.field(j).type) for j in range(5)], schema=schema)


def words_joined(texts: pa.Array) -> pa.Array:
    """What joined() gives for whole texts."""
    found = [joined(bytestream.word_lists(text)) for k in range(0, len(texts), 200) for text in encoded(texts.slice(k, 200))]
    return pa.StructArray.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.string())], ["n", "sha"])


@store.keeps_columns
def deduplicated(docs: DataFrame, width: int = WIDTH, key: int = KEY, hot: int = HOT, block: int = BLOCK, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with _n_words, _n_removed, _sha (SHA-256 of the kept words joined by one space) and _kept (those words; null
    where nothing is removed, as the text is whole then).

    A null text is an empty one; texts of fewer than `width` words keep all. Ids are integers. Rows with a null id lose
    nothing and make no other lose anything; rows of one id don't either, among each other, so repeated rows fare alike.
    Windows are judged on the input. An empty table stays empty; other columns pass through."""
    if not key <= width <= LONGEST:
        raise ValueError(f"windows have from {key} to {LONGEST} words")
    t = words.no_null(F.col(text))
    rows = docs.select(F.col(ident).cast("long").alias("_id"), F.xxhash64(text).alias("_key"), t.alias("_text"))
    listed = spans_of(rows, width, key, hot, block).groupBy("_id", "_key").agg(F.collect_set(F.struct("_a", "_b")).alias("_spans"))
    listed = store.written(listed, "listed")
    texts = store.marked(rows, F.col("_key"), listed.select("_key")).join(listed, ["_id", "_key"]).dropDuplicates(["_id", "_key"])
    cut = texts.select("_id", "_key", "_text", "_spans").mapInArrow(removed, "_id long, _key long, _n_kept long, _sha string, _kept string")
    cut = cut.withColumnsRenamed({"_id": "_cut_id", "_key": "_cut_key", "_sha": "_cut_sha"})
    base = docs.withColumns({"_id": F.col(ident).cast("long"), "_key": F.xxhash64(text), "_all": F.arrow_udf(words_joined, "n long, sha string")(F.col(text))})
    out = base.join(cut, (F.col("_id") == F.col("_cut_id")) & (F.col("_key") == F.col("_cut_key")), "left")
    out = out.withColumns({"_n_words": F.col("_all.n"), "_n_removed": F.col("_all.n") - F.coalesce("_n_kept", "_all.n"), "_sha": F.coalesce("_cut_sha", "_all.sha")})
    return out.drop("_id", "_key", "_all", "_n_kept", "_cut_id", "_cut_key", "_cut_sha")
