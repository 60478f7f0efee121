"""Near-duplicates by MinHash: universal hash minima, banding, signature verification, exact confirmation, components.

1. A Python worker turns each text into its set of shingle hashes (64 bits), and that into MINIMA minima of functions
   a * x + b modulo 2**32, in BANDS bands of ROWS. It returns a hash of each band, one byte of each minimum, and a
   128-bit key of the whole set.
2. Documents with equal sets form a class; only its smallest id goes on. A group of a billion copies is one row here.
3. Within each band bucket every member is paired with the bucket's smallest member. Pairs whose signatures agree in
   under SURE of the minima are dropped; the rest are confirmed on the full sets. Links give components.
4. A bucket whose members are now in one component is settled. In others, members of different components that weren't
   compared yet are paired: all such pairs in a bucket of up to SMALL members, and in a larger one those with a pivot
   that changes each round. When no pivot joins anything any more, what is left of large buckets is compared in full,
   in blocks within a worker, with signatures first.
So no step makes all pairs of a group, and none gathers a group, but the result is that of comparing all pairs of each
bucket. Two documents of similarity 0.8 share no bucket with probability (1 - 0.8**ROWS)**BANDS = 1e-7.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytestream, store
from .components import components, salt, salted

ROWS, BANDS = 5, 40
MINIMA = ROWS * BANDS
#: Share of agreeing signature bytes that a pair needs before its sets are fetched. At similarity 0.8 the share is 0.8
#: on average with a deviation of 0.028.
SURE = 0.65
SMALL = 32
_rng = np.random.Generator(np.random.PCG64(7))
_a = (_rng.integers(0, 1 << 32, MINIMA, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
_b = _rng.integers(0, 1 << 32, MINIMA, dtype=np.uint64).astype(np.uint32)[:, None]


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the n-word shingles of each text; a shorter text is one shingle of all its words."""
    data = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]  # bytes: A-Z only
    out = []
    for h in bytestream.word_hashes(data):
        if 0 < len(h) < n:
            g = bytestream.gram_hashes(h, len(h)) * np.uint64(2 * len(h) + 1)
        else:
            g = bytestream.gram_hashes(h, n)
        out.append(np.unique(g))
    return out


def minima(hashes: np.ndarray) -> np.ndarray:
    x = (hashes >> np.uint64(32)).astype(np.uint32)[None, :]
    found = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for at in range(0, x.shape[1], 512):
        np.minimum(found, (_a * x[:, at : at + 512] + _b).min(axis=1), out=found)
    return found


def signature(m: np.ndarray) -> bytes:
    """A byte of each minimum, mixed from all its bits: of a minimum of many values the top bits are always 0."""
    return ((m * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes()


SIGNED = pa.schema([("_id", pa.int64()), ("_n", pa.int64()), ("_set", pa.binary()), ("_bands", pa.list_(pa.int64())), ("_sig", pa.binary())])
SIGNED_DDL = "_id long, _n long, _set binary, _bands array<long>, _sig binary"


def sign(n: int):
    def work(batches):
        for batch in bytestream.slices(batches):
            ids = batch.column(0)
            rows = []
            for s in shingle_sets(batch.column(1).to_pylist(), n):
                if not len(s):
                    rows.append((0, None, None, None))
                    continue
                m = minima(s)
                wide = m.reshape(BANDS, ROWS).astype(np.uint64)
                h = np.arange(BANDS, dtype=np.uint64)
                for k in range(ROWS):
                    h = bytestream.mix(h * np.uint64(0xD6E8FEB86659FD93) + wide[:, k] + np.uint64(1))
                bands = h.view(np.int64)
                rows.append((len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), bands, signature(m)))
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), *(pa.array([r[k] for r in rows], SIGNED.field(k + 1).type) for k in range(4))], schema=SIGNED)

    return work


def agreeing(batches):
    """The pairs whose signatures agree often enough. Columns: _a, _b, _sig_a, _sig_b."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, MINIMA) for k in (2, 3))
        keep = (x == y).sum(axis=1) >= SURE * MINIMA
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["_a", "_b"]).filter(pa.array(keep))


def packed(n: int):
    def work(batches):
        for batch in bytestream.slices(batches):
            sets = [s.tobytes() for s in shingle_sets(batch.column(1).to_pylist(), n)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sets, pa.binary())], names=["_id", "_set"])

    return work


def confirm(num: int, den: int):
    """Keeps the pairs with den * intersection >= num * union. Columns: _a, _b, _set_a, _set_b."""

    def work(batches):
        for batch in bytestream.slices(batches, 2_000):
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["_a", "_b"]).filter(pa.array(keep, pa.bool_()))

    return work


PAIR_DDL = "_a long, _b long"


class Search:
    """The state of one run: signatures of the classes' smallest ids, their buckets, tested pairs, links."""

    def __init__(self, docs: DataFrame, signed: DataFrame, n: int, num: int, den: int, ident: str, text: str):
        self.n, self.num, self.den = n, num, den
        self.texts = docs.select(F.col(ident).cast("long").alias("_id"), F.col(text).alias("_t"))
        # equal sets have equal bands and signatures: any of a class will do
        classes = signed.where((F.col("_n") > 0) & F.col("_id").isNotNull()).groupBy("_set")
        self.reps = store.written(classes.agg(F.min("_id").alias("_id"), F.count(F.lit(1)).alias("_copies"), F.first("_bands").alias("_bands"), F.first("_sig").alias("_sig")), "reps")
        bands = self.reps.select("_id", F.explode("_bands").alias("_k"))
        shared = bands.groupBy("_k").agg(F.min("_id").alias("_p"), F.count(F.lit(1)).alias("_m")).where(F.col("_m") > 1)
        self.members = store.written(bands.join(shared, "_k"), "members")  # _k, _id, _p, _m
        self.tested = self.links = self.known = None

    def test(self, pairs: DataFrame) -> DataFrame:
        """Links among the pairs (_a < _b), each tested once in the whole run."""
        pairs = pairs.distinct()
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["_a", "_b"], "left_anti")
        pairs = store.written(pairs, "pairs")
        self.tested = pairs if self.tested is None else self.tested.unionByName(pairs)
        sig = self.reps.select("_id", "_sig")
        signed = pairs.join(sig.toDF("_a", "_sig_a"), "_a").join(sig.toDF("_b", "_sig_b"), "_b").select("_a", "_b", "_sig_a", "_sig_b")
        likely = store.written(signed.mapInArrow(store.trimmed(agreeing), PAIR_DDL), "likely")
        ids = likely.select(F.col("_a").alias("_id")).union(likely.select("_b")).distinct()
        near = store.marked(self.texts, F.col("_id"), ids).join(ids, "_id")  # Spark would push a semi join below the marks
        sets = store.written(near.mapInArrow(store.trimmed(packed(self.n)), "_id long, _set binary"), "sets")
        joined = likely.join(sets.toDF("_b", "_set_b"), "_b").join(sets.toDF("_a", "_set_a"), "_a").select("_a", "_b", "_set_a", "_set_b")
        found = store.written(joined.mapInArrow(store.trimmed(confirm(self.num, self.den)), PAIR_DDL), "links")
        store.drop(sets)
        self.links = found if self.links is None else self.links.unionByName(found)
        return found

    def join(self) -> None:
        """Components by all links so far."""
        links = self.links if self.known is None else self.links.unionByName(self.known)
        self.known = components(links, "_a", "_b").select(F.col("_component").alias("_a"), F.col("_id").alias("_b"))

    def place(self) -> None:
        """Components so far, and of each bucket (of three members or more) the members of each: `placed` is _k, _m, _id,
        _c, and `mixed` has _k, _m, _c, _n (members), _low and _high (ids) for buckets of several components, and the
        bucket's _main component, that of most members."""
        self.join()
        of = self.known.select(F.col("_b").alias("_id"), F.col("_a").alias("_component"))
        self.placed = self.members.where(F.col("_m") > 2).join(of, "_id", "left").select("_k", "_m", "_id", F.coalesce("_component", "_id").alias("_c"))
        each = store.written(self.placed.groupBy("_k", "_m", "_c").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_low"), F.max("_id").alias("_high")), "placed")
        main = each.groupBy("_k").agg(F.count(F.lit(1)).alias("_comps"), F.max_by("_c", F.struct("_n", "_c")).alias("_main")).where(F.col("_comps") > 1)
        self.mixed = store.written(each.join(main.select("_k", "_main"), "_k"), "mixed")

    @staticmethod
    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("_x", "_y").alias("_a"), F.greatest("_x", "_y").alias("_b"))

    def run(self) -> DataFrame:
        """_id, _component of the classes' smallest ids."""
        star = self.members.where(F.col("_id") != F.col("_p"))
        self.test(self.ordered(star.select(F.col("_p").alias("_x"), F.col("_id").alias("_y"))))
        self.place()
        small = self.placed.join(self.mixed.where(F.col("_m") <= SMALL).select("_k").distinct(), "_k", "left_semi")
        x, y = small.select("_k", F.col("_id").alias("_x"), F.col("_c").alias("_cx")), small.select("_k", F.col("_id").alias("_y"), F.col("_c").alias("_cy"))
        pairs = x.join(y, "_k").where((F.col("_x") < F.col("_y")) & (F.col("_cx") != F.col("_cy"))).select("_x", "_y")
        # in large buckets: the members outside the main component with its largest member (the smallest was the star's)
        large = self.mixed.where(F.col("_m") > SMALL)
        pivot = large.where(F.col("_c") == F.col("_main")).select("_k", F.col("_high").alias("_x"))
        outer = self.placed.join(large.where(F.col("_c") != F.col("_main")).select("_k", "_c"), ["_k", "_c"], "left_semi").select("_k", F.col("_id").alias("_y"))
        if not self.test(self.ordered(pairs.unionByName(pivot.join(outer, "_k").select("_x", "_y")))).isEmpty():
            self.place()
        large = self.mixed.where(F.col("_m") > SMALL)
        if not large.isEmpty():
            self.test(self.rest(large))
            self.join()
        return self.known.select(F.col("_b").alias("_id"), F.col("_a").alias("_component"))

    def rest(self, large: DataFrame) -> DataFrame:
        """What pivots didn't settle: candidates for links between components that meet in large buckets, none left out.

        The members' shingles are put into one order, rare ones (among the members) first. Sets of sizes x and y that are
        alike enough share c(x, y) shingles or more, so the first x - c + 1 of one and y - c + 1 of the other have one in
        common. An outlier of a crowd of near copies differs from it in its rarest shingles; where these are its alone,
        it meets nobody. Only members of components other than a bucket's main one seek, and only among other components,
        so the crowd isn't compared with itself. To keep the common shingles of a crowd from meeting at all, each entry
        names the classes of sizes (4 % wide) that it may meet."""
        of = self.reps.select("_id").join(self.known.select(F.col("_b").alias("_id"), F.col("_a").alias("_component")), "_id", "left").select("_id", F.coalesce("_component", "_id").alias("_c"))
        comps = large.groupBy("_c").agg(F.max((F.col("_c") != F.col("_main")).cast("int")).alias("_s"))
        members = store.written(of.join(comps, "_c").select("_id", "_c", (F.col("_s") == 1).alias("_seeks")), "members")
        ids = members.select("_id").distinct()
        near = store.marked(self.texts, F.col("_id"), ids).join(ids, "_id")
        each = near.mapInArrow(store.trimmed(listed(self.n)), "_id long, _s long, _n int")
        each = store.written(each, "shingles")
        rare = each.groupBy("_s").agg(F.count(F.lit(1)).alias("_df"))
        t = self.num / self.den
        n = F.col("_n")
        by = each.join(rare, "_s").groupBy("_id", "_n").agg(F.array_sort(F.collect_list(F.struct("_df", "_s"))).alias("_o"))
        prefix = by.select("_id", "_n", F.posexplode(F.slice("_o", F.lit(1), n - F.ceil(t * n).cast("int") + 1)).alias("_i", "_e"))
        entry = prefix.where(F.col("_e._df") > 1).select("_id", "_n", "_i", F.col("_e._s").alias("_s"), F.floor(F.log(n.cast("double")) / np.log(1.04)).cast("int").alias("_class"))
        entry = entry.join(members, "_id")
        # from c(x, y) <= x - i: y may have (1 + t) / t * (x - i) - x shingles at most, and t * x at least
        low = F.floor(F.log(t * n) / np.log(1.04) - 1e-9).cast("int")
        high = F.floor(F.log((1 + t) / t * (n - F.col("_i")) - n + 1e-9) / np.log(1.04) + 1e-9).cast("int")
        asks = entry.where(F.col("_seeks")).where(((1 + t) / t * (n - F.col("_i")) - n > 0)).withColumn("_low", low).withColumn("_high", high).where(F.col("_low") <= F.col("_high"))
        asks = asks.select("_s", F.explode(F.sequence("_low", "_high")).alias("_class"), F.col("_id").alias("_x"), F.col("_c").alias("_cx"), n.alias("_nx"), F.col("_i").alias("_ix"))
        has = entry.select("_s", "_class", F.col("_id").alias("_y"), F.col("_c").alias("_cy"), n.alias("_ny"), F.col("_i").alias("_iy"))
        need = F.ceil((F.col("_nx") + F.col("_ny")) * (t / (1 + t)) - 1e-9)
        fits = (F.col("_cx") != F.col("_cy")) & (F.col("_ix") <= F.col("_nx") - need) & (F.col("_iy") <= F.col("_ny") - need)
        return self.ordered(asks.join(has, ["_s", "_class"]).where(fits).select("_x", "_y"))


def listed(n: int):
    """A row for each shingle of a text, with their number."""

    def work(batches):
        for batch in bytestream.slices(batches):
            sets = shingle_sets(batch.column(1).to_pylist(), n)
            sizes = np.array([len(s) for s in sets], np.int32)
            if not sizes.sum():
                continue
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(batch.column(0)), sizes)), pa.array(np.concatenate(sets).view(np.int64)), pa.array(np.repeat(sizes, sizes))], names=["_id", "_s", "_n"])

    return work


def grouped(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """_id, _n (size of the set of n-word shingles), _component: a row for each row of docs.

    Documents are linked if den * intersection >= num * union of their sets. The component is the smallest id that links
    reach. A text without words (null, empty, blank) has an empty set and is linked with nothing. A text of fewer than n
    words has one shingle. Rows that share an id are one node. A row with a null id has no component (null) and links
    nothing. Ids are longs. Other columns are ignored; an empty table gives an empty one."""
    store.ship(docs.sparkSession)
    store.small_batches(docs.sparkSession)
    signed = store.written(docs.select(ident, text).mapInArrow(store.trimmed(sign(n)), SIGNED_DDL), "signed")
    search = Search(docs, signed, n, num, den, ident, text)
    found = search.run()
    narrow = signed.select("_id", "_n", "_set")
    firsts = search.reps.select("_set", "_copies", F.col("_id").alias("_first")).join(found, F.col("_first") == F.col("_id"), "left")
    # a text without copies or links is its own component; copies of one text are dealt over several tasks
    firsts = firsts.where((F.col("_copies") > 1) | F.col("_component").isNotNull()).select("_set", F.coalesce("_component", "_first").alias("_via"))
    placed = narrow.withColumn("_s", salt("_id")).join(salted(firsts), ["_set", "_s"], "left").withColumn("_via", F.when(F.col("_id").isNotNull(), F.coalesce("_via", "_id")))
    # an id of several rows with different sets joins their components
    repeated = narrow.where(F.col("_id").isNotNull()).groupBy("_id").count().where(F.col("count") > 1)
    if repeated.isEmpty():
        return placed.select("_id", "_n", F.col("_via").alias("_component"))
    placed = store.written(placed, "placed")
    more = components(placed.where(F.col("_id") != F.col("_via")).select("_id", "_via"), "_id", "_via")
    return placed.select("_id", "_n").join(more, "_id", "left").select("_id", "_n", F.coalesce("_component", "_id").alias("_component"))


@store.keeps_columns
def representatives(docs: DataFrame, ident: str = "doc_id", **options) -> DataFrame:
    """docs without the documents of a group other than its smallest id. Rows without id stay."""
    gone = grouped(docs, ident=ident, **options).where(F.col("_component") != F.col("_id")).select(F.col("_id").alias("_gone"))
    return docs.join(store.written(gone, "gone"), F.col(ident).cast("long") == F.col("_gone"), "left_anti")
