"""Mixing sources to target weights by Poisson replication.

The mean number of copies of a document of source s is  rate(s) = epochs * weight(s) * all bytes / bytes(s),  so that the
expected share of s in the mixture's bytes is weight(s). How often a document is repeated is drawn by inverting a
Poisson distribution with that mean at a uniform number made from a hash of seed and id: no state, the same result on any
cluster. Documents are exploded by their count and dealt out by a hash of (seed, id, copy), within partitions sorted by
it, which is a random permutation of all rows.

A mean above PART is drawn as the sum of equal parts, each inverted by itself, which is exactly Poisson again. A row draws
SPAN parts. A document with more becomes a row for each block of SPAN parts, dealt out before its copies are made; block
totals are summed up on narrow rows, so that copies are numbered through. So no array and no row grows with the rate.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import store, words

#: Means above this are drawn as a sum of equal parts, so that exp(-mean) stays far from underflow.
PART = 32.0
#: Parts that one row draws: some 2,048 copies.
SPAN = 64
#: Longest array by which a row is exploded into blocks.
FAN = 4_096
#: Up to so many sources (some 1 KB each) their table is broadcast; beyond, it is joined by a shuffle.
BROADCAST_SOURCES = 10_000


def source_key(source: str) -> Column:
    """A key that tells a null source from every other."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null"))


def rates(docs: DataFrame, weights: dict[str | None, float] | None, epochs: float, source: str, text: str) -> DataFrame:
    """_key, _rate, _parts, _cdf of each source. Without weights, sources with any byte get equal ones; with them,
    sources that aren't named get none. Weights are scaled to a sum of 1."""
    size = F.octet_length(words.no_null(F.col(text))).cast("long")
    found = docs.groupBy(source_key(source).alias("_key")).agg(F.sum(size).alias("_bytes"))
    if weights is None:
        w = F.when(F.col("_bytes") > 0, 1.0).otherwise(0.0)
    else:
        given = docs.sparkSession.createDataFrame([("null" if k is None else f"={k}", float(v)) for k, v in weights.items()], "_key string, _given double")
        found = found.join(F.broadcast(given), "_key", "left")
        w = F.when(F.col("_bytes") > 0, F.coalesce("_given", F.lit(0.0))).otherwise(0.0)
    found = found.withColumn("_w", w)
    sums = found.agg(F.sum("_bytes").alias("b"), F.sum("_w").alias("w")).first()
    if not sums["w"]:
        return found.select("_key", F.lit(0.0).alias("_rate"), F.lit(1).cast("long").alias("_parts"), F.array(F.lit(1.0)).alias("_cdf"))
    rate = F.when(F.col("_bytes") > 0, F.lit(epochs * sums["b"] / sums["w"]) * F.col("_w") / F.col("_bytes")).otherwise(0.0)
    parts = F.greatest(F.ceil(F.col("_rate") / PART), F.lit(1)).cast("long")
    mean = F.col("_rate") / F.col("_parts")
    last = int(PART + 12 * math.sqrt(PART) + 20)
    # the distribution function at 0, 1, ..., last; beyond that it is 1 in double precision
    steps = F.aggregate(
        F.sequence(F.lit(1), F.lit(last)),
        F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c")),
        lambda s, k: F.struct((s["p"] * mean / k).alias("p"), F.concat(s["c"], F.array(F.element_at(s["c"], -1) + s["p"] * mean / k)).alias("c")),
    )
    return found.withColumn("_rate", rate).withColumn("_parts", parts).select("_key", "_rate", "_parts", steps["c"].alias("_cdf"))


def hashed(digits: int, *of: Column) -> Column:
    """A long from so many hexadecimal digits of an MD5 hash."""
    text = F.concat_ws("|", *(F.coalesce(x.cast("string"), F.lit("null")) for x in of))
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def uniform(*of: Column) -> Column:
    """In [0, 1), from 52 bits."""
    return hashed(13, *of).cast("double") / F.lit(2.0**52)


def numbered(df: DataFrame, count: Column, most: int, name: str, *keys: str) -> DataFrame:
    """A row for each of 0 ... count - 1 (a long column of at most `most`), in `name`: its digits to the base FAN are
    exploded one after another, and between them rows are dealt out by keys and number."""
    digits = 1
    while FAN**digits < most:
        digits += 1
    df = df.withColumn(name, F.lit(0).cast("long"))
    for d in range(digits - 1, -1, -1):
        unit = FAN**d
        last = F.least(F.lit(FAN - 1).cast("long"), F.floor((count - 1 - F.col(name)) / F.lit(unit)))
        df = df.withColumn("_digit", F.explode(F.sequence(F.lit(0).cast("long"), last))).withColumn(name, F.col(name) + F.col("_digit") * unit).drop("_digit")
        if d:
            df = df.repartition(*keys, name)
    return df


def drawn(seed: str, ident: str, block: Column) -> Column:
    """Copies that the parts of a block give: the sum of what each part's uniform number inverts to."""
    first = block * SPAN
    parts = F.sequence(first + 1, first + F.least(F.lit(SPAN).cast("long"), F.col("_parts") - first))
    draws = F.transform(parts, lambda part: uniform(F.lit(seed), F.col(ident), part))
    one = lambda u: F.size(F.filter(F.col("_cdf"), lambda c: c <= u))
    return F.aggregate(draws, F.lit(0).cast("long"), lambda n, u: n + one(u))


def blocks_of(rows: DataFrame, seed: str, ident: str, most: int) -> DataFrame:
    """rows (with _key, _parts, _cdf) once for each block of parts, with _block and _n, the block's copies."""
    blocks = F.ceil(F.col("_parts") / SPAN)
    return numbered(rows, blocks, most, "_block", ident, "_key").withColumn("_n", drawn(seed, ident, F.col("_block")))


@store.keeps_columns
def replicated(docs: DataFrame, weights: dict[str | None, float] | None = None, epochs: float = 1.0, seed: str = "mix-1", ident: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """A row for each copy: the columns of docs, then _rate, _copies, _copy (from 1) and _order (the shuffle key).

    A null source is a source of its own. A null or empty text has no bytes; where a whole source has none, its rate is
    0. Rows that share an id get the same count. A null id is hashed as such. Rates have no bound. An empty table gives
    an empty one."""
    table = rates(docs, weights, epochs, source, text)
    size = table.agg(F.count(F.lit(1)).alias("n"), F.max("_parts").alias("parts")).first()
    most = -(-(size["parts"] or 1) // SPAN)
    if size["n"] <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    keyed = docs.withColumn("_key", source_key(source)).join(table, "_key").where(F.col("_rate") > 0)
    zero = F.lit(0).cast("long")
    rows = keyed.where(F.col("_parts") <= SPAN).withColumn("_n", drawn(seed, ident, zero)).withColumns({"_first": zero, "_copies": F.col("_n")})
    if most > 1:
        many = keyed.where(F.col("_parts") > SPAN)
        narrow = many.select(F.col(ident), "_key").distinct().join(table, "_key")
        by = Window.partitionBy(ident, "_key")
        sums = blocks_of(narrow, seed, ident, most).select(
            F.col(ident).alias("_of"), F.col("_key").alias("_by"), F.col("_block").alias("_at"), "_n",
            (F.sum("_n").over(by.orderBy("_block")) - F.col("_n")).alias("_first"), F.sum("_n").over(by).alias("_copies"),
        )
        sums = store.written(sums, "blocks")
        each = numbered(many, F.ceil(F.col("_parts") / SPAN), most, "_block", ident, "_key")
        each = each.join(sums, F.col(ident).eqNullSafe(F.col("_of")) & (F.col("_key") == F.col("_by")) & (F.col("_block") == F.col("_at")))
        rows = rows.unionByName(each.drop("_of", "_by", "_at", "_block"))
    copies = rows.where(F.col("_n") > 0).withColumn("_copy", F.explode(F.sequence(F.col("_first") + 1, F.col("_first") + F.col("_n"))))
    mixed = copies.withColumn("_order", hashed(15, F.lit(f"{seed}/order"), F.col(ident), F.col("_copy")))
    return mixed.repartition("_order").sortWithinPartitions("_order").drop("_key", "_parts", "_cdf", "_first", "_n")


@store.keeps_columns
def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mixture with the columns of docs only."""
    return replicated(docs, **options).select(*docs.columns)
