"""Interaction of five filters: what each order of them removes, step by step, by direct relational replay.

Each document becomes a row of flags (which filters it fails, which labels it has). Documents of one part with the same
flags fare alike in every order, so tasks add them up first: a part has 32 rows at most, with the documents each stands
for. These are crossed with the 120 orders, a broadcast table of fixed size, and exploded into five steps. The first filter
of an order that a document fails removes it; whatever fails later is redundant. Sums by part, order and step are again made
in tasks before the shuffle. (Replayed one by one, a document is 600 rows; that took 570 CPU seconds a GB.)
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytestream, store, words
from .suffixdedup import encoded

LETTERS = "ABCDE"
#: Failure bounds: fewest words, least percentage of distinct words, highest percentage of capitals, and the marks of D.
LEAST_WORDS, DISTINCT, CAPITALS, MARKS = 50, 65, 5, b"#$%&*|"


def failures(texts: pa.Array) -> pa.Array:
    """Bit k where a text fails filter k of A to D; a null text is empty, and an empty one fails A alone."""
    out = []
    for k in range(0, len(texts), 200):
        for text in encoded(texts.slice(k, 200)):
            n, different = 0, set()
            for some in bytestream.word_lists(text):
                n += len(some)
                different.update(some)
            data = np.frombuffer(text, np.uint8)
            capitals = np.count_nonzero((data >= ord("A")) & (data <= ord("Z")))
            points = np.count_nonzero(data & 0xC0 != 0x80)  # bytes that begin a code point
            fails = (n < LEAST_WORDS, 100 * len(different) < DISTINCT * n, 100 * capitals > CAPITALS * points, any(m in text for m in MARKS))
            out.append(sum(f << b for b, f in enumerate(fails)))
    return pa.array(out, pa.int32())


def flags(docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, fails, good, toxic): a row for each document, fails with bit k set where it fails filter k of LETTERS.

    E fails where a smaller id has the same text, null texts counting as empty; rows without id fail it never and make no
    other fail. Rows equal in id and text don't make each other fail. A document is good or toxic if any label of its id
    says so; labels that are null or of null ids say nothing. A null part is the empty one."""
    store.ship(docs.sparkSession)
    whole = F.md5(words.no_null(F.col(text)).cast("binary")).alias("_sum")
    rows = docs.select(F.col(ident).alias("_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), whole, F.arrow_udf(failures, "int")(F.col(text)).alias("_bits"))
    # a row for each text that several ids have; tasks combine their copies before they hand them on
    same = docs.select(F.col(ident).alias("_id"), whole)
    first = same.groupBy("_sum").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last")).where(F.col("_first") < F.col("_last"))
    rows = rows.join(first, "_sum", "left").select("_id", "part", (F.col("_bits") + F.when(F.col("_id") > F.col("_first"), 1 << 4).otherwise(0)).alias("fails"))
    marks = labels.groupBy(F.col(ident).alias("_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("_good"), F.max((F.col("toxic") == 1).cast("int")).alias("_toxic"))
    rows = rows.join(marks.where(F.col("_id").isNotNull()), "_id", "left")
    return rows.select("part", "fails", F.coalesce("_good", F.lit(0)).alias("good"), F.coalesce("_toxic", F.lit(0)).alias("toxic"))


def orders(spark) -> DataFrame:
    """(filter_order, _bits): the 120 orders and the bit of each step's filter."""
    rows = [("".join(p), [1 << LETTERS.index(x) for x in p]) for p in permutations(LETTERS)]
    return spark.createDataFrame(rows, "filter_order string, _bits array<int>")


def replayed(flagged: DataFrame) -> DataFrame:
    """One row for each part, order and step of flagged (part, fails, good, toxic), zeros included: kept (after the step),
    removed (by it), redundant (failing its filter, removed earlier), unique_fails (failing that filter only), good_lost,
    toxic_lost, and shapley (removed by its filter over all orders). An empty table gives no rows."""
    alike = flagged.groupBy("part", "fails").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col("good").cast("long")).alias("_good"), F.sum(F.col("toxic").cast("long")).alias("_toxic"))
    bit = lambda k: F.get("_bits", F.lit(k))
    first = reduce(lambda rest, k: F.when(F.col("fails").bitwiseAND(bit(k)) != 0, k + 1).otherwise(rest), range(4, -1, -1), F.lit(6))
    crossed = alike.join(F.broadcast(orders(flagged.sparkSession)), how="cross").withColumn("_removed_at", first)  # 120 rows a set of flags
    steps = crossed.select("*", F.posexplode("_bits").alias("_at", "_bit")).withColumn("step", F.col("_at") + 1)
    here = F.col("_removed_at") == F.col("step")
    failing = F.col("fails").bitwiseAND(F.col("_bit")) != 0
    total = lambda when, of="_n": F.sum(F.when(when, F.col(of)).otherwise(F.lit(0).cast("long")))
    sums = steps.groupBy("part", "filter_order", "step", "_bit").agg(
        total(F.col("_removed_at") > F.col("step")).alias("kept"),
        total(here).alias("removed"),
        total(failing & ~here).alias("redundant"),
        total(F.col("fails") == F.col("_bit")).alias("unique_fails"),
        total(here, "_good").alias("good_lost"),
        total(here, "_toxic").alias("toxic_lost"),
    )
    shapley = sums.groupBy("part", "_bit").agg(F.sum("removed").alias("shapley"))  # five rows a part
    return sums.join(shapley, ["part", "_bit"]).drop("_bit")


def audited(docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """The replay of all orders over all documents (see flags and replayed). Columns other than those named are ignored,
    whatever they are called."""
    return replayed(flags(docs, labels, ident, text, part))
