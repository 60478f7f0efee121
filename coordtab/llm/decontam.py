"""Benchmark decontamination: short test items found inside long documents.

Both sides are sets of word shingles, hashed to 64 bits. A document contains an item if it holds at least `threshold` of
the item's shingles. Items are partitioned by set size in powers of two. Of an item whose class ends at size u, the
u - ceil(threshold * u) + 1 smallest hashes are its MinHash sketch. At most that many less one of its shingles can be
missing from a document that contains it, so at least one sketch value occurs in every such document: the search for
sketch values misses nothing, however long the document, and needs no sketch of the long side. What it finds is verified
by exact containment over all shingles of the item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import store, words

WORDS = 5
THRESHOLD = 0.8
#: Item shingles (16 bytes each) and candidate ids up to these numbers are broadcast; beyond, joins shuffle both sides.
BROADCAST_SHINGLES = 500_000
BROADCAST_IDS = 1_000_000


def positions(n_words: Column, n: Column | int) -> Column:
    return F.explode(F.sequence(F.lit(0), n_words - n))


def shingle_rows(rows: DataFrame, ident: str, text: str, n: int) -> DataFrame:
    """_id, _h: a row for each run of n words; the words are lower-cased."""
    split = rows.select(F.col(ident).alias("_id"), words.words(F.lower(F.col(text))).alias("_w")).where(F.size("_w") >= n)
    return split.select("_id", "_w", positions(F.size("_w"), n).alias("_p")).select("_id", words.gram_hash(F.col("_w"), F.col("_p"), n).alias("_h"))


def item_shingles(items: DataFrame, ident: str, text: str, n: int, threshold: float) -> DataFrame:
    """_item, _n (words of a shingle: n, or the item's words if it has fewer), _h, _size (of the item's set), _sketch."""
    split = items.select(F.col(ident).alias("_item"), words.words(F.lower(F.col(text))).alias("_w")).where(F.size("_w") > 0)
    short = F.least(F.size("_w"), F.lit(n))
    each = split.select("_item", "_w", short.alias("_n"), F.explode(F.sequence(F.lit(0), F.size("_w") - short)).alias("_p"))
    h = F.coalesce(*(F.when(F.col("_n") == k, words.gram_hash(F.col("_w"), F.col("_p"), k)) for k in range(1, n + 1)))
    sets = each.select("_item", "_n", h.alias("_h")).distinct()
    by = Window.partitionBy("_item")
    ranked = sets.withColumn("_size", F.count(F.lit(1)).over(by)).withColumn("_rank", F.row_number().over(by.orderBy("_h")))
    top = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("_size"))))
    return ranked.select("_item", "_n", "_h", "_size", (F.col("_rank") <= top - F.ceil(top * threshold) + 1).alias("_sketch"))


def hinted(df: DataFrame, n: int, most: int) -> DataFrame:
    return F.broadcast(df) if n <= most else df


def contained(docs: DataFrame, items: DataFrame, n: int = WORDS, threshold: float = THRESHOLD, ident: str = "doc_id", text: str = "text", item_ident: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, n_item (size of the item's set), n_common, containment: a row for each item in each document.

    Null, empty and blank texts have no shingles: such items are found nowhere, such documents contain nothing. An item
    with fewer than n words is one shingle of all its words, sought among the runs of as many words. Rows that share an
    id are read as one document (or item): their sets are united. Items with equal sets are each reported. Empty tables
    give no rows. Other columns are ignored."""
    docs = docs.select(F.col(ident).alias("_doc"), F.col(text).alias("_t"))
    ident, text = "_doc", "_t"
    sets = store.written(item_shingles(items, item_ident, item_text, n, threshold), "items")
    lengths = [(r["_n"], r["c"], r["s"]) for r in sets.groupBy("_n").agg(F.count(F.lit(1)).alias("c"), F.sum(F.col("_sketch").cast("long")).alias("s")).collect()]  # n rows at most
    if not lengths:
        lengths = [(n, 0, 0)]
    total = sum(c for _, c, _ in lengths)
    found = None
    for k, _, _ in lengths:
        of = hinted(sets.where((F.col("_n") == k) & F.col("_sketch")).select("_item", "_h"), total, BROADCAST_SHINGLES)
        hits = shingle_rows(docs, ident, text, k).join(of, "_h").select("_id", "_item")
        found = hits if found is None else found.unionByName(hits)
    candidates = store.written(found.distinct(), "candidates")
    ids = candidates.select("_id").distinct()
    suspects = docs.join(hinted(ids, ids.count(), BROADCAST_IDS), F.col(ident) == F.col("_id"), "left_semi")
    shared = None
    for k, _, _ in lengths:
        of = hinted(sets.where(F.col("_n") == k).select("_item", "_h", "_size"), total, BROADCAST_SHINGLES)
        hits = shingle_rows(suspects, ident, text, k).join(of, "_h")
        shared = hits if shared is None else shared.unionByName(hits)
    counts = shared.distinct().groupBy("_id", "_item", "_size").agg(F.count(F.lit(1)).alias("_common"))
    return (
        counts.where(F.col("_common") >= F.lit(threshold) * F.col("_size"))
        .join(candidates, ["_id", "_item"], "left_semi")
        .select(F.col("_id").alias("doc_id"), F.col("_item").alias("item_id"), F.col("_size").cast("long").alias("n_item"), F.col("_common").cast("long").alias("n_common"), (F.col("_common") / F.col("_size")).alias("containment"))
    )


@store.keeps_columns
def clean(docs: DataFrame, items: DataFrame, ident: str = "doc_id", **options) -> DataFrame:
    """The documents that contain no item, with all their columns. Documents without id stay."""
    leaks = store.written(contained(docs, items, ident=ident, **options).select(F.col("doc_id").alias("_leak")).distinct(), "leaks")
    return docs.join(hinted(leaks, leaks.count(), BROADCAST_IDS), F.col(ident) == F.col("_leak"), "left_anti")
