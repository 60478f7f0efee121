"""Quality rules: plain counts, and a hashed n-gram log-likelihood ratio.

Two multinomials over hash buckets of words and word pairs are counted: one over documents that a label calls good (the
trusted target), one over the whole raw corpus. A document's score is the mean, over its n-grams, of
log(target share / raw share) of their buckets. A document is kept if its counts pass and its score is not below a
threshold: no draw, the same verdict each time.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store, words

BUCKETS = 16_384
#: The target is counted over so many good documents at most, those with the smallest hashes of their ids. Their ids are
#: broadcast (8 bytes each). The raw corpus is counted whole.
TRUSTED = 50_000
#: Mean log-likelihood ratio (nats a n-gram) below which a document goes.
THRESHOLD = -0.06
SYMBOLS = r"[^#*$%&|<>]+"


def bucket(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(BUCKETS)).cast("int")


def trusted_ids(labels: DataFrame, ident: str, limit: int) -> DataFrame:
    good = labels.where(F.col("quality") == 1).select(F.col(ident).alias("_good")).where(F.col("_good").isNotNull()).distinct()
    return good.orderBy(F.xxhash64("_good"), "_good").limit(limit)


def log_ratios(docs: DataFrame, labels: DataFrame, ident: str, text: str, limit: int) -> np.ndarray:
    """log(target share / raw share) of each bucket, with 1/2 added to each count; zeros where nothing is trusted."""
    flagged = docs.join(F.broadcast(trusted_ids(labels, ident, limit)), F.col(ident) == F.col("_good"), "left")
    w = flagged.select(F.col("_good").isNotNull().cast("long").alias("_t"), words.words(F.col(text)).alias("_w")).where(F.size("_w") > 0)
    each = w.select("_t", "_w", F.explode(F.sequence(F.lit(0), F.size("_w") - 1)).alias("_p"))
    one, two = F.get("_w", F.col("_p")), F.get("_w", F.col("_p") + 1)
    grams = each.select("_t", F.explode(F.array(bucket(one), F.when(two.isNotNull(), bucket(one, two)))).alias("_b")).where(F.col("_b").isNotNull())
    counts = grams.groupBy("_b").agg(F.count(F.lit(1)).alias("raw"), F.sum("_t").alias("target")).toPandas()  # BUCKETS rows at most
    raw, target = np.full(BUCKETS, 0.5), np.full(BUCKETS, 0.5)
    raw[counts["_b"]] += counts["raw"]
    target[counts["_b"]] += counts["target"]
    if not counts["target"].sum():
        return np.zeros(BUCKETS)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def repeat_words(w: Column) -> Column:
    """Words inside a window of three words that the text holds twice or more. The windows are sorted by hash within the
    row, so a long text takes n log n steps and no shuffle."""
    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda p: F.struct(words.gram_hash(w, p, 3).alias("h"), p.alias("p")))
    return F.when(F.size(w) >= 4, F.array_sort(windows))


def covered(ordered: Column) -> Column:
    twin = lambda x, k: ((k > 0) & (F.get(ordered, k - 1)["h"] == x["h"])) | ((k < F.size(ordered) - 1) & (F.get(ordered, k + 1)["h"] == x["h"]))
    starts = F.array_sort(F.transform(F.filter(ordered, twin), lambda x: x["p"]))
    total = F.aggregate(starts, F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")), lambda s, p: F.struct(p.alias("last"), (s["n"] + F.least(F.lit(3), p - s["last"])).alias("n")))
    return F.coalesce(total["n"], F.lit(0).cast("long"))


@store.keeps_columns
def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, trusted: int = TRUSTED, ident: str = "doc_id", text: str = "text", label_ident: str = "doc_id") -> DataFrame:
    """All columns of docs, then _n_words, _word_chars, _n_symbols, _n_dup_lines, _n_repeat_words, _base_failed, _llr
    and _kept.

    A null text is an empty one: no words, so its counts fail and it isn't kept; its score is 0. Repeated rows and ids
    are judged each by its own text. Without labels all scores are 0. Of equal hashes of ids the smaller id is trusted
    first. An empty table stays empty."""
    ids = labels.select(F.col(label_ident).alias(ident), "quality")
    weights = log_ratios(docs, ids, ident, text, trusted)
    t = words.no_null(F.col(text))
    table = F.lit(weights)  # one literal of BUCKETS doubles
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(words.SPACES)) != "")
    w = F.col("_w")
    at = lambda *x: F.get(table, bucket(*x))
    singles = F.aggregate(w, F.lit(0.0), lambda s, x: s + at(x))
    pairs = F.when(F.size(w) >= 2, F.aggregate(F.sequence(F.lit(0), F.size(w) - 2), F.lit(0.0), lambda s, p: s + at(F.get(w, p), F.get(w, p + 1)))).otherwise(0.0)
    n = F.size(w).cast("long")
    return (
        docs.withColumns({"_w": words.words(F.col(text)), "_lines": lines})
        .withColumns({"_windows": repeat_words(w)})
        .withColumns({
            "_n_words": n, "_word_chars": F.length(F.array_join(w, "")).cast("long"),
            "_n_symbols": F.length(F.regexp_replace(t, SYMBOLS, "")).cast("long"),
            "_n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_n_repeat_words": covered(F.col("_windows")),
            "_llr": F.when(n > 0, (singles + pairs) / (2 * n - 1)).otherwise(0.0),
        })
        .drop("_w", "_lines", "_windows")
        .withColumn("_base_failed", (F.col("_n_words") < 50) | (F.lit(100) * F.col("_n_repeat_words") > F.lit(50) * F.col("_n_words")))
        .withColumn("_kept", ~F.col("_base_failed") & (F.col("_llr") >= threshold))
    )
