"""The thin queries op1_ to op13_: each applies its operator to a whole table and returns the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, codes, decontam, htmltext, langid, lmscore, mixing, neardup, pii, quality, rlz, sharding, suffixdedup


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    out = langid.predicted(table(spark, sf_dir, "documents"))
    return out.select("doc_id", langid.held_out("doc_id").alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))


def op2_htmltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    out = htmltext.extracted(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", F.col("_text").alias("text"), F.length("_text").cast("long").alias("n_chars"))


def op3_suffixdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated passages of 400 bytes."""
    out = suffixdedup.deduplicated(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("_n_bytes").alias("n_bytes"), F.col("_n_removed").alias("n_removed"), F.col("_n_spans").alias("n_spans"), F.col("_sha").alias("kept_sha256"))


OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT r, p, md5(b[p:p + 399]) AS h FROM d, unnest(range(1, octet_length(b) - 398)) AS t(p)),
hits AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY h) AS n FROM w) WHERE n > 1),
marked AS (SELECT r, p, CASE WHEN p - lag(p) OVER (PARTITION BY r ORDER BY p) <= 400 THEN 0 ELSE 1 END AS new FROM hits),
runs AS (SELECT r, min(p) AS a, max(p) + 400 AS z FROM (SELECT r, p, sum(new) OVER (PARTITION BY r ORDER BY p) AS g FROM marked) GROUP BY r, g),
kept AS (SELECT r, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 1) AS a, a AS z FROM runs
         UNION ALL SELECT r, coalesce(max(z), 1), max(octet_length(b)) + 1 FROM d LEFT JOIN runs USING (r) GROUP BY r),
bytes AS (SELECT r, sha256(unhex(string_agg(hex(b[kept.a:kept.z - 1]), '' ORDER BY kept.a))) AS kept_sha256 FROM kept JOIN d USING (r) GROUP BY r),
sums AS (SELECT r, sum(z - a) AS n_removed, count(*) AS n_spans FROM runs GROUP BY r)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, kept_sha256
FROM d JOIN bytes USING (r) LEFT JOIN sums USING (r)
"""


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) with at least 0.8 of the item's five-word shingles in the document."""
    return decontam.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS w FROM benchmark),
items AS (SELECT DISTINCT item_id, least(5, len(w)) AS n, array_to_string(w[p:p + least(5, len(w)) - 1], ' ') AS s
          FROM b, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS t(p) WHERE len(w) > 0),
sizes AS (SELECT item_id, count(*) AS n_item FROM items GROUP BY item_id),
grams AS (SELECT DISTINCT doc_id, n, array_to_string(w[p:p + n - 1], ' ') AS s
          FROM d, (SELECT DISTINCT n FROM items) AS k, unnest(range(1, len(w) - n + 2)) AS t(p)),
common AS (SELECT doc_id, item_id, count(*) AS n_common FROM grams JOIN items USING (n, s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_item, n_common, n_common / n_item AS containment
FROM common JOIN sizes USING (item_id) WHERE 10 * n_common >= 8 * n_item
"""


def op5_lmscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean log score of every document under the three-gram counts of all other documents."""
    out = lmscore.scored(table(spark, sf_dir, "documents"))
    return out.select(F.col("_id").alias("doc_id"), F.col("_words").alias("n_words"), F.round("_logprob", 4).alias("logprob"), F.round("_score", 6).alias("score"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT doc_id, p, len(w) AS m, w[p] AS a, CASE WHEN p > 1 THEN w[p - 1] END AS b, CASE WHEN p > 2 THEN w[p - 2] END AS c FROM d, unnest(range(1, len(w) + 1)) AS u(p)),
one AS (SELECT doc_id, a, sum(n) OVER (PARTITION BY a) - n AS r FROM (SELECT doc_id, a, count(*) AS n FROM t GROUP BY ALL)),
two AS (SELECT doc_id, b, a, sum(n) OVER (PARTITION BY b, a) - n AS r FROM (SELECT doc_id, b, a, count(*) AS n FROM t WHERE b IS NOT NULL GROUP BY ALL)),
three AS (SELECT doc_id, c, b, a, sum(n) OVER (PARTITION BY c, b, a) - n AS r FROM (SELECT doc_id, c, b, a, count(*) AS n FROM t WHERE c IS NOT NULL GROUP BY ALL)),
joined AS (SELECT t.doc_id, CASE WHEN x.r > 0 THEN x.r ELSE 0.5 END / greatest((SELECT count(*) FROM t) - m, 1) AS s1, y.r AS r2, hx.r AS h2, z.r AS r3, hy.r AS h3, t.b, t.c
           FROM t JOIN one AS x ON x.doc_id = t.doc_id AND x.a = t.a
           LEFT JOIN two AS y ON y.doc_id = t.doc_id AND y.b = t.b AND y.a = t.a LEFT JOIN one AS hx ON hx.doc_id = t.doc_id AND hx.a = t.b
           LEFT JOIN three AS z ON z.doc_id = t.doc_id AND z.c = t.c AND z.b = t.b AND z.a = t.a LEFT JOIN two AS hy ON hy.doc_id = t.doc_id AND hy.b = t.c AND hy.a = t.b),
backed AS (SELECT doc_id, c, r3, h3, CASE WHEN b IS NULL THEN s1 WHEN r2 > 0 THEN r2 / h2 ELSE 0.4 * s1 END AS s2 FROM joined),
sums AS (SELECT doc_id, sum(ln(CASE WHEN c IS NULL THEN s2 WHEN r3 > 0 THEN r3 / h3 ELSE 0.4 * s2 END)) AS l FROM backed GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, round(coalesce(l, 0), 4) AS logprob, round(l / len(w), 6) AS score FROM d LEFT JOIN sums USING (doc_id)
"""


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes."""
    return sharding.shard_slots(table(spark, sf_dir, "documents"))


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the group of documents whose sets of word pairs are 0.8 alike or more."""
    out = neardup.grouped(table(spark, sf_dir, "documents"), n=2)
    kept = F.coalesce(F.col("_id") == F.col("_component"), F.lit(True))
    return out.select(F.col("_id").alias("doc_id"), F.col("_n").alias("n_shingles"), F.col("_component").alias("component_id"), kept.alias("kept"))


OP7_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 1], ' ') AS s FROM d, unnest(range(1, greatest(len(w), 2))) AS t(p) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM sets AS a JOIN sets AS b USING (s) WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN sizes AS p ON p.doc_id = x JOIN sizes AS q ON q.doc_id = y WHERE 100 * common.n >= 80 * (p.n + q.n - common.n)),
edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, edges.y FROM reach JOIN edges ON edges.x = reach.y),
least_ AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM least_ LEFT JOIN sizes USING (doc_id)
"""


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents replicated so that every source has the same share of bytes."""
    out = mixing.replicated(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", F.col("_rate").alias("rate"), F.col("_copies").alias("copies"), F.col("_copy").alias("copy"), F.col("_order").alias("shuffle_key"))


OP8_SQL = """
WITH s AS (SELECT source, sum(strlen(coalesce(text, ''))) AS n FROM documents GROUP BY source),
r AS (SELECT source, (SELECT 1.0::DOUBLE * sum(n) / (count(*) FILTER (n > 0))::DOUBLE FROM s) * 1.0::DOUBLE / n AS rate FROM s WHERE n > 0),
p AS (SELECT source, rate, greatest(CAST(ceil(rate / 32.0) AS BIGINT), 1) AS parts FROM r),
c AS (SELECT source, k, sum(exp(-rate / parts + k * ln(rate / parts) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS f FROM p, unnest(range(0, 120)) AS t(k)),
u AS (SELECT doc_id, source, rate, q, CAST('0x' || substr(md5('mix-1|' || doc_id || '|' || q), 1, 13) AS BIGINT) / pow(2.0, 52) AS u FROM documents JOIN p USING (source), unnest(range(1, parts + 1)) AS t(q)),
n AS (SELECT doc_id, source, rate, sum((SELECT count(*) FROM c WHERE c.source = u.source AND c.f <= u.u)) AS copies FROM u GROUP BY doc_id, source, rate)
SELECT doc_id, source, rate, CAST(copies AS BIGINT) AS copies, CAST(copy AS BIGINT) AS copy, CAST('0x' || substr(md5('mix-1/order|' || doc_id || '|' || copy), 1, 15) AS BIGINT) AS shuffle_key
FROM n, unnest(range(1, CAST(copies AS BIGINT) + 1)) AS t(copy)
"""


#: The query's rows must be the same wherever it runs, so its key is public; in production the key is a secret.
OP9_KEY = "a public key"


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced by pseudonyms, and how many of each kind were replaced."""
    out = pii.pseudonymised(table(spark, sf_dir, "documents"), OP9_KEY)
    of = lambda kind: F.size(F.filter("_found", lambda x: x["kind"] == kind))
    counts = [of(kind).alias(f"n_{kind}") for kind in pii.KINDS]
    return out.select("doc_id", "text", *counts)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, log-likelihood ratio and verdict of every document."""
    out = quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")
    return out.select("doc_id", *(F.col(f"_{x}").alias(x) for x in names))


def op11_rlz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the passages of 50 words that start in an earlier one."""
    out = rlz.deduplicated(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"), F.col("_sha").alias("kept_sha256"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS w FROM documents),
windows AS (SELECT r, doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS h FROM d, unnest(range(1, len(w) - 48)) AS t(p)),
firsts AS (SELECT h, min(doc_id) AS f FROM windows GROUP BY h),
gone AS (SELECT DISTINCT r, p + k AS q FROM windows JOIN firsts USING (h), range(0, 50) AS o(k) WHERE doc_id > f),
each AS (SELECT r, q, w[q] AS word FROM d, unnest(range(1, len(w) + 1)) AS t(q)),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY q) AS t FROM each ANTI JOIN gone USING (r, q) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""


def op12_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from every source in each of their 120 orders, step by step."""
    return audit.audited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS w FROM documents),
m AS (SELECT text, min(doc_id) AS least_id FROM t GROUP BY text),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, map {
        'A': len(w) < 50, 'B': 100 * len(list_distinct(w)) < 65 * len(w),
        'C': 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text),
        'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(t.doc_id > least_id, false)} AS fails
      FROM t JOIN m USING (text) LEFT JOIN l ON l.doc_id = t.doc_id),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x AS a, x AS b, x AS c, x AS d, x AS e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT part, filter_order, step, filter_order[step] AS letter, good, toxic, fails, fails[filter_order[step]] AS failing,
        len(list_filter(string_split(filter_order[1:step - 1], ''), lambda y: y <> '' AND fails[y])) > 0 AS gone
      FROM f, o, range(1, 6) AS r(step)),
q AS (SELECT part, filter_order, step, letter, count(*) FILTER (NOT gone AND NOT failing) AS kept, count(*) FILTER (failing AND NOT gone) AS removed,
        count(*) FILTER (failing AND gone) AS redundant, count(*) FILTER (failing AND len(list_filter(map_values(fails), lambda y: y)) = 1) AS unique_fails,
        count(*) FILTER (failing AND NOT gone AND good) AS good_lost, count(*) FILTER (failing AND NOT gone AND toxic) AS toxic_lost
      FROM s GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM q
"""


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector as 16 indexes into codebooks of 64 entries, with its error and that of its label."""
    out = codes.compressed(table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", F.lower(F.hex("_code")).alias("code"), F.col("_error").alias("error"), F.col("_label_error").alias("label_error"), F.col("_books").alias("codebooks_sha256"))


#: The codebooks' sums and the codes of one round, of vectors v (r, p, q, x) and codebooks (p, e, q, x).
OP13_ROUND = """
{d} AS (SELECT r, p, e, sum((v.x - b.x) * (v.x - b.x)) AS d FROM v JOIN {book} AS b USING (p, q) GROUP BY r, p, e),
{a} AS (SELECT r, p, min(d) AS d, arg_min(e, (d, e)) AS e FROM {d} GROUP BY r, p)"""
OP13_MOVE = """
{new} AS (SELECT p, e, q, coalesce(CAST(floor(m) AS BIGINT), x) AS x FROM {book} LEFT JOIN (SELECT p, e, q, sum(x)::DOUBLE / count(*) AS m FROM {a} JOIN v USING (r, p) GROUP BY p, e, q) USING (p, e, q))"""
OP13_SQL = (
    """
WITH k AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, * FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
v AS (SELECT r, (n - 1) // 4 AS p, (n - 1) % 4 AS q, CAST(floor(256 * CAST(embedding[n] AS DOUBLE)) AS BIGINT) AS x FROM k, range(1, 65) AS t(n)),
b0 AS (SELECT p, r AS e, q, x FROM v WHERE r < 64),"""
    + ",".join(OP13_ROUND.format(d=f"d{n}", a=f"a{n}", book=f"b{n}") + "," + OP13_MOVE.format(new=f"b{n + 1}", book=f"b{n}", a=f"a{n}") for n in range(2))
    + ","
    + OP13_ROUND.format(d="d2", a="a2", book="b2")
    + """,
s AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(x, ',' ORDER BY p, e, q)) FROM b2) AS codebooks_sha256 FROM s JOIN k USING (r)
"""
)


def queries():
    return {
        "op1_langid": op1_langid,
        "op2_htmltext": op2_htmltext,
        "op3_suffixdedup": op3_suffixdedup,
        "op4_decontamination": op4_decontamination,
        "op5_lmscore": op5_lmscore,
        "op6_sharding": op6_sharding,
        "op7_neardup": op7_neardup,
        "op8_mixing": op8_mixing,
        "op9_pii": op9_pii,
        "op10_quality": op10_quality,
        "op11_rlz": op11_rlz,
        "op12_audit": op12_audit,
        "op13_codes": op13_codes,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_suffixdedup": OP3_SQL, "op4_decontamination": OP4_SQL, "op5_lmscore": OP5_SQL, "op7_neardup": OP7_SQL, "op8_mixing": OP8_SQL, "op11_rlz": OP11_SQL, "op12_audit": OP12_SQL, "op13_codes": OP13_SQL}
