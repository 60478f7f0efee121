"""Relative Lempel-Ziv parsing, the filter audit and vector codes against brute force."""

import collections
import hashlib
import itertools
import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from coordtab.llm import audit, codes, queries, rlz

SF = "/root/testdata/sf0.001"
DDL = "doc_id long, text string, source string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# ---------------------------------------------------------------- 11


def brute_kept(rows, width):
    """(id, text) -> the words kept."""
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - width + 1 if i is not None else 0):
            g = tuple(w[k : k + width])
            first[g] = min(first.get(g, i), i)
    out = {}
    for i, t in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - width + 1 if i is not None else 0):
            if first[tuple(w[k : k + width])] < i:
                gone.update(range(k, k + width))
        out[i, t] = [x for k, x in enumerate(w) if k not in gone]
    return out


def checked_passages(spark, rows, width, **options):
    table = spark.createDataFrame([(i, t, "s") for i, t in rows], DDL).withColumns({"_h": F.lit("clash"), "_id": F.lit("clash"), "_sha": F.lit("clash")})
    out = rlz.deduplicated(table, width=width, **options)
    assert len(out.columns) == len(set(out.columns)) and out.select("_h", "_id").distinct().collect() == [("clash", "clash")]
    out, expected = out.collect(), brute_kept(rows, width)
    assert collections.Counter((r.doc_id, r.text) for r in out) == collections.Counter(rows)
    for r in out:
        kept = expected[r.doc_id, r.text]
        assert (r._n_words, r._n_removed) == (len(words(r.text)), len(words(r.text)) - len(kept)), r.doc_id
        assert r._sha == hashlib.sha256(" ".join(kept).encode()).hexdigest()
        assert r._kept == (" ".join(kept) if r._n_removed else None)


@pytest.mark.parametrize("width, key, hot, block", [(8, 3, 2_000, 4_000), (8, 3, 3, 10), (5, 5, 2_000, 7)])
def test_passages_against_brute_force(spark, width, key, hot, block):
    rng = random.Random(width + hot)
    vocabulary = [f"w{k}" for k in range(30)] + ["ä", "字"]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randrange(4, 30))] for _ in range(8)]
    rows = []
    for i in range(150):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 25))]
        for _ in range(rng.randrange(0, 4)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            at = rng.randrange(len(w) + 1)
            w[at:at] = p[a : a + rng.randrange(3, 30)] * rng.randrange(1, 3)
        rows.append((i // 2 if i % 10 == 0 else i, rng.choice([" ", "\n", " \t "]).join(w)))
    rows += [(None, rows[3][1]), (None, None), (200, None), (201, ""), (202, " \n"), rows[5], rows[5], (203, "a " * 300), (204, "a " * 9), (-4, rows[7][1])]
    checked_passages(spark, rows, width, key=key, hot=hot, block=block)


def test_long_texts_are_cut_without_a_seam(spark, monkeypatch):
    monkeypatch.setattr(rlz, "CHUNK", 40)
    rng = random.Random(3)
    texts = [np.array([rng.randrange(1 << 60) for _ in range(500)], np.uint64), np.array([7] * 130, np.uint64), np.arange(30, dtype=np.uint64)]
    texts.append(np.concatenate([texts[0][100:300], texts[1]]))

    def found():
        return {tuple(map(int, x)) for x in zip(*rlz.entries_of(texts, 20, 6))}

    cut = found()
    monkeypatch.setattr(rlz, "CHUNK", 1 << 17)
    assert found() == cut


def test_longest_earlier_and_factors():
    rng = random.Random(5)
    texts = [[rng.randrange(3) for _ in range(rng.randrange(1, 90))] for _ in range(12)]
    owner = [k // 2 for k in range(12)]  # two texts of each document
    stream, of, text = [], [], []
    for k, t in enumerate(texts):
        stream += [x + 12 for x in t] + [k]
        of += [owner[k]] * (len(t) + 1)
        text += [k] * (len(t) + 1)
    got = rlz.longest_earlier(np.array(stream), np.array(of))

    def common(p, q):
        n = 0
        while max(p, q) + n < len(stream) and stream[p + n] == stream[q + n] and n < rlz.LONGEST:
            n += 1
        return n

    expected = [max([common(p, q) for q in range(len(stream)) if of[q] < of[p]], default=0) for p in range(len(stream))]
    assert got.tolist() == expected
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes) + np.arange(12)
    start, end = rlz.factors(got, ends - sizes, ends)
    assert [x for s, e in zip(start, end) for x in range(s, e)] == [k for k in range(len(stream)) if k not in set(ends)]
    for width in (4, 9, 64):
        hits = rlz.repeated_windows(start, end, got, np.array(text), width)
        assert hits.tolist() == [p for p in range(len(stream)) if expected[p] >= width]


def test_passages_of_an_empty_table(spark):
    assert rlz.deduplicated(spark.createDataFrame([], DDL)).count() == 0
    with pytest.raises(ValueError):
        rlz.deduplicated(spark.createDataFrame([], DDL), width=100)


# ---------------------------------------------------------------- 12


def brute_audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    out = collections.defaultdict(collections.Counter)
    shapley = collections.Counter()
    for i, t, p in rows:
        t, w = t or "", words(t)
        fails = {x for x, bad in zip("ABCDE", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), re.search(r"[#$%&*|]", t), i is not None and i > least[t])) if bad}
        for order in itertools.permutations("ABCDE"):
            gone = False
            for step, x in enumerate(order, 1):
                c = out[p or "", "".join(order), step]
                here = not gone and x in fails
                c["kept"] += not gone and not here
                c["removed"] += here
                c["redundant"] += gone and x in fails
                c["unique_fails"] += fails == {x}
                c["good_lost"] += here and i in good
                c["toxic_lost"] += here and i in toxic
                shapley[p or "", x] += here
                gone |= here
    return {k: (*(c[n] for n in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")), shapley[k[0], k[1][k[2] - 1]]) for k, c in out.items()}


def test_audit_against_brute_force(spark):
    real = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").limit(60)
    rows = [tuple(r) for r in real.collect()]
    rows += [(None, None, None), (None, "x " * 60, "s"), (500, None, ""), (501, "", None), (502, " \n", "alone"), rows[0], (503, rows[0][1], None), (504, "A#b", "s"), (505, "Wort " * 20_000, "s"), (506, "日本 " * 55, "s"), (505, "Wort " * 20_000, "s")]
    labels = [(0, 1, 0), (0, None, 1), (1, 0, 1), (2, None, None), (None, 1, 1), (503, 1, 1), (503, 1, 1), (9999, 1, 1), (505, 1, 0)]
    table = spark.createDataFrame(rows, DDL).withColumns({"quality": F.lit(1), "toxic": F.lit(1), "fails": F.lit(31), "part": F.lit("clash"), "_id": F.lit(0), "step": F.lit(9)})
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumns({"part": F.lit("clash"), "_good": F.lit(0)})
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in audit.audited(table, marks).collect()}
    assert got == brute_audit(rows, labels)
    assert len(got) == 600 * len({r[2] or "" for r in rows})


def test_audit_of_empty_tables(spark):
    none, labels = spark.createDataFrame([], DDL), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audited(none, labels).count() == 0
    one = audit.audited(spark.createDataFrame([(1, "a b", None)], DDL), labels)
    assert one.count() == 600 and one.agg(F.sum("removed")).first()[0] == 120


def test_audit_sums_are_made_before_the_shuffle(spark):
    plan = audit.replayed(spark.createDataFrame([("s", 3, 1, 0)], "part string, fails int, good int, toxic int"))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and plan.count("partial_sum") >= 6


# ---------------------------------------------------------------- 13


def brute_codes(rows, parts, entries, rounds):
    kept = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return {}
    dim = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == dim]
    width = -(-dim // parts)
    cut = lambda v: [tuple(([math.floor(256 * x) for x in v] + [0] * (width * parts - dim))[p * width : (p + 1) * width]) for p in range(parts)]
    vectors = [cut(r[1]) for r in kept]
    books = [[v[p] for v in vectors[:entries]] for p in range(parts)]
    nearest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = collections.defaultdict(list)
            for v in vectors:
                own[nearest(v[p], books[p])[1]].append(v[p])
            for k, xs in own.items():
                books[p][k] = tuple(sum(c) // len(xs) for c in zip(*xs))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    coded = [[nearest(v[p], books[p]) for p in range(parts)] for v in vectors]
    label = collections.Counter()
    for r, c in zip(kept, coded):
        label[r[2]] += sum(d for d, _ in c)
    return collections.Counter((r[0], bytes(k for _, k in c), sum(d for d, _ in c), label[r[2]], digest) for r, c in zip(kept, coded))


VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("dim, parts, entries, n", [(8, 4, 16, 200), (7, 4, 8, 60), (8, 2, 64, 20)])
def test_codes_against_brute_force(spark, dim, parts, entries, n):
    rng = random.Random(dim + n)
    f32 = lambda x: float(np.float32(x))
    rows = [(k * 3 % n, [f32(rng.choice([0, 0.25, -0.25, rng.gauss(0, 1), rng.gauss(0, 50)])) for _ in range(dim)], rng.choice([None, 1, 2])) for k in range(n)]
    rows += [rows[0], rows[0], (None, rows[1][1], None), (0, rows[2][1], 7), (-5, None, 1), (-6, [], 1), (-7, [None] * dim, 1), (-8, [float("nan")] * dim, 1), (-9, [1.0] * (dim - 1) + [float("-inf")], 2), (n, [1.0] * (dim + 1), 1)]
    table = spark.createDataFrame(rows, VECTORS).repartition(5).withColumns({"_code": F.lit("clash"), "_of": F.lit("clash"), "_n": F.lit("clash")})
    out = codes.compressed(table, parts=parts, entries=entries)
    assert set(table.columns) <= set(out.columns) and out.select("_of", "_n").distinct().collect() == [("clash", "clash")]
    got = collections.Counter((r.vec_id, bytes(r._code), r._error, r._label_error, r._books) for r in out.collect())
    assert got == brute_codes(rows, parts, entries, 2)


def test_annuli_find_the_nearest_entry():
    rng = np.random.default_rng(1)
    for spread in (2, 40, 100_000):
        book, x = rng.integers(-spread, spread, (64, 4)), rng.integers(-spread, spread, (3_000, 4))
        x[:64] = book
        index, square = codes.Annuli(book).nearest(x)
        every = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        assert (square == every.min(axis=1)).all() and (index == every.argmin(axis=1)).all()


def test_vectors_that_cant_be_coded(spark):
    none = spark.createDataFrame([], VECTORS)
    assert codes.compressed(none).count() == 0
    assert codes.compressed(spark.createDataFrame([(1, None, 1), (2, [], None)], VECTORS)).count() == 0
    with pytest.raises(Exception, match="can't be compressed"):
        codes.compressed(spark.createDataFrame([(1, [2.0**21] * 16, 1)], VECTORS)).count()


# ---------------------------------------------------------------- queries


@pytest.mark.parametrize("name", ["op11_rlz", "op12_audit", "op13_codes"])
def test_queries_match_their_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "labels", "embeddings"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    expected, got = db.execute(queries.oracle_sql()[name]).df(), queries.queries()[name](spark, SF).toPandas()
    columns = sorted(expected.columns)
    assert sorted(got.columns) == columns
    a, b = (x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (got, expected))
    assert a.equals(b)
