"""Every registered query of the matrix operators, with the SQL that must return the same rows.

The driver's tables serve as matrices: lineitem is sparse (order x part, quantity), orders gives a list of entries with
positions, part and orders give vectors. Values are whole numbers where sums are compared, so that the order of additions
doesn't matter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import storage
from ..functions import cplx, morton
from ..meta import Field, Kind, Layout, Meta, Symmetry
from ..operators import entries as en
from ..operators import generate, graphs, halo, integers, multilevel, products, solver, spy, tiles
from ..operators import partitioning as pt
from ..operators import permutations as pe
from ..operators import vectors as ve
from ..sources import datasource, mtx
from ..streaming import assemble as streaming

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

#: Common table expressions that the SQL uses.
VIEWS = """
e AS (SELECT o_orderkey AS k, o_custkey % 100 + 1 AS i, o_orderkey % 7 + 1 AS j, CAST(floor(o_totalprice) AS BIGINT) AS a FROM orders),
s AS (SELECT k, greatest(i, j * 9) AS i, least(i, j * 9) AS j, CAST(a AS DOUBLE) AS a FROM e),
l AS (SELECT l_orderkey + 1 AS i, l_partkey + 1 AS j, l_quantity AS a FROM lineitem),
x AS (SELECT p_partkey + 1 AS i, CAST(p_size AS DOUBLE) AS a FROM part),
y AS (SELECT o_orderkey AS i, floor(o_totalprice) AS a FROM orders),
p AS (SELECT o_orderkey AS i, CAST(o_custkey AS DOUBLE) AS a FROM orders WHERE o_orderpriority = '1-URGENT'),
q AS (SELECT o_orderkey AS i, floor(o_totalprice) AS a FROM orders WHERE o_orderstatus = 'F' OR o_orderpriority = '1-URGENT'),
z AS (SELECT l_orderkey + 1 AS i, l_partkey + 1 AS j, l_quantity AS re, CAST(l_linenumber AS DOUBLE) AS im FROM lineitem),
c AS (SELECT o_orderkey AS i, CAST(o_custkey % 50 AS DOUBLE) AS re, CAST(o_orderkey % 11 AS DOUBLE) - 5 AS im FROM orders),
r AS (SELECT o_orderkey AS src, (o_orderkey * 7 + 3) % (SELECT count(*) FROM orders) AS dst FROM orders),
v AS (SELECT l_orderkey AS value, l_returnflag AS f FROM lineitem),
w AS (SELECT o_orderkey AS k, o_custkey + 1 AS i, (o_orderkey * 7 + 3) % (SELECT count(*) FROM customer) + 1 AS j, 1.0::DOUBLE AS a FROM orders)
"""


class Tables:
    """The same relations as frames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def n_orders(self) -> int:
        return self.read("orders").count()

    @property
    def e(self) -> DataFrame:
        return self.read("orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 100 + 1).alias("i"), (F.col("o_orderkey") % 7 + 1).alias("j"), F.floor("o_totalprice").cast("long").alias("a"))

    @property
    def s(self) -> DataFrame:
        return self.e.select("k", F.greatest(F.col("i"), F.col("j") * 9).alias("i"), F.least(F.col("i"), F.col("j") * 9).alias("j"), F.col("a").cast("double").alias("a"))

    @property
    def l(self) -> DataFrame:  # noqa: E743
        return en.matrix(self.read("lineitem"), "l_orderkey", "l_partkey", "l_quantity")

    @property
    def x(self) -> DataFrame:
        return ve.vector(self.read("part"), F.col("p_partkey") + 1, F.col("p_size").cast("double"))

    @property
    def y(self) -> DataFrame:
        return ve.vector(self.read("orders"), "o_orderkey", F.floor("o_totalprice").cast("double"))

    @property
    def p(self) -> DataFrame:
        return ve.vector(self.read("orders").where(F.col("o_orderpriority") == "1-URGENT"), "o_orderkey", F.col("o_custkey").cast("double"))

    @property
    def q(self) -> DataFrame:
        return ve.vector(self.read("orders").where("o_orderstatus = 'F' OR o_orderpriority = '1-URGENT'"), "o_orderkey", F.floor("o_totalprice").cast("double"))

    @property
    def z(self) -> DataFrame:
        return self.read("lineitem").select((F.col("l_orderkey") + 1).alias("i"), (F.col("l_partkey") + 1).alias("j"), cplx.cx(F.col("l_quantity"), F.col("l_linenumber").cast("double")).alias("a"))

    @property
    def c(self) -> DataFrame:
        return self.read("orders").select(F.col("o_orderkey").alias("i"), cplx.cx((F.col("o_custkey") % 50).cast("double"), (F.col("o_orderkey") % 11).cast("double") - 5).alias("a"))

    @property
    def r(self) -> DataFrame:
        return self.read("orders").select(F.col("o_orderkey").alias("src"), ((F.col("o_orderkey") * 7 + 3) % self.n_orders).alias("dst"))

    def v(self, flag: str) -> DataFrame:
        return integers.values(self.read("lineitem").where(F.col("l_returnflag") == flag), "l_orderkey")

    @property
    def n_customers(self) -> int:
        return self.read("customer").count()

    @property
    def w(self) -> DataFrame:
        """A graph of the customers that grows with the tables."""
        return self.read("orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") + 1).alias("i"), ((F.col("o_orderkey") * 7 + 3) % self.n_customers + 1).alias("j"), F.lit(1.0).alias("a"))


def parts(df: DataFrame) -> DataFrame:
    """A complex column as two."""
    return df.select("*", F.col("a.re").alias("re"), F.col("a.im").alias("im")).drop("a")


def query(name: str, sql: str | None = None):
    """Registers a function of Tables; the SQL may use VIEWS, unless it brings its own WITH."""

    def register(f: Callable[[Tables], DataFrame]):
        _QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            _SQL[name] = sql if sql.lstrip().startswith("WITH") else f"WITH {VIEWS.strip()} {sql}"
        return f

    return register


# ---------------------------------------------------------------- products

query("gemv_n", "SELECT l.i, sum(l.a * x.a) AS a FROM l JOIN x ON l.j = x.i GROUP BY l.i")(lambda t: products.gemv(t.l, t.x))
query("gemv_t", "SELECT l.j AS i, sum(l.a * y.a) AS a FROM l JOIN y ON l.i = y.i + 1 GROUP BY l.j")(lambda t: products.gemv(t.l, t.y.withColumn("i", F.col("i") + 1), trans="trans"))
query("gemv_alpha_beta", "SELECT o_orderkey + 1 AS i, 2 * coalesce(g.a, 0) + 3 * floor(o_totalprice) AS a FROM orders LEFT JOIN (SELECT l.i, sum(l.a * x.a) AS a FROM l JOIN x ON l.j = x.i GROUP BY l.i) AS g ON g.i = o_orderkey + 1")(
    lambda t: products.gemv(t.l, t.x, t.y.withColumn("i", F.col("i") + 1), alpha=2.0, beta=3.0)
)
query("gemv_symmetric", "SELECT f.i, sum(f.a * (f.j % 10)) AS a FROM (SELECT i, j, a FROM s UNION ALL SELECT j, i, a FROM s WHERE i <> j) AS f GROUP BY f.i")(
    lambda t: products.gemv(t.s, t.spark.range(1, 101).select(F.col("id").alias("i"), (F.col("id") % 10).cast("double").alias("a")), symmetry="symmetric")
)
query("gemv_skew", "SELECT f.i, sum(f.a * (f.j % 10)) AS a FROM (SELECT i, j, a FROM s UNION ALL SELECT j, i, -a FROM s WHERE i <> j) AS f GROUP BY f.i")(
    lambda t: products.gemv(t.s, t.spark.range(1, 101).select(F.col("id").alias("i"), (F.col("id") % 10).cast("double").alias("a")), symmetry="skew-symmetric")
)
query("gemv_integer", "SELECT i, CAST(2 * sum(a * j) AS BIGINT) AS a FROM e GROUP BY i")(
    lambda t: products.gemv(t.e, t.spark.range(1, 8).select(F.col("id").alias("i"), F.col("id").alias("a")), alpha=2)
)
query("gemv_pattern", "SELECT l.i, sum(x.a) AS a FROM l JOIN x ON l.j = x.i GROUP BY l.i")(lambda t: products.gemv(t.l.drop("a"), t.x))
query("gemv_complex", "SELECT z.i, 2 * sum(z.re * c.re - z.im * c.im) - 3 * sum(z.re * c.im + z.im * c.re) AS re, 2 * sum(z.re * c.im + z.im * c.re) + 3 * sum(z.re * c.re - z.im * c.im) AS im FROM z JOIN c ON z.j = c.i + 1 GROUP BY z.i")(
    lambda t: parts(products.gemv(t.z, t.c.withColumn("i", F.col("i") + 1), alpha=2 + 3j))
)
query("gemv_complex_h", "SELECT z.j AS i, sum(z.re * c.re + z.im * c.im) AS re, sum(z.re * c.im - z.im * c.re) AS im FROM z JOIN c ON z.i = c.i + 1 GROUP BY z.j")(
    lambda t: parts(products.gemv(t.z, t.c.withColumn("i", F.col("i") + 1), trans="conjtrans"))
)
query("gemm_sparse", "SELECT a.i, b.i AS j, sum(a.a * b.a) AS a FROM (SELECT l_suppkey + 1 AS i, l_partkey + 1 AS j, l_quantity AS a FROM lineitem) AS a JOIN (SELECT l_suppkey + 1 AS i, l_partkey + 1 AS j, l_quantity AS a FROM lineitem) AS b USING (j) GROUP BY a.i, b.i")(
    lambda t: products.gemm(m := en.matrix(t.read("lineitem"), "l_suppkey", "l_partkey", "l_quantity"), m, trans_b="trans")
)
query("gemm_beta", "SELECT i, j, 2 * coalesce(g, 0) + 3 * coalesce(c, 0) AS a FROM (SELECT a.j AS i, b.j, CAST(sum(a.a * b.a) AS DOUBLE) AS g FROM e AS a JOIN (SELECT i, j, CAST(sum(1) AS BIGINT) AS a FROM e GROUP BY i, j) AS b ON a.i = b.i GROUP BY a.j, b.j) AS p FULL JOIN (SELECT n_nationkey + 1 AS i, n_regionkey + 1 AS j, CAST(n_nationkey AS DOUBLE) AS c FROM nation) AS q USING (i, j)")(
    lambda t: products.gemm(t.e.withColumn("a", F.col("a").cast("double")), en.assemble(t.e.withColumn("a", F.lit(1.0))), en.matrix(t.read("nation"), "n_nationkey", "n_regionkey", F.col("n_nationkey").cast("double")), alpha=2.0, beta=3.0, trans_a="trans")
)
query("gemm_dense", "WITH m AS (SELECT p_partkey % 96 + 1 AS i, p_size AS j, CAST(sum(p_partkey % 13 + 1) AS DOUBLE) AS a FROM part GROUP BY ALL) SELECT x.j AS i, y.j, sum(x.a * y.a) AS a FROM m AS x JOIN m AS y USING (i) GROUP BY x.j, y.j")(
    lambda t: products.gemm_dense(m := en.assemble(en.matrix(t.read("part"), F.col("p_partkey") % 96, F.col("p_size") - 1, (F.col("p_partkey") % 13 + 1).cast("double"))), m, trans_a="trans", tile=32)
)
query("gemv_dense_embeddings", "SELECT vec_id + 1 AS i, round(sum(e), 4) AS a FROM (SELECT vec_id, unnest(embedding) AS e FROM embeddings) GROUP BY vec_id")(
    lambda t: products.gemv(en.from_dense(t.read("embeddings"), "vec_id", "embedding").withColumn("a", F.col("a").cast("double")), ve.constant(t.spark, 64, 1.0).withColumn("i", F.col("i") + 1)).withColumn("a", F.round("a", 4))
)
query("flops", "SELECT 'gemv' AS operation, CAST(3 * count(*) AS BIGINT) AS flops FROM lineitem UNION ALL SELECT 'dot', CAST(2 * count(*) AS BIGINT) FROM orders")(
    lambda t: t.spark.createDataFrame([("gemv", products.flops("gemv", t.l.count())), ("dot", products.flops("dot", t.y.count()))], "operation string, flops long")
)

# ---------------------------------------------------------------- entries

query("assemble", "SELECT i, j, sum(a) AS a FROM l GROUP BY i, j")(lambda t: en.assemble(t.l))
query("assemble_sorted", "SELECT row_number() OVER (ORDER BY i, j) - 1 AS k, i, j, CAST(sum(a) AS BIGINT) AS a FROM e GROUP BY i, j")(lambda t: en.assemble(t.e.drop("k"), "row-major"))
query("assemble_pattern", "SELECT DISTINCT i, j FROM l")(lambda t: en.assemble(t.l.drop("a")))
query("assemble_complex", "SELECT i, j, sum(re) AS re, sum(im) AS im FROM z GROUP BY i, j")(lambda t: parts(en.assemble(t.z)))
RUNS = "t AS (SELECT *, CASE WHEN i = lag(i) OVER (ORDER BY k) AND j = lag(j) OVER (ORDER BY k) THEN 0 ELSE 1 END AS f FROM (SELECT o_orderkey AS k, o_orderkey // 3 % 5 + 1 AS i, o_orderkey // 4 % 2 + 1 AS j, a FROM orders JOIN e ON o_orderkey = k)), u AS (SELECT *, sum(f) OVER (ORDER BY k) AS run FROM t)"


def runs(t: Tables) -> DataFrame:
    return t.e.select("k", (F.expr("k div 3") % 5 + 1).alias("i"), (F.expr("k div 4") % 2 + 1).alias("j"), "a")


query("compact", f"WITH {VIEWS.strip()}, {RUNS} SELECT CAST(run - 1 AS BIGINT) AS k, min(i) AS i, min(j) AS j, CAST(sum(a) AS BIGINT) AS a, count(*) AS lines FROM u GROUP BY run")(lambda t: en.compact(runs(t)))
query("compact_map", f"WITH {VIEWS.strip()}, {RUNS} SELECT k, CAST(run AS BIGINT) AS dst FROM u")(lambda t: en.compact_map(runs(t)))
query("sort_row_major", "SELECT row_number() OVER (ORDER BY i, j, k) - 1 AS k, i, j, a, k AS src FROM e")(lambda t: en.sort(t.e, "row-major").select("k", "i", "j", "a", "src"))
query("sort_column_major", "SELECT row_number() OVER (ORDER BY j, i, k) - 1 AS k, i, j, a, k AS src FROM e")(lambda t: en.sort(t.e, "column-major").select("k", "i", "j", "a", "src"))


def spread_sql(x: str) -> str:
    for shift, mask in morton.SPREAD:
        x = f"((({x}) | (({x}) << {shift})) & {mask})" if shift == 16 else f"(SELECT (q | (q << {shift})) & {mask} FROM (SELECT {x} AS q))"
    return x


MORTON = f"(({spread_sql('i - 1')}) << 1) | ({spread_sql('j - 1')})"
query("sort_morton", f"SELECT row_number() OVER (ORDER BY m, k) - 1 AS k, i, j, a, k AS src FROM (SELECT *, {MORTON} AS m FROM e)")(lambda t: en.sort(t.e, "morton").select("k", "i", "j", "a", "src"))
query("sort_permute", "SELECT dst AS k, i, j, a, k AS src FROM e JOIN r ON k = r.src")(lambda t: en.sort(t.e, "permute", t.r.toDF("k", "dst")).select("k", "i", "j", "a", "src"))
query("sort_permutation", "SELECT k, row_number() OVER (ORDER BY i, j, k) - 1 AS dst FROM e")(lambda t: en.sort_permutation(t.e, "row-major"))
query("transpose", "SELECT k, j AS i, i AS j, a FROM e")(lambda t: en.transpose(t.e))
query("transpose_conjugate", "SELECT j AS i, i AS j, re, -im AS im FROM z")(lambda t: parts(en.transpose(t.z, conjugate=True)))
query("transpose_array", "SELECT o_orderkey % 5 * (SELECT count(*) // 5 FROM orders) + o_orderkey // 5 AS k, o_custkey AS a FROM orders")(lambda t: en.transpose_array(t.read("orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("a")), t.n_orders // 5, 5))
for kind, sign in (("symmetric", ""), ("skew-symmetric", "-")):
    query(f"expand_{kind[:4]}", f"SELECT i, j, a FROM s UNION ALL SELECT j, i, {sign}a FROM s WHERE i <> j")(lambda t, kind=kind: en.expand_symmetry(t.s, kind))
query("expand_hermitian", "SELECT i, j, re, im FROM z UNION ALL SELECT j, i, re, -im FROM z WHERE i <> j")(lambda t: parts(en.expand_symmetry(t.z, "hermitian")))
query("nonzeros", "SELECT count(*) AS stored, count(*) FILTER (i = j) AS diagonal, 2 * count(*) - count(*) FILTER (i = j) AS nonzeros FROM s")(lambda t: en.nonzeros(t.s, "symmetric"))
query("diagonal", "SELECT i, j, a FROM l WHERE i = j")(lambda t: en.diagonal(t.l))
query("in_bounds", "SELECT k, i, j, a FROM e")(lambda t: en.in_bounds(t.e, 100, 7))
query("set_constant", "SELECT k, i, j, CAST(5 AS BIGINT) AS a FROM e")(lambda t: en.set_constant(t.e, 5))
query("set_zero", "SELECT i, j, 0.0::DOUBLE AS a FROM l")(lambda t: en.set_zero(t.l))
query("set_values", "SELECT k, i, j, o_custkey AS a FROM e JOIN orders ON k = o_orderkey")(lambda t: en.set_values(t.e, t.read("orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("a"))).select("k", "i", "j", "a"))
query("gather_lines", "SELECT r.src AS k, i, j, a FROM r JOIN e ON r.dst = e.k")(lambda t: en.gathered(t.e, t.r.toDF("k", "src")).select("k", "i", "j", "a"))
query("dense", "SELECT (i - 1) * 7 + j - 1 AS k, i, j, CAST(coalesce(q.a, 0) AS BIGINT) AS a FROM (SELECT unnest(range(1, 101)) AS i) CROSS JOIN (SELECT unnest(range(1, 8)) AS j) LEFT JOIN (SELECT i, j, sum(a) AS a FROM e GROUP BY i, j) AS q USING (i, j)")(lambda t: en.dense(t.e, 100, 7))
query("from_dense", "SELECT vec_id + 1 AS i, unnest(range(1, 65)) AS j, unnest(embedding) AS a FROM embeddings")(lambda t: en.from_dense(t.read("embeddings"), "vec_id", "embedding"))
query("array_places", "SELECT o_orderkey // 12 + 1 AS i, o_orderkey % 12 + 1 AS j, o_custkey AS a FROM orders")(lambda t: en.array_places(t.read("orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("a")), 12))
query("triangular_places", "SELECT q.i, o_orderkey - q.i * (q.i - 1) // 2 + 1 AS j, o_custkey AS a FROM orders JOIN (SELECT unnest(range(1, 2000)) AS i) AS q ON o_orderkey >= q.i * (q.i - 1) // 2 AND o_orderkey < q.i * (q.i + 1) // 2")(lambda t: en.triangular_places(t.read("orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("a"))))
query("row_pointers", "SELECT i, CAST(sum(n) OVER (ORDER BY i) - n AS BIGINT) AS first, CAST(sum(n) OVER (ORDER BY i) AS BIGINT) AS last FROM (SELECT o_orderkey + 1 AS i, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey)")(lambda t: en.pointers(t.l, t.n_orders))
query("column_pointers", "SELECT i, CAST(sum(n) OVER (ORDER BY i) - n AS BIGINT) AS first, CAST(sum(n) OVER (ORDER BY i) AS BIGINT) AS last FROM (SELECT p_partkey + 1 AS i, count(l_partkey) AS n FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey)")(lambda t: en.pointers(t.l, t.read("part").count(), "j"))
query("compressed_rows", "SELECT row_number() OVER (ORDER BY i, k) - 1 AS k, i, j, a, k AS src FROM e")(lambda t: en.compressed(t.e).select("k", "i", "j", "a", "src"))
query("from_compressed", "SELECT row_number() OVER (ORDER BY i, k) - 1 AS k, i, j, a FROM e")(lambda t: en.from_compressed(en.pointers(t.e, 100), en.compressed(t.e).select("k", "j", "a")))
query("local_numbers", "SELECT DISTINCT l_orderkey + 1 AS src, dense_rank() OVER (ORDER BY l_orderkey) AS dst FROM lineitem")(lambda t: en.local_numbers(t.l))
query("relabel", "SELECT k, 101 - i AS i, j + 10 AS j, a FROM e")(lambda t: en.relabelled(t.e, t.spark.range(1, 101).select(F.col("id").alias("src"), (101 - F.col("id")).alias("dst")), t.spark.range(1, 8).select(F.col("id").alias("src"), (F.col("id") + 10).alias("dst"))).select("k", "i", "j", "a"))

# ---------------------------------------------------------------- vectors

query("scal", "SELECT i, 2.5 * a AS a FROM y")(lambda t: ve.scal(t.y, 2.5))
query("scal_integer", "SELECT k, i, j, CAST(trunc(a * 0.5::DOUBLE) AS BIGINT) AS a FROM e")(lambda t: ve.scal(t.e, 0.5))
query("scal_complex", "SELECT i, 2 * re - 3 * im AS re, 2 * im + 3 * re AS im FROM c")(lambda t: parts(ve.scal(t.c, 2 + 3j)))
query("axpy", "SELECT y.i, 2 * o_custkey + y.a AS a FROM y JOIN orders ON y.i = o_orderkey")(lambda t: ve.axpy(ve.vector(t.read("orders"), "o_orderkey", F.col("o_custkey").cast("double")), t.y, 2.0))
query("axpy_blocks", "SELECT y.i, 2 * o_custkey + y.a AS a FROM y JOIN orders ON y.i = o_orderkey")(
    lambda t: ve.unblocked(ve.axpy_blocks(ve.blocked(ve.vector(t.read("orders"), "o_orderkey", F.col("o_custkey").cast("double")), 1_000), ve.blocked(t.y, 1_000), 2.0), 1_000)
)
query("axpy_complex", "SELECT c.i, 1 * c.re - 2 * c.im + c.re AS re, c.im + 2 * c.re + c.im AS im FROM c")(lambda t: parts(ve.axpy(t.c, t.c, 1 + 2j)))
query("axpy_matrix", "SELECT i, j, 3 * sum(a) AS a FROM l GROUP BY i, j")(lambda t: ve.axpy(m := en.assemble(t.l), m, 2.0))
query("aypx", "SELECT y.i, 3 * y.a + o_custkey AS a FROM y JOIN orders ON y.i = o_orderkey")(lambda t: ve.aypx(ve.vector(t.read("orders"), "o_orderkey", F.col("o_custkey").cast("double")), t.y, 3.0))
query("add_patterns", "SELECT i, sum(a) AS a FROM (SELECT i, 2 * a AS a FROM p UNION ALL SELECT i, a FROM q) GROUP BY i")(lambda t: ve.added(t.p, t.q, 2.0))
query("copy", "SELECT i, CAST(o_custkey AS DOUBLE) AS a FROM y JOIN orders ON i = o_orderkey")(lambda t: ve.copy(ve.vector(t.read("orders"), "o_orderkey", F.col("o_custkey").cast("double")), t.y))
query("swap", "SELECT 'x' AS name, i, a FROM y UNION ALL SELECT 'y', i, a FROM p")(lambda t: (s := ve.swap(t.p, t.y))[0].select(F.lit("x").alias("name"), "i", "a").unionByName(s[1].select(F.lit("y").alias("name"), "i", "a")))
query("dot", "SELECT sum(y.a * o_custkey) AS dot FROM y JOIN orders ON y.i = o_orderkey")(lambda t: ve.dot(t.y, ve.vector(t.read("orders"), "o_orderkey", F.col("o_custkey").cast("double"))))
query("dot_frobenius", "SELECT sum(q.a * q.a) AS dot FROM (SELECT i, j, sum(a) AS a FROM l GROUP BY i, j) AS q")(lambda t: ve.dot(m := en.assemble(t.l), m))
query("dotu", "SELECT sum(re * re - im * im) AS re, sum(2 * re * im) AS im FROM c")(lambda t: ve.dotu(t.c, t.c))
query("dotc", "SELECT sum(c.re * d.re + c.im * d.im) AS re, sum(c.re * d.im - c.im * d.re) AS im FROM c JOIN (SELECT o_orderkey AS i, CAST(o_orderkey % 3 AS DOUBLE) AS re, 1.0::DOUBLE AS im FROM orders) AS d USING (i)")(lambda t: ve.dotc(t.c, t.read("orders").select(F.col("o_orderkey").alias("i"), cplx.cx((F.col("o_orderkey") % 3).cast("double"), 1.0).alias("a"))))
query("nrm2", "SELECT sqrt(sum(a * a)) AS nrm2 FROM y")(lambda t: ve.nrm2(t.y))
query("nrm2_complex", "SELECT sqrt(sum(re * re + im * im)) AS nrm2 FROM c")(lambda t: ve.nrm2(t.c))
query("asum", "SELECT sum(abs(a - 100000)) AS asum FROM y")(lambda t: ve.asum(t.y.withColumn("a", F.col("a") - 100000)))
query("asum_complex", "SELECT sum(abs(re) + abs(im)) AS asum FROM c")(lambda t: ve.asum(t.c))
query("iamax", "SELECT i AS iamax FROM y ORDER BY abs(a) DESC, i LIMIT 1")(lambda t: ve.iamax(t.y))
query("iamax_complex", "SELECT i AS iamax FROM c ORDER BY abs(re) + abs(im) DESC, i LIMIT 1")(lambda t: ve.iamax(t.c))
query("usdot", "SELECT sum(p.a * y.a) AS dot FROM p JOIN y USING (i)")(lambda t: ve.usdot(t.p, t.y))
query("usdotc", "SELECT sum(p.a * c.re) AS re, sum(p.a * c.im) AS im FROM p JOIN c USING (i)")(lambda t: ve.usdotc(t.p.withColumn("a", cplx.cx(F.col("a"), 0.0)), t.c))
query("usaxpy", "SELECT y.i, y.a + 2 * coalesce(p.a, 0) AS a FROM y LEFT JOIN p USING (i)")(lambda t: ve.usaxpy(t.p, t.y, 2.0))
query("usga", "SELECT p.i, y.a FROM p JOIN y USING (i)")(lambda t: ve.usga(t.p, t.y))
query("usgz", "SELECT y.i, CASE WHEN p.i IS NULL THEN y.a ELSE 0 END AS a FROM y LEFT JOIN p USING (i)")(lambda t: ve.usgz(t.p, t.y)[1])
query("ussc", "SELECT y.i, coalesce(p.a, y.a) AS a FROM y LEFT JOIN p USING (i)")(lambda t: ve.ussc(t.p, t.y))
query("usscga", "SELECT q.i, coalesce(p.a, 0) AS a FROM q LEFT JOIN p USING (i)")(lambda t: ve.usscga(t.p, t.q))
query("constant_vector", "SELECT range AS i, 1.0::DOUBLE AS a FROM range(0, (SELECT count(*) FROM orders))")(lambda t: ve.constant(t.spark, t.n_orders, 1.0))
query("get_values", "SELECT string_agg(r_regionkey * 10, ',' ORDER BY r_regionkey) AS values FROM region")(lambda t: ve.get_values(ve.vector(t.read("region"), "r_regionkey", (F.col("r_regionkey") * 10).cast("int"))).select(F.array_join("values", ",").alias("values")))

# ---------------------------------------------------------------- partitions and splits

query("partition_block", "SELECT o_orderkey AS idx, CAST(o_orderkey // CAST(ceil((SELECT count(*) FROM orders) / 7) AS BIGINT) AS INTEGER) AS part FROM orders")(lambda t: t.read("orders").select(F.col("o_orderkey").alias("idx"), pt.part_of(F.col("o_orderkey"), "block", t.n_orders, 7).alias("part")))
query("partition_block_sizes", "SELECT o_orderkey AS idx, CAST(CASE WHEN o_orderkey < 10 THEN 0 WHEN o_orderkey < 600 THEN 1 ELSE 2 END AS INTEGER) AS part FROM orders")(lambda t: t.read("orders").select(F.col("o_orderkey").alias("idx"), pt.part_of(F.col("o_orderkey"), "block", t.n_orders, 3, sizes=[10, 590, t.n_orders - 600]).alias("part")))
query("partition_cyclic", "SELECT o_orderkey AS idx, CAST(o_orderkey % 7 AS INTEGER) AS part FROM orders")(lambda t: t.read("orders").select(F.col("o_orderkey").alias("idx"), pt.part_of(F.col("o_orderkey"), "cyclic", t.n_orders, 7).alias("part")))
query("partition_block_cyclic", "SELECT o_orderkey AS idx, CAST(o_orderkey // 16 % 7 AS INTEGER) AS part FROM orders")(lambda t: t.read("orders").select(F.col("o_orderkey").alias("idx"), pt.part_of(F.col("o_orderkey"), "block-cyclic", t.n_orders, 7, block=16).alias("part")))
query("partition_custom", "SELECT c_custkey AS idx, c_nationkey AS k, n_regionkey AS part FROM customer JOIN nation ON n_nationkey = c_nationkey")(lambda t: pt.custom(t.read("customer").select(F.col("c_custkey").alias("idx"), F.col("c_nationkey").alias("k")), F.col("k"), t.read("nation").select(F.col("n_nationkey").alias("idx"), F.col("n_regionkey").alias("part"))))
query("partition_nonzeros", "SELECT k, i, j, a, CAST(k // CAST(ceil((SELECT count(*) FROM orders) / 4) AS BIGINT) AS INTEGER) AS part FROM e")(lambda t: pt.partition(t.e, "nonzeros", 100, 7, t.n_orders, nonzeros={"how": "block", "parts": 4}))
query("partition_rows", "SELECT k, i, j, a, CAST((i - 1) // 25 AS INTEGER) AS part FROM e")(lambda t: pt.partition(t.e, "rows", 100, 7, 0, rows={"how": "block", "parts": 4}))
query("partition_columns", "SELECT k, i, j, a, CAST((j - 1) % 3 AS INTEGER) AS part FROM e")(lambda t: pt.partition(t.e, "columns", 100, 7, 0, columns={"how": "cyclic", "parts": 3}))
query("partition_2d", "SELECT k, i, j, a, CAST((i - 1) // 25 * 3 + (j - 1) % 3 AS INTEGER) AS part FROM e")(lambda t: pt.partition(t.e, "2d", 100, 7, 0, rows={"how": "block", "parts": 4}, columns={"how": "cyclic", "parts": 3}))
query("part_sizes", "SELECT CAST(q.part AS INTEGER) AS part, count(k) AS size FROM (SELECT unnest(range(0, 8)) AS part) AS q LEFT JOIN e ON (j - 1) % 3 * 2 = q.part GROUP BY q.part")(lambda t: pt.sizes(t.e.withColumn("part", ((F.col("j") - 1) % 3 * 2).cast("int")), 8))
query("split", "SELECT k, i, j, a, (i - 1) // 25 AS file FROM e")(lambda t: _union([p.withColumn("file", F.lit(n).cast("long")) for n, p in enumerate(pt.split(pt.partition(t.e, "rows", 100, 7, 0, rows={"how": "block", "parts": 4}), 4))]))
query("split_vector", "SELECT i, a, i % 3 AS piece FROM y")(lambda t: _union([p.withColumn("piece", F.lit(n).cast("long")) for n, p in enumerate(ve.split(t.y, t.y.select("i", (F.col("i") % 3).alias("part")), 3))]))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


# ---------------------------------------------------------------- permutations, sets, sorts, codes

query("permutation_identity", "SELECT range AS src, range AS dst FROM range(0, (SELECT count(*) FROM orders))")(lambda t: pe.identity(t.spark, t.n_orders))
query("permutation_invert", "SELECT dst AS src, src AS dst FROM r")(lambda t: pe.invert(t.r))
query("permutation_compose", "SELECT a.src, b.dst FROM r AS a JOIN r AS b ON a.dst = b.src")(lambda t: pe.compose(t.r, t.r))
query("permutation_apply", "SELECT dst AS i, a FROM y JOIN r ON i = src")(lambda t: pe.apply(t.r, t.y))
query("permute_scatter", "SELECT k, 101 - i AS i, j, a FROM e")(lambda t: pe.scatter(t.e, t.spark.range(1, 101).select(F.col("id").alias("src"), (101 - F.col("id")).alias("dst"))))
query("permute_gather", "SELECT k, (i + 97) % 100 + 1 AS i, j, a FROM e")(lambda t: pe.gather(t.e, t.spark.range(1, 101).select(F.col("id").alias("src"), ((F.col("id") + 1) % 100 + 1).alias("dst"))))
query("permutation_by_parts", "SELECT o_orderkey + 1 AS src, row_number() OVER (ORDER BY o_orderkey % 7, o_orderkey) AS dst FROM orders")(lambda t: pe.by_parts(t.read("orders").select(F.col("o_orderkey").alias("idx"), (F.col("o_orderkey") % 7).alias("part"))))

A, B = "(SELECT value FROM v WHERE f = 'A')", "(SELECT value FROM v WHERE f = 'R')"
NUMBERED = "SELECT row_number() OVER (ORDER BY value) - 1 AS k, value FROM"
query("set_merge", f"{NUMBERED} ({A} UNION ALL {B})")(lambda t: integers.merge(t.v("A"), t.v("R")))
query("set_compact", f"{NUMBERED} (SELECT DISTINCT value FROM {A})")(lambda t: integers.compact(t.v("A")))
query("set_union", f"{NUMBERED} ({A} UNION {B})")(lambda t: integers.union(t.v("A"), t.v("R")))
query("set_intersection", f"{NUMBERED} ({A} INTERSECT {B})")(lambda t: integers.intersection(t.v("A"), t.v("R")))
query("set_difference", f"{NUMBERED} ({A} EXCEPT {B})")(lambda t: integers.difference(t.v("A"), t.v("R")))
query("set_destinations", f"SELECT a.value, coalesce(q.k, -1) AS dst FROM {A} AS a LEFT JOIN ({NUMBERED} ({A} INTERSECT {B})) AS q USING (value)")(lambda t: integers.destinations(t.v("A"), integers.intersection(t.v("A"), t.v("R"))))
query("sort_integers", "SELECT o_orderkey AS k, o_custkey AS a, row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS dst FROM orders")(lambda t: integers.sort(t.read("orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("a")), ["a"]))
query("sort_pairs", "SELECT k, i, j, row_number() OVER (ORDER BY i, j, k) - 1 AS dst FROM e")(lambda t: integers.sort(t.e.select("k", "i", "j"), ["i", "j"]))
query("sort_unsigned", "SELECT o_orderkey AS k, o_custkey - 500 AS a, row_number() OVER (ORDER BY o_custkey < 500, o_custkey, o_orderkey) - 1 AS dst FROM orders")(lambda t: integers.sort_unsigned(t.read("orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") - 500).alias("a")), ["a"]))
query("morton_encode", f"SELECT k, {MORTON} AS code FROM (SELECT o_orderkey AS k, o_orderkey * 7919 % 1000003 + 1 AS i, o_custkey * 104729 % 1000003 + 1 AS j FROM orders)")(lambda t: t.read("orders").select(F.col("o_orderkey").alias("k"), morton.encode32(F.col("o_orderkey") * 7919 % 1000003, F.col("o_custkey") * 104729 % 1000003).alias("code")))
query("morton_decode", "SELECT o_orderkey AS k, o_orderkey * 7919 % 1000003 AS i, o_custkey * 104729 % 1000003 AS j FROM orders")(lambda t: t.read("orders").select("o_orderkey", morton.encode32(F.col("o_orderkey") * 7919 % 1000003, F.col("o_custkey") * 104729 % 1000003).alias("m")).select(F.col("o_orderkey").alias("k"), morton.decode32(F.col("m"))[0].alias("i"), morton.decode32(F.col("m"))[1].alias("j")))
query("morton_64", "SELECT o_orderkey AS k, o_orderkey * 7919000000 AS i, o_custkey * 10472900000 AS j FROM orders")(
    lambda t: (m := t.read("orders").select(F.col("o_orderkey").alias("k"), *(c.alias(n) for c, n in zip(morton.encode64(F.col("o_orderkey") * 7919000000, F.col("o_custkey") * 10472900000), ("h", "l"))))).select("k", *(c.alias(n) for c, n in zip(morton.decode64(F.col("h"), F.col("l")), ("i", "j"))))
)

# ---------------------------------------------------------------- graphs, solver, generators, pictures, files, streams

EDGES = "g AS (SELECT DISTINCT i AS src, j AS dst FROM s WHERE i <> j UNION SELECT DISTINCT j, i FROM s WHERE i <> j)"
query("graph_adjacency", f"WITH {VIEWS.strip()}, {EDGES} SELECT src, dst FROM g")(lambda t: graphs.adjacency(t.s, 100, 100).select("src", "dst"))
query("graph_degrees", f"WITH {VIEWS.strip()}, {EDGES} SELECT q.v, count(src) AS degree FROM (SELECT unnest(range(1, 101)) AS v) AS q LEFT JOIN g ON src = q.v GROUP BY q.v")(lambda t: graphs.degrees(graphs.adjacency(t.s, 100, 100), 100))
query("graph_levels", "WITH RECURSIVE g AS (SELECT DISTINCT o_custkey % 100 + 1 AS src, o_custkey % 97 + 101 AS dst FROM orders), h AS (SELECT src, dst FROM g UNION SELECT dst, src FROM g), q AS (SELECT 1::BIGINT AS v, 0 AS level UNION SELECT h.dst, q.level + 1 FROM q JOIN h ON q.v = h.src WHERE q.level < 200) SELECT v, min(level) AS level FROM q GROUP BY v")(
    lambda t: graphs.levels(graphs.adjacency(t.read("orders").select((F.col("o_custkey") % 100 + 1).alias("i"), (F.col("o_custkey") % 97 + 1).alias("j")), 100, 97), 1)
)
query("reorder_rcm")(lambda t: graphs.reorder(t.w, t.n_customers, t.n_customers, "rcm")[0])
query("reorder_nd")(lambda t: graphs.reorder(t.w, t.n_customers, t.n_customers, "nd")[0])
query("reorder_parts")(lambda t: graphs.reorder(t.w, t.n_customers, t.n_customers, "metis", parts=4)[0])
query("partition_graph")(lambda t: graphs.partition(t.w, t.n_customers, t.n_customers, 4))


def same_entries(t: Tables, moved: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame:
    """What an order must keep: one number for each vertex, every number once, every entry at its place. Values tell nothing
    apart, so degrees of rows are compared: how many rows have how many entries."""
    entries, perm, _ = moved
    back = perm.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("src").alias("n_src"), F.countDistinct("dst").alias("n_dst"), F.min("dst").alias("low"), F.max("dst").alias("high"))
    placed = entries.join(perm.select(F.col("src").alias("_i"), F.col("dst").alias("i")), "i").join(perm.select(F.col("src").alias("_j"), F.col("dst").alias("j")), "j")
    matched = placed.join(t.w.select("k", F.col("i").alias("_wi"), F.col("j").alias("_wj")), "k").agg(F.count_if((F.col("_i") == F.col("_wi")) & (F.col("_j") == F.col("_wj"))).alias("n_entries"))
    return back.withColumn("_one", F.lit(1)).join(matched.withColumn("_one", F.lit(1)), "_one").drop("_one")


ORDERED = "SELECT n, n AS n_src, n AS n_dst, 1::BIGINT AS low, n AS high, (SELECT count(*) FROM orders) AS n_entries FROM (SELECT count(*) AS n FROM customer)"
query("reorder_rcm_kept", ORDERED)(lambda t: same_entries(t, graphs.reorder(t.w, t.n_customers, t.n_customers, "rcm")))
query("reorder_nd_kept", ORDERED)(lambda t: same_entries(t, graphs.reorder(t.w, t.n_customers, t.n_customers, "nd")))
query("reorder_parts_kept", ORDERED)(lambda t: same_entries(t, graphs.reorder(t.w, t.n_customers, t.n_customers, "metis", parts=4)))


@query("reorder_rcm_levels", f"WITH {VIEWS.strip()} SELECT count(*) AS n, true AS same FROM s")
def _rcm_levels(t: Tables) -> DataFrame:
    """The order by levels in Spark is that of the driver."""
    local, spread = (graphs.rcm(t.s, 100, 100, None, most)[0].select("src", "dst") for most in (graphs.LOCAL_EDGES, 0))
    same = local.exceptAll(spread).isEmpty()
    return t.s.agg(F.count(F.lit(1)).alias("n"), F.lit(same).alias("same"))


@query("partition_graph_kept", "SELECT part::INTEGER AS part, count(*) AS n, true AS improved FROM (SELECT (row_number() OVER () - 1) * 4 // (SELECT count(*) FROM customer) AS part FROM customer) GROUP BY part")
def _partition_kept(t: Tables) -> DataFrame:
    """Sizes of the parts, and whether the edge cut is none above that of runs of a breadth-first order."""
    n = t.n_customers
    edges = graphs.stored(t.w, n, n)
    order = storage.written(graphs.order_of(edges, n, None), "order")
    parted = graphs.partition(t.w, n, n, 4, edges=edges, order=order)
    runs = order.select("v", F.floor(F.col("pos") * 4 / n).cast("int").alias("part"))
    better = graphs.cut_of(edges, parted) <= graphs.cut_of(edges, runs)
    return parted.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("improved", F.lit(better))


query("edge_cut", f"WITH {VIEWS.strip()}, {EDGES} SELECT count(*) FILTER (src % 4 <> dst % 4) AS edge_cut FROM g WHERE src < dst")(lambda t: graphs.edge_cut(t.s, 100, 100, t.spark.range(1, 101).select(F.col("id").alias("v"), (F.col("id") % 4).alias("part"))))
query("bandwidth", "SELECT max(abs(i - j)) AS bandwidth FROM s")(lambda t: graphs.bandwidth(t.s))


@query("conjugate_gradients", "SELECT i, a FROM x")
def _cg(t: Tables) -> DataFrame:
    """A = tridiagonal (-1, 4, -1) over parts, b = A x for a known x; the solution is rounded back to x."""
    x = t.x
    n = x.count()
    a = t.spark.range(1, n + 1).select(F.explode(F.array(*(F.struct(F.col("id").alias("i"), (F.col("id") + d).alias("j"), F.lit(v).alias("a")) for d, v in ((0, 4.0), (-1, -1.0), (1, -1.0))))).alias("e")).select("e.*").where(F.col("j").between(1, n))
    b = products.gemv(a, x)
    return solver.cg(a, b, rtol=1e-12).x.withColumn("a", F.round("a", 6) + 0.0)




def random_like_lineitem(t: Tables) -> DataFrame:
    """As many random entries as lineitem has rows, of an orders x part matrix."""
    return generate.uniform_matrix(t.spark, t.n_orders, t.read("part").count(), t.read("lineitem").count(), "integer", low=1, high=9, seed=t.read("nation").count())


@query("random_uniform_kept", "SELECT count(*) AS n, true AS inside, true AS even, true AS spread FROM lineitem")
def _uniform_kept(t: Tables) -> DataFrame:
    """Number and range of the entries; whether the frequencies of the nine values and of ten bands of rows are those of
    an even distribution (within five deviations)."""
    made = random_like_lineitem(t)
    n, rows, columns = t.read("lineitem").count(), t.n_orders, t.read("part").count()

    def even(cell, cells: int):
        far = made.groupBy(cell.alias("c")).agg(F.count(F.lit(1)).alias("n")).agg(F.max(F.abs(F.col("n") - n / cells)), F.count(F.lit(1))).first()
        return far[1] == cells and far[0] <= 5 * (n / cells) ** 0.5

    sums = made.agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("i").between(1, rows) & F.col("j").between(1, columns) & F.col("a").between(1, 9)).alias("inside"))
    return sums.withColumns({"even": F.lit(even(F.col("a"), 9)), "spread": F.lit(even(F.floor((F.col("i") - 1) * 10 / rows), 10))})


query("random_uniform")(random_like_lineitem)
query("random_block_diagonal", "SELECT range AS k, range // 12 * 4 + range % 12 // 3 + 1 AS i, range // 12 * 3 + range % 3 + 1 AS j FROM range(0, (SELECT 12 * count(*) FROM supplier))")(lambda t: generate.block_diagonal(t.spark, t.read("supplier").count(), 4, 3, field="pattern"))
query("spy_pixels", "SELECT DISTINCT CAST(floor((j - 0.5) / (SELECT count(*) FROM part) * (40 * (SELECT count(*) FROM part) // (SELECT count(*) FROM orders))) AS INTEGER) AS x, CAST(floor((i - 0.5) / (SELECT count(*) FROM orders) * 40) AS INTEGER) AS y FROM l")(
    lambda t: spy.pixels(t.l, t.n_orders, t.read("part").count(), 40, 40)
)


@query("spy_picture", "SELECT DISTINCT CAST(floor((j - 0.5) / 7 * 7) AS INTEGER) AS x, CAST(floor((i - 0.5) / 100 * 40) AS INTEGER) AS y FROM e")
def _spy(t: Tables) -> DataFrame:
    return spy.pixels(t.e, 100, 7, 40, 40)


def round_trip(t: Tables, m: Meta, data: DataFrame, **options) -> tuple[Meta, DataFrame]:
    path = storage.new_path(t.spark, "mtx")
    mtx.write(m, data, path, **options)
    return mtx.read(t.spark, path)


query("mtx_matrix", "SELECT k, i, j, a FROM e")(lambda t: round_trip(t, Meta(100, 7, t.n_orders, field=Field.INTEGER, comments=("% orders\n",)), t.e)[1])
query("mtx_matrix_real", "SELECT k, i, j, a FROM s")(lambda t: round_trip(t, Meta(100, 100, t.n_orders), t.s, fmt="%.17g", compression="gzip")[1])
query("mtx_vector", "SELECT i AS k, a FROM y")(lambda t: round_trip(t, Meta(t.n_orders, kind=Kind.VECTOR, layout=Layout.ARRAY), t.y.select(F.col("i").alias("k"), "a"), fmt="%.1f", single=False)[1])


query("mtx_complex", "SELECT o_orderkey AS k, o_custkey + 1 AS i, o_orderkey + 1 AS j, CAST(o_custkey % 50 AS DOUBLE) AS re, CAST(o_orderkey % 11 AS DOUBLE) - 5 AS im FROM orders")(
    lambda t: parts(round_trip(t, Meta(t.n_customers, t.n_orders, t.n_orders, field=Field.COMPLEX), t.read("orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") + 1).alias("i"), (F.col("o_orderkey") + 1).alias("j"), cplx.cx((F.col("o_custkey") % 50).cast("double"), (F.col("o_orderkey") % 11).cast("double") - 5).alias("a")))[1])
)
query("mtx_pattern", "SELECT k, i, j FROM e")(lambda t: round_trip(t, Meta(100, 7, t.n_orders, field=Field.PATTERN), t.e.drop("a"))[1])
query("mtx_integer_vector", "SELECT k, i, a FROM e")(lambda t: round_trip(t, Meta(100, kind=Kind.VECTOR, nnz=t.n_orders, field=Field.INTEGER), t.e.drop("j"), fmt="%+d")[1].select("k", "i", "a"))


@query("mtx_symmetric_array", "WITH n AS (SELECT count(*) AS n FROM nation) SELECT i * (i - 1) // 2 + j - 1 AS k, i, j, CAST(i * j AS DOUBLE) AS a FROM n, range(1, n + 1) AS r(i), range(1, i + 1) AS c(j)")
def _symmetric_array(t: Tables) -> DataFrame:
    n = t.read("nation").count()
    lower = t.spark.range(1, n + 1).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("id"))).alias("j"))
    data = lower.select(F.expr("i * (i - 1) div 2 + j - 1").alias("k"), (F.col("i") * F.col("j")).cast("double").alias("a"))
    path = storage.new_path(t.spark, "mtx")
    mtx.write(Meta(n, n, layout=Layout.ARRAY, symmetry=Symmetry.SYMMETRIC), data, path)
    return mtx.read_matrix(t.spark, path)[1].select("k", "i", "j", "a")


@query("mtx_comments", "SELECT 'coordinate' AS format, 7::BIGINT AS rows, count(*)::BIGINT AS n, '% one|%|% three' AS comments FROM orders")
def _comments(t: Tables) -> DataFrame:
    path = storage.new_path(t.spark, "mtx")
    mtx.write(Meta(7, 100, t.n_orders, field=Field.INTEGER, comments=("% one\n", "%\n", "% three\n")), t.e.select("k", F.col("j").alias("i"), F.col("i").alias("j"), "a"), path)
    return mtx.info(t.spark, path).select("format", "rows", F.col("nonzeros").alias("n"), F.array_join("comments", "|").alias("comments"))


@query("mtx_info", "SELECT 'matrix' AS object, 'coordinate' AS format, 'integer' AS field, 'general' AS symmetry, 100::BIGINT AS rows, 7::BIGINT AS columns, count(*) AS nonzeros FROM orders")
def _info(t: Tables) -> DataFrame:
    path = storage.new_path(t.spark, "mtx")
    mtx.write(Meta(100, 7, t.n_orders, field=Field.INTEGER), t.e, path)
    return mtx.info(t.spark, path).drop("comments")


@query("stream_assemble", "SELECT user_id AS i, CAST(length(event_type) AS BIGINT) AS j, count(*) AS a FROM events GROUP BY ALL")
def _stream(t: Tables) -> DataFrame:
    """The events as a stream of entries, assembled into a table until all of them are read."""
    events = t.read("events")
    stream = t.spark.readStream.schema(events.schema).parquet(f"{t.dir}/events.parquet*")
    placed = stream.select(F.col("user_id").alias("i"), F.length("event_type").cast("long").alias("j"), F.lit(1).cast("long").alias("a"))
    name = f"assembled_{abs(hash(t.dir)) % 10**8}"
    writer = streaming.assembled(placed).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True)
    writer.start().awaitTermination()
    return t.spark.table(name)


# ---------------------------------------------------------------- structures for large inputs


@query("stream_assemble_table", "SELECT user_id AS i, CAST(length(event_type) AS BIGINT) AS j, count(*) AS a FROM events GROUP BY ALL")
def _stream_table(t: Tables) -> DataFrame:
    """The events as a stream, assembled into a table of files that no repeated batch can spoil."""
    events = t.read("events")
    stream = t.spark.readStream.schema(events.schema).parquet(f"{t.dir}/events.parquet*")
    table = streaming.Table(t.spark, storage.new_path(t.spark, "assembled"))
    placed = stream.select(F.col("user_id").alias("i"), F.length("event_type").cast("long").alias("j"), F.lit(1).cast("long").alias("a"))
    streaming.into_table(placed, table, storage.new_path(t.spark, "checkpoint")).awaitTermination()
    return table.read()


def key_grid(t: Tables) -> tuple[DataFrame, int]:
    """The parts in rows of equal length, in order of their keys: each is joined to the next of its row and the one below."""
    n = t.read("part").count()
    side = max(1, int(n**0.5))
    key = F.col("p_partkey")
    right, below = F.when((key % side < side - 1) & (key < n - 1), key + 2), F.when(key + side < n, key + side + 1)
    each = t.read("part").select((key + 1).alias("i"), F.explode(F.array(right, below)).alias("j")).where("j IS NOT NULL")
    return each.select((F.col("i") * 2 + (F.col("j") > F.col("i") + 1).cast("int")).alias("k"), "i", "j", F.lit(1.0).alias("a")), n


def compared(t: Tables, a: DataFrame, n: int, parts: int) -> DataFrame:
    """Vertices, the parts that are within their bound, and whether the cut is none above that of the flat form."""
    edges = graphs.stored(a, n, n)
    parted = storage.written(multilevel.partition(a, n, n, parts, edges=edges), "parts")
    better = graphs.cut_of(edges, parted) <= graphs.cut_of(edges, graphs.partition(a, n, n, parts, edges=edges))
    bound = max(-(-n // parts), int(n * multilevel.BALANCE / parts))
    sizes = parted.groupBy("part").agg(F.count(F.lit(1)).alias("_n"), F.countDistinct("v").alias("_v"))
    return sizes.agg(F.sum("_v").alias("n"), F.count_if(F.col("_n") <= bound).alias("within"), F.lit(better).alias("no_worse"))


query("partition_multilevel", "SELECT count(*) AS n, 4::BIGINT AS within, true AS no_worse FROM customer")(lambda t: compared(t, t.w, t.n_customers, 4))
query("partition_multilevel_grid", "SELECT count(*) AS n, 4::BIGINT AS within, true AS no_worse FROM part")(lambda t: compared(t, *key_grid(t), 4))


@query("separator_halves", "SELECT count(*) AS n, 0::BIGINT AS joined, true AS halves, true AS small FROM part")
def _halves(t: Tables) -> DataFrame:
    """Vertices in halves and separator, edges that join the halves, whether the halves are within their bound, and the
    separator is none larger than the middle level of a breadth-first level structure."""
    a, n = key_grid(t)
    edges = graphs.stored(a, n, n)
    vertices = t.spark.range(1, n + 1).select(F.col("id").alias("v"), F.lit(0).cast("long").alias("piece"))
    sides = multilevel.halves(vertices, edges)
    joined = edges.join(sides.toDF("src", "_a"), "src").join(sides.toDF("dst", "_b"), "dst").where("_a = 0 AND _b = 1").count()
    level = graphs.levels(edges, graphs.pseudo_peripheral(edges)).groupBy("level").count().withColumn("_upto", F.sum("count").over(Window.orderBy("level")))  # a row a level
    middle = level.where(F.col("_upto") > n / 2).orderBy("level").first()["count"]
    size = F.count_if(F.col("side") == 2)
    bound = max(-(-n // 2), int(n * 1.1 / 2))
    return sides.agg(F.countDistinct("v").alias("n"), F.lit(joined).cast("long").alias("joined"), ((F.count_if(F.col("side") == 0) <= bound) & (F.count_if(F.col("side") == 1) <= bound)).alias("halves"), (size <= middle).alias("small"))


@query("reorder_separators_kept", "SELECT n, n AS n_src, n AS n_dst, 1::BIGINT AS low, n AS high FROM (SELECT count(*) AS n FROM part)")
def _separators_kept(t: Tables) -> DataFrame:
    a, n = key_grid(t)
    perm, _ = multilevel.dissection(a, n, n, smallest=max(8, n // 3))
    return perm.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("src").alias("n_src"), F.countDistinct("dst").alias("n_dst"), F.min("dst").alias("low"), F.max("dst").alias("high"))


def runs_of(t: Tables, n: int, parts: int) -> DataFrame:
    """(i, part): equal runs of 1..n."""
    return t.spark.range(1, n + 1).select(F.col("id").alias("i"), F.floor((F.col("id") - 1) * parts / n).cast("int").alias("part"))


@query("gemv_prepared", "SELECT l.i, sum(l.a * x.a) AS a FROM l JOIN x ON l.j = x.i GROUP BY l.i")
def _prepared(t: Tables) -> DataFrame:
    """The product by a plan that moves only what other parts need."""
    plan = halo.Product(t.l, runs_of(t, t.n_orders, 8), 8, columns=runs_of(t, t.read("part").count(), 8))
    return plan.written(plan.gemv(plan.placed(t.x))).select("i", "a")


@query("conjugate_gradients_parts", "SELECT i, a FROM x")
def _cg_parts(t: Tables) -> DataFrame:
    """A = L + 1 for the Laplacian L of the grid of parts, laid out in parts of rows; b = A x."""
    a, n = key_grid(t)
    degree = graphs.degrees(graphs.adjacency(a, n, n), n).select(F.col("v").alias("i"), F.col("v").alias("j"), (F.col("degree") + 1.0).alias("a"))
    a = degree.unionByName(en.expand_symmetry(a.select(F.greatest("i", "j").alias("i"), F.least("i", "j").alias("j"), F.lit(-1.0).alias("a")), "symmetric"))
    return solver.cg(a, products.gemv(a, t.x), rtol=1e-12, owners=runs_of(t, n, 4), partitions=4).x.withColumn("a", F.round("a", 6) + 0.0)


@query("usscga_plan", "SELECT q.i, CASE WHEN q.i % 3 = 0 THEN 0 ELSE 1 END AS part, coalesce(p.a, 0) AS a FROM q LEFT JOIN p USING (i)")
def _usscga_plan(t: Tables) -> DataFrame:
    """Packed vectors in parts, x by quarters of its places and z by thirds, scattered by a stored plan."""
    x = t.p.select((F.col("i") % 4).cast("int").alias("part"), "i", "a")
    z = t.q.select(F.when(F.col("i") % 3 == 0, 0).otherwise(1).alias("part"), "i")
    return halo.Scatter(x, z, 4).run(halo.bucketed(x, 4, "i")).select("i", "part", "a")


query("gemv_tiles", "SELECT l.i, sum(l.a * x.a) AS a FROM l JOIN x ON l.j = x.i GROUP BY l.i")(lambda t: tiles.gemv(tiles.tiled(t.l, 512), ve.blocked(t.x.withColumn("i", F.col("i") - 1), 512), size=512))
query("tiles_entries", "SELECT i, j, sum(a) AS a FROM l GROUP BY i, j")(lambda t: tiles.entries_of(tiles.tiled(t.l, 512), 512))

SKEWED = "(SELECT l_suppkey + 1 AS i, CASE WHEN l_linenumber = 1 THEN 1 ELSE l_partkey + 1 END AS j, l_quantity AS a FROM lineitem)"


@query("gemm_grid", f"SELECT a.i, b.i AS j, sum(a.a * b.a) AS a FROM {SKEWED} AS a JOIN {SKEWED} AS b USING (j) GROUP BY a.i, b.i")
def _gemm_grid(t: Tables) -> DataFrame:
    """A product whose first inner index has a quarter of all entries."""
    m = en.matrix(t.read("lineitem"), "l_suppkey", F.when(F.col("l_linenumber") == 1, 0).otherwise(F.col("l_partkey")), "l_quantity")
    return products.gemm_grid(m, m, trans_b="trans", heavy=1_000)


@query("mtx_source", "SELECT i, j, a FROM e")
def _source(t: Tables) -> DataFrame:
    """Entries written and read as a data source of Spark."""
    datasource.register(t.spark)
    path = storage.new_path(t.spark, "mtx")
    t.e.drop("k").write.format("mtx").options(rows=100, columns=7).mode("append").save(path)
    return t.spark.read.format("mtx").option("split", 1 << 16).load(path)


query("mtx_source_filtered", "SELECT i, j, a FROM e WHERE i BETWEEN 20 AND 30 AND j IN (2, 5)")(lambda t: _source(t).where(F.col("i").between(20, 30) & F.col("j").isin(2, 5)))
query(
    "partition_sized_table",
    f"WITH {VIEWS.strip()}, d AS (SELECT o_orderkey AS part, o_custkey % 4 AS size FROM orders), f AS (SELECT part, CAST(sum(size) OVER (ORDER BY part) AS BIGINT) AS upto, size FROM d) SELECT k, q.idx, CAST((SELECT min(part) FROM f WHERE f.upto > q.idx) AS INTEGER) AS part FROM (SELECT l_orderkey * 8 + l_linenumber AS k, l_orderkey AS idx FROM lineitem) AS q",
)(lambda t: pt.sized(t.read("lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("k"), F.col("l_orderkey").alias("idx")), F.col("idx"), t.read("orders").select(F.col("o_orderkey").alias("part"), (F.col("o_custkey") % 4).alias("size"))))
query("get_values_blocks", "SELECT o_orderkey // 1000 AS b, string_agg(CAST(floor(o_totalprice) AS BIGINT), ',' ORDER BY o_orderkey) AS values FROM orders GROUP BY b")(
    lambda t: ve.blocked(ve.vector(t.read("orders"), "o_orderkey", F.floor("o_totalprice").cast("long")), 1_000).select("b", F.array_join(F.transform("values", lambda v: v.cast("string")), ",").alias("values"))
)


@query("mtx_sizes", "WITH n AS (SELECT count(*) AS n FROM orders) SELECT 2 * n AS cat, 100::BIGINT AS transposed_columns, 7::BIGINT AS row_vector, 100::BIGINT AS column_vector, n AS data_lines FROM n")
def _sizes(t: Tables) -> DataFrame:
    """Sizes from a file's header: of the file twice, transposed, of row and column vectors, and its data lines."""
    path = storage.new_path(t.spark, "mtx")
    mtx.write(Meta(100, 7, t.n_orders, field=Field.INTEGER), t.e, path)
    m, _ = mtx.meta(t.spark, path)
    return t.spark.createDataFrame([(m.concatenated(m).nnz, m.transposed().ncols, m.row_vector_size, m.column_vector_size, m.data_lines)], "cat long, transposed_columns long, row_vector long, column_vector long, data_lines long")


#: Data lines of other variants: kind of vector or matrix, layout, field, precision, symmetry.
query("mtx_single", "SELECT k, i, j, CAST(a AS FLOAT) AS a FROM e")(lambda t: single(t, Meta(100, 7, t.n_orders, precision="single"), t.e.withColumn("a", F.col("a").cast("float"))))
query("mtx_complex_vector", "SELECT i AS k, i + 1 AS i, re, im FROM c")(lambda t: parts(round_trip(t, Meta(t.n_orders, kind=Kind.VECTOR, nnz=t.n_orders, field=Field.COMPLEX), t.c.select(F.col("i").alias("k"), (F.col("i") + 1).alias("i"), "a"))[1]))
query("mtx_complex_array", "SELECT i AS k, re, im FROM c")(lambda t: parts(round_trip(t, Meta(t.n_orders, kind=Kind.VECTOR, layout=Layout.ARRAY, field=Field.COMPLEX), t.c.select(F.col("i").alias("k"), "a"))[1]))
query("mtx_pattern_vector", "SELECT k, i FROM e")(lambda t: round_trip(t, Meta(100, kind=Kind.VECTOR, nnz=t.n_orders, field=Field.PATTERN), t.e.select("k", "i"))[1])
query("mtx_integer_array", "SELECT o_orderkey AS k, o_custkey AS a FROM orders")(lambda t: round_trip(t, Meta(t.n_orders, kind=Kind.VECTOR, layout=Layout.ARRAY, field=Field.INTEGER), t.read("orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("a")))[1])


def single(t: Tables, m: Meta, data: DataFrame) -> DataFrame:
    path = storage.new_path(t.spark, "mtx")
    mtx.write(m, data, path, fmt="%.9g")
    return mtx.read(t.spark, path, "single")[1]


def lower_array(t: Tables, kind: Symmetry, a, field: Field = Field.REAL) -> DataFrame:
    """A file of a lower triangle, row by row, filled with the customers of the first orders, and its places read back."""
    n = int((2 * t.n_orders) ** 0.5) - 1
    lines = n * (n - 1) // 2 if kind is Symmetry.SKEW else n * (n + 1) // 2
    data = t.read("orders").where(F.col("o_orderkey") < lines).select(F.col("o_orderkey").alias("k"), a.alias("a"))
    path = storage.new_path(t.spark, "mtx")
    mtx.write(Meta(n, n, layout=Layout.ARRAY, field=field, symmetry=kind), data, path)
    return mtx.read_matrix(t.spark, path)[1].select("k", "i", "j", "a")


LOWER = "n AS (SELECT CAST(floor(sqrt(2 * count(*))) AS BIGINT) - 1 AS n FROM orders)"
query("mtx_skew_array", f"WITH {LOWER} SELECT o_orderkey AS k, i, j, CAST(o_custkey AS DOUBLE) AS a FROM n, range(2, n + 1) AS r(i), range(1, i) AS c(j), orders WHERE o_orderkey = (i - 1) * (i - 2) // 2 + j - 1")(lambda t: lower_array(t, Symmetry.SKEW, F.col("o_custkey").cast("double")))
query("mtx_hermitian_array", f"WITH {LOWER} SELECT o_orderkey AS k, i, j, CAST(o_custkey AS DOUBLE) AS re, CAST(o_orderkey % 3 AS DOUBLE) AS im FROM n, range(1, n + 1) AS r(i), range(1, i + 1) AS c(j), orders WHERE o_orderkey = i * (i - 1) // 2 + j - 1")(
    lambda t: parts(lower_array(t, Symmetry.HERMITIAN, cplx.cx(F.col("o_custkey").cast("double"), (F.col("o_orderkey") % 3).cast("double")), Field.COMPLEX))
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
