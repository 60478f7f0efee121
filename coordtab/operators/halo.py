"""Matrices and vectors laid out in parts, for products that are made again and again.

A table (i, part) names the owner of each index. Vectors are (part, i, a) in the part of the owner, matrices (part, i, j, a)
in that of the row's owner; both are stored in buckets of part, so that what stands in one part meets without being moved.
Which part needs which index of another one is found once and stored (`Routes`); after that a product ships only these
values, however often it is made: A is never exchanged, nor is what a part has itself."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..errors import IncompatibleError
from ..meta import Symmetry, Transposition
from . import vectors as ve
from .products import oriented, product_sum

#: Tables in equal buckets of part needn't be exchanged to be joined or grouped by part and index, and nothing is broadcast.
SETTINGS = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}


@contextmanager
def in_place(spark: SparkSession):
    """Plans made within it use the buckets."""
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    try:
        for k, v in SETTINGS.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def bucketed(df: DataFrame, buckets: int, *order: str, dealt: bool = False) -> DataFrame:
    """df as a table in buckets of part, in the shared folder. dealt: it is the result of a plan in_place already."""
    spark = df.sparkSession
    name, path = f"coordtab_{uuid.uuid4().hex}", storage.new_path(spark, "bucketed")
    with in_place(spark):
        rows = df if dealt else df.repartition(buckets, "part")
        rows.write.bucketBy(buckets, "part").sortBy("part", *order).option("path", path).format("parquet").saveAsTable(name)
    out = spark.table(name)
    out._stored, out._table = path, name
    return out


def drop(*tables: DataFrame | None) -> None:
    for t in tables:
        name = None if t is None else vars(t).pop("_table", None)
        if name:
            t.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
        storage.drop(t)


class Routes:
    """Which values of a packed vector go where, for any values of the same places: wanted and held are (part, i)."""

    def __init__(self, held: DataFrame, wanted: DataFrame, buckets: int):
        self.buckets = buckets
        routes = wanted.select(F.col("part").alias("to"), "i").distinct().join(held.select("part", "i").distinct(), "i")
        self.away = bucketed(routes.where(F.col("part") != F.col("to")).select("part", "i", "to"), buckets, "i")

    def shipped(self, x: DataFrame) -> DataFrame:
        """(part, i, a): the values of x (part, i, a), in buckets of part, that other parts want, each in the part that
        wants it. They are all that is exchanged."""
        sent = self.away.join(x.select("part", "i", "a"), ["part", "i"])
        return sent.select(F.col("to").alias("part"), "i", "a")

    def volume(self) -> DataFrame:
        """(part, to, n): values sent from part to part in each use."""
        return self.away.groupBy("part", "to").agg(F.count(F.lit(1)).alias("n"))

    def close(self) -> None:
        drop(self.away)


class Scatter:
    """A persistent usscga: packed z (part, i) takes packed x's values where x (part, i) has the place and 0 where it
    hasn't. The places are those of both when it is made; values may change from run to run. An index that x holds more
    than once, in one part or in several, has no single value: it stops the making."""

    def __init__(self, x: DataFrame, z: DataFrame, buckets: int):
        if not x.groupBy("i").count().where("count > 1").isEmpty():
            raise IncompatibleError("a place is held twice")
        self.z = bucketed(z.drop("a"), buckets, "i")
        self.routes = Routes(x, z, buckets)

    def start(self, x: DataFrame) -> DataFrame:
        """The values on their way: x (part, i, a) in buckets of part."""
        return self.routes.shipped(x)

    def run(self, x: DataFrame) -> DataFrame:
        """z with its values, in buckets of part."""
        kind = ve.kind_of(x)
        own = x.select("part", "i", F.col("a").alias("_own"))
        away = self.start(x).withColumnRenamed("a", "_away")
        both = self.z.join(own, ["part", "i"], "left").join(away, ["part", "i"], "left")
        out = both.select(*self.z.columns, F.coalesce("_own", "_away", ve.nothing(kind)).alias("a"))
        return bucketed(out, self.routes.buckets, "i", dealt=True)

    def close(self) -> None:
        drop(self.z)
        self.routes.close()


class Product:
    """y = op(A) x for one A and many x. owners (i, part) is a table of all rows and columns of a square A (another has
    owners of its columns apart)."""

    keys = ["part", "i"]

    def __init__(self, a: DataFrame, owners: DataFrame, buckets: int, columns: DataFrame | None = None, trans: Transposition | str = "notrans", symmetry: Symmetry | str = "general"):
        full = oriented(a, trans, symmetry)
        self.buckets = buckets
        self.owners = storage.written(owners.select("i", "part"), "owners")
        of_columns = self.owners if columns is None else storage.written(columns.select("i", "part"), "owners")
        self.columns = of_columns
        placed = full.join(self.owners, "i").join(of_columns.toDF("j", "_owner"), "j").select("part", "i", "j", "a", "_owner")
        placed = storage.written(placed, "placed")
        self.own = bucketed(placed.where(F.col("_owner") == F.col("part")).drop("_owner"), buckets, "j")
        self.away = bucketed(placed.where(F.col("_owner") != F.col("part")).drop("_owner"), buckets, "j")
        self.routes = Routes(self.columns, placed.select("part", F.col("j").alias("i")), buckets)
        storage.drop(placed)

    def placed(self, x: DataFrame, columns: bool = True) -> DataFrame:
        """A vector (i, a) in the parts of its owners, stored."""
        return bucketed(x.join(self.columns if columns else self.owners, "i").select("part", *x.columns), self.buckets, "i")

    def gemv(self, x: DataFrame) -> DataFrame:
        """(part, i, a) of the rows that have a product, as a plan to be run in_place: x is (part, i, a) in buckets."""
        is_complex = ve.is_complex(x)
        if ve.is_complex(self.own) != is_complex:
            raise IncompatibleError("A and x differ in field")
        sums = []
        for entries, values in ((self.own, x), (self.away, self.routes.shipped(x))):
            met = entries.withColumnRenamed("a", "_a").join(values.select("part", F.col("i").alias("j"), F.col("a").alias("_x")), ["part", "j"])
            sums.append(product_sum(met, self.keys, "_a", "_x", is_complex))
        kind = ve.kind_of(sums[0])
        zero = ve.nothing(kind)
        both = sums[0].withColumnRenamed("a", "_l").join(sums[1].withColumnRenamed("a", "_r"), self.keys, "full")
        return both.select(*self.keys, ve.plus(F.coalesce("_l", zero), F.coalesce("_r", zero), kind).alias("a"))

    def written(self, df: DataFrame) -> DataFrame:
        """A result that holds gemv()'s plan, stored in the same buckets."""
        return bucketed(df, self.buckets, "i", dealt=True)

    def close(self) -> None:
        drop(self.own, self.away, self.columns)
        if self.columns is not self.owners:
            drop(self.owners)
        self.routes.close()
