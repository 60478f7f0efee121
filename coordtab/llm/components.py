"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store

#: What a node's edges are dealt over in joins. Its minimum, which partial sums find without moving them, is repeated as often.
SALTS = 8


def salt(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(SALTS)).cast("int").alias("_s")


def salted(df: DataFrame) -> DataFrame:
    """df once for each salt."""
    return df.withColumn("_s", F.explode(F.array(*map(F.lit, range(SALTS)))))


def least(edges: DataFrame) -> DataFrame:
    """u, m: the smallest of the smaller neighbours of every node that has any."""
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def large_star(edges: DataFrame) -> DataFrame:
    """Joins every larger neighbour of a node to the node's smallest neighbour (or itself). Edges have u > v."""
    near = salted(least(edges)).withColumnRenamed("u", "v")
    return edges.withColumn("_s", salt("u")).join(near, ["v", "_s"], "left").select("u", F.coalesce("m", "v").alias("v"))


def small_star(edges: DataFrame) -> DataFrame:
    """Joins a node and its smaller neighbours to the smallest of them. Edges have u > v."""
    near = least(edges)
    moved = edges.withColumn("_s", salt("v")).join(salted(near), ["u", "_s"]).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(near.select("u", F.col("m").alias("v"))).distinct()


def are_stars(edges: DataFrame) -> bool:
    """Whether every node that has a smaller neighbour has one only, which has none."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("below"), F.lit(0).alias("above"))
    ends = ends.unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    by = ends.groupBy("x").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return by.where((F.col("below") > 1) | ((F.col("below") > 0) & (F.col("above") > 0))).isEmpty()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """_id, _component: the smallest id reachable, for every id that has an edge and isn't the smallest itself.

    Every round halves paths, so the number of rounds is logarithmic; each is written to the shared folder, and none is
    made once all edges are stars. Loops and repeated edges do no harm; edges with a null end are ignored."""
    two = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    now = store.written(two.distinct(), "edges")
    while not are_stars(now):
        wide = store.written(large_star(now), "wide")
        store.drop(now)
        now = store.written(small_star(wide), "edges")
        store.drop(wide)
    return now.select(F.col("u").alias("_id"), F.col("v").alias("_component"))
