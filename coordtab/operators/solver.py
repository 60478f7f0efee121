"""Conjugate gradients for symmetric positive definite systems."""

from __future__ import annotations

from dataclasses import dataclass
from math import sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import NotConverged
from ..meta import Symmetry
from . import halo
from .products import Prepared


@dataclass
class Solution:
    x: DataFrame
    iterations: int
    b_norm: float
    residual_norm: float
    first_residual_norm: float
    converged: bool


def cg(a: DataFrame, b: DataFrame, x0: DataFrame | None = None, atol: float = 0.0, rtol: float = 1e-6, max_iterations: int = 100, symmetry: Symmetry | str = "general", strict: bool = False, restart: int = 0, partitions: int | None = None, owners: DataFrame | None = None) -> Solution:
    """Solves A x = b; stops where the residual's norm is at most rtol |b| or atol. Vectors have 1-based i and are full.

    An iteration is one product and two scalars; its vectors are written to the shared folder, so that neither lineage
    nor a lost executor makes it repeat earlier ones. Every `restart` iterations the residual is computed anew.

    With owners (i, part), which names a part for each row, matrix and vectors are laid out in parts, and an iteration
    exchanges nothing but the values of p that other parts need (see halo.Product)."""
    spark = a.sparkSession
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    plan = Prepared(a, count, symmetry=symmetry) if owners is None else halo.Product(a, owners, count, symmetry=symmetry)
    keys = plan.keys
    b = plan.placed(b)
    x = b.select(*keys, F.lit(0.0).alias("a")) if x0 is None else plan.placed(x0)

    def begin(x: DataFrame) -> DataFrame:
        t = plan.gemv(x).withColumnRenamed("a", "_t")
        joined = b.select(*keys, F.col("a").alias("_b")).join(x.select(*keys, F.col("a").alias("x")), keys).join(t, keys, "left")
        r = F.col("_b") - F.coalesce("_t", F.lit(0.0))
        return plan.written(joined.select(*keys, "x", r.alias("r"), r.alias("p")))

    def squared(column: str, df: DataFrame) -> float:
        return df.agg(F.coalesce(F.sum(F.col(column) * F.col(column)), F.lit(0.0))).first()[0]

    try:
        b_norm = sqrt(squared("a", b))
        state = table = begin(x)
        rr = squared("r", state)
        first = sqrt(rr)
        done = lambda rr: sqrt(rr) <= rtol * b_norm or sqrt(rr) <= atol
        count = 0
        while not done(rr) and count < max_iterations:
            if restart and count and count % restart == 0:
                before, state = table, begin(state.select(*keys, F.col("x").alias("a")))
                table = state
                halo.drop(before)
                rr = squared("r", state)
            t = plan.gemv(state.select(*keys, F.col("p").alias("a"))).withColumnRenamed("a", "t")
            before, state = table, plan.written(state.join(t, keys, "left").withColumn("t", F.coalesce("t", F.lit(0.0))))
            table = state
            halo.drop(before)
            pt = state.agg(F.sum(F.col("p") * F.col("t"))).first()[0]
            if not pt:
                break
            alpha = rr / pt
            moved = state.select(*keys, (F.col("x") + alpha * F.col("p")).alias("x"), (F.col("r") - alpha * F.col("t")).alias("r"), "p")
            new = squared("r", moved)
            state = moved.withColumn("p", F.col("r") + F.lit(new / rr) * F.col("p"))
            rr = new
            count += 1
        if strict and not done(rr):
            raise NotConverged(f"residual {sqrt(rr)} after {count} iterations")
        return Solution(state.select("i", F.col("x").alias("a")), count, b_norm, sqrt(rr), first, done(rr))
    finally:
        plan.close()
