"""Complex numbers as struct<re, im> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cx(re, im=0.0) -> Column:
    part = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.struct(part(re).alias("re"), part(im).alias("im"))


def lit(z: complex) -> Column:
    return cx(complex(z).real, complex(z).imag)


def add(x: Column, y: Column) -> Column:
    return cx(x["re"] + y["re"], x["im"] + y["im"])


def mul(x: Column, y: Column) -> Column:
    return cx(x["re"] * y["re"] - x["im"] * y["im"], x["re"] * y["im"] + x["im"] * y["re"])


def conj(x: Column) -> Column:
    return cx(x["re"], -x["im"])


def scale(x: Column, alpha) -> Column:
    return cx(x["re"] * alpha, x["im"] * alpha)


def abs1(x: Column) -> Column:
    """|re| + |im|, the magnitude that sums and maxima of absolute values use."""
    return F.abs(x["re"]) + F.abs(x["im"])


def total(x: Column) -> Column:
    return cx(F.sum(x["re"]), F.sum(x["im"]))


def coalesced(x: Column) -> Column:
    return F.coalesce(x, lit(0))
