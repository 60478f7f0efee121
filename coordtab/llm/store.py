"""Intermediate tables (those of the library), the package on the executors, and marks before joins."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import drop, new_path, remove, shared_dir, written

__all__ = ["drop", "keeps_columns", "marked", "new_path", "remove", "shared_dir", "ship", "small_batches", "trimmed", "written"]

PACKAGE = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors (once an application), so that Python workers can import it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    target = f"{tempfile.mkdtemp(prefix='coordtab-')}/coordtab.zip"
    with zipfile.ZipFile(target, "w") as z:
        for file in sorted(PACKAGE.rglob("*.py")):
            z.write(file, file.relative_to(PACKAGE.parent))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


#: Rows go to Python workers in Arrow batches of so many bytes; Spark's own bound of 64 MB is taken by each of an executor's
#: tasks several times, in the JVM and in the worker.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def small_batches(spark: SparkSession) -> None:
    """Sets BATCH_BYTES for the session, unless it has a bound of its own."""
    if BATCH_BYTES[0] not in spark.conf.getAll:
        spark.conf.set(*BATCH_BYTES)


def trimmed(work):
    """For functions of Python workers: what they leave unused when they end goes back to the system, as the worker lives
    on beside other stages."""

    @functools.wraps(work)
    def run(batches):
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # C libraries without it
                ctypes.CDLL(None).malloc_trim(0)

    return run


#: Keys are marked in so many bits (8 MB), which are broadcast. With more keys than bits, some rows pass in vain.
BITS = 1 << 26


def marked(df: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """The rows of df whose key (a long) is in the only column of keys, and some others: a test of one of BITS bits, made
    before rows are shuffled to a join that settles it."""
    bit = lambda k: F.pmod(k, F.lit(BITS)) + 1
    name = keys.columns[0]
    places = keys.where(F.col(name).isNotNull()).select(bit(F.col(name)).alias("_x"))
    maps = places.groupBy(F.expr("bitmap_bucket_number(_x)").alias("_m")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(_x))").alias("_map"))
    at = df.withColumn("_x", bit(key)).withColumn("_m", F.expr("bitmap_bucket_number(_x)"))
    byte = F.conv(F.hex(F.substr("_map", (F.floor(F.expr("bitmap_bit_position(_x)") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    set_ = F.expr("shiftright(_byte, cast(bitmap_bit_position(_x) % 8 as int)) & 1") == 1
    return at.join(F.broadcast(maps), "_m").withColumn("_byte", byte).where(set_).select(*df.columns)


def keeps_columns(operator):
    """For operators that add columns (named with a leading underscore) to a table: columns of the table that start with an
    underscore get other names meanwhile, so that they clash with nothing. One that has the name of an added column
    gives way to it."""

    @functools.wraps(operator)
    def run(docs: DataFrame, *args, **options):
        named = {x for x in (*args, *options.values()) if isinstance(x, str)}
        other = {c: f"kept-{k}-{uuid.uuid4().hex}" for k, c in enumerate(docs.columns) if c.startswith("_") and c not in named}
        if not other:
            return operator(docs, *args, **options)
        out = operator(docs.withColumnsRenamed(other), *args, **options)
        added = {c.lower() for c in out.columns}
        out = out.drop(*(v for c, v in other.items() if c.lower() in added))
        return out.withColumnsRenamed({v: c for c, v in other.items() if c.lower() not in added})

    return run
