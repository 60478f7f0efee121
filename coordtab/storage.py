"""Tables that cut lineage, in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

_cleaned: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, a new one, on a session of one machine only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    found = "file://" + tempfile.mkdtemp(prefix="coordtab-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    """A path for one table; what stands of all tables of an application goes when the driver ends."""
    folder = f"{shared_dir(spark).rstrip('/')}/coordtab/{spark.sparkContext.applicationId}"
    if folder not in _cleaned:
        _cleaned.add(folder)
        atexit.register(remove, spark, folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table or folder; at exit the session may be gone already, then the files stay."""
    jvm = spark.sparkContext._jvm
    if spark.sparkContext._jsc is None or jvm is None:
        return
    try:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  a closed gateway raises whatever socket error it meets
        return


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes df once as Parquet into the shared folder and reads it back. A lost executor costs no
    recomputation of what stands above, and all users of the result read the same rows."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored = path
    return out


def bucketed(df: DataFrame, key: str, name: str, dealt: bool = False) -> DataFrame:
    """written(), in as many buckets of key as Spark makes partitions: joins and sums by key leave the table where it is.
    dealt: df is partitioned by key already."""
    spark = df.sparkSession
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table, path = f"coordtab_{uuid.uuid4().hex}", new_path(spark, name)
    rows = df if dealt else df.repartition(count, key)
    rows.write.bucketBy(count, key).sortBy(key).option("path", path).format("parquet").saveAsTable(table)
    out = spark.table(table)
    out._stored, out._table = path, table
    return out


#: Joins that send no table by way of the driver.
NO_BROADCASTS = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Plans made and run within it use these settings."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def without_broadcasts(step: Callable) -> Callable:
    """A step of many rounds, whose first argument is a frame: each round would broadcast the same tables anew, all of them
    by way of the driver."""

    @wraps(step)
    def run(df: DataFrame, *args, **kwargs):
        with settings(df.sparkSession, NO_BROADCASTS):
            return step(df, *args, **kwargs)

    return run


def drop(*tables: DataFrame | None) -> None:
    """Deletes tables that written() or bucketed() gave, once nothing will read them any more."""
    for t in tables:
        table = None if t is None else vars(t).pop("_table", None)
        if table:
            t.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
        path = None if t is None else vars(t).pop("_stored", None)
        if path:
            remove(t.sparkSession, path)
