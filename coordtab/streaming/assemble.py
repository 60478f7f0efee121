"""Assembly of entries as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..operators import entries as en


def assembled(stream: DataFrame) -> DataFrame:
    """Sums of the entries of each place so far, for update or complete mode. The state has a row for each place."""
    return stream.groupBy("i", "j").agg(F.sum("a").alias("a"))


def assembled_windows(stream: DataFrame, time: str, width: str, late: str) -> DataFrame:
    """Sums of each place in windows of time, for append mode: a window is dropped from the state once it is `late` old."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("window"), "i", "j").agg(F.sum("a").alias("a"))


#: Batches after which a table's deltas become one base.
COMPACT = 16


class Table:
    """Sums of a stream of entries in a folder, exact however often a batch is written.

    A batch leaves its own sums as batch=<id>, which a repeated batch writes anew. Now and then all of them, with the base
    before, become the base upto=<id>; it counts once it is whole, and then its batches count no more. So a stop at any
    moment, before or after a write, neither loses a batch nor adds it twice."""

    def __init__(self, spark: SparkSession, path: str, compact: int = COMPACT):
        self.spark, self.path, self.compact = spark, path.rstrip("/"), compact
        self.root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        self.files = self.root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def whole(self, kind: str) -> list[int]:
        """Ids of the whole tables of a kind, ascending."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        if not self.files.exists(self.root):
            return []
        names = [f.getPath().getName() for f in self.files.listStatus(self.root)]
        return sorted(int(n.partition("=")[2]) for n in names if n.startswith(f"{kind}=") and self.files.exists(path(f"{self.path}/{n}/_SUCCESS")))

    def parts(self) -> tuple[list[str], int]:
        """Folders that make up the table, and the number of batches among them."""
        base = self.whole("upto")[-1:]
        new = [b for b in self.whole("batch") if not base or b > base[0]]
        return [f"{self.path}/upto={b}" for b in base] + [f"{self.path}/batch={b}" for b in new], len(new)

    def read(self) -> DataFrame:
        """(i, j, a) so far."""
        return en.assemble(self.spark.read.parquet(*self.parts()[0]))

    def add(self, batch: DataFrame, number: int) -> None:
        """For foreachBatch: batch has entries (i, j, a)."""
        base = self.whole("upto")[-1:]
        if base and number <= base[0]:
            return  # a repeated batch that the base has already
        en.assemble(batch).write.mode("overwrite").parquet(f"{self.path}/batch={number}")
        folders, count = self.parts()
        if count >= self.compact:
            en.assemble(self.spark.read.parquet(*folders)).write.mode("overwrite").parquet(f"{self.path}/upto={number}")
            for folder in folders:
                storage.remove(self.spark, folder)


def into_table(stream: DataFrame, table: Table, checkpoint: str, **trigger):
    """Starts to assemble a stream of entries (i, j, a) into a table."""
    return stream.writeStream.foreachBatch(table.add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
