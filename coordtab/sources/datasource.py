"""Coordinate files as a data source of Spark: spark.read.format("mtx").load(path), df.write.format("mtx").save(path).

Reading takes byte ranges of the files as partitions, a split into Arrow batches by pyarrow's parser, the schema from header
and size line, and conditions on i and j, which are tested before rows reach Spark. Storage positions aren't numbered, as
that takes a pass over all of a file: mtx.read does it, and reads arrays and gzip files. Paths are those of pyarrow's file
systems; for others mtx.read goes through Spark's own readers."""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv, fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from ..errors import HeaderError, IncompatibleError
from ..meta import Field, Kind, Layout, Meta, Symmetry
from .mtx import head

#: Bytes of a partition, and of the text that is parsed at once.
SPLIT, BLOCK = 64 << 20, 4 << 20
TESTS = {EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal}


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path within it."""
    url = urlparse(path)
    if url.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(url.path) if url.scheme else path
    return fs.FileSystem.from_uri(path)


def files_of(system: fs.FileSystem, path: str) -> list[fs.FileInfo]:
    """The file, or the part files of a folder in order."""
    found = system.get_file_info(path)
    if found.type == fs.FileType.File:
        return [found]
    inside = system.get_file_info(fs.FileSelector(path))
    return sorted((f for f in inside if f.type == fs.FileType.File and f.base_name[0] not in "._"), key=lambda f: f.path)


def heading(system: fs.FileSystem, files: list[fs.FileInfo]) -> tuple[Meta, int]:
    """Meta, and the bytes of the first file before the data (comments must end within it)."""
    if not files:
        raise HeaderError("no file")
    with system.open_input_file(files[0].path) as f:
        n = 1 << 16
        while True:
            f.seek(0)
            text = f.read(n)
            lines = text.decode().split("\n")
            whole = lines[:-1] if len(text) == n else [x for x in lines if x or x is not lines[-1]]
            found = head(whole)
            if found:
                return found[0], min(len(text), sum(len(x.encode()) + 1 for x in whole[: found[1]]))
            if len(text) < n:
                raise HeaderError("no size line")
            n *= 8


def rest(f: pa.NativeFile, at: int) -> bytes:
    """What follows from there, up to the end of a line and with it."""
    f.seek(at)
    out = b""
    while b"\n" not in out:
        more = f.read(256)
        if not more:
            return out
        out += more
    return out[: out.index(b"\n") + 1]


def columns_of(m: Meta) -> dict[str, pa.DataType]:
    if m.layout is not Layout.COORDINATE:
        raise IncompatibleError("this source reads coordinate files; mtx.read reads arrays")
    out = {"i": pa.int64()} | ({"j": pa.int64()} if m.kind is Kind.MATRIX else {})
    if m.field is Field.COMPLEX:
        return out | {"re": pa.float64(), "im": pa.float64()}
    return out if m.field is Field.PATTERN else out | {"a": pa.int64() if m.field is Field.INTEGER else pa.float64()}


@dataclass
class Range(InputPartition):
    path: str
    begin: int
    end: int
    #: where data begins in the file
    first: int


class Reader(DataSourceReader):
    def __init__(self, path: str, m: Meta, before: int, split: int):
        self.path, self.meta, self.before, self.split = path, m, before, split
        self.tests: list = []

    def pushFilters(self, filters):
        for f in filters:
            if type(f) in (*TESTS, In) and f.attribute in (("i",), ("j",)):
                self.tests.append(f)
            else:
                yield f

    def partitions(self) -> list[Range]:
        system, path = located(self.path)
        out = []
        for k, f in enumerate(files_of(system, path)):
            first = self.before if k == 0 else 0
            out += [Range(f.path, a, min(a + self.split, f.size), first) for a in range(first, f.size, self.split)]
        return out

    def lines(self, part: Range) -> Iterator[bytes]:
        """Blocks of whole lines that begin in the range."""
        system, _ = located(self.path)
        with system.open_input_file(part.path) as f:
            at = part.begin
            if at > part.first:  # the line that the range before ends in is read there, unless it ends just before
                at = at - 1 + len(rest(f, at - 1))
            while at < part.end:
                f.seek(at)
                block = f.read(min(BLOCK, part.end - at))
                if not block.endswith(b"\n"):
                    block += rest(f, at + len(block))
                at += len(block)
                yield block

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        columns = columns_of(self.meta)
        parse = csv.ParseOptions(delimiter=" ", quote_char=False)
        types = csv.ConvertOptions(column_types=columns, include_columns=list(columns))
        for block in self.lines(part):
            if not block.strip():
                continue
            t = csv.read_csv(io.BytesIO(block), csv.ReadOptions(column_names=list(columns), use_threads=False), parse, types)
            for name, most in (("i", self.meta.nrows), ("j", self.meta.ncols)):
                if name in columns and len(t):
                    low, high = pc.min_max(t[name]).as_py().values()
                    if low < 1 or high > most:
                        raise HeaderError(f"index out of bounds: {name} from {low} to {high}")
            for test in self.tests:
                column = t[test.attribute[0]]
                t = t.filter(pc.is_in(column, pa.array(test.value, pa.int64())) if isinstance(test, In) else TESTS[type(test)](column, pa.scalar(test.value)))
            if self.meta.field is Field.COMPLEX:
                a = pa.StructArray.from_arrays([t["re"].combine_chunks(), t["im"].combine_chunks()], ["re", "im"])
                t = t.drop_columns(["re", "im"]).append_column("a", a)
            yield from t.to_batches()


@dataclass
class Written(WriterCommitMessage):
    path: str | None
    n: int


class Writer(DataSourceArrowWriter):
    """Part files of data lines; header and size line are a file before them, written when all tasks have ended. What a
    task that failed has left is removed."""

    def __init__(self, path: str, options: dict, columns: list[str], kinds: dict[str, str], overwrite: bool):
        self.path, self.options, self.columns, self.kinds, self.overwrite = path, options, columns, kinds, overwrite

    def meta(self, n: int) -> Meta:
        kind = self.kinds.get("a")
        field = Field.PATTERN if kind is None else Field.COMPLEX if kind.startswith("struct") else Field.INTEGER if kind in ("tinyint", "smallint", "int", "bigint") else Field.REAL
        matrix = "j" in self.columns
        return Meta(int(self.options["rows"]), int(self.options["columns"]) if matrix else -1, n, kind=Kind.MATRIX if matrix else Kind.VECTOR, field=field, symmetry=Symmetry(self.options.get("symmetry", "general")))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        system, path = located(self.path)
        system.create_dir(path)
        name, n = f"{path}/part-{task.partitionId():05d}-{task.taskAttemptId()}.mtx", 0
        with system.open_output_stream(name) as out:
            for batch in iterator:
                named = pa.Table.from_batches([batch])
                texts = [named[c].cast(pa.string()) for c in ("i", "j") if c in self.columns]
                if "a" in self.columns:
                    a = named["a"].combine_chunks()
                    texts += [(a.field(q) if isinstance(a, pa.StructArray) else a).cast(pa.string()) for q in (("re", "im") if isinstance(a, pa.StructArray) else (0,))]
                lines = pc.binary_join_element_wise(*texts, " ")
                n += len(lines)
                out.write("".join(x + "\n" for x in lines.to_pylist()).encode())
        return Written(name, n)

    def commit(self, messages: list[Written | None]) -> None:
        system, path = located(self.path)
        done = {m.path for m in messages if m}
        system.create_dir(path)
        m = self.meta(sum(x.n for x in messages if x))
        for f in files_of(system, path):
            if f.path not in done:
                system.delete_file(f.path)
        with system.open_output_stream(f"{path}/header.mtx") as out:
            out.write(f"{m.header_line()}\n{m.size_line()}\n".encode())

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = located(self.path)
        for m in messages:
            if m:
                system.delete_file(m.path)


class MatrixSource(DataSource):
    """Options: path; rows and columns, which a writer needs; symmetry of what is written; split, bytes of a partition."""

    @classmethod
    def name(cls) -> str:
        return "mtx"

    def head(self) -> tuple[Meta, int]:
        system, path = located(self.options["path"])
        return heading(system, files_of(system, path))

    def schema(self) -> str:
        names = {pa.int64(): "bigint", pa.float64(): "double"}
        columns = {c: names[t] for c, t in columns_of(self.head()[0]).items()}
        if "re" in columns:
            columns = {c: t for c, t in columns.items() if c in "ij"} | {"a": "struct<re: double, im: double>"}
        return ", ".join(f"{c} {t}" for c, t in columns.items())

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], *self.head(), int(self.options.get("split", SPLIT)))

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        kinds = {f.name: f.dataType.simpleString() for f in schema}
        if "i" not in kinds or not set(kinds) <= {"i", "j", "a"}:
            raise IncompatibleError("entries are (i, j, a), (i, a), (i, j) or (i)")
        system, path = located(self.options["path"])
        if not overwrite and system.get_file_info(path).type != fs.FileType.NotFound:
            raise IncompatibleError("the path has something already; mode overwrite replaces it")
        return Writer(self.options["path"], dict(self.options), list(kinds), kinds, overwrite)


def register(spark: SparkSession) -> None:
    """Makes format("mtx") known to a session. This package must be importable on the executors (installed there, or sent
    with addPyFile)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MatrixSource)
