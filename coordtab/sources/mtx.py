"""Matrix Market text files as DataFrames.

The header and size are read on the driver from the first lines. Data lines are parsed by Spark's expressions, with their
position k: lines are numbered within each split of a file, and the numbers of lines of the splits (one row a split) give
the offsets. Gzip files are read as one split."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import HeaderError
from ..functions import cplx, numfmt
from ..meta import Field, Kind, Layout, Meta, Precision, header_of, size_of
from ..operators import entries as en

WHOLE, DECIMAL = r"[+-]?\d+", r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|[+-]?(?:inf|infinity|nan)"


def head(lines: list[str]) -> tuple[Meta, int] | None:
    """Meta and the number of lines before the data; None if more lines are needed."""
    if not lines:
        raise HeaderError("the file is empty")
    header = header_of(lines[0])
    at = 1
    while at < len(lines) and lines[at].startswith("%"):
        at += 1
    if at == len(lines):
        return None
    size = size_of(lines[at], header["kind"], header["layout"])
    return Meta(**header, **size, comments=tuple(x + "\n" for x in lines[1:at])), at + 1


def first_lines(spark: SparkSession, files: list[str], n: int) -> list[str]:
    """The first lines of files that follow one another. Spark deals out large files first, so each is read by itself."""
    out: list[str] = []
    for file in files:
        out += [r["value"] for r in spark.read.text(file).take(n - len(out))]
        if len(out) >= n:
            break
    return out


def meta(spark: SparkSession, path: str, precision: Precision | str = "double") -> tuple[Meta, int]:
    files, n = sorted(spark.read.text(path).inputFiles()), 64
    while True:
        lines = first_lines(spark, files, n)
        found = head(lines)
        if found:
            return replace(found[0], precision=Precision(precision)), found[1]
        if len(lines) < n:
            raise HeaderError("no size line")
        n *= 8


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) with lines from 0, in order of the file."""
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_m"))
    splits = text.groupBy("_f", "_b").agg(F.min("_m").alias("_first"), F.count(F.lit(1)).alias("_n"))
    order = Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("_f", "_b", "_first", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_before"))
    return text.join(F.broadcast(offsets), ["_f", "_b"]).select((F.col("_before") + F.col("_m") - F.col("_first")).alias("line"), "value")  # a row a split


def types(m: Meta) -> tuple[str, str]:
    single = m.precision is Precision.SINGLE
    return ("int" if single else "bigint"), ("float" if single else "double")


def fields_of(m: Meta, k: Column, value: Column) -> list[Column]:
    """i, j, a of data line k; a line of another form, or an index out of bounds, stops the job. As all of it depends on
    k, the optimizer can't parse lines before it is known which of them are data."""
    whole, decimal = types(m)
    n_index = {Kind.MATRIX: 2, Kind.VECTOR: 1}[m.kind] if m.layout is Layout.COORDINATE else 0
    n_value = {Field.PATTERN: 0, Field.COMPLEX: 2}.get(m.field, 1)
    number = WHOLE if m.field is Field.INTEGER else DECIMAL
    pattern = " ".join([r"\d+"] * n_index + [f"(?:{number})"] * n_value)
    bad = F.raise_error(F.concat(F.lit("not a data line: "), value)).cast("string")
    parts = F.split(F.when(k < 0, F.lit(None)).when(value.rlike(f"(?i)^{pattern}$"), value).otherwise(bad), " ")
    out = []
    for at, (name, most) in enumerate([("i", m.nrows), ("j", m.ncols)][:n_index]):
        x = parts[at].cast("long")
        wrong = F.raise_error(F.concat(F.lit("index out of bounds: "), value)).cast("long")
        out.append(F.when(x.between(1, most), x).when(k < 0, F.lit(None)).otherwise(wrong).alias(name))
    if m.field is Field.COMPLEX:
        out.append(cplx.cx(parts[n_index].cast(decimal), parts[n_index + 1].cast(decimal)).alias("a"))
    elif m.field is not Field.PATTERN:
        out.append(parts[n_index].cast(whole if m.field is Field.INTEGER else decimal).alias("a"))
    return out


def read(spark: SparkSession, path: str, precision: Precision | str = "double") -> tuple[Meta, DataFrame]:
    """Meta and data: (k, i, j, a), (k, i, a) for coordinate vectors, (k, a) for arrays."""
    m, before = meta(spark, path, precision)
    lines = numbered(spark, path).where((F.col("line") >= before) & (F.col("value") != ""))
    data = lines.select((F.col("line") - before).alias("k"), *fields_of(m, F.col("line") - before, F.col("value")))
    return m, data


def counted(m: Meta, data: DataFrame) -> DataFrame:
    """data; a job fails if the number of lines isn't that of the size line."""
    found = data.count()
    if found != m.data_lines:
        raise HeaderError(f"{m.data_lines} data lines were expected, not {found}")
    return data


def read_matrix(spark: SparkSession, path: str, precision: Precision | str = "double") -> tuple[Meta, DataFrame]:
    """Meta and (k, i, j, a), places of arrays worked out."""
    m, data = read(spark, path, precision)
    if m.layout is Layout.COORDINATE:
        return m, data
    if m.symmetry == "general":
        return m, data.select("k", (F.expr(f"k div {m.ncols}") + 1).alias("i"), (F.col("k") % m.ncols + 1).alias("j"), "a")
    return m, en.triangular_places(data, strict=m.symmetry == "skew-symmetric", keep=("k",))


def read_vector(spark: SparkSession, path: str, precision: Precision | str = "double") -> tuple[Meta, DataFrame]:
    """Meta and (i, a) with 0-based i."""
    m, data = read(spark, path, precision)
    i = F.col("i") - 1 if m.layout is Layout.COORDINATE else F.col("k")
    return m, data.select(i.alias("i"), *(["a"] if "a" in data.columns else []))


def lines_of(m: Meta, data: DataFrame, fmt: str | None = None) -> DataFrame:
    """(k, value): the text of data lines. The default format is %g, for integers %d."""
    spec = numfmt.parse(fmt or ("%d" if m.field is Field.INTEGER else "%g"), m.field is Field.INTEGER)
    parts = [F.col(c).cast("string") for c in ("i", "j") if c in data.columns and m.layout is Layout.COORDINATE]
    if m.field is Field.COMPLEX:
        parts += [numfmt.formatted(F.col("a.re"), spec), numfmt.formatted(F.col("a.im"), spec)]
    elif m.field is not Field.PATTERN:
        parts.append(numfmt.formatted(F.col("a"), spec))
    return data.select("k", F.concat_ws(" ", *parts).alias("value"))


def write(m: Meta, data: DataFrame, path: str, fmt: str | None = None, compression: str | None = None, single: bool = False) -> None:
    """Header, comments, size and data lines in order of k, in part files that make up the file one after the other, sorted
    and written in parallel; or (single=True) in one file, which one task writes."""
    spark = data.sparkSession
    top = [m.header_line(), *(c.removesuffix("\n") for c in m.comments), m.size_line()]
    first = spark.createDataFrame([(k - len(top), v) for k, v in enumerate(top)], "k long, value string")
    lines = first.unionByName(lines_of(m, data, fmt)).orderBy("k")
    lines = lines.coalesce(1).sortWithinPartitions("k") if single else lines
    lines.select("value").write.mode("overwrite").options(**({"compression": compression} if compression else {})).text(path)


def info(spark: SparkSession, path: str) -> DataFrame:
    """One row: what header, size and comments say."""
    m, _ = meta(spark, path)
    row = (str(m.kind), str(m.layout), str(m.field), str(m.symmetry), m.nrows, m.ncols, m.nnz, [re.sub(r"\n$", "", c) for c in m.comments])
    return spark.createDataFrame([row], "object string, format string, field string, symmetry string, rows long, columns long, nonzeros long, comments array<string>")
