"""What a matrix or vector is, apart from its entries: the data model's enumerations and sizes."""

from __future__ import annotations

from dataclasses import dataclass, replace
from enum import StrEnum

from .errors import HeaderError, IncompatibleError, SizeError


class Kind(StrEnum):
    MATRIX = "matrix"
    VECTOR = "vector"


class Layout(StrEnum):
    ARRAY = "array"
    COORDINATE = "coordinate"


class Field(StrEnum):
    REAL = "real"
    COMPLEX = "complex"
    INTEGER = "integer"
    PATTERN = "pattern"


class Symmetry(StrEnum):
    GENERAL = "general"
    SYMMETRIC = "symmetric"
    SKEW = "skew-symmetric"
    HERMITIAN = "hermitian"


class Precision(StrEnum):
    SINGLE = "single"
    DOUBLE = "double"


class Transposition(StrEnum):
    NONE = "notrans"
    TRANS = "trans"
    CONJ = "conjtrans"


class Sorting(StrEnum):
    UNSORTED = "unsorted"
    PERMUTE = "permute"
    ROW = "row-major"
    COLUMN = "column-major"
    MORTON = "morton"


class Ordering(StrEnum):
    DEFAULT = "default"
    CUSTOM = "custom"
    RCM = "rcm"
    ND = "nd"
    METIS = "metis"
    SCOTCH = "scotch"


class Partitioning(StrEnum):
    BLOCK = "block"
    CYCLIC = "cyclic"
    BLOCK_CYCLIC = "block-cyclic"
    CUSTOM = "custom"


class PartKind(StrEnum):
    NONZEROS = "nonzeros"
    ROWS = "rows"
    COLUMNS = "columns"
    TWO_D = "2d"
    METIS = "metis"
    SCOTCH = "scotch"


class VectorBackend(StrEnum):
    """Accepted for compatibility; Spark plans all of them alike."""

    BASE = "base"
    BLAS = "blas"
    NULL = "null"
    OMP = "omp"


class MatrixBackend(StrEnum):
    BLAS = "blas"
    COO = "coo"
    CSR = "csr"
    DENSE = "dense"
    NULL = "null"
    OMPCSR = "ompcsr"


class Overlap(StrEnum):
    NONE = "none"
    IRECV = "irecv"


def parse_enum[E: StrEnum](kind: type[E], text: str, delimiters: str = "") -> tuple[E, str]:
    """Reads a name up to the end or to one of the delimiters; returns it and what follows the delimiter."""
    at = min([text.index(d) for d in delimiters if d in text], default=len(text))
    try:
        return kind(text[:at]), text[at + 1 :]
    except ValueError:
        raise HeaderError(f"{text[:at]!r} is none of {', '.join(kind)}") from None


@dataclass(frozen=True)
class Meta:
    """Header, comments and size of a matrix or vector. ncols is -1 for vectors, nnz is -1 in array layout."""

    nrows: int
    ncols: int = -1
    nnz: int = -1
    kind: Kind = Kind.MATRIX
    layout: Layout = Layout.COORDINATE
    field: Field = Field.REAL
    symmetry: Symmetry = Symmetry.GENERAL
    precision: Precision = Precision.DOUBLE
    comments: tuple[str, ...] = ()

    @property
    def data_lines(self) -> int:
        """Lines of the data section, from kind, layout and symmetry."""
        if self.layout is Layout.COORDINATE:
            return self.nnz
        if self.kind is Kind.VECTOR:
            return self.nrows
        if self.symmetry is Symmetry.GENERAL:
            return self.nrows * self.ncols
        if self.nrows != self.ncols:
            raise SizeError("a symmetric matrix must be square")
        n = self.nrows
        return n * (n - 1) // 2 if self.symmetry is Symmetry.SKEW else n * (n + 1) // 2

    def header_line(self) -> str:
        return f"%%MatrixMarket {self.kind} {self.layout} {self.field} {self.symmetry}"

    def size_line(self) -> str:
        parts = [self.nrows] + [self.ncols] * (self.kind is Kind.MATRIX) + [self.nnz] * (self.layout is Layout.COORDINATE)
        return " ".join(map(str, parts))

    def transposed(self) -> Meta:
        return self if self.kind is Kind.VECTOR else replace(self, nrows=self.ncols, ncols=self.nrows)

    def concatenated(self, other: Meta) -> Meta:
        """Size of two files' data one after the other: array rows add up, coordinate entries do."""
        if (self.kind, self.layout, self.field, self.symmetry) != (other.kind, other.layout, other.field, other.symmetry):
            raise IncompatibleError("headers differ")
        if self.layout is Layout.ARRAY:
            if self.ncols != other.ncols:
                raise IncompatibleError("numbers of columns differ")
            return replace(self, nrows=self.nrows + other.nrows, comments=self.comments + other.comments)
        if (self.nrows, self.ncols) != (other.nrows, other.ncols):
            raise IncompatibleError("dimensions differ")
        return replace(self, nnz=self.nnz + other.nnz, comments=self.comments + other.comments)

    @property
    def row_vector_size(self) -> int:
        """A row vector has as many entries as the matrix has columns."""
        return self.ncols

    @property
    def column_vector_size(self) -> int:
        return self.nrows


def valid_comment(line: str) -> str:
    if not line.startswith("%") or line.count("\n") != 1 or not line.endswith("\n"):
        raise HeaderError("a comment starts with % and has one newline, at its end")
    return line


def header_of(line: str) -> dict:
    """Kind, layout, field and symmetry of a header line: exact case, single spaces."""
    start = "%%MatrixMarket "
    if not line.startswith(start):
        raise HeaderError("the first line must start with %%MatrixMarket")
    rest = line[len(start) :].removesuffix("\n")
    kind, rest = parse_enum(Kind, rest, " ")
    layout, rest = parse_enum(Layout, rest, " ")
    field_, rest = parse_enum(Field, rest, " ")
    symmetry, rest = parse_enum(Symmetry, rest)
    if layout is Layout.ARRAY and field_ is Field.PATTERN:
        raise HeaderError("an array can't be a pattern")
    return {"kind": kind, "layout": layout, "field": field_, "symmetry": symmetry}


def size_of(line: str, kind: Kind, layout: Layout) -> dict:
    """nrows, ncols, nnz of a size line; strictly single spaces."""
    parts = line.removesuffix("\n").split(" ")
    names = ["nrows"] + ["ncols"] * (kind is Kind.MATRIX) + ["nnz"] * (layout is Layout.COORDINATE)
    if len(parts) != len(names) or not all(p.isascii() and p.isdigit() for p in parts):
        raise SizeError(f"a size line of {len(names)} numbers was expected, not {line!r}")
    return dict(zip(names, map(int, parts)))
