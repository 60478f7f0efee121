"""Errors of the engine; each has a short code that callers can compare."""

from __future__ import annotations


class MatrixError(ValueError):
    code = "error"

    def __init__(self, message: str):
        super().__init__(message)


class HeaderError(MatrixError):
    code = "invalid header"


class SizeError(MatrixError):
    code = "invalid size"


class DataError(MatrixError):
    code = "invalid data"


class IndexBoundsError(MatrixError):
    code = "index out of bounds"


class IncompatibleError(MatrixError):
    """Operands whose field, size or symmetry don't go together."""

    code = "incompatible operands"


class PartitionError(MatrixError):
    code = "invalid partition"


class PermutationError(MatrixError):
    code = "invalid permutation"


class FormatError(MatrixError):
    code = "invalid number format"


class NotConverged(MatrixError):
    code = "not converged"
