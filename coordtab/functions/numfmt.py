"""Number formats in the style of C's printf."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import FormatError

SPEC = re.compile(r"%(?P<flags>[-+ #0]*)(?P<width>\d*)(?:\.(?P<precision>\d*))?(?P<kind>[eEfFgGd])")


@dataclass(frozen=True)
class Spec:
    flags: str = ""
    width: int | None = None
    precision: int | None = None
    kind: str = "g"

    def __str__(self) -> str:
        return f"%{self.flags}{self.width or ''}{'' if self.precision is None else f'.{self.precision}'}{self.kind}"


def parse(text: str, integer: bool = False) -> Spec:
    """One conversion and nothing else; `*` and length modifiers aren't allowed, d is for integers only and the others
    for other fields only."""
    m = SPEC.fullmatch(text)
    if not m:
        raise FormatError(f"{text!r} is no number format")
    if (m["kind"] == "d") != integer:
        raise FormatError(f"{text!r} doesn't suit the field")
    return Spec(m["flags"], int(m["width"]) if m["width"] else None, None if m["precision"] is None else int(m["precision"] or 0), m["kind"])


def formatted(value: Column, spec: Spec) -> Column:
    """Text of a number. C's %g drops zeros and Java's doesn't, and ties of %e and %f are rounded otherwise, so these are
    formatted in Arrow batches; %d is by Java's formatter, without the flags that C ignores."""
    if spec.kind == "d" and spec.precision is None:
        if not spec.flags and spec.width is None:
            return value.cast("string")
        flags = "".join(c for c in dict.fromkeys(spec.flags) if c != "#" and not (c == "0" and ("-" in spec.flags or spec.width is None)) and not (c == " " and "+" in spec.flags) and not (c == "-" and spec.width is None))
        return F.when(value.isNotNull(), F.format_string(f"%{flags}{spec.width or ''}d", value))
    pattern = str(spec)

    def work(x: pa.Array) -> pa.Array:
        return pa.array([None if v is None else pattern % v for v in x.to_pylist()], pa.string())

    return F.arrow_udf(work, "string")(value)
