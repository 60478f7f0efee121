"""Pictures of sparsity patterns: the relation of pixels, and a PNG of it."""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..meta import Symmetry
from . import entries as en


def picture_size(nrows: int, ncols: int, width: int, height: int) -> tuple[int, int]:
    """(width, height): a side that the matrix fits into shows each index; else the longer side takes all its room, and
    the shorter one keeps the shape where both are too long."""
    if nrows < height or ncols < width:
        return (ncols if ncols < width else width), (nrows if nrows < height else height)
    if nrows == ncols:
        return width, height
    return (height * ncols // nrows, height) if nrows > ncols else (width, width * nrows // ncols)


def pixels(entries: DataFrame, nrows: int, ncols: int, width: int = 1000, height: int = 1000, symmetry: Symmetry | str = "general") -> DataFrame:
    """(x, y) of the pixels that hold an entry, implied ones too; at most width * height rows."""
    w, h = picture_size(nrows, ncols, width, height)
    pattern = en.expand_symmetry(entries.select("i", "j"), "general" if Symmetry(symmetry) is Symmetry.GENERAL else "symmetric")
    x = F.floor((F.col("j") - 0.5) / ncols * w).cast("int")
    y = F.floor((F.col("i") - 0.5) / nrows * h).cast("int")
    return pattern.select(x.alias("x"), y.alias("y")).distinct()


def png(pixel_rows, width: int, height: int, foreground: int = 0x000000, background: int = 0xFFFFFF, gamma: float | None = None, texts: dict[str, str] | None = None) -> bytes:
    """An RGB image of the pixels (pairs x, y)."""
    rgb = lambda c: bytes(((c >> 16) & 255, (c >> 8) & 255, c & 255))
    rows = [bytearray(rgb(background) * width) for _ in range(height)]
    for x, y in pixel_rows:
        rows[y][3 * x : 3 * x + 3] = rgb(foreground)

    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    out = [b"\x89PNG\r\n\x1a\n", chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0))]
    if gamma is not None:
        out.append(chunk(b"gAMA", struct.pack(">I", round(gamma * 100_000))))
    out += [chunk(b"tEXt", k.encode("latin-1") + b"\0" + v.encode("latin-1")) for k, v in (texts or {}).items()]
    out += [chunk(b"IDAT", zlib.compress(b"".join(b"\0" + bytes(r) for r in rows))), chunk(b"IEND", b"")]
    return b"".join(out)


def draw(entries: DataFrame, nrows: int, ncols: int, path: str, width: int = 1000, height: int = 1000, symmetry: Symmetry | str = "general", **options) -> None:
    """Writes the picture on the driver; what is collected is bounded by its pixels."""
    w, h = picture_size(nrows, ncols, width, height)
    found = pixels(entries, nrows, ncols, width, height, symmetry).toPandas()
    with open(path, "wb") as f:
        f.write(png(zip(found["x"].tolist(), found["y"].tolist()), w, h, **options))
