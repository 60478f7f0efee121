"""Vectorised hashing of words and byte windows with NumPy, for the operators that run in Python workers.

A string's hash is the sum of table[byte] * BASE**position over 64 bits, taken from prefix sums and divided by
BASE**start (BASE is odd, so it has an inverse), then mixed. Equal strings have equal hashes wherever they stand.
"""

from __future__ import annotations

import numpy as np

#: Bytes that are hashed at once; a longer text is cut at white space.
CHUNK = 1 << 19
BASE = 0x9E3779B97F4A7C13
_MASK = (1 << 64) - 1
_table = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 64, 256, dtype=np.uint64, endpoint=False)
_space = np.zeros(256, bool)
_space[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[int, np.ndarray] = {}


def slices(batches, rows: int = 500):
    """Smaller Arrow batches, for work that takes several times the room of the rows."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64; kept for reuse."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK // 4), base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


INVERSE = pow(BASE, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads each input bit over all output bits."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def prefix(buf: np.ndarray) -> np.ndarray:
    """Prefix sums, one longer than buf."""
    out = np.empty(len(buf) + 1, np.uint64)
    out[0] = 0
    np.cumsum(_table[buf] * powers(BASE, len(buf)), out=out[1:])
    return out


def span_hashes(pre: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    inverse = powers(INVERSE, len(pre))
    return mix((pre[ends] - pre[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def window_hashes(pre: np.ndarray, width: int) -> np.ndarray:
    """Hash of each window of that many bytes."""
    n = len(pre) - width
    if n <= 0:
        return np.empty(0, np.uint64)
    return mix((pre[width:] - pre[:-width]) * powers(INVERSE, n))


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than white space."""
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = ~_space[buf]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _pieces(text: bytes):
    """Parts of CHUNK bytes or a little more, cut at white space (a longer word is left whole)."""
    at = 0
    while len(text) - at > 2 * CHUNK:
        end = at + CHUNK
        while end < len(text) and not _space[text[end]]:
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def word_lists(text: bytes):
    """The words of a text in order, a list for each of its pieces; bytes are split at the six white space characters."""
    for piece in _pieces(text):
        yield piece.split()


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """The hashes of the words of each text."""
    out: list[np.ndarray] = []
    group: list[bytes] = []
    size = 0

    def flush():
        if not group:
            return
        buf = np.frombuffer(b" ".join(group), np.uint8)
        starts, ends = word_spans(buf)
        h = span_hashes(prefix(buf), starts, ends)
        bounds = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in group]))
        out.extend(np.split(h, bounds[:-1]))

    for t in texts:
        if len(t) > CHUNK:
            flush()
            group, size = [], 0
            parts = []
            for piece in _pieces(t):
                group = [piece]
                flush()
                parts.append(out.pop())
            group = []
            out.append(np.concatenate(parts))
            continue
        group.append(t)
        size += len(t) + 1
        if size >= CHUNK:
            flush()
            group, size = [], 0
    flush()
    return out


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words, from the words' hashes; none if there are fewer."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + h[k : len(h) - n + 1 + k])
    return out
