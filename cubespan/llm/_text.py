"""Words and n-grams of UTF-8 text as numpy arrays.

A word is a maximal run of bytes other than space and 0x09-0x0D. Text comes as one byte array with the
offsets of its documents, as Arrow holds it, so no string objects are made. Hashes have 64 bits; two
different sequences share one with a chance of about 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
IS_SEPARATOR = np.zeros(256, bool)
IS_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_ODD = U64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
_SPAN = U64(_BASE)
_SPAN_INVERSE = U64(pow(_BASE, -1, 1 << 64))
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, U64), np.ones(1, U64))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit integers; one to one."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U64) * _ODD)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of the base and of its inverse modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        made = []
        for base in (_SPAN, _SPAN_INVERSE):
            p = np.full(size, base, U64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _powers = (made[0], made[1])
    return _powers


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def parts(off: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about limit bytes, one document at least."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the index of each document's first word (one more at the end)."""
    n = len(data)
    inside = ~IS_SEPARATOR[data]
    begin, last = inside.copy(), inside.copy()
    if n:
        begin[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    begin[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """A hash of the bytes of each span. Spans ascend."""
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + block, "right")))
        hi = int(ends[j - 1])
        power, inverse = _power(hi - lo + 1)
        total = np.zeros(hi - lo + 1, U64)
        np.cumsum(_BYTE[data[lo:hi]] * power[: hi - lo], out=total[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (total[e] - total[s]) * inverse[s]
        i = j
    return mix(out + (ends - starts).astype(U64) * _ODD)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive items, from the hashes of the items; empty if there are fewer."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    g = mix(h[:m] + U64(n))
    for k in range(1, n):
        g = mix(g * _SPAN + h[k : k + m])
    return g


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """As grams(), for large n: the cost doesn't depend on n."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    power, inverse = _power(len(h) + 1)
    total = np.zeros(len(h) + 1, U64)
    np.cumsum(h * power[: len(h)], out=total[1:])
    return mix((total[n:] - total[:m]) * inverse[:m] + U64(n))


def within(first: np.ndarray, n: int) -> np.ndarray:
    """Which starts of n consecutive words lie in one document, for len(words) - n + 1 starts."""
    m = int(first[-1]) - n + 1
    if m <= 0:
        return np.zeros(0, bool)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return doc[:m] == doc[n - 1 :]


def covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of size words lie in a window of n words that starts at one of starts."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + n, -1)
    return np.cumsum(edge)[:size] > 0
