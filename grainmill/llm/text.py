"""Vectorised text primitives over Arrow strings: words, their 64-bit hashes, offsets. No per-word Python.

A text is seen as its UTF-8 bytes. A null text counts as an empty one. Callers walk a batch in slices of
whole documents of about ``SLICE_BYTES`` (see ``slices``), so that temporary arrays stay small whatever the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)  # odd, so that its powers have inverses modulo 2**64
_pow = np.ones(1, _U)
_inv = np.ones(1, _U)


def packed(df: DataFrame, **added: Column) -> DataFrame:
    """All columns in one, ``_row``, next to ``added``: whatever the input's columns are called, they clash with nothing."""
    return df.select(F.struct(*[df[c] for c in df.columns]).alias("_row"), *[v.alias(k) for k, v in added.items()])


def unpacked(df: DataFrame, columns: list[str], **replaced: Column) -> DataFrame:
    """The columns of ``_row`` again, some of them replaced, and others of ``replaced`` added."""
    return df.select(*[replaced.get(c, F.col("_row").getField(c)).alias(c) for c in columns], *[v.alias(k) for k, v in replaced.items() if k not in columns])


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser (splitmix64): every output bit depends on all input bits."""
    x = np.asarray(x, _U).copy()
    with np.errstate(over="ignore"):
        x ^= x >> _U(30)
        x *= _U(0xBF58476D1CE4E5B9)
        x ^= x >> _U(27)
        x *= _U(0x94D049BB133111EB)
        x ^= x >> _U(31)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))

#: Word bytes: ASCII letters and digits and every byte of a non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Word bytes: everything but ASCII white space.
SOLID = np.ones(256, bool)
SOLID[[9, 10, 11, 12, 13, 32]] = False


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, 2 * len(_pow))
        with np.errstate(over="ignore"):
            p = np.full(size, _BASE, _U)
            p[0] = 1
            _pow = np.cumprod(p, dtype=_U)
            p = np.full(size, _U(pow(int(_BASE), -1, 1 << 64)), _U)
            p[0] = 1
            _inv = np.cumprod(p, dtype=_U)
    return _pow, _inv


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array, end to end, and the offsets at which its values begin (one more than values)."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays([c.cast(pa.large_string()) for c in column.chunks]) if column.num_chunks else pa.array([], pa.large_string())
    arr = pc.fill_null(column, "").cast(pa.large_string())
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(arr.buffers()[1], np.int64, count=len(arr) + 1, offset=8 * arr.offset)
    raw = np.frombuffer(arr.buffers()[2], np.uint8) if arr.buffers()[2] else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of documents that hold about ``size`` bytes each, one document at least."""
    a, n = 0, len(off) - 1
    while a < n:
        b = int(np.searchsorted(off, off[a] + size, "right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b
        a = b


def spans(raw: np.ndarray, off: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of ``kind`` bytes: their starts and ends, and for each document the index of its first run."""
    n = len(raw)
    if not n:
        e = np.zeros(0, np.int64)
        return e, e, np.zeros(len(off), np.int64)
    m = kind[raw]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    left = np.ones(n, bool)
    left[1:] = ~m[:-1]
    right = np.ones(n, bool)
    right[:-1] = ~m[1:]
    starts = np.flatnonzero(m & (left | edge[:n]))
    ends = np.flatnonzero(m & (right | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def sums(values: np.ndarray) -> np.ndarray:
    """Prefix sums that begin with 0, modulo 2**64."""
    out = np.zeros(len(values) + 1, _U)
    np.cumsum(values, dtype=_U, out=out[1:])
    return out


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes, of its content alone."""
    p, q = _powers(len(raw) + 1)
    with np.errstate(over="ignore"):
        c = sums(_BYTE[raw] * p[: len(raw)])
        return mix64((c[ends] - c[starts]) * q[starts] + (ends - starts).astype(_U))


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """A hash of each ``width`` consecutive values; ``len(values) - width + 1`` of them, none if there are fewer."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, _U)
    p, q = _powers(len(values) + 1)
    with np.errstate(over="ignore"):
        c = sums(values * p[: len(values)])
        return mix64((c[width:] - c[:-width]) * q[:n])


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of ``values[start:end]`` for each pair."""
    p, q = _powers(len(values) + 1)
    with np.errstate(over="ignore"):
        c = sums(values * p[: len(values)])
        return mix64((c[ends] - c[starts]) * q[starts] + (ends - starts).astype(_U))


def hash_words(words: list[str]) -> np.ndarray:
    """The hashes that ``span_hashes`` gives these strings."""
    raw, off = utf8(pa.array(words, pa.string()))
    return span_hashes(raw, off[:-1], off[1:])


def char_positions(raw: np.ndarray) -> np.ndarray:
    """For each byte position (and the end) the number of characters before it."""
    out = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=out[1:])
    return out


def lookup(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """The index of each value in a sorted array of distinct values, -1 where it isn't in it."""
    if not len(ordered):
        return np.full(len(values), -1, np.int64)
    at = np.searchsorted(ordered, values)
    at[at == len(ordered)] = 0
    return np.where(ordered[at] == values, at, -1)


def per_doc(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over each document's range ``first[d]:first[d+1]``, 0 where it is empty."""
    c = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=c[1:])
    return c[first[1:]] - c[first[:-1]]
