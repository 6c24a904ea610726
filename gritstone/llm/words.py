"""Words of whole Arrow text columns as 64-bit hashes, without a Python object per word.

A word is a run of bytes outside [\\x20\\x09-\\x0D]. Its hash is a sum of scrambled numbers, one for
each byte at its place in the word, scrambled again: unlike a polynomial modulo 2**64, it has no
family of words that are bound to collide. Equal words have equal hashes in every task and run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE, _SALT = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of text that are worked on together; one longer document makes its own slice.
SLICE_BYTES = 1 << 18
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A number for each byte at each of the first 64 places of a word; later places scramble these further.
_PLACES = mix(np.arange(1, 64 * 256 + 1, dtype=np.uint64) * np.uint64(_BASE))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def slices(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, row offsets) of parts of about SLICE_BYTES; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if column.null_count:  # a null may own bytes
        lengths = np.diff(at) * np.asarray(column.is_valid())
        if lengths.sum() != at[-1] - at[0]:
            yield from slices(column.fill_null(""))
            return
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + SLICE_BYTES, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi - lo, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start byte, end byte) of each word, and the word offsets of the rows."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64)
    if lower:
        data = _LOWER[data]
    solid = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = True, ~solid[:-1]
    after[-1], after[:-1] = True, ~solid[1:]
    start = np.flatnonzero(solid & (before | edge[:-1]))
    end = np.flatnonzero(solid & (after | edge[1:])) + 1
    length = end - start
    if not len(start):
        return np.zeros(0, np.uint64), start, end, np.zeros(len(offsets), np.int64)
    first = np.cumsum(length) - length
    place = np.arange(first[-1] + length[-1]) - np.repeat(first, length)
    value = _PLACES[(place & 63) << 8 | data[solid]]
    far = np.flatnonzero(place > 63)
    if len(far):
        value[far] = mix(value[far] + (place[far] >> 6).astype(np.uint64) * np.uint64(_SALT))
    h = mix(np.add.reduceat(value, first) + length.astype(np.uint64) * np.uint64(_SALT))
    return h, start, end, np.searchsorted(start, offsets)


def shingles(h: np.ndarray, rows: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of `size` consecutive words of each row, and the row offsets. A row of fewer words has its whole sequence as one shingle; a row without words has none."""
    count = np.diff(rows)
    made = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    out = np.zeros(len(made) + 1, np.int64)
    np.cumsum(made, out=out[1:])
    start = np.arange(out[-1]) - np.repeat(out[:-1] - rows[:-1], made)
    size_of = np.repeat(np.minimum(count, size), made)
    padded = np.concatenate([h, np.zeros(size, np.uint64)])
    total = size_of.astype(np.uint64) * np.uint64(_SALT)
    factor = 1
    for k in range(size):
        factor = factor * _BASE & _MASK
        part = padded[start + k] * np.uint64(factor)
        total += part if size_of.size and size_of.min() > k else np.where(size_of > k, part, np.uint64(0))
    return mix(total), out


def distinct(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each row, sorted, and the new row offsets."""
    parts = [np.unique(values[a:b]) for a, b in zip(rows[:-1], rows[1:], strict=True)]
    out = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=out[1:])
    return (np.concatenate(parts) if parts else values[:0]), out
