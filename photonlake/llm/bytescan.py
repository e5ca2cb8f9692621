"""Vectorised scans of UTF-8 text columns, straight from Arrow buffers.

All functions work on one flat byte array that holds a slice of a column and on the row offsets in it, so
the cost per byte is a handful of numpy passes and no Python object is made per word. Slices hold about
``SLICE_BYTES`` bytes (a longer text is a slice of its own), which bounds memory by the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 1 << 21
#: For scans that hold up to some hundred bytes of intermediate arrays for each byte of a slice.
SHORT_SLICE_BYTES = 1 << 18

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_BASE_INV = _U(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = (np.ones(1, _U), np.ones(1, _U))


def slices(column: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, bytes, offsets from 0) over a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    n = len(column)
    if n == 0:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + max_bytes, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def lower(data: np.ndarray) -> np.ndarray:
    """Lower-case A-Z only."""
    return _LOWER[data]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        tables = []
        for base in (_BASE, _BASE_INV):
            t = np.full(size, base, _U)
            t[0] = 1
            tables.append(np.cumprod(t, dtype=_U))
        _powers = (tables[0], tables[1])
    return _powers


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial hash; ``span_hash`` turns two of its entries into the hash of the bytes between.

    Good for hashed features only: some texts (of the Thue-Morse kind) share a hash.
    """
    power, _ = _power_tables(len(data) + 1)
    out = np.zeros(len(data) + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * power[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each [start, end) whatever its place in the slice."""
    _, inverse = _power_tables(len(prefix))
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(_U) * _U(0xD6E8FEB86659FD93))


_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)
#: Longer words are hashed one by one by a library.
_LONG_WORD = 64


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on as one number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    return np.ndarray((len(data) + 9,), "<u8", padded, 0, (1,))


def low_bytes(numbers: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The first ``n`` (0 to 8) bytes of each number."""
    return numbers & _LOW_BYTES[n]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes other than space and 0x09-0x0D: (starts, ends, first word of each row and the end)."""
    if len(data) == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every lower-cased word, and the first word of each row and the end.

    Eight bytes at a time pass through a bijective mix, so that words of up to eight bytes never share a hash with
    others of their length, and longer ones only by chance.
    """
    starts, ends, bounds = words(data, offsets)
    lowered = lower(data)
    size, at = ends - starts, eights(lowered)
    out = mix(size.astype(_U) * _U(0xD6E8FEB86659FD93))
    live = np.arange(len(starts))
    for done in range(0, _LONG_WORD, 8):
        live = live[size[live] > done]
        if not len(live):
            break
        out[live] = mix(out[live] ^ low_bytes(at[starts[live] + done], np.minimum(size[live] - done, 8)))
    live = live[size[live] > _LONG_WORD]
    if len(live):
        raw = memoryview(lowered)
        out[live] = np.fromiter((xxhash.xxh3_64_intdigest(raw[s:e], 1) for s, e in zip(starts[live].tolist(), ends[live].tolist(), strict=True)), _U, len(live))
    return out, bounds
