"""Splitting texts into the pieces that byte-level BPE merges within, and a cache of their ids.

The split is that of ``public_tokenizers.PATTERN``: contractions, runs of letters, numbers or other signs
with at most one space before them, and runs of white space that leave their last character to what
follows. It is done on whole slices of a column at once, from the class of each character. Ids of a piece
depend on nothing around it, so each worker encodes a distinct piece once and keeps its ids.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa

from photonlake.llm import bytescan as B

LETTER, NUMBER, OTHER, WHITE = range(4)
#: Intermediate arrays take up to some hundred bytes for each byte of a slice; shorter ones have too few new pieces at once.
SLICE_BYTES = 1 << 19
#: The contractions of the pattern, without their apostrophe.
CONTRACTIONS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")


@cache
def _classes() -> np.ndarray:
    """Class of every code point."""
    import regex

    points = np.arange(0x110000, dtype="<u4")
    points[0xD800:0xE000] = 0
    points = points.tobytes().decode("utf-32-le")
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, points):
            out[m.start() : m.end()] = kind
    return out


def _characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte position and class of every character."""
    table = _classes()
    if not (data & 0x80).any():
        return np.arange(len(data)), table[data]
    at = np.flatnonzero((data & 0xC0) != 0x80)
    first = data[at]
    kinds = table[first]
    wide = np.flatnonzero(first >= 0xC0)
    padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int32)
    p, lead = at[wide], first[wide].astype(np.int32)
    one, two, three = (padded[p + k] & 0x3F for k in (1, 2, 3))
    code = np.where(lead < 0xE0, (lead & 0x1F) << 6 | one, np.where(lead < 0xF0, (lead & 0x0F) << 12 | one << 6 | two, (lead & 0x07) << 18 | one << 12 | two << 6 | three))
    kinds[wide] = table[np.minimum(code, 0x10FFFF)]
    return at, kinds


def split(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte starts of all pieces, in order; a piece ends where the next one starts or the slice ends."""
    if len(data) == 0:
        return np.zeros(0, np.int64)
    at, kind = _characters(data)
    n = len(at)
    row_starts = np.searchsorted(at, offsets)
    row_edge = np.zeros(n + 1, bool)
    row_edge[row_starts] = True
    run = np.empty(n + 1, bool)
    run[0] = run[n] = True
    run[1:n] = (kind[1:] != kind[:-1]) | row_edge[1:n]
    starts = run[:n].copy()
    # White space before something else of the same row: its last character stands apart.
    ends = np.flatnonzero(run[1:] & (kind == WHITE) & ~row_edge[1:])
    starts[ends] = True
    starts[ends[data[at[ends]] == 0x20] + 1] = False
    # An apostrophe that starts a piece, and one of the endings after it.
    quotes = np.flatnonzero((data[at] == 0x27) & starts & ~row_edge[1:])
    if len(quotes):
        byte = np.concatenate([data[at], np.zeros(3, np.uint8)])
        edge = np.concatenate([row_edge, np.ones(3, bool)])
        for ending in CONTRACTIONS:
            fits = np.ones(len(quotes), bool)
            for k, c in enumerate(ending, 1):
                fits &= (byte[quotes + k] == c) & ~edge[quotes + k]
            hit = quotes[fits]
            starts[hit + 1] = False
            after = hit + 1 + len(ending)
            starts[after[after < n]] = True
    return at[starts]


class HashTable:
    """Open addressing from non-zero 64-bit keys to positions, looked up and filled for whole arrays."""

    def __init__(self, bits: int):
        self.mask = np.uint64((1 << bits) - 1)
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.zeros(1 << bits, np.int32)
        self.held = 0

    def grown(self, n: int) -> HashTable:
        """The same entries with room for ``n``, half empty."""
        out, full = HashTable(int(n).bit_length() + 1), self.keys != 0
        out.add(self.keys[full], self.values[full])
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Value of each key, -1 where there is none."""
        slot = (keys & self.mask).astype(np.int64)
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], -1)
        open_ = np.flatnonzero((held != keys) & (held != 0))
        while len(open_):
            slot = (slot[open_] + 1 if len(slot) != len(open_) else slot + 1) & int(self.mask)
            held = self.keys[slot]
            same = held == keys[open_]
            out[open_[same]] = self.values[slot[same]]
            left = ~same & (held != 0)
            open_, slot = open_[left], slot[left]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Insert distinct new keys."""
        self.held += len(keys)
        slot = (keys & self.mask).astype(np.int64)
        while len(keys):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[free]
            mine = free & (self.keys[slot] == keys)
            self.values[slot[mine]] = values[mine]
            keys, values, slot = keys[~mine], values[~mine], (slot[~mine] + 1) & int(self.mask)


class PieceIds:
    """Ids of pieces; ``encode`` gets the pieces that are not held yet.

    A piece of up to 16 bytes is found by a hash of its two zero-padded words, and taken only if both words and its
    length are equal; longer ones, and the rare ones that share a hash, are found by their bytes. So a piece never
    gets the ids of another. Between slices it forgets everything if it holds more than ``most`` pieces or
    ``most_bytes`` of long pieces and ids, which bounds its memory.
    """

    SHORT = 16

    def __init__(self, encode: Callable[[list[bytes]], list], most: int = 1 << 19, most_bytes: int = 32 << 20):
        self.encode, self.most, self.most_bytes = encode, most, most_bytes
        self._clear()

    def _clear(self) -> None:
        self.table, self.long = HashTable(16), {}
        self.low, self.high = np.zeros(1, np.uint64), np.zeros(1, np.uint64)
        self.size, self.start, self.length = np.zeros(1, np.int32), np.zeros(1, np.int64), np.zeros(1, np.int32)
        self.flat = np.zeros(1, np.uint32)
        self.held = self.filled = self.bytes = 0

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])

    @staticmethod
    def _words(data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and second eight bytes of each piece, and the hash of both and the length."""
        at = B.eights(data)
        low, high = B.low_bytes(at[starts], np.minimum(size, 8)), B.low_bytes(at[np.minimum(starts + 8, len(data))], np.clip(size - 8, 0, 8))
        return low, high, B.mix(low ^ B.mix(high + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))) | np.uint64(1)

    def entries(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Entry of each piece of one slice."""
        if self.held > self.most or self.bytes > self.most_bytes:
            self._clear()
        size = np.diff(starts, append=len(data))
        low, high, keys = self._words(data, starts, size)
        found = self.table.find(keys)
        same = (found >= 0) & (size <= self.SHORT) & (self.low[found] == low) & (self.high[found] == high) & (self.size[found] == size)
        if same.all():
            return found
        raw, fresh = data.tobytes(), []
        new = np.flatnonzero((found < 0) & (size <= self.SHORT))
        if len(new):
            _, first, of = np.unique(keys[new], return_index=True, return_inverse=True)
            first = new[first]
            alike = (low[new] == low[first[of]]) & (high[new] == high[first[of]]) & (size[new] == size[first[of]])
            found[new] = self.held + of
            same[new] = alike
            fresh = [raw[s:e] for s, e in zip(starts[first].tolist(), (starts[first] + size[first]).tolist(), strict=True)]
        rest = np.flatnonzero(~same)
        if len(rest):
            known = {}
            for i, s, n in zip(rest.tolist(), starts[rest].tolist(), size[rest].tolist(), strict=True):
                piece = raw[s : s + n]
                at = self.long.get(piece)
                if at is None:
                    at = known.setdefault(piece, self.held + len(fresh))
                    if at == self.held + len(fresh):
                        fresh.append(piece)
                found[i] = at
        if fresh:
            self._add(fresh)
        return found

    def _add(self, pieces: list[bytes]) -> None:
        ids = self.encode(pieces)
        n = self.held + len(pieces)
        size, length = np.fromiter(map(len, pieces), np.int64, len(pieces)), np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.concatenate([np.asarray(x, np.uint32) for x in ids])
        joined = np.frombuffer(b"".join(pieces), np.uint8)
        low, high, keys = self._words(joined, np.cumsum(size) - size, size)
        for name, values in (("low", low), ("high", high), ("size", size), ("length", length), ("start", self.filled + np.cumsum(length) - length)):
            room = self._room(getattr(self, name), n)
            room[self.held : n] = values
            setattr(self, name, room)
        self.flat = self._room(self.flat, self.filled + len(flat))
        self.flat[self.filled : self.filled + len(flat)] = flat
        short = np.flatnonzero(size <= self.SHORT)
        keys, first = np.unique(keys[short], return_index=True)
        keys, first = keys[self.table.find(keys) < 0], short[first][self.table.find(keys) < 0]
        if 2 * (self.table.held + len(keys)) > len(self.table.keys):
            self.table = self.table.grown(self.table.held + len(keys))
        self.table.add(keys, (self.held + first).astype(np.int32))
        by_bytes = np.ones(len(pieces), bool)
        by_bytes[first] = False
        for i in np.flatnonzero(by_bytes).tolist():
            self.long[pieces[i]] = self.held + i
            self.bytes += len(pieces[i]) + 160
        self.held, self.filled, self.bytes = n, self.filled + len(flat), self.bytes + 4 * len(flat)

    def ids(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each whole text, as unsigned 32-bit integers."""
        for _, _, data, offsets in B.slices(column, SLICE_BYTES):
            starts = split(data, offsets)
            entries = self.entries(data, starts)
            lengths = self.length[entries]
            ends = np.cumsum(lengths)
            total = int(ends[-1]) if len(ends) else 0
            flat = self.flat[np.repeat(self.start[entries] - (ends - lengths), lengths) + np.arange(total)]
            bounds = np.concatenate([[0], ends])[np.searchsorted(starts, offsets)]
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                yield flat[lo:hi]
