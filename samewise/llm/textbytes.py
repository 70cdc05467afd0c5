"""Words of Arrow text columns, found on their UTF-8 bytes with numpy.

Both word classes in use are unions of ASCII ranges with everything beyond ASCII, so a byte decides alone whether it belongs to
a word: all bytes of a multi-byte character are above 0x7F.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 21  # bytes of text that are worked on at once
_BLOCK = 1 << 20
_SPAN = 1 << 12
_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[0] = 0
_PLACE = _RANDOM.integers(1, 2**63, _SPAN, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def byte_table(space_only: bool, lower: bool) -> np.ndarray:
    """What each byte becomes; 0 for those between words. NUL, where it belongs to a word, becomes 0xFF, which UTF-8 never has."""
    table = np.arange(256, dtype=np.uint8)
    table[0] = 0xFF
    if lower:
        table[ord("A") : ord("Z") + 1] += 32
    if space_only:
        table[[0x20, *range(0x09, 0x0E)]] = 0
    else:
        keep = np.zeros(256, bool)
        keep[0x30:0x3A] = keep[0x61:0x7B] = keep[0x80:] = True
        table[~keep[table]] = 0
        table[0] = 0
    return table


ALNUM = byte_table(space_only=False, lower=True)  # [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z are lowered
SPACED = byte_table(space_only=True, lower=False)  # [^\x20\x09-\x0D]+


class Words(NamedTuple):
    """first[d]:first[d + 1] are the words of text d; start and end are bytes in data, which holds what the table made of them."""

    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    data: np.ndarray

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _K1
    return h ^ (h >> np.uint64(32))


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes; the order matters."""
    return mixed(a * _K1 + (b ^ (b >> np.uint64(31))) * _K2)


def runs_of(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n neighbours, made by doubling: len(h) - n + 1 of them."""
    if len(h) < n:
        return h[:0]
    whole, done, power, size = None, 0, h, 1
    while True:
        if n & size:
            ahead = power[done:]
            whole = power if whole is None else paired(whole[: len(ahead)], ahead)
            done += size
            if done == n:
                return whole
        power = paired(power[:-size], power[size:])
        size *= 2


def pieces(texts: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end, bytes, offsets) for stretches of about ``limit`` bytes or one text. NULL has no bytes."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, at, raw = texts.buffers()
    offsets = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Words:
    """The words of the texts data[offsets[d]:offsets[d + 1]]; none reaches over a text's end."""
    data = table[data]
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return Words(np.zeros(len(offsets), np.int64), empty, empty, np.zeros(0, np.uint64), data)
    inside = data != 0
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    begins[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(np.searchsorted(start, offsets), start, end, _hashed(data, start), data)


def _hashed(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A word's hash: the sum of its bytes' numbers times their places' numbers, mixed."""
    out = np.empty(len(start), np.uint64)
    stop = np.append(start[1:], len(data))
    a = 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(stop, start[a] + _BLOCK, "right")))
        lo, hi = start[a], stop[b - 1]
        place = (np.arange(lo, hi) - np.repeat(start[a:b], stop[a:b] - start[a:b])) & (_SPAN - 1)
        out[a:b] = np.add.reduceat(_BYTE[data[lo:hi]] * _PLACE[place], start[a:b] - lo)
        a = b
    return mixed(out)


def spans_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of set flags."""
    padded = np.zeros(len(flags) + 2, np.int8)
    padded[1:-1] = flags
    turn = np.diff(padded)
    return np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
