"""Vectorised text primitives over Arrow buffers: polynomial hashes, words, shingles.

Texts are never turned into Python strings here. A batch's UTF-8 bytes are one uint8 array plus row offsets, worked
through in pieces of about half a megabyte, so memory stays bounded and the arrays stay in the CPU's cache.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 19
U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
BASE = 0xD1342543DE82EF95
INVERSE = pow(BASE, -1, 1 << 64)


def release() -> None:
    """Give memory that the last group's arrays have left back to the system; workers live for many groups."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _trim = None


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def row_pieces(offsets: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Runs of whole rows [i, j) of about `size` bytes; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(32))
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    return h


_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n, grown by doubling."""
    if len(_powers["up"]) < n:
        size = 1 << max(10, int(n - 1).bit_length())
        for key, base in (("up", BASE), ("down", INVERSE)):
            p = np.full(size, U(base))
            p[0] = 1
            _powers[key] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = BASE**i times the polynomial hash of data[i:j]."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * up[: len(data)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (prefix[end] - prefix[start]) * powers(len(prefix))[1][start]


def table(word: bytes | None = None, gap: bytes | None = None) -> np.ndarray:
    """Byte map for words(): 0 at separators, else the byte with A-Z lower-cased."""
    m = np.arange(256, dtype=np.uint8)
    m[65:91] += 32
    keep = np.zeros(256, bool)
    if word is not None:
        keep[np.frombuffer(word, np.uint8)] = True
    else:
        keep[:] = True
        keep[np.frombuffer(gap, np.uint8)] = False
    return np.where(keep, m, 0).astype(np.uint8)


#: Lower-cased words of letters, digits and everything beyond ASCII.
ALNUM = table(word=bytes([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]))
#: Lower-cased words between blanks; byte 0 belongs to words, so it's mapped to a value that UTF-8 never has.
BLANKS = table(gap=bytes([32, *range(9, 14)]))
BLANKS[0] = 0xFF


class Words:
    """Words of a run of rows: hash, start and end byte within the run, row, and the rows' first words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, mapped: np.ndarray):
        offsets = offsets - offsets[0]
        rows = len(offsets) - 1
        hashes, starts, ends = [], [], []
        n = len(data)
        lo = 0
        while lo < n:
            hi = min(n, lo + PIECE)
            if hi < n:  # never cut a word
                cut = _last_gap(data, offsets, mapped, lo, hi)
                hi = cut if cut > lo else _next_gap(data, offsets, mapped, hi)
            m = mapped[data[lo:hi]]
            inside = m != 0
            first = inside.copy()
            first[1:] &= ~inside[:-1]
            last = inside.copy()
            last[:-1] &= ~inside[1:]
            edge = offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi, "right")] - lo
            e = edge[edge < hi - lo]
            first[e] |= inside[e]
            e = edge[edge > 0] - 1
            last[e] |= inside[e]
            s, t = np.flatnonzero(first), np.flatnonzero(last) + 1
            p = prefix_hashes(m)
            hashes.append(mix(span_hashes(p, s, t)))
            starts.append(s + lo)
            ends.append(t + lo)
            lo = hi
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.hash, self.start, self.end = join(hashes, np.uint64), join(starts, np.int64), join(ends, np.int64)
        self.first = np.searchsorted(self.start, offsets).astype(np.int64)
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(rows, dtype=np.int64), self.count)


def _last_gap(data, offsets, mapped, lo, hi):
    """The last place in (lo, hi] where no word is cut."""
    gap = np.flatnonzero(mapped[data[max(lo, hi - 4096) : hi]] == 0)
    at = max(lo, hi - 4096) + int(gap[-1]) + 1 if len(gap) else lo
    i = int(np.searchsorted(offsets, hi, "right")) - 1
    return max(at, int(offsets[i]) if offsets[i] > lo else lo)


def _next_gap(data, offsets, mapped, hi):
    end = int(offsets[min(len(offsets) - 1, int(np.searchsorted(offsets, hi)))])
    while hi < end:
        gap = np.flatnonzero(mapped[data[hi : min(end, hi + PIECE)]] == 0)
        if len(gap):
            return hi + int(gap[0])
        hi = min(end, hi + PIECE)
    return end


_STEPS = [U(pow(0x9E3779B97F4A7C15, i, 1 << 64)) for i in range(1, 64)]


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of `size` consecutive words per row, sorted, with row offsets; a shorter row's words are one shingle."""
    n = len(words.hash)
    full = np.zeros(n, np.uint64)
    if n >= size:
        for j in range(size):
            full[: n - size + 1] += words.hash[j : n - size + 1 + j] * _STEPS[j]
    full = mix(full)
    sets = []
    for r, (a, k) in enumerate(zip(words.first[:-1].tolist(), words.count.tolist(), strict=True)):
        if k >= size:
            sets.append(np.unique(full[a : a + k - size + 1]))
        elif k:
            short = U(k)
            with np.errstate(over="ignore"):
                for j in range(k):
                    short = short * U(31) + words.hash[a + j] * _STEPS[40 + j % 20]
            sets.append(mix(np.array([short], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    at = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), at
