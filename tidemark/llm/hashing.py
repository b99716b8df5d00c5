"""Vectorised Rabin-Karp hashing over the bytes and words of a block of texts.

All arithmetic is modulo 2**64 (numpy wraps). A prefix sum of ``value * base**i``
gives the hash of any slice by one subtraction and one multiplication with the
inverse power; a final mix spreads the bits.
"""

from __future__ import annotations

import numpy as np

_MASK = (1 << 64) - 1
BYTE_BASE = 0x9E3779B97F4A7C15 | 1
WORD_BASE = 0xD6E8FEB86659FD93 | 1
SECOND_BASE = 0xA0761D6478BD642F | 1
#: Bytes or words whose prefix sums are held at once.
STEP = 1 << 18
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i in range(n), kept for the life of the process."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(base, -1, 1 << 64)
        out = []
        for b in (base, inverse):
            x = np.full(size, np.uint64(b), dtype=np.uint64)
            x[0] = 1
            out.append(np.cumprod(x, dtype=np.uint64))
        have = _powers[base] = (out[0], out[1])
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums of values[i] * base**i, one longer than values."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(base, len(values))[0], out=out[1:])
    return out


def slices(sums: np.ndarray, base: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Unmixed hashes of values[start:end] from prefix()."""
    return (sums[end] - sums[start]) * powers(base, len(sums))[1][start]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word of every text, and the first word's number of each text (one longer).

    A word is a maximal run of bytes other than ASCII white space inside one text.
    """
    n = len(data)
    if n == 0:
        z = np.zeros(0, dtype=np.int64)
        return z, z, np.zeros(len(offsets), dtype=np.int64)
    inside = ~_SPACE[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    cut = offsets[(offsets > 0) & (offsets < n)]
    begin[cut] = inside[cut]
    start = np.flatnonzero(begin)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cut - 1] = inside[cut - 1]
    end = np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes and length; a long text's words are hashed in steps."""
    out = np.empty(len(start), np.uint64)
    lo = 0
    while lo < len(start):
        first = start[lo]
        hi = max(int(np.searchsorted(end, first + STEP, side="right")), lo + 1)
        sums = prefix(data[first : end[hi - 1]].astype(np.uint64) + np.uint64(1), BYTE_BASE)
        out[lo:hi] = slices(sums, BYTE_BASE, start[lo:hi] - first, end[lo:hi] - first)
        lo = hi
    return mix(out + (end - start).astype(np.uint64))


def windows(values: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the values that start k consecutive ones inside one text; first: each text's first value (one longer)."""
    n = np.diff(first)
    length = np.maximum(n - k + 1, 0)
    total = int(length.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    return np.repeat(first[:-1] - (np.cumsum(length) - length), length) + np.arange(total)


def rolling(values: np.ndarray, at: np.ndarray, k: int, base: int = WORD_BASE) -> np.ndarray:
    """Rabin-Karp hashes of values[i:i+k] for each i of at (ascending), in steps. Bytes count as one more than they are."""
    out = np.empty(len(at), np.uint64)
    lo = 0
    while lo < len(at):
        first = at[lo]
        hi = int(np.searchsorted(at, first + STEP))
        part = values[first : at[hi - 1] + k]
        sums = prefix(part.astype(np.uint64) + np.uint64(1) if part.dtype == np.uint8 else part, base)
        place = at[lo:hi] - first
        out[lo:hi] = slices(sums, base, place, place + k)
        lo = hi
    return mix(out)


def chunks(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Runs of whole texts of at most `most` bytes together (a longer text stands alone)."""
    out, lo = [], 0
    n = len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        out.append((lo, hi))
        lo = hi
    return out
