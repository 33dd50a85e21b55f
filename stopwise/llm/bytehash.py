"""Vectorised polynomial hashes over bytes and words (modulo 2^64, with a final mix)."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xC2B2AE3D27D4EB4F
MIX = np.uint64(0xD6E8FEB86659FD93)
SHIFT = np.uint64(32)
PIECE = 1 << 20

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for lo, hi in ranges:
        table[lo:hi + 1] = True
    return table


SPACES = separators((0x20, 0x20), (0x09, 0x0D))
#: Judged on bytes whose capitals are folded.
NON_WORD = separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))

_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n + 1 of each."""
    global _powers, _inverses
    if len(_powers) <= n:
        size = 1 << max(16, int(n).bit_length())
        inverse = pow(BASE, -1, 1 << 64)
        _powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, BASE, np.uint64)]), dtype=np.uint64)
        _inverses = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, inverse, np.uint64)]), dtype=np.uint64)
    return _powers, _inverses


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> SHIFT)) * MIX
    h = (h ^ (h >> SHIFT)) * MIX
    return h ^ (h >> SHIFT)


def prefix(b: np.ndarray) -> np.ndarray:
    out = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * powers(len(b))[0][:len(b)], out=out[1:])
    return out


def spans_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each b[start:end], from the prefix sums."""
    inverse = powers(len(sums))[1]
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(WORD_BASE))


def word_spans(b: np.ndarray, split: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of bytes that are no separators."""
    gap = np.ones(len(b) + 2, np.int8)
    gap[1:-1] = split[b]
    edges = np.flatnonzero(np.diff(gap))
    return edges[::2], edges[1::2]


def words(data: bytes, split: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of the words of a text, a piece of about a megabyte at a time."""
    found, at, n = [], 0, len(data)

    def piece(size: int) -> np.ndarray:
        b = np.frombuffer(data, np.uint8, min(size, n - at), at)
        return FOLD[b] if fold else b

    while at < n:
        b = piece(PIECE)
        while at + len(b) < n and not split[b].any():  # a word longer than the piece
            b = piece(2 * len(b))
        end = at + len(b)
        if end < n:
            end = at + int(np.flatnonzero(split[b])[-1]) + 1
            b = b[:end - at]
        start, stop = word_spans(b, split)
        if len(start):
            found.append((spans_hash(prefix(b), start, stop), start + at, stop + at))
        at = end
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found)) if len(found) > 1 else found[0]


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, factor = np.zeros(n, np.uint64), 1
    for j in range(k):
        out += hashes[j:j + n] * np.uint64(factor)
        factor = factor * WORD_BASE % (1 << 64)
    return mix(out + np.uint64(k))


def window_argmin(x: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost minimum of each window; one forward and one backward scan over blocks of the width.

    The upper bits of the values are compared, the lower 21 carry the position (``x`` is shorter than 2^21).
    """
    n, low = len(x), np.uint64((1 << 21) - 1)
    key = (x & ~low) | np.arange(n, dtype=np.uint64)
    padded = np.full(-(-n // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = key
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(back[:n - width + 1], ahead[width - 1:n]) & low).astype(np.int64)
