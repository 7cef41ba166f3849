"""Word shingles of whole texts as sorted 64-bit hashes, vectorised over bytes."""

from __future__ import annotations

import numpy as np

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_RNG = np.random.Generator(np.random.PCG64(97))
_BYTE = _RNG.integers(1, 1 << 63, size=256, dtype=np.uint64) | np.uint64(1)
_BYTE[list(SPACES)] = 0
_BASE = np.uint64(0x9E3779B97F4A7C15)
_GAP = np.zeros(256, dtype=bool)
_GAP[list(SPACES)] = True
PIECE = 1 << 20
_POWERS = np.ones(1, dtype=np.uint64)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        p = np.full(max(n, 4096), _BASE, dtype=np.uint64)
        p[0] = 1
        _POWERS = np.multiply.accumulate(p)
    return _POWERS


def _piece(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, dtype=np.uint8)
    gap = _GAP[b]
    first = ~gap
    first[1:] &= gap[:-1]
    start = np.flatnonzero(first)
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    place = np.arange(len(b)) - np.repeat(np.concatenate([[0], start]), np.diff(np.concatenate([[0], start, [len(b)]])))
    return mix(np.add.reduceat(_BYTE[b] * _powers(len(b))[place], start))


def word_hashes(text: str) -> np.ndarray:
    """One hash for each word, A-Z lower-cased; words are what white space of ASCII separates."""
    data = text.encode("utf-8", "surrogatepass").translate(_LOWER)
    if len(data) <= PIECE:
        return _piece(data)
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        while end < len(data) and not _GAP[data[end]]:  # a word is never cut
            end += 1
        out.append(_piece(data[at:end]))
        at = end
    return np.concatenate(out)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Distinct hashes, ascending. Fewer words than ``words`` are one shingle; none, no shingle."""
    w = word_hashes(text or "")
    n = len(w)
    if n == 0:
        return w
    k = min(words, n)
    total = np.zeros(n - k + 1, dtype=np.uint64)
    for i in range(k):
        total = mix(total ^ w[i : n - k + 1 + i], i + 1 + (0 if k == words else 64))
    return np.unique(total)
