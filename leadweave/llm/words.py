"""Words of UTF-8 texts as arrays: where they are, and 64-bit hashes of them."""

from __future__ import annotations

import numpy as np


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64."""
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


BASE = 0x9E3779B97F4A7C15  # odd, so that its powers have inverses
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_OF_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_OF_PLACE = powers(BASE, 1024)


def words(raw: bytes, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and hash of each word between ASCII white space; lower: A-Z as a-z."""
    b = np.frombuffer(raw, dtype=np.uint8)
    inside = ~_SPACE[b]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    begin, end = edge[::2], edge[1::2]
    if not len(begin):
        return begin, end, np.zeros(0, dtype=np.uint64)
    at = np.arange(begin[0], len(b))
    at -= np.repeat(begin, np.diff(begin, append=len(b)))
    b = b[begin[0] :]
    terms = _OF_BYTE[_LOWER[b] if lower else b]
    terms *= _OF_PLACE[at & 1023]
    terms[~inside[begin[0] :]] = 0
    h = np.add.reduceat(terms, begin - begin[0])
    return begin, end, mix64(h + (end - begin).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive words, by its first word."""
    if len(h) < n:
        return np.zeros(0, dtype=np.uint64)
    p = powers(0xE7037ED1A0B428DB, n)
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out += h[k : len(h) - n + 1 + k] * p[k]
    return mix64(out)


def rolling_hashes(h: np.ndarray, n: int, base: int = BASE) -> np.ndarray:
    """Like gram_hashes, for long n: from prefix sums and inverse powers."""
    if len(h) < n:
        return np.zeros(0, dtype=np.uint64)
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(h * powers(base, len(h)), dtype=np.uint64)])
    return mix64((total[n:] - total[:-n]) * powers(pow(base, -1, 1 << 64), len(h) - n + 1))


def sliding_min(g: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each n consecutive values."""
    have, out = 1, g
    while have < n:
        step = min(have, n - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out
