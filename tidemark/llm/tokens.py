"""Word and shingle hashing on raw UTF-8 bytes, vectorised over one document.

A word is a maximal run of bytes outside U+0020 and U+0009 to U+000D.  Its hash
is a wrapping polynomial over randomised byte values, taken from running sums,
so no Python object is made for a word.
"""

from __future__ import annotations

import hashlib

import numpy as np

SHINGLE = 5

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_PLACE = _rng.integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True

_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        n = max(n, 2 * len(_powers), 1 << 16)
        for base, name in ((_BASE, "_powers"), (_INVERSE, "_inverses")):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            globals()[name] = np.multiply.accumulate(steps)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(raw: bytes) -> np.ndarray:
    data = np.frombuffer(raw, np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    _grow(len(data) + 1)
    inside = np.empty(len(data) + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(_BLANK[data], out=inside[1:-1])
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = turns[::2], turns[1::2]
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers[: len(data)], out=run[1:])
    return mix((run[end] - run[start]) * _inverses[start] + (end - start).astype(np.uint64) * np.uint64(_BASE))


def shingle_set(raw: bytes, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; fewer words make one shingle, none make none."""
    words = word_hashes(raw)
    n = len(words)
    if n == 0:
        return words
    if n < k:
        return mix(np.uint64(n) + (words * _PLACE[:n]).sum(dtype=np.uint64, keepdims=True))
    out = words[: n - k + 1] * _PLACE[0]
    for i in range(1, k):
        out = out + words[i : n - k + 1 + i] * _PLACE[i]
    out = np.sort(mix(out))
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def set_digest(tokens: np.ndarray) -> bytes:
    """128 bits that name a set of hashes."""
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
