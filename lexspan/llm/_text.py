"""Vectorised word and shingle hashing over whole texts.

Words are the maximal runs of bytes other than 0x20 and 0x09-0x0D, after A-Z
became a-z.  A word's 64-bit value is a polynomial over random byte values,
taken from prefix sums, so no Python loop runs over words.
"""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240917)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 2**64)
_COEF = _rng.integers(1, 2**63, 16, dtype=np.uint64) | np.uint64(1)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BLOCK = 1 << 16
EMPTY = np.empty(0, dtype=np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW, _POW_INV = _powers(_BASE, _BLOCK), _powers(_BASE_INV, _BLOCK)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _block_words(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    space = _SPACE[a]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate(([0], edge))
    if not space[-1]:
        edge = np.concatenate((edge, [len(a)]))
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return EMPTY, start, end
    pw, inv = (_POW, _POW_INV) if len(a) <= _BLOCK else (_powers(_BASE, len(a)), _powers(_BASE_INV, len(a)))
    acc = np.zeros(len(a) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[a] * pw[: len(a)], out=acc[1:])
    return mix((acc[end] - acc[start]) * inv[start]), start, end


def word_hashes(text: str | None, spans: bool = False):
    """The hash of each word in order; with spans also the byte start and end of each."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)
    whole = np.frombuffer(data, dtype=np.uint8)
    parts, starts, ends, at = [], [], [], 0
    while at < len(whole):
        to = min(at + _BLOCK, len(whole))
        if to < len(whole):
            cut = np.flatnonzero(_SPACE[whole[at:to]])
            if len(cut):
                to = at + int(cut[-1]) + 1
            else:  # one word longer than a block
                while to < len(whole) and not _SPACE[whole[to]]:
                    more = np.flatnonzero(_SPACE[whole[to : to + _BLOCK]])
                    to = to + int(more[0]) if len(more) else min(to + _BLOCK, len(whole))
        h, s, e = _block_words(whole[at:to])
        parts.append(h)
        if spans:
            starts.append(s + at)
            ends.append(e + at)
        at = to
    words = np.concatenate(parts) if parts else EMPTY
    if not spans:
        return words
    none = np.empty(0, dtype=np.int64)
    return words, np.concatenate(starts) if starts else none, np.concatenate(ends) if ends else none


def shingles(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of all k-word shingles in order; fewer words give one shingle of the whole sequence."""
    n = len(words)
    if n == 0:
        return EMPTY
    if n < k:
        return mix(np.array([n], dtype=np.uint64) + np.sum(words * _COEF[:n], dtype=np.uint64))
    acc = np.full(n - k + 1, k, dtype=np.uint64)
    for j in range(k):
        acc += words[j : n - k + 1 + j] * _COEF[j]
    return mix(acc)


def shingle_set(text: str | None, k: int = 5) -> np.ndarray:
    return np.unique(shingles(word_hashes(text), k))


def signature(values: np.ndarray) -> tuple[int, int]:
    """128 bits that identify a set of hashes, as two signed 64-bit integers."""
    one = np.add.reduce(mix(values + np.uint64(0x1B873593)), dtype=np.uint64)
    two = np.bitwise_xor.reduce(mix(values ^ np.uint64(0xCC9E2D51A5A5A5A5)))
    return int(np.int64(np.uint64(one))), int(np.int64(np.uint64(two)))
