"""Words, word hashes and shingle hashes of whole batches of UTF-8 text as numpy arrays."""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15 | 1)
_INV = U(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
_powers: dict[int, np.ndarray] = {}

#: [^\x20\x09-\x0D]
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: A-Z to a-z, everything else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _pow(base: np.uint64, n: int) -> np.ndarray:
    got = _powers.get(int(base))
    if got is None or len(got) < n:
        size = max(n, 1 << 16)
        got = np.full(size, base, U)
        got[0] = U(1)
        got = np.cumprod(got, dtype=U)
        if size <= 1 << 22:
            _powers[int(base)] = got
    return got[:n]


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word and the number of words before each text (one more than texts)."""
    w = is_word[data]
    start, end = w.copy(), w.copy()
    start[1:] &= ~w[:-1]
    end[:-1] &= ~w[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    start[inner] = w[inner]
    end[inner - 1] = w[inner - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, offsets, "left")


def word_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, wherever the word stands."""
    total = np.zeros(len(data) + 1, U)
    np.cumsum(_BYTE[data] * _pow(_BASE, len(data)), out=total[1:])
    h = total[e] - total[s]
    h *= _pow(_INV, len(data) + 1)[s]
    return mix(h ^ ((e - s).astype(U) * U(0xD6E8FEB86659FD93)))


def shingle_hashes(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words inside each text, and where each text's shingles begin. A text of fewer words,
    but some, has one shingle of all of them."""
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    begin = np.zeros(len(n) + 1, np.int64)
    np.cumsum(count, out=begin[1:])
    K = U(0xFF51AFD7ED558CCD)
    out = np.zeros(begin[-1], U)
    if len(h) >= k:
        roll = np.full(len(h) - k + 1, U(k), U)
        for j in range(k):
            roll *= K
            roll += h[j : len(h) - k + 1 + j]
        at = np.arange(begin[-1]) - np.repeat(begin[:-1] - first[:-1], count)
        full = np.repeat(n >= k, count)
        out[full] = mix(roll[at[full]])
    for i in np.flatnonzero((n > 0) & (n < k)):
        x = U(n[i])
        with np.errstate(over="ignore"):
            for y in h[first[i] : first[i + 1]]:
                x = x * K + y
        out[begin[i]] = mix(np.array([x], U))[0]
    return out, begin
