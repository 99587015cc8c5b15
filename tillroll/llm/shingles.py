"""Hashes of words and of word windows, computed on the bytes of whole texts."""

from __future__ import annotations

import numpy as np

# Odd multipliers of the hash steps.
_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_SEED = 0x5EED

_rng = np.random.default_rng(_SEED)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
# A-Z as a-z; blanks (space, tab to carriage return) end words.
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_WINDOW = _rng.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all (splitmix64's last steps)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of every word, in order.

    A word's hash is the sum over its bytes of a random number for the byte
    times a power of an odd multiplier for its place in the word, mixed.
    """
    raw = np.frombuffer(data, np.uint8)
    word = ~_BLANK[raw]
    edges = np.flatnonzero(np.diff(word, prepend=False, append=False))
    starts, ends = edges[0::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    letters = raw[word]
    sizes = ends - starts
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    place = np.arange(len(letters)) - np.repeat(first, sizes)
    terms = _BYTE[letters] * _powers(int(place.max()) + 1)[place]
    return mix(np.add.reduceat(terms, first) + sizes.astype(np.uint64) * _MUL)


_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.cumprod(np.full(2 * n, _MUL, np.uint64)) * mix(np.arange(2 * n, dtype=np.uint64) + _MUL)
    return _POWERS


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` words; of the whole sequence, if it is shorter."""
    n = min(size, len(words))
    if n == 0:
        return words
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out += words[k : len(words) - n + 1 + k] * _WINDOW[k]
    return mix(out + np.uint64(n))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The distinct window hashes of a text, sorted."""
    if not text:
        return np.zeros(0, np.uint64)
    return np.unique(windows(word_hashes(text.encode()), size))
