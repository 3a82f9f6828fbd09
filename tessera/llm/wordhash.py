"""Vectorised 64-bit hashes of all words of a UTF-8 text.

A word's hash is a polynomial in its bytes, taken from prefix sums modulo 2**64,
so no Python object per word is made.  Texts are cut into segments at white
space, which bounds memory by the segment and the longest word.
"""

from __future__ import annotations

import numpy as np

_SEGMENT = 1 << 21
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.Generator(np.random.PCG64(20240)).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)

_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grow(n: int) -> None:
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 1 << 16)
        ones = np.ones(size, np.uint64)
        a, b = ones * np.uint64(_BASE), ones * np.uint64(_BASE_INV)
        a[0] = b[0] = 1
        _powers, _inverse = np.multiply.accumulate(a), np.multiply.accumulate(b)


def _segment(data: np.ndarray) -> np.ndarray:
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    _grow(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * _inverse[starts])


def word_codes(text: bytes) -> np.ndarray:
    """One code a word, in order; equal words have equal codes."""
    data = np.frombuffer(text, np.uint8)
    if len(data) <= _SEGMENT:
        return _segment(data)
    parts, at = [], 0
    while at < len(data):
        end = min(at + _SEGMENT, len(data))
        while end < len(data) and not _SPACE[data[end]]:  # to the end of the word
            ahead = np.flatnonzero(_SPACE[data[end : end + _SEGMENT]])
            end = end + int(ahead[0]) if len(ahead) else min(end + _SEGMENT, len(data))
        parts.append(_segment(data[at:end]))
        at = end
    return np.concatenate(parts)
