"""Words of many texts at once: boundaries and 64-bit hashes by numpy, without a Python loop per word.

A word's hash is a polynomial over random byte values modulo 2**64, mixed with its length. Two
given words collide with a chance near 2**-64, so among 10**8 distinct words about one in
a thousand corpora holds a colliding pair.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 2**64)
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE_LOWER = _BYTE[_LOWER]
_power = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, for at least n positions."""
    global _power, _inverse
    if len(_power) < n:
        size = 1 << (n - 1).bit_length()
        p = np.full(size, _MULTIPLIER, np.uint64)
        q = np.full(size, _INVERSE, np.uint64)
        p[0] = q[0] = 1
        _power, _inverse = np.cumprod(p), np.cumprod(q)
    return _power, _inverse


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def word_hashes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and the number of words of each text."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = _IS_SPACE[buf]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[0::2], edge[1::2]
    start = start[: len(end)]
    power, inverse = _tables(len(buf) + 1)
    values = (_BYTE_LOWER if lower else _BYTE)[buf]
    values *= power[: len(buf)]
    sums = np.cumsum(values)
    before = np.where(start > 0, sums[start - 1], _U(0))
    h = (sums[end - 1] - before) * inverse[start]
    h = mix(h + (end - start).astype(np.uint64) * _U(0xD6E8FEB86659FD93))
    stops = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    upto = np.searchsorted(start, stops)
    return h, np.diff(np.concatenate(([0], upto)))


def combine(parts: list[np.ndarray]) -> np.ndarray:
    """A hash of several aligned hashes; their order counts."""
    h = np.full(len(parts[0]), len(parts), np.uint64)
    for x in parts:
        h = mix(h * _U(_MULTIPLIER) + x)
    return h


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values of an array that is not empty; sorting is faster than the hash table of ``np.unique``."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))]


def shingle_sets(texts: list[bytes], size: int = 5) -> list[np.ndarray]:
    """Each text's sorted distinct hashes of ``size`` lower-cased words in a row.

    A text of fewer words gives its whole sequence as one; a text without words gives none.
    """
    h, counts = word_hashes(texts)
    n = len(h)
    runs = combine([h[k : n - size + 1 + k] for k in range(size)]) if n >= size else h[:0]
    out, at = [], 0
    for count in counts.tolist():
        if count >= size:
            out.append(distinct(runs[at : at + count - size + 1]))
        elif count:
            out.append(combine([h[at + k : at + k + 1] for k in range(count)]))
        else:
            out.append(h[:0])
        at += count
    return out
