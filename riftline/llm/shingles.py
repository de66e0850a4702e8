"""Sets of hashed word shingles, and bitmaps over them, vectorised over batches of whole texts."""

from __future__ import annotations

import numpy as np

K = 5
_MASK = (1 << 64) - 1
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))
#: Powers that a worker keeps; longer runs of text compute theirs.
_KEPT = 1 << 21


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) >= n:
        return _powers
    made = tuple(np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, base, np.uint64)]) for base in (_BASE, _INVERSE))
    if n <= _KEPT:
        _powers = made
    return made


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of the joined texts, with A-Z lower-cased, and the number of words in each text."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    inside = ~_SPACE[data]
    edge = np.diff(np.r_[False, inside].astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _power(len(data))
    total = np.r_[np.uint64(0), np.cumsum(_BYTE[data] * up[: len(data)], dtype=np.uint64)]
    words = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _ODD)
    last = np.cumsum(np.fromiter((len(x) + 1 for x in texts), np.int64, len(texts)))
    return words, np.diff(np.r_[0, np.searchsorted(starts, last)])


def shingle_sets(texts: list[bytes], k: int = K) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text with fewer than k words has its whole sequence as one."""
    words, counts = word_hashes(texts)
    n = max(0, len(words) - k + 1)
    rolled = words[:n].copy()
    for i in range(1, k):
        rolled = rolled * np.uint64(_BASE) + words[i : n + i]
    rolled = mix(rolled)
    out, at = [], 0
    for m in counts.tolist():
        if m >= k:
            own = np.sort(rolled[at : at + m - k + 1])
            out.append(own[np.r_[True, own[1:] != own[:-1]]])
        elif m:
            h = 0
            for w in words[at : at + m].tolist():
                h = (h * _BASE + w) & _MASK
            out.append(mix(np.array([(h + m * 0xA24BAED4963EE407) & _MASK], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
        at += m
    return out


def fingerprint(s: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    return int(mix(np.array([mix(s ^ _ODD).sum(dtype=np.uint64)]) + np.uint64(len(s)))[0].astype(np.int64)) if len(s) else 0


def width(n: int) -> int:
    """Bits of the bitmap of a set of n: four to eight for each element, a power of two, within bounds."""
    return min(1 << 16, max(256, 4 << (n - 1).bit_length())) if n else 256


def bitmap(s: np.ndarray) -> bytes:
    bits = np.zeros(width(len(s)), np.uint8)
    bits[(s & np.uint64(len(bits) - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def overlap_bound(a: bytes, n_a: int, b: bytes, n_b: int) -> int:
    """No more than so many elements can be common: each bit of one that the other lacks stands for one that is not."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2 :]
    return min(n_a - int(np.bitwise_count(x & ~y).sum()), n_b - int(np.bitwise_count(y & ~x).sum()))
