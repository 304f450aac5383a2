"""Word shingles of many texts at once, as 64-bit hashes in numpy arrays.

All texts of an Arrow batch lie in one byte buffer, so words are found, hashed
and combined with whole-array operations; no Python object is made per word.
"""

from __future__ import annotations

import numpy as np

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_BASE = 0x9DDFEA08EB382D69  # odd, so that it has an inverse modulo 2**64
_BASE_INVERSE = pow(_BASE, -1, 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer on 64-bit values (the public splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, dtype=np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def word_hashes(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start offsets and 64-bit hashes of the maximal runs of non-white bytes."""
    if not len(buffer):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    black = np.concatenate(([False], ~_WHITE[buffer], [False]))
    edge = np.flatnonzero(black[1:] != black[:-1])
    start, end = edge[::2], edge[1::2]
    out = np.empty(len(start), np.uint64)
    # The running sums wrap modulo 2**64; blocks keep the arrays of powers small, and those of few texts no longer than these.
    step = min(1 << 18, len(buffer))
    longest = int((end - start).max(initial=0))
    power, inverse = _powers(_BASE, step + longest + 1), _powers(_BASE_INVERSE, step + 1)
    for low in range(0, len(buffer), step):
        a, b = np.searchsorted(start, (low, low + step))
        if a == b:
            continue
        high = int(end[b - 1])
        part = (_LOWER[buffer[low:high]].astype(np.uint64) + np.uint64(1)) * power[: high - low]
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(part, dtype=np.uint64)))
        s, e = start[a:b] - low, end[a:b] - low
        out[a:b] = (total[e] - total[s]) * inverse[s]
    return start, mix(out ^ (end - start).astype(np.uint64))


def shingle_sets(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its `width`-word shingles.

    A text of fewer words, but not none, has its whole word sequence as its one
    shingle; a text without words has an empty set.
    """
    buffer = np.frombuffer(b" ".join(texts), dtype=np.uint8)
    start, word = word_hashes(buffer)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    first = np.searchsorted(start, np.concatenate(([0], np.cumsum(lengths))))
    n = max(0, len(word) - width + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(width):
        rolled = mix(rolled * np.uint64(_BASE) + word[k : k + n])
    sets = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= width:
            sets.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            h = np.full(1, b - a, np.uint64)
            for k in range(a, b):
                h = mix(h * np.uint64(_BASE) + word[k : k + 1])
            sets.append(h)
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets
