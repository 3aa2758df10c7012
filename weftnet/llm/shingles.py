"""Hashed word shingles of whole texts, vectorised over many texts at once.

Words are runs of bytes other than ASCII white space, with A-Z lowered. A text's set has the 64-bit hashes of
its distinct shingles of `width` words; with fewer words the whole sequence is the one shingle, and without
words the set is empty.
"""

from __future__ import annotations

import hashlib

import numpy as np

WIDTH = 5
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACES = [pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Hasher:
    def __init__(self, width: int = WIDTH) -> None:
        self.width = width
        self.up = self.down = np.ones(1, np.uint64)

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        """The sorted distinct shingle hashes of each text."""
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        if len(self.up) <= len(data):
            self.up, self.down = _powers(_BASE, len(data) + len(data) // 8 + 1), _powers(_INVERSE, len(data) + len(data) // 8 + 1)
        ink = ~_SPACE[data]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], ink]).view(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], dtype=np.uint64)])
        words = mix((run[ends] - run[starts]) * self.down[starts])
        bounds = np.searchsorted(starts, np.cumsum([0, *[len(t) + 1 for t in texts]]))
        n = len(words) - self.width + 1
        rolled = np.zeros(max(0, n), np.uint64)
        for k in range(self.width if n > 0 else 0):
            rolled += words[k : k + n] * np.uint64(_PLACES[k])
        rolled = mix(rolled)
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= self.width:
                out.append(np.unique(rolled[a : b - self.width + 1]))
            elif b > a:
                out.append(mix(np.array([sum(int(w) * _PLACES[k] for k, w in enumerate(words[a:b])) + (b - a) & (1 << 64) - 1], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
        return out


def set_key(x: np.ndarray) -> int:
    """A 64-bit name of a set, as a signed integer."""
    return int.from_bytes(hashlib.md5(x.tobytes()).digest()[:8], "little", signed=True)
