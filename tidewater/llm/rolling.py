"""Hashes of substrings and of word shingles over a whole batch of texts at once."""

from __future__ import annotations

import numpy as np

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (splitmix finaliser)."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD1342543DE82EF95))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n, modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = max(1 << 16, 1 << n.bit_length())
        x = np.full(size + 1, base, np.uint64)
        x[0] = 1
        have = _powers[base] = np.multiply.accumulate(x)
    return have


class Prefix:
    """Polynomial hashes of any substrings of ``data``; equal strings have equal hashes, wherever they stand."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[data] * powers(_BASE, n)[:n], out=self.sums[1:])
        self.back = powers(_INVERSE, n)

    def hashes(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.back[start] + (stop - start).astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        """The hash of the ``k`` bytes at every place that has so many."""
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.back[:n] + _U(k))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def shingles(texts: list[bytes], k: int = 5) -> list[np.ndarray]:
    """For each text the hashes of its runs of ``k`` words, in order, each labelled with how often it came before.

    A text of fewer words has one shingle of them all; one without words has none.
    """
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    start, stop = edge[::2], edge[1::2]
    word = Prefix(data).hashes(start, stop) if len(start) else np.zeros(0, np.uint64)
    cut = np.searchsorted(start, ends).tolist()
    run = np.zeros(max(0, len(word) - k + 1), np.uint64)
    for t in range(k):
        run = mix(run * _U(0x2545F4914F6CDD1D) + word[t : t + len(run)])
    out, a = [], 0
    for b in cut:
        if b - a >= k:
            s = run[a : b - k + 1]
        else:
            s, x = np.zeros(0, np.uint64), word[a:b]
            if len(x):
                s = mix(np.array([sum(int(v) * pow(_BASE, i + 1, 1 << 64) for i, v in enumerate(x)) & 0xFFFFFFFFFFFFFFFF], np.uint64))
        out.append(labelled(s))
        a = b
    return out


def labelled(s: np.ndarray) -> np.ndarray:
    """Occurrence labels: the second, third ... of equal values get values of their own."""
    if len(s) < 2:
        return s
    order = np.argsort(s, kind="stable")
    same = np.concatenate([[False], s[order][1:] == s[order][:-1]])
    if not same.any():
        return s
    at = np.arange(len(s))
    first = np.maximum.accumulate(np.where(same, 0, at))
    out = s.copy()
    out[order] = np.where(same, mix(s[order] + _U(0xA0761D6478BD642F) * (at - first).astype(np.uint64)), s[order])
    return out
