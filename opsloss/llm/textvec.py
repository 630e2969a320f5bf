"""Numpy kernels over many texts at once: words, shingles and character n-grams as hashes.

Texts are handled as lower-cased (A-Z only) UTF-8 bytes; words are runs of bytes other than
ASCII white space; an n-gram is a run of n bytes. Eight bytes are loaded at a time through an
overlapping view, so nothing loops over characters in Python.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_K1, _K2, _K3 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOW = np.array([0] + [2 ** (8 * i) - 1 for i in range(1, 9)], dtype=U)   # masks of 0..8 low bytes


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = (h ^ (h >> U(30))) * _K2
    h = (h ^ (h >> U(27))) * _K3
    return h ^ (h >> U(31))


class Bytes:
    """Lower-cased bytes of some texts, each between white-space separators."""

    def __init__(self, texts: list[str], lower: bool = True):
        enc = [t.encode("utf-8", "surrogatepass") for t in texts]
        body = b"\n" + b"\n".join(enc) + b"\n"
        if lower:
            body = body.lower()
        self.raw = body
        n = len(body)
        padded = np.frombuffer(body + bytes(16), dtype=np.uint8)
        self.arr = padded[:n]
        self.space = SPACE[self.arr]
        self.eight = np.ndarray(shape=(n + 8,), dtype="<u8", buffer=padded, strides=(1,))
        sizes = np.fromiter((len(e) + 1 for e in enc), dtype=np.int64, count=len(enc))
        self.start = np.concatenate([[1], 1 + np.cumsum(sizes)])      # start[i] .. start[i + 1] - 1: text i

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Byte offsets where words begin and end, in order."""
        edge = np.flatnonzero(self.space[1:] != self.space[:-1]) + 1
        return edge[0::2], edge[1::2]

    def word_hashes(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = end - begin
        h = mix(self.eight[begin] & LOW[np.minimum(size, 8)]) + size.astype(U) * _K1
        at, rest = 8, np.flatnonzero(size > 8)
        while len(rest):
            h[rest] = mix(h[rest] * _K1 + (self.eight[begin[rest] + at] & LOW[np.minimum(size[rest] - at, 8)]))
            at += 8
            rest = rest[size[rest] > at]
        return h

    def per_text(self, positions: np.ndarray) -> np.ndarray:
        """Indices that cut ``positions`` (ascending byte offsets) into the texts: len(texts) + 1."""
        return np.searchsorted(positions, self.start)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and hashes of the n-grams that lie in one word, the white space at its sides
        (as one blank) included."""
        m = len(self.arr) - n + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U)
        ok = np.ones(m, dtype=bool)
        for i in range(1, n - 1):
            ok &= ~self.space[i:m + i]
        ok &= ~(self.space[:m] & self.space[n - 1:m + n - 1]) if n <= 2 else True
        at = np.flatnonzero(ok)
        v = self.eight[at] & LOW[n]
        first, last = self.space[at], self.space[at + n - 1]
        v[first] = (v[first] & ~U(0xFF)) | U(32)
        top = U(8 * (n - 1))
        v[last] = (v[last] & ~(U(0xFF) << top)) | (U(32) << top)
        return at, mix(v + np.array([n], dtype=U) * _K1)


def combine(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive items of a sequence of hashes (len(h) - n + 1 of them)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    out = h[:m].copy()
    for i in range(1, n):
        out = mix(out * _K1 + h[i:m + i])
    return out


def sums(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums of values[cuts[i]:cuts[i + 1]] (0 for an empty part)."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[cuts[1:]] - total[cuts[:-1]]
