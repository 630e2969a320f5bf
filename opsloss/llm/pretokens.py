"""Byte-level BPE pre-tokens of many texts at once, in numpy.

The pre-tokeniser of the given vocabulary file splits a text by the public pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

Here the split is computed from the character classes of whole batches: runs of one class are
pre-tokens, a single blank joins the run after it, the last white space of a run before other text
stands apart, and the contractions are cut out of quote-letter sequences. ``split`` gives the same
pieces as the pattern (tests compare with the library). A piece is identified by its bytes: by two
64-bit words up to 16 bytes, by the bytes themselves beyond.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

U = np.uint64
LOW = np.array([0] + [2 ** (8 * i) - 1 for i in range(1, 9)], dtype=U)
LETTER, NUMBER, BLANK, OTHER = 0, 1, 2, 3
_TABLE: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The class of every code point, built once in a process."""
    if not _TABLE:
        import regex

        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        code = np.full(0x110000, OTHER, dtype=np.uint8)
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\s+")):
            for m in regex.finditer(pattern, every):
                a, b = m.span()
                code[a + (0x800 if a >= 0xD800 else 0):b + (0x800 if b > 0xD800 else 0)] = kind
        _TABLE.append(code)
    return _TABLE[0]


def split(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(UTF-8 bytes of all texts, byte offset of every piece and the end, pieces before each text and in all)."""
    size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    ends = np.cumsum(size)
    body = "".join(texts)
    n = len(body)
    if n == 0:
        return b"", np.zeros(1, np.int64), np.zeros(len(texts) + 1, np.int64)
    point = np.frombuffer(body.encode("utf-32-le"), dtype="<u4")
    cls = classes()[point]
    first = np.zeros(n + 1, dtype=bool)                     # where a text begins; also past the end
    first[np.concatenate([[0], ends])] = True
    begin = np.empty(n + 1, dtype=bool)
    begin[0] = begin[n] = True
    begin[1:n] = cls[1:] != cls[:-1]
    begin |= first
    blank = cls == BLANK
    # the last white space before other text of the same text stands apart, a single blank joins that text
    last = np.zeros(n, dtype=bool)
    last[:-1] = blank[:-1] & ~blank[1:] & ~first[1:n]
    at = np.flatnonzero(last)
    begin[at] = True
    joins = at[point[at] == 32]
    begin[joins + 1] = False
    # contractions: a quote that begins a run of others by itself, right before the letters
    quote = np.flatnonzero((point == 39) & begin[:n] & ~first[1:])
    if len(quote):
        pad = np.concatenate([point, np.zeros(3, dtype=point.dtype)])
        start = np.concatenate([first, [True, True]])
        a, b = pad[quote + 1], pad[quote + 2]
        one = np.isin(a, [ord("s"), ord("t"), ord("m"), ord("d")])
        two = ((a == ord("r")) & (b == ord("e")) | (a == ord("v")) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))) & ~start[quote + 2]
        for hit, long in ((one, 2), (two & ~one, 3)):
            q = quote[hit]
            begin[q + 1] = False
            begin[q + long] = True
    raw = body.encode("utf-8", "surrogatepass")
    if len(raw) == n:
        offset = np.flatnonzero(begin)
        cuts = np.concatenate([[0], ends])
        return raw, offset, np.searchsorted(offset, cuts)
    # a code point begins at every byte that does not continue one; also the end
    byte = np.flatnonzero(np.append((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80, True))
    at = np.flatnonzero(begin)
    return raw, byte[at], np.searchsorted(at, np.concatenate([[0], ends]))


def distinct(raw: bytes, offset: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct pieces, and for every piece the index of its distinct one."""
    n = len(offset) - 1
    if n <= 0:
        return [], np.zeros(0, np.int64)
    begin, size = offset[:-1], np.diff(offset)
    eight = np.ndarray(shape=(len(raw) + 8,), dtype="<u8", buffer=raw + bytes(16), strides=(1,))
    lo = eight[begin] & LOW[np.minimum(size, 8)]
    hi = eight[np.minimum(begin + 8, len(raw))] & LOW[np.clip(size - 8, 0, 8)]
    long = np.flatnonzero(size > 16)
    if len(long):                                          # numbered by their bytes
        seen: dict[bytes, int] = {}
        number = [seen.setdefault(raw[a:a + s], len(seen)) for a, s in zip(begin[long].tolist(), size[long].tolist())]
        lo[long], hi[long] = np.array(number, dtype=U), U(0)
    # number by a mix of both words and the size, then compare the words themselves
    small = np.minimum(size, 17).astype(U)
    h = lo * U(0x9E3779B97F4A7C15) ^ (hi + small) * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(29)
    index, values = pd.factorize(h)
    pick = np.empty(len(values), dtype=np.int64)
    pick[index] = np.arange(n)
    mate = pick[index]
    if (lo[mate] != lo).any() or (hi[mate] != hi).any() or (small[mate] != small).any():
        order = np.lexsort((small, hi, lo))                # two pieces with one hash: order by the words
        ls, is_, ss = lo[order], hi[order], small[order]
        new = np.concatenate([[True], (ls[1:] != ls[:-1]) | (is_[1:] != is_[:-1]) | (ss[1:] != ss[:-1])])
        index[order] = np.cumsum(new) - 1
        pick = order[new]
    return [raw[a:a + s] for a, s in zip(begin[pick].tolist(), size[pick].tolist())], index
