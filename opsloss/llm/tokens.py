"""Tokens of many texts at once: byte classes in numpy, distinct tokens by Arrow's dictionary encoding.

All separators are ASCII, so cutting the UTF-8 bytes is the same as cutting the code points.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa

from opsloss.llm.textvec import LOW, U, mix

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32          # A-Z


def byte_class(chars: bytes) -> np.ndarray:
    """Table of 256 booleans, true for the bytes given."""
    table = np.zeros(256, dtype=bool)
    table[list(chars)] = True
    return table


class Tokens:
    """The tokens of an Arrow string column, in order.

    ``row[i]``: the text token i stands in; ``begin``, ``end``: its place in ``raw``, the lower-cased (A-Z only) bytes of
    all texts. ``hashes``: 64 bits of each token's bytes. ``code[i]``: which distinct token, ``distinct[code]`` its bytes."""

    def __init__(self, column: pa.Array, token: np.ndarray):
        column = column.cast(pa.large_string())
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
        lo, hi = (int(at[0]), int(at[-1])) if len(column) else (0, 0)
        self.at = at - lo
        self.padded = np.zeros(hi - lo + 16, dtype=np.uint8)
        self.raw = self.padded[:hi - lo]
        if hi > lo:
            self.raw[:] = LOWER[np.frombuffer(data, dtype=np.uint8)[lo:hi]]
        inside = token[self.raw]
        first = np.zeros(hi - lo + 1, dtype=bool)      # a text begins here
        first[self.at] = True
        before = np.concatenate([[False], inside[:-1]]) & ~first[:-1]
        after = np.concatenate([inside[1:], [False]]) & ~first[1:]
        self.begin = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.row = np.repeat(np.arange(len(column)), np.diff(np.searchsorted(self.begin, self.at)))

    def hashes(self) -> np.ndarray:
        """Eight bytes of all tokens at a time."""
        eight = np.ndarray(shape=(len(self.raw) + 8,), dtype="<u8", buffer=self.padded, strides=(1,))
        size = self.end - self.begin
        step = U(0x9E3779B97F4A7C15)
        h = mix((eight[self.begin] & LOW[np.minimum(size, 8)]) + size.astype(U) * step)
        at, rest = 8, np.flatnonzero(size > 8)
        while len(rest):
            h[rest] = mix(h[rest] * step + (eight[self.begin[rest] + at] & LOW[np.minimum(size[rest] - at, 8)]))
            at += 8
            rest = rest[size[rest] > at]
        return h

    @cached_property
    def _coded(self) -> pa.DictionaryArray:
        edges = np.empty(2 * len(self.begin) + 1, dtype=np.int64)
        edges[0:-1:2], edges[1::2], edges[-1] = self.begin, self.end, len(self.raw)
        runs = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1,
                                     [None, pa.py_buffer(edges), pa.py_buffer(self.raw.tobytes())])
        return runs.take(pa.array(np.arange(0, len(edges) - 1, 2))).dictionary_encode()

    @property
    def code(self) -> np.ndarray:
        return self._coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)

    @property
    def distinct(self) -> pa.Array:
        return self._coded.dictionary
