"""Sorted arrays of 64-bit hashes with values, and a directory on the top bits."""

from __future__ import annotations

import numpy as np

from rivulet.llm.textkernel import U64


class HashArray:
    """Read-only map from well-mixed 64-bit hashes to numbers.

    Sixteen bytes or fewer an entry.  A lookup starts where the directory says that hashes with
    the same top bits begin, and steps on while the stored hash is smaller.
    """

    def __init__(self, hashes: np.ndarray, values: np.ndarray):
        order = np.argsort(hashes, kind="stable")
        self.hashes = np.append(hashes[order], U64(0xFFFFFFFFFFFFFFFF))
        self.values = np.append(values[order], values.dtype.type(0))
        self.bits = max(4, min(22, int(len(hashes)).bit_length()))
        tops = self.hashes[:-1] >> U64(64 - self.bits)
        self.first = np.searchsorted(tops, np.arange(1 << self.bits, dtype=U64)).astype(np.int32)

    def __len__(self) -> int:
        return len(self.hashes) - 1

    def get(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, value); value is 0 where nothing is found."""
        at = self.first[(wanted >> U64(64 - self.bits)).astype(np.int64)].astype(np.int64)
        held = self.hashes[at]
        todo = np.flatnonzero(held < wanted)
        while len(todo):
            at[todo] += 1
            todo = todo[self.hashes[at[todo]] < wanted[todo]]
        found = (self.hashes[at] == wanted) & (at < len(self))
        return found, np.where(found, self.values[at], self.values.dtype.type(0))
