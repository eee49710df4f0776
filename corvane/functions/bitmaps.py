"""Compressed sets of small integers: sorted arrays while sparse, packed bits once dense."""

from __future__ import annotations

import numpy as np

CHUNK = 1 << 16  # integers of one set are below this
ARRAY_MAX = CHUNK // 16  # above that many members 2**13 bytes of bits are smaller than 2 bytes a member


class Bitmap:
    __slots__ = ("bits", "items")

    def __init__(self, items: np.ndarray | None = None, bits: np.ndarray | None = None):
        self.items, self.bits = items, bits

    @classmethod
    def of(cls, values: np.ndarray) -> Bitmap:
        values = np.unique(values)
        if len(values) <= ARRAY_MAX:
            return cls(items=values.astype(np.uint16))
        flags = np.zeros(CHUNK, dtype=bool)
        flags[values] = True
        return cls(bits=np.packbits(flags))

    def _bits(self) -> np.ndarray:
        if self.bits is not None:
            return self.bits
        flags = np.zeros(CHUNK, dtype=bool)
        flags[self.items] = True
        return np.packbits(flags)

    @staticmethod
    def _from_bits(bits: np.ndarray) -> Bitmap:
        flags = np.unpackbits(bits)
        n = int(flags.sum())
        return Bitmap(items=np.flatnonzero(flags).astype(np.uint16)) if n <= ARRAY_MAX else Bitmap(bits=bits)

    def __or__(self, other: Bitmap) -> Bitmap:
        if self.bits is None and other.bits is None and len(self.items) + len(other.items) <= ARRAY_MAX:
            return Bitmap(items=np.union1d(self.items, other.items))
        return Bitmap._from_bits(self._bits() | other._bits())

    def and_not(self, other: Bitmap) -> Bitmap:
        if self.bits is None and other.bits is None:
            return Bitmap(items=np.setdiff1d(self.items, other.items, assume_unique=True))
        if self.bits is None:
            flags = np.unpackbits(other.bits)
            return Bitmap(items=self.items[flags[self.items] == 0])
        return Bitmap._from_bits(self.bits & ~other._bits())

    def decode(self) -> np.ndarray:
        return self.items.astype(np.int64) if self.bits is None else np.flatnonzero(np.unpackbits(self.bits))

    def __len__(self) -> int:
        return len(self.decode())
