"""A cuckoo filter over 128-bit digests, in numpy."""

from __future__ import annotations

import numpy as np

SLOTS, KICKS = 4, 400


class CuckooFilter:
    """16-bit marks in buckets of four; supports insertion and deletion.

    A key inserted once and not deleted is always found. A key that was never
    inserted is found with probability of about 8 / 65536.
    """

    def __init__(self, table: np.ndarray) -> None:
        self.table = table

    @classmethod
    def sized(cls, n: int) -> CuckooFilter:
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, n) / (SLOTS * 0.8)))))
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def load(cls, blob: bytes) -> CuckooFilter:
        return cls(np.frombuffer(blob, np.uint16).reshape(-1, SLOTS).copy())

    def dump(self) -> bytes:
        return self.table.tobytes()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Marks and both buckets of keys: uint64 pairs."""
        mask = np.uint64(len(self.table) - 1)
        marks = np.maximum(keys[:, 1] >> np.uint64(48), np.uint64(1))
        first = keys[:, 0] & mask
        return marks.astype(np.uint16), first, first ^ self._jump(marks, mask)

    @staticmethod
    def _jump(marks: np.ndarray, mask: np.uint64) -> np.ndarray:
        return (marks.astype(np.uint64) * np.uint64(0x5BD1E995)) & mask

    def holds(self, keys: np.ndarray) -> np.ndarray:
        marks, a, b = self._places(keys)
        m = marks[:, None]
        return (self.table[a] == m).any(1) | (self.table[b] == m).any(1)

    def insert(self, keys: np.ndarray) -> bool:
        """False if the filter is too full; it must then be built anew, larger."""
        marks, a, b = self._places(keys)
        mask = np.uint64(len(self.table) - 1)
        rng = np.random.default_rng(len(keys))
        for m, i, j in zip(marks, a, b, strict=True):
            for at in (i, j):
                free = np.flatnonzero(self.table[at] == 0)
                if len(free):
                    self.table[at, free[0]] = m
                    break
            else:
                at = i
                for _ in range(KICKS):
                    slot = rng.integers(SLOTS)
                    m, self.table[at, slot] = self.table[at, slot], m
                    at = at ^ self._jump(np.array([m]), mask)[0]
                    free = np.flatnonzero(self.table[at] == 0)
                    if len(free):
                        self.table[at, free[0]] = m
                        break
                else:
                    return False
        return True

    def delete(self, keys: np.ndarray) -> None:
        """Take out keys that were inserted before."""
        for m, i, j in zip(*self._places(keys), strict=True):
            for at in (i, j):
                held = np.flatnonzero(self.table[at] == m)
                if len(held):
                    self.table[at, held[0]] = 0
                    break
