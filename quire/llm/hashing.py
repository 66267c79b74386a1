"""Hash tables for arrays of keys."""

from __future__ import annotations

import numpy as np

FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xBF58476D1CE4E5B9)


def mixed(h: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Hashes carried on by one more number each."""
    with np.errstate(over="ignore"):
        h = (h ^ codes.astype("u8")) * np.uint64(0xFF51AFD7ED558CCD)
        return h ^ (h >> np.uint64(32))


class Table:
    """Numbers by 64-bit key: a table sparse enough that few keys collide, a smaller one for those, and so on."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.levels = []
        keys, values = keys.astype("u8"), values.astype("i4")
        for factor in FACTORS:
            bits = max(10, int(len(keys)).bit_length() + 4)
            slot = self._slot(keys, factor, bits)
            held, kept, used = np.zeros(1 << bits, "u8"), np.zeros(1 << bits, "i4"), np.zeros(1 << bits, bool)
            held[slot], kept[slot], used[slot] = keys, values, True
            if not used[0]:
                held[0] = 1  # else key 0 would be found there
            self.levels.append((np.uint64(factor), np.uint64(64 - bits), held, kept))
            left = held[slot] != keys
            keys, values = keys[left], values[left]
            if not len(keys):
                return
        raise ValueError("keys collide in all tables")

    @staticmethod
    def _slot(keys: np.ndarray, factor: int, bits: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys * np.uint64(factor)) >> np.uint64(64 - bits)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are there, in order, and their numbers."""
        with np.errstate(over="ignore"):
            factor, shift, held, kept = self.levels[0]
            slot = (keys * factor) >> shift
            same = held[slot] == keys
            out = kept[slot]
            for factor, shift, held, kept in self.levels[1:]:
                miss = np.flatnonzero(~same)
                slot = (keys[miss] * factor) >> shift
                more = held[slot] == keys[miss]
                same[miss[more]] = True
                out[miss[more]] = kept[slot[more]]
        where = np.flatnonzero(same)
        return where, out[where]
