"""A minimal perfect hash over whole-number keys, with the keys beside it to tell strangers.

Level after level, each key left hashes into a bit array of twice as many bits as there are keys;
keys alone on their bit stay, the others go on. A key's slot is the rank of its bit over all
levels, so ``n`` keys have the slots 0 to ``n - 1``. About 3.7 bits a key, beside the keys.
"""

from __future__ import annotations

import io

import numpy as np

SPREAD = 2
FEW = 64  # bits of the smallest level


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mix of each key, another for each seed; the multipliers are those of splitmix64."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64(((seed + 1) * 0x9E3779B97F4A7C15) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Slots of a set of distinct keys below 2^32."""

    def __init__(self, sizes: list[int], words: np.ndarray, keys: np.ndarray | None):
        self.sizes, self.words, self.keys = sizes, words, keys
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        counts = np.bitwise_count(words).astype(np.int64)
        self.before = np.cumsum(counts) - counts

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """Of distinct keys; the result does not depend on their order."""
        left, sizes, levels = keys.astype(np.uint32), [], []
        while len(left):
            size = max(FEW, -(-len(left) * SPREAD // 64) * 64)
            bits = (mixed(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(bits, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            left = left[~alone[bits]]
        words = np.concatenate(levels) if levels else np.empty(0, "<u8")
        out = cls(sizes, words, None)
        slots = out._slots(keys)
        out.keys = np.empty(len(keys), np.uint32)
        out.keys[slots] = keys
        return out

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        slots = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            bits = (mixed(keys[left], level) % np.uint64(size)).astype(np.int64) + self.starts[level]
            word, shift = self.words[bits >> 6], (bits & 63).astype(np.uint64)
            found = (word >> shift) & np.uint64(1) == 1
            below = word & ((np.uint64(1) << shift) - np.uint64(1))
            slots[left[found]] = (self.before[bits >> 6] + np.bitwise_count(below))[found]
            left = left[~found]
            if not len(left):
                break
        return slots

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for a key that was not built in: the key at the slot is compared."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        slots = self._slots(keys)
        return np.where((slots >= 0) & (self.keys[slots] == keys), slots, -1)

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, sizes=np.array(self.sizes, np.int64), words=self.words, keys=self.keys)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        held = np.load(io.BytesIO(data))
        return cls(held["sizes"].tolist(), held["words"], held["keys"])
