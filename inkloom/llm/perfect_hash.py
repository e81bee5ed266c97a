"""A minimal perfect hash over distinct 64-bit hashes, built and probed with numpy."""

from __future__ import annotations

import numpy as np

GAMMA = 2.0


def mixed(keys: np.ndarray, level: int) -> np.ndarray:
    """An independent 64-bit hash of the keys for each level (splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Levels of bit arrays: a key that is alone at its bit is placed, others go one level on.

    The slot of a key is the number of set bits before its own, so n keys fill slots 0 to n-1
    at about three bits a key. A key that was not indexed gets -1 or any slot: compare a
    fingerprint that is kept in the slot.
    """

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.rank = np.cumsum(bits, dtype=np.int64) - bits

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, parts, rest, level = [], [], keys.astype(np.uint64), 0
        while len(rest):
            size = max(8, int(GAMMA * len(rest)))
            at = (mixed(rest, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size)[at] == 1
            bits = np.zeros(size, dtype=np.uint8)
            bits[at[alone]] = 1
            sizes.append(size)
            parts.append(bits)
            rest = rest[~alone]
            level += 1
        return cls(np.array(sizes, np.int64), np.concatenate(parts or [np.zeros(0, np.uint8)]))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, dtype=np.int64)
        rest, keys, start = np.arange(len(keys)), keys.astype(np.uint64), 0
        for level, size in enumerate(self.sizes):
            if not len(rest):
                break
            at = start + (mixed(keys[rest], level) % np.uint64(size)).astype(np.int64)
            hit = self.bits[at] == 1
            out[rest[hit]] = self.rank[at[hit]]
            rest = rest[~hit]
            start += int(size)
        return out

    def to_bytes(self) -> tuple[bytes, bytes]:
        return self.sizes.tobytes(), np.packbits(self.bits).tobytes()

    @classmethod
    def from_bytes(cls, sizes: bytes, bits: bytes) -> PerfectHash:
        own = np.frombuffer(sizes, np.int64)
        return cls(own, np.unpackbits(np.frombuffer(bits, np.uint8), count=int(own.sum())))
