"""Substring hashes and content-chosen anchors of byte strings, vectorised with numpy."""

from __future__ import annotations

import numpy as np

from inkloom.llm.perfect_hash import mixed

#: Odd, so it has an inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: A random 64-bit value for each byte.
VALUES = mixed(np.arange(256, dtype=np.uint64), 40)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, count: int) -> np.ndarray:
    """base^0 .. base^(count-1) modulo 2^64, kept for the next call."""
    have = _POWERS.get(base)
    if have is None or len(have) < count:
        steps = np.full(max(count, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(steps)
    return have[:count]


class Hashes:
    """Hash of any substring of ``data``: polynomial modulo 2^64, from one prefix sum."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(VALUES[data] * powers(INVERSE, len(data)), out=self.sums[1:])
        self.up = powers(BASE, len(data) + 1)

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Mixed hash of data[start:stop], element by element; the same bytes hash alike."""
        return mixed((self.sums[stop] - self.sums[start]) * self.up[stop], 41)

    def all_of(self, length: int) -> np.ndarray:
        """Hashes of every substring of one length."""
        if len(self.sums) <= length:
            return np.zeros(0, np.uint64)
        return mixed((self.sums[length:] - self.sums[:-length]) * self.up[length:], 41)


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (np.minimum or np.maximum) over every run of ``width`` values, by doubling."""
    done, out = 1, values
    while 2 * done <= width:
        out = pick(out[:-done], out[done:])
        done *= 2
    rest = width - done
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(hashes: np.ndarray, width: int) -> np.ndarray:
    """Positions that are the least hash of some ``width`` neighbouring positions.

    Every run of ``width`` positions holds one, and which one depends only on the run's content.
    """
    if len(hashes) < width:
        return np.zeros(0, np.int64)
    least = sliding(hashes, width, np.minimum)
    low = np.zeros(width - 1, np.uint64)
    reach = sliding(np.concatenate([low, least, low]), width, np.maximum)
    return np.flatnonzero(reach == hashes)
