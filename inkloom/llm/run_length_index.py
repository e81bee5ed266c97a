"""A run-length index of a byte text: its Burrows-Wheeler transform in runs, with samples.

For every run of the transform the index keeps the text positions of its first and last row, and
how far the suffixes on both sides of a run border agree. That is enough for the matching
statistics of the text against the rest of itself: a suffix whose row is inside a run agrees with
the neighbouring row in one byte less than the suffix one position before it does, so only the
sampled positions carry new lengths and the others are streamed from them.
"""

from __future__ import annotations

import numpy as np

WORD = 8


def packed_words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as a big-endian number; zeros beyond the end."""
    wide = np.concatenate([data, np.zeros(2 * WORD, np.uint8)]).astype(np.uint64)
    for width in (1, 2, 4):
        wide = (wide[:-width] << np.uint64(8 * width)) | wide[width:]
    return wide


def suffix_array(words: np.ndarray, n: int) -> np.ndarray:
    """Start positions of the n suffixes in order, by doubling; only tied suffixes are resorted."""
    order = np.argsort(words[:n], kind="stable")
    rank = np.zeros(n, np.int64)
    rows, keys = np.arange(n), words[order]
    width = WORD
    while True:
        fresh = np.ones(len(rows), bool)
        fresh[1:] = keys[1:] != keys[:-1]
        rank[order[rows]] = np.maximum.accumulate(np.where(fresh, rows, 0)) + 1
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        rows = rows[tied]
        if not len(rows):
            return order
        at = order[rows]
        after = at + width
        following = np.where(after < n, rank[np.minimum(after, n - 1)], 0)
        keys = (rank[at].astype(np.uint64) << np.uint64(32)) | following.astype(np.uint64)
        again = np.argsort(keys, kind="stable")
        order[rows] = at[again]
        keys = keys[again]
        width *= 2


def common_prefix(words: np.ndarray, n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bytes in which the suffixes at ``a`` and ``b`` agree, pair by pair."""
    out = np.zeros(len(a), np.int64)
    most = n - np.maximum(a, b)
    live = np.arange(len(a))
    while len(live):
        done = out[live]
        differ = words[a[live] + done] ^ words[b[live] + done]
        on = (differ == 0) & (done + WORD <= most[live])
        stop = live[~on]
        rest, same = differ[~on], np.zeros(len(stop), np.int64)
        for bits in (32, 16, 8):
            clear = (rest >> np.uint64(64 - bits)) == 0
            same += np.where(clear, bits // 8, 0)
            rest = np.where(clear, rest << np.uint64(bits), rest)
        out[stop] = np.minimum(out[stop] + same, most[stop])
        live = live[on]
        out[live] += WORD
    return out


class RunLengthIndex:
    """The runs of the transform and their samples; the suffix array is dropped after building."""

    def __init__(self, data: np.ndarray):
        self.n = n = len(data)
        words = packed_words(data)
        suffixes = suffix_array(words, n)
        before = data[suffixes - 1].astype(np.int16)
        before[suffixes == 0] = 256  # the end of the text, before its first byte
        border = np.flatnonzero(before[1:] != before[:-1])
        #: One symbol a run, and the row where it begins.
        self.starts = np.concatenate([np.zeros(min(n, 1), np.int64), border + 1])
        self.symbols = before[self.starts]
        #: Text positions of each run's first and last row.
        self.heads = suffixes[self.starts]
        self.tails = suffixes[np.concatenate([border, np.full(min(n, 1), n - 1)])]
        agree = common_prefix(words, n, self.tails[:-1], self.heads[1:])
        self.head_lengths = np.concatenate([np.zeros(min(n, 1), np.int64), agree])
        self.tail_lengths = np.concatenate([agree, np.zeros(min(n, 1), np.int64)])

    def matching_statistics(self) -> np.ndarray:
        """For each position, the length of the longest match that starts anywhere else."""
        best = np.zeros(self.n, np.int64)
        at = np.arange(self.n)
        for places, lengths in ((self.heads, self.head_lengths), (self.tails, self.tail_lengths)):
            value, last = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
            value[places] = lengths
            last[places] = places
            np.maximum.accumulate(last, out=last)
            np.maximum(best, value[last] - (at - last), out=best)
        return best


def long_matches(data: np.ndarray, separator: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, stops) of the maximal stretches covered by repeated strings of ``length`` bytes
    that hold no separator. ``data`` ends with a separator."""
    n = len(data)
    ends = np.flatnonzero(data == separator)
    room = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)
    long = (RunLengthIndex(data).matching_statistics() >= length) & (room >= length)
    return covered(np.flatnonzero(long), length, n)


def covered(starts: np.ndarray, length: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Union of [s, s + length) as maximal stretches."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + length, -1)
    inside = np.concatenate([[False], np.cumsum(steps[:n]) > 0, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]
