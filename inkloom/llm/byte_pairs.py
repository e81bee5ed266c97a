"""Byte-level BPE encoding and decoding by the ranks of a public vocabulary.

A text is cut into pieces by the vocabulary's pattern and each piece is merged on its own. The
distinct pieces of a batch are dealt by length into padded matrices of token ids. In every round
each row merges its leftmost pair of least rank: ranks come from one hashed lookup of the pairs
that changed, the tail moves up by one column, and rows without a pair are compacted away. A
pair's rank is that of the two byte strings joined, and a piece that is a token is that token.

Ids are kept as little-endian unsigned 32-bit integers, the form of token files.
"""

from __future__ import annotations

import base64
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

NO_RANK = np.iinfo(np.int32).max
#: Pieces of more bytes than this are merged through a heap: rounds of a matrix cost its width.
WIDEST = 512
#: Cells of one matrix; distinct pieces, and their tokens, that a worker keeps between batches.
CELLS = 1 << 21
KEPT_PIECES = 400_000
KEPT_TOKENS = 1 << 22
#: Pieces looked up at once, so that a very long text is never a list of all its pieces.
AT_ONCE = 1 << 18


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, of a file with a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class PairTable:
    """Open-addressing hash table from a pair of ids to the id of what they merge into."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        bits = max(4, int(4 * max(1, len(left))).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, NO_RANK, np.int32)
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        slots, open_ = self._slots(keys), np.arange(len(keys))
        while len(open_):
            at = slots[open_]
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[open_[free]]
            stored = free & (self.keys[at] == keys[open_])
            self.values[at[stored]] = merged[open_[stored]]
            open_ = open_[~stored]
            slots[open_] = slots[open_] + 1 & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id of each merged pair, ``NO_RANK`` where it is no token; negative ids are padding."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        slots = self._slots(keys)
        found = self.values[slots]
        seen = self.keys[slots]
        open_ = np.flatnonzero((seen != keys) & (seen >= 0))
        found[seen < 0] = NO_RANK
        while len(open_):
            slots[open_] = slots[open_] + 1 & self.mask
            seen = self.keys[slots[open_]]
            found[open_] = np.where(seen == keys[open_], self.values[slots[open_]], NO_RANK)
            open_ = open_[(seen != keys[open_]) & (seen >= 0)]
        found[(left < 0) | (right < 0)] = NO_RANK
        return found


def gathered(values: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The runs values[start : start + count], one after another."""
    total = np.cumsum(count)
    shift = np.repeat(start - total + count, count)
    return values[shift + np.arange(len(shift))]


class Pieces(dict):
    """Numbers pieces in the order in which they are first asked for."""

    def __missing__(self, piece: str) -> int:
        number = self[piece] = len(self)
        return number


class Vocabulary:
    """Encoder and decoder of one rank table and the pattern that cuts text into pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.whole = ranks
        self.pattern = regex.compile(pattern)
        self.token = {rank: token for token, rank in ranks.items()}
        self.size = np.zeros(max(self.token) + 1, np.int64)
        self.size[list(self.token)] = [len(token) for token in self.token.values()]
        self.place = np.zeros(len(self.size), np.int64)
        self.place[list(self.token)] = np.cumsum([0, *map(len, self.token.values())])[:-1]
        self.bytes = np.frombuffer(b"".join(self.token.values()), np.uint8)
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"a byte-level vocabulary has all 256 bytes; {missing[:5]} are missing")
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        splits = [
            (ranks[token[:k]], ranks[token[k:]], rank)
            for token, rank in ranks.items()
            for k in range(1, len(token))
            if token[:k] in ranks and token[k:] in ranks
        ]
        self.pairs = PairTable(*np.array(splits, np.int64).reshape(-1, 3).T.astype(np.int32))
        self._forget()

    def _forget(self) -> None:
        self.numbers = Pieces()
        self.tokens = np.zeros(1 << 16, np.int32)
        self.starts = np.zeros(1, np.int64)

    # -- merging -------------------------------------------------------------------------------

    def merged(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each piece, and the ids of all of them in order."""
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        known: list[tuple[int, int]] = []
        buckets: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            token = self.whole.get(piece)
            if token is not None:
                known.append((k, token))
            elif len(piece) > WIDEST:
                ids = self._by_heap(piece)
                done.append((np.array([k]), np.array([len(ids)]), ids))
            else:
                width = len(piece) + 3 & ~3 if len(piece) <= 32 else 1 << (len(piece) - 1).bit_length()
                buckets.setdefault(width, []).append(k)
        if known:
            who, ids = np.array(known).T
            done.append((who, np.ones(len(who), np.int64), ids.astype(np.int32)))
        for width, members in buckets.items():
            rows = max(1, CELLS // width)
            for at in range(0, len(members), rows):
                self._by_rounds(pieces, members[at : at + rows], width, done)
        if not done:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        who, count, flat = (np.concatenate(column) for column in zip(*done, strict=True))
        order = np.argsort(who)
        return count[order], gathered(flat, (np.cumsum(count) - count)[order], count[order])

    def _by_rounds(self, pieces: list[bytes], members: list[int], width: int, done: list) -> None:
        rows = [pieces[k] for k in members]
        flat = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in rows), np.uint8)
        ids = self.of_byte[flat.reshape(len(rows), width)]
        length = np.fromiter(map(len, rows), np.int64, count=len(rows))
        ids[np.arange(width) >= length[:, None]] = -1
        who = np.array(members)
        ranks = self.pairs.ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(rows), -1)
        while len(who):
            row = np.arange(len(who))
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(who), np.int64)
            least = ranks[row, at] if ranks.shape[1] else np.full(len(who), NO_RANK)
            live = least < NO_RANK
            if not live.all():
                full = np.arange(ids.shape[1]) < length[~live, None]
                done.append((who[~live], length[~live], ids[~live][full]))
                ids, ranks, who, length = ids[live], ranks[live], who[live], length[live]
                row, at, least = np.arange(len(who)), at[live], least[live]
            if not len(who):
                return
            ids[row, at] = least
            # The tail moves up: one column fewer, for every live row lost one token.
            columns = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, columns + (columns > at[:, None]), axis=1)
            columns = columns[:-1]
            ranks = np.take_along_axis(ranks, columns + (columns >= at[:, None]), axis=1)
            length = length - 1
            for shift in (1, 0):
                ok = np.flatnonzero((at >= shift) & (at - shift + 1 < ids.shape[1]))
                left = at[ok] - shift
                ranks[ok, left] = self.pairs.ranks(ids[ok, left], ids[ok, left + 1])

    def _by_heap(self, piece: bytes) -> np.ndarray:
        """The same merges, leftmost pair of least rank first, for one very long piece."""
        ids = self.of_byte[np.frombuffer(piece, np.uint8)].tolist()
        after = list(range(1, len(ids) + 1))
        before = list(range(-1, len(ids) - 1))
        first = self.pairs.ranks(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32)).tolist()
        heap = [(rank, k) for k, rank in enumerate(first) if rank < NO_RANK]
        heapify(heap)
        token, whole = self.token, self.whole
        rank_at: list[int] = [*first, NO_RANK]

        def renew(k: int) -> None:
            other = after[k]
            rank = NO_RANK
            if other < len(ids):
                rank = whole.get(token[ids[k]] + token[ids[other]], NO_RANK)
            rank_at[k] = rank
            if rank < NO_RANK:
                heappush(heap, (rank, k))

        while heap:
            rank, k = heappop(heap)
            if rank_at[k] != rank or ids[k] < 0:
                continue
            gone = after[k]
            ids[k], ids[gone] = rank, -1
            rank_at[gone] = NO_RANK
            after[k] = after[gone]
            if after[k] < len(ids):
                before[after[k]] = k
            renew(k)
            if before[k] >= 0:
                renew(before[k])
        return np.array([x for x in ids if x >= 0], np.int32)

    # -- texts ---------------------------------------------------------------------------------

    def _ids_of(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each piece, and the ids of all of them in order."""
        if len(self.numbers) > KEPT_PIECES or self.starts[-1] > KEPT_TOKENS:
            self._forget()
        old = len(self.numbers)
        number = np.fromiter(map(self.numbers.__getitem__, pieces), np.int64, count=len(pieces))
        if len(self.numbers) > old:
            count, flat = self.merged([p.encode() for p in islice(self.numbers, old, None)])
            ends = self.starts[-1] + np.cumsum(count)
            while ends[-1] > len(self.tokens):
                self.tokens = np.concatenate([self.tokens, np.zeros_like(self.tokens)])
            self.tokens[self.starts[-1] : ends[-1]] = flat
            self.starts = np.concatenate([self.starts, ends])
        start = self.starts[number]
        count = self.starts[number + 1] - start
        return count, gathered(self.tokens, start, count)

    def encode(self, text: str) -> bytes:
        """Ids of a text, as little-endian unsigned 32-bit integers."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; the texts share matrices."""
        out: list[bytes] = []
        pieces: list[str] = []
        ends: list[int] = []

        def flush() -> None:
            count, ids = self._ids_of(pieces)
            upto = np.concatenate([[0], np.cumsum(count)])[[0, *ends]].tolist()
            raw = ids.astype("<u4").tobytes()
            out.extend(raw[4 * a : 4 * b] for a, b in zip(upto, upto[1:], strict=False))
            pieces.clear()
            ends.clear()

        for text in texts:
            if len(text) > AT_ONCE:
                flush()
                found = (match[0] for match in self.pattern.finditer(text))
                parts = iter(lambda found=found: list(islice(found, AT_ONCE)), [])
                out.append(b"".join(self._ids_of(p)[1].astype("<u4").tobytes() for p in parts))
                continue
            pieces += self.pattern.findall(text)
            ends.append(len(pieces))
            if len(pieces) >= AT_ONCE:
                flush()
        flush()
        return out

    def decode(self, ids: bytes) -> bytes:
        """Bytes of the tokens, which need not be whole characters where ids were cut."""
        numbers = np.frombuffer(ids, "<u4").astype(np.int64)
        if len(numbers) and (numbers.max() >= len(self.size) or not self.size[numbers].all()):
            raise ValueError("an id is none of the vocabulary's")
        parts = (numbers[at : at + AT_ONCE] for at in range(0, len(numbers), AT_ONCE))
        return b"".join(gathered(self.bytes, self.place[x], self.size[x]).tobytes() for x in parts)


class Tokenizer:
    """Column functions of one vocabulary.

    The rank table, a file of fixed size, is read once where the job is planned and broadcast;
    a worker builds its pair table on first use and keeps it, together with the pieces it met,
    up to ``KEPT_PIECES``.
    """

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        ranks = read_ranks(path)
        self.shared = spark.sparkContext.broadcast((ranks, pattern))
        self.key = hash((pattern, tuple(sorted(ranks.items()))))

    def encode(self):
        """Column function: text to ids as a binary of little-endian unsigned 32-bit integers.

        Null text gives no ids, as empty text does.
        """
        shared, key = self.shared, self.key

        @F.arrow_udf("binary")
        def encoded(texts: pa.Array) -> pa.Array:
            own = _vocabulary(shared, key)
            return pa.array(own.encode_all([x or "" for x in texts.to_pylist()]), pa.binary())

        return encoded

    def decode(self):
        """Column function: such ids back to bytes; null gives null, an unknown id is an error."""
        shared, key = self.shared, self.key

        @F.arrow_udf("binary")
        def decoded(ids: pa.Array) -> pa.Array:
            own = _vocabulary(shared, key)
            made = [own.decode(x.as_py()) if x.is_valid else None for x in ids]
            return pa.array(made, pa.binary())

        return decoded

    def round_trip(self):
        """Column function: text to (ids, back), its ids and the bytes that they decode to.

        The same as :meth:`encode` and then :meth:`decode`, with a text encoded once where both are
        wanted.
        """
        shared, key = self.shared, self.key

        @F.arrow_udf("ids binary, back binary")
        def both(texts: pa.Array) -> pa.Array:
            own = _vocabulary(shared, key)
            ids = own.encode_all([x or "" for x in texts.to_pylist()])
            back = [own.decode(x) for x in ids]
            return pa.StructArray.from_arrays(
                [pa.array(ids, pa.binary()), pa.array(back, pa.binary())], names=["ids", "back"]
            )

        return both


_LOADED: dict[int, Vocabulary] = {}


def _vocabulary(shared, key: int) -> Vocabulary:
    """The vocabulary of a broadcast, built once in a worker process; the last one is kept."""
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Vocabulary(*shared.value)
    return _LOADED[key]
