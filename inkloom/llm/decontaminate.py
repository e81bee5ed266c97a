"""Benchmark decontamination by pigeonhole pieces and Myers' bit-parallel edit distance.

A test item with a budget of k edits is split into k + 1 pieces: whichever k edits are made, one
piece stays whole. All pieces go into one Aho-Corasick automaton; each exact piece hit in a
document names an item and where its start would be, and the text around that place is verified
by Myers' algorithm, whose columns are Python integers as long as the item.

Items and documents are compared by their letters and digits: lower-cased, everything else one
space, with a space before and after. So an item is whole words: without a budget it is never found
inside a word, and what a word's rest adds to an end counts as an edit.

The documents are read once. The items are broadcast in blocks of ``ITEMS_A_BLOCK``. A worker holds
their texts, and the automatons, many times larger, of at most ``BLOCKS_KEPT`` blocks; of more
blocks than that it builds one after the other for each batch of texts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.llm.common import packed, pick, unpacked

#: What stands before and after items and texts, so that their ends are the ends of words.
EDGE = " "
TOKEN = re.compile(r"[^\W_]+")
ITEMS_A_BLOCK = 5_000
BLOCKS_KEPT = 4
MATCH = "array<struct<item_id: bigint, distance: int, start: bigint, stop: bigint>>"


def normal(text: str) -> str:
    return " ".join(TOKEN.findall(text.lower()))


def original_spans(text: str) -> tuple[list[int], list[int]]:
    """For every character of the normal form, the start and end of its token in ``text``."""
    starts: list[int] = []
    stops: list[int] = []
    for found in TOKEN.finditer(text):
        # Lower-casing may lengthen a token; its characters all stand for the whole token.
        width = len(found.group().lower()) + 1
        starts += [found.start()] * width
        stops += [found.end()] * width
    return starts, stops


def edit_budget(length: int, share: float) -> int:
    return int(length * share)


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece) of ``budget + 1`` consecutive pieces of nearly equal length."""
    cuts = [round(k * len(item) / (budget + 1)) for k in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def myers(pattern_bits: dict[str, int], length: int, text: str) -> tuple[int, int]:
    """Least edit distance of the pattern to any substring of ``text``, and where that ends.

    Ties: the first end. The end is exclusive.
    """
    full = (1 << length) - 1
    top = 1 << (length - 1)
    plus, minus, score = full, 0, length
    best, end = length, 0
    get = pattern_bits.get
    for at, char in enumerate(text, 1):
        equal = get(char, 0)
        xv = equal | minus
        xh = (((equal & plus) + plus) ^ plus) | equal
        up = minus | (full & ~(xh | plus))
        down = plus & xh
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = (up << 1) & full
        down = (down << 1) & full
        plus = down | (full & ~(xv | up))
        minus = up & xv
        if score < best:
            best, end = score, at
    return best, end


def pattern_bits(pattern: str) -> dict[str, int]:
    bits: dict[str, int] = {}
    for k, char in enumerate(pattern):
        bits[char] = bits.get(char, 0) | 1 << k
    return bits


class Matcher:
    """The automaton over one block of items; built once in each Python worker."""

    def __init__(self, items: list[tuple[int, str]], share: float):
        # The budget is a share of the item, not of the edges.
        self.budgets = [edit_budget(len(text), share) for _, text in items]
        items = [(item_id, f"{EDGE}{text}{EDGE}") for item_id, text in items]
        self.items = items
        self.bits = [pattern_bits(text) for _, text in items]
        self.reverse = [pattern_bits(text[::-1]) for _, text in items]
        places: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text) in enumerate(items):
            for offset, piece in pieces(text, self.budgets[k]):
                places.setdefault(piece, []).append((k, offset + len(piece)))
        self.automaton = ahocorasick.Automaton()
        for piece, own in places.items():
            self.automaton.add_word(piece, own)
        if places:
            self.automaton.make_automaton()

    def matches(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, start, stop) in ``text``: the best match of each item.

        Ties: the first in the text. A match starts and stops with whole words.
        """
        if not text or not len(self.automaton):
            return []
        plain = f"{EDGE}{normal(text)}{EDGE}"
        best: dict[int, tuple[int, int, int]] = {}
        tried: dict[int, int] = {}
        for last, own in self.automaton.iter(plain):
            for k, upto in own:
                budget, length = self.budgets[k], len(self.items[k][1])
                start = last + 1 - upto
                # Hits of one copy name starts at most 2k apart: the window around the first
                # is wide enough for all of them.
                if k in tried and abs(start - tried[k]) <= budget:
                    continue
                tried[k] = start
                low = max(0, start - 2 * budget)
                window = plain[low : start + length + 2 * budget]
                distance, end = myers(self.bits[k], length, window)
                if distance > budget or (k in best and best[k][0] <= distance):
                    continue
                back = window[max(0, end - length - budget) : end][::-1]
                _, width = myers_whole(self.reverse[k], length, back)
                best[k] = (distance, low + end - width, low + end)
        if not best:
            return []
        starts, stops = original_spans(text)
        spans = []
        for k, (distance, a, b) in sorted(best.items()):
            # The match without the spaces at its ends, counted in the text without its edge.
            matched = plain[a:b]
            first = a + len(matched) - len(matched.lstrip()) - len(EDGE)
            last = max(first, b - len(matched) + len(matched.rstrip()) - len(EDGE) - 1)
            spans.append((self.items[k][0], distance, starts[first], stops[last]))
        return spans


def myers_whole(bits: dict[str, int], length: int, text: str) -> tuple[int, int]:
    """Least edit distance of the pattern to any prefix of ``text``, and its length.

    The columns start at the distance from the empty pattern, so the text's start is fixed.
    """
    full = (1 << length) - 1
    top = 1 << (length - 1)
    plus, minus, score = full, 0, length
    best, width = length, 0
    for at, char in enumerate(text, 1):
        equal = bits.get(char, 0)
        xv = equal | minus
        xh = (((equal & plus) + plus) ^ plus) | equal
        up = minus | (full & ~(xh | plus))
        down = plus & xh
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = ((up << 1) | 1) & full
        down = (down << 1) & full
        plus = down | (full & ~(xv | up))
        minus = up & xv
        if score < best:
            best, width = score, at
    return best, width


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The distinct items in blocks of a bounded number, their texts in normal form.

    Items of null text, or without letter and digit, cannot be found and are left out; of rows
    that repeat an id each distinct text is an item. A text that only rows of null id have is an
    item with a hash of the text as its id.
    """
    items = pick(benchmark, item_id="bigint", text="string").filter(F.col("text").isNotNull())
    named = items.filter(F.col("item_id").isNotNull())
    unnamed = items.filter(F.col("item_id").isNull()).join(named.select("text"), "text", "left_anti")
    rows = (
        named.unionByName(unnamed.select(F.xxhash64("text").alias("item_id"), "text"))
        .distinct()
        .orderBy("item_id", "text")
    )
    block: list[tuple[int, str]] = []
    for row in rows.toLocalIterator():
        if plain := normal(row["text"]):
            block.append((row["item_id"], plain))
        if len(block) == ITEMS_A_BLOCK:
            yield block
            block = []
    if block:
        yield block


def _matchers(blocks: list, share: float) -> Callable[[], Iterator[Matcher]]:
    """Gives the matchers of all blocks, as often as called."""
    if len(blocks) <= BLOCKS_KEPT:
        kept = [Matcher(block.value, share) for block in blocks]
        return lambda: iter(kept)

    def anew() -> Iterator[Matcher]:
        for block in blocks:
            yield Matcher(block.value, share)

    return anew


def _finder(benchmark: DataFrame, share: float, *, any_one: bool = False):
    """Arrow function text -> its matches; with ``any_one`` those of the first block with some."""
    context = benchmark.sparkSession.sparkContext
    blocks = [context.broadcast(block) for block in item_blocks(benchmark)]
    fields = ("item_id", "distance", "start", "stop")

    @F.arrow_udf(MATCH)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matchers = _matchers(blocks, share)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
        kind = pa.list_(pa.struct(list(zip(fields, kinds, strict=True))))
        for texts in batches:
            found: list[list[dict]] = [[] for _ in texts]
            for matcher in matchers():
                for own, text in zip(found, texts, strict=True):
                    if not (own and any_one):
                        own += [dict(zip(fields, m, strict=True)) for m in matcher.matches(text.as_py())]
            yield pa.array(found, kind)

    return find


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.05) -> DataFrame:
    """(doc_id, item_id, distance, start, stop): the best match of every item in every document.

    A match has at most ``share`` of the item's length in edits. ``start`` and ``stop`` are code
    points of the document's own text. Null or empty text: no match. Null doc_id: kept as null.
    Repeated rows match alike; an empty table on either side gives no rows. Very long texts: one
    pass, and one window an item and place.
    """
    rows = pick(docs, doc_id="bigint", text="string")
    found = _finder(benchmark, share)("text")
    return rows.select("doc_id", F.explode(found).alias("m")).select("doc_id", "m.*")


def uncontaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.05) -> DataFrame:
    """The rows of ``docs`` in which no item is found, columns unchanged."""
    found = _finder(benchmark, share, any_one=True)("text")
    return unpacked(packed(docs).filter(F.size(found) == 0), docs.columns)
