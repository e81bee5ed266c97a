"""Long repeats against brute force, at every way a window can be judged."""

from __future__ import annotations

import random

import cases
import numpy as np
import pytest

from inkloom.llm import suffix_dedup
from inkloom.llm.anchors import Hashes, sliding
from inkloom.llm.run_length_index import RunLengthIndex, long_matches, packed_words, suffix_array


def brute(texts: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    seen: dict[bytes, int] = {}
    for t in texts:
        for k in range(len(t) - length + 1):
            seen[t[k : k + length]] = seen.get(t[k : k + length], 0) + 1
    out = []
    for t in texts:
        cover = [False] * (len(t) + 1)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                cover[k : k + length] = [True] * length
        edges = [k for k in range(len(t) + 1) if cover[k] != (k > 0 and cover[k - 1])]
        out.append(list(zip(edges[::2], edges[1::2], strict=True)))
    return out


def corpus(seed: int, n: int = 40) -> list[str]:
    """Unrelated texts, near copies, shared passages, periodic and short texts."""
    rng = random.Random(seed)
    fresh = lambda k: "".join(rng.choice("abcdé ") for _ in range(k))
    base, passage = fresh(700), fresh(150)
    texts = [fresh(500) for _ in range(n // 4)]
    for _ in range(n // 4):
        copy = list(base)
        for _ in range(rng.randrange(6)):
            copy[rng.randrange(len(copy))] = rng.choice("xyz")
        texts.append("".join(copy))
    texts += [fresh(rng.randrange(200)) + passage + fresh(rng.randrange(200)) for _ in range(n // 4)]
    texts += ["a" * 400, "ab" * 300, "ab" * 200, base, "", "short", base[300:], base[:300] + base[100:]]
    return texts


@pytest.mark.parametrize("seed, hot, shard", [(1, 20_000, 1 << 21), (2, 1, 1 << 21), (3, 20_000, 500), (4, 3, 2000)])
def test_spans_equal_brute_force(spark, monkeypatch, seed, hot, shard):
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", shard)
    texts = corpus(seed)
    rows = [(k, t, None, None, None) for k, t in enumerate(texts)]
    found = suffix_dedup.repeats(cases.frame(spark, rows).repartition(3), length=100, hot=hot).collect()
    wanted = brute([t.encode() for t in texts], 100)
    assert {r.doc_id: [tuple(s) for s in r.spans] for r in found} == dict(enumerate(wanted))


def test_awkward_rows(spark):
    rows = cases.documents()
    found = suffix_dedup.repeats(cases.frame(spark), length=64).collect()
    wanted = brute([(r[1] or "").encode() for r in rows], 64)
    assert sorted((r.doc_id or -1, r.text or "", tuple(map(tuple, r.spans))) for r in found) == sorted(
        (r[0] or -1, r[1] or "", tuple(w)) for r, w in zip(rows, wanted, strict=True)
    )
    assert suffix_dedup.repeats(cases.frame(spark, [])).count() == 0


def test_pieces_of_a_long_text_lose_no_window(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 300)
    data = np.frombuffer("".join(random.Random(3).choice("ab") for _ in range(2000)).encode(), np.uint8)
    _, _, start, width = suffix_dedup.contexts(data, 100)
    windows = sorted(k for a, w in zip(start, width, strict=True) for k in range(a, a + w - 99))
    assert windows == list(range(len(data) - 99))


def test_suffix_array_and_statistics():
    rng = random.Random(6)
    for _ in range(60):
        text = bytes(rng.choice(b"ab\x00") for _ in range(rng.randint(1, 80))) + b"\xff"
        data = np.frombuffer(text, np.uint8)
        order = suffix_array(packed_words(data), len(data))
        assert order.tolist() == sorted(range(len(text)), key=lambda k: text[k:])
        index = RunLengthIndex(data)
        assert len(index.starts) == len(index.heads) == len(index.tails) <= len(text)
        same = lambda a, b: next((k for k in range(len(text)) if text[a + k : a + k + 1] != text[b + k : b + k + 1] or max(a, b) + k >= len(text)), 0)
        wanted = [max((same(a, b) for b in range(len(text)) if b != a), default=0) for a in range(len(text))]
        assert index.matching_statistics().tolist() == wanted


def test_a_match_never_crosses_a_separator():
    data = np.frombuffer(b"abcd\xffefgh\xffabcd\xffefgh\xff", np.uint8)
    starts, stops = long_matches(data, 255, 5)
    assert len(starts) == len(stops) == 0


def test_substring_hashes_and_sliding():
    data = np.frombuffer(b"abracadabra" * 3, np.uint8)
    hashes = Hashes(data)
    assert hashes.of(np.array([0]), np.array([7])) == hashes.of(np.array([11]), np.array([18]))
    assert (hashes.all_of(7)[:5] == hashes.of(np.arange(5), np.arange(5) + 7)).all()
    values = np.random.default_rng(1).integers(0, 9, 50).astype(np.uint64)
    for width in (1, 2, 5, 16, 50):
        assert sliding(values, width, np.minimum).tolist() == [values[k : k + width].min() for k in range(51 - width)]
