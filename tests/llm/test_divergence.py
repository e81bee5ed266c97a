"""Source divergence: the pointer sort and the shares against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

import cases
import numpy as np
import pyarrow as pa
import pytest

from inkloom.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text: str | None) -> list[str]:
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def brute(rows: list[tuple], min_docs: int, top: int) -> list[tuple]:
    docs = [(lang or "", source or "", Counter(terms_of(text))) for _, text, lang, source, *_ in rows]
    out = []
    for lang in {d[0] for d in docs}:
        frequency = Counter(t for d in docs if d[0] == lang for t in d[2])
        kept = [t for t, n in frequency.items() if n >= min_docs]

        def share(counts, kept=kept):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (counts[t] + 1) // (total + len(kept)) for t in kept}

        sources = sorted({d[1] for d in docs if d[0] == lang}, key=lambda s: s.encode())
        counts = {s: sum((d[2] for d in docs if d[:2] == (lang, s)), Counter()) for s in sources}
        shares = {s: share(counts[s]) for s in sources}
        whole = share(sum(counts.values(), Counter()))
        for s in sources:
            p = shares[s]
            pair = [(sum((p[t] - q[t]) ** 2 // q[t] for t in kept), o) for o, q in shares.items() if o != s]
            term = [((p[t] - whole[t]) ** 2 // whole[t], t) for t in kept if counts[s][t] and p[t] > whole[t]]
            for part, found, most in (("pair", pair, len(pair)), ("term", term, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k) for k, (v, item) in enumerate(found[:most], 1)]
    return sorted(out)


def found(frame, **given) -> list[tuple]:
    rows = divergence.source_divergence(frame, **given)
    assert rows.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in rows.collect())


def test_pointer_sort_equals_sorting_the_tokens():
    rng = random.Random(2)
    signs = ["a", "b", "B", "é", "漢", " ", "1", "abcdefgh", "abcdefghabcdefgh"]
    for size in (0, 1, 5, 300):
        texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(size)]
        data, edges = divergence.bytes_of(pa.array(["x", *texts, None])[1:])
        data = divergence.LOWERED[data]
        start, length = divergence.token_runs(data, edges)
        tokens = [bytes(data[a : a + n]) for a, n in zip(start, length, strict=True)]
        assert tokens == [t.encode() for text in texts for t in terms_of(text)]
        order, term = divergence.sorted_terms(data, start, length)
        assert [tokens[k] for k in order] == sorted(tokens)
        names = sorted(set(tokens))
        assert [names[k] for k in term] == sorted(tokens)


def test_equal_runs_give_occurrences_and_documents():
    texts = ["a b a", "B a", "", "c a"]
    group = np.array([0, 1, 1, 0])
    names, own, n, df = divergence.run_counts(*divergence.bytes_of(pa.array(texts)), group, 2)
    got = dict(zip(zip(names.to_pylist(), own.tolist(), strict=True), zip(n.tolist(), df.tolist(), strict=True), strict=True))
    assert got == {("a", 0): (3, 2), ("a", 1): (1, 1), ("b", 0): (1, 1), ("b", 1): (1, 1), ("c", 0): (1, 1)}


def many(n: int) -> list[tuple]:
    rng = random.Random(7)
    words = [f"{a}{b}" for a in ("wort", "mot", "longerthaneight", "é") for b in "abcdefghij"]
    rows = []
    for k in range(n):
        source = "hot" if k % 3 == 0 else rng.choice([None, "", "b", "ß", "Z", *[f"s{j}" for j in range(9)]])
        text = " ".join(rng.choice(words[: 8 + k % 33]) for _ in range(rng.randrange(40)))
        rows.append((k, text if k % 11 else None, rng.choice(["en", "fr", None]), source, None))
    return rows


@pytest.mark.parametrize("side, at_once, size", [(32, 1 << 15, 8 << 20), (3, 7, 200)])
def test_equals_brute_force_in_one_and_in_many_shards(spark, monkeypatch, side, at_once, size):
    for name, value in (("SIDE", side), ("TERMS_AT_ONCE", at_once), ("SLICE", size)):
        monkeypatch.setattr(divergence, name, value)
    rows = many(240)
    wanted = brute(rows, 3, 5)
    assert len([r for r in wanted if r[2] == "pair"]) > 300
    assert found(cases.frame(spark, rows, extra=False), min_docs=3, top=5) == wanted


def test_awkward_rows(spark):
    wanted = brute(cases.documents(), 3, 200)
    assert found(cases.frame(spark)) == wanted
    assert found(cases.frame(spark, [])) == []
    # A language without kept terms still has its pairs; one without a second source has none.
    rows = [(1, "one", "en", "a", None), (2, "two", "en", "b", None), (3, "x x x", "de", "a", None)]
    assert found(cases.frame(spark, rows)) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_shares_are_exact_beyond_long_products(spark):
    row = spark.sql("select 9000000000000 as n, 9100000000000 as total, 5 as kept")
    got = row.select(divergence.share(row.n, row.total, row.kept)).first()[0]
    assert got == 1 + 1_000_000_000 * 9_000_000_000_001 // 9_100_000_000_005
