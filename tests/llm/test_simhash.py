"""SimHash: fingerprints and components against brute force."""

from __future__ import annotations

import random

import cases
import numpy as np
import pytest
import xxhash

from inkloom.llm import simhash
from inkloom.llm.components import components


def brute_print(text: str | None) -> int:
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    runs = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints: list[int], radius: int) -> list[int]:
    group = list(range(len(prints)))
    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius and group[a] != group[b]:
                group = [min(group[a], group[b]) if g in (group[a], group[b]) else g for g in group]
    return group


def near_texts(n=60):
    rng, words = random.Random(4), [f"w{k}" for k in range(400)]
    rows, base = [], [rng.choice(words) for _ in range(300)]
    for k in range(n):
        text = list(base) if k % 3 else [rng.choice(words) for _ in range(300)]
        for _ in range(rng.randrange(4)):
            text[rng.randrange(300)] = rng.choice(words)
        rows.append((k, " ".join(text), "en", "a", None))
    return rows


@pytest.mark.parametrize("tile", [4, 2048])
def test_components_equal_brute_force(spark, tile):
    rows = near_texts()
    prints = [brute_print(r[1]) for r in rows]
    found = simhash.near_duplicates(cases.frame(spark, rows), tile=tile)
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in found.collect()}
    wanted = brute_components(prints, 3)
    assert len(set(wanted)) < len(rows)
    assert got == {k: (prints[k], wanted[k]) for k in range(len(rows))}


def test_every_close_pair_agrees_under_a_mask():
    rng = random.Random(9)
    for count in (10, 1 << 23, 1 << 33):
        masks = simhash._keys(count, 3)
        for _ in range(300):
            a = rng.getrandbits(64)
            b = a
            for bit in rng.sample(range(64), 3):
                b ^= 1 << bit
            assert any(a & m == b & m for m in masks)


def test_forest_connects_what_is_linked():
    rng = np.random.default_rng(2)
    left = rng.integers(0, 64, 40, dtype=np.uint64)
    for right in (left, rng.integers(0, 64, 30, dtype=np.uint64)):
        every = left if right is left else np.concatenate([left, right])
        edges = simhash._forest(left, right, 1)
        assert len(edges) < len(every)
        assert all(int(every[a] ^ every[b]).bit_count() <= 1 for a, b in edges)


def test_awkward_rows_and_stage(spark):
    docs = cases.frame(spark)
    found = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert {found[k].fp for k in (0, 1, 2)} == {0} and {found[k].component_id for k in (0, 1, 2)} == {0}
    kept = simhash.one_of_each(docs)
    ids = [r[0] for r in kept.collect()]
    assert kept.columns == docs.columns and len(ids) == len(set(ids)) and 5 in ids and 1 not in ids
    assert simhash.near_duplicates(cases.frame(spark, [])).count() == 0


def test_clean_documents_of_null_and_repeated_ids_stay(spark):
    rng = random.Random(8)
    a, b, c, d = (" ".join(f"w{rng.randrange(9999)}" for _ in range(60)) for _ in range(4))
    rows = [(i, t, None, None, None) for i, t in ((None, a), (None, a), (None, b), (5, c), (5, d), (1, c), (6, d), (None, d))]
    kept = [(r.doc_id, r.text) for r in simhash.one_of_each(cases.frame(spark, rows)).collect()]
    assert sorted(kept, key=repr) == sorted([(None, a), (None, b), (1, c), (5, d)], key=repr)


def test_components_of_long_chains(spark):
    chain = spark.range(300).selectExpr("id * 11 % 301 as a", "(id + 1) * 11 % 301 as b")
    rows = components(chain.union(spark.createDataFrame([(900, 901)], "a long, b long"))).collect()
    assert {r.node: r.component for r in rows} == {k: 0 for k in range(301)} | {900: 900, 901: 900}
