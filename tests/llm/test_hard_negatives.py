"""Hard negatives: the cover tree's properties, and searches against brute force."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkloom.llm import hard_negatives as H

ROWS = "vec_id bigint, embedding array<double>, label int"


def clustered(n: int, width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    centers = rng.integers(-60, 60, (12, width))
    vectors = centers[rng.integers(0, 12, n)] + rng.integers(-3, 4, (n, width))
    vectors[rng.integers(0, n, n // 20)] = 0
    return vectors.astype(np.int64), rng.integers(0, 4, n)


def tree_of(vectors: np.ndarray, label: np.ndarray) -> H.CoverTree:
    tree = H.CoverTree.build(vectors, label, [[(0, k)] for k in range(len(vectors))])
    return H.CoverTree.load(tree.dump())


def below(tree: H.CoverTree, node: int) -> list[int]:
    points = list(range(tree.loose[node], tree.loose[node + 1]))
    return points + [p for c in range(*tree.child[node]) for p in below(tree, c)]


def test_nodes_cover_their_points_and_centres_lie_apart():
    vectors, label = clustered(900, 5, 1)
    tree = tree_of(vectors, label)
    top = tree.norm[0]
    lifted = np.column_stack([tree.as_float, np.sqrt(np.maximum(0, top**2 - (tree.as_float**2).sum(axis=1)))]) / top

    def angle(a, b):
        return np.arccos(np.clip(lifted[a] @ lifted[b], -1, 1))

    assert sorted(below(tree, 0)) == list(range(900)) and len(tree.center) > 20
    for node in range(len(tree.center)):
        inside = below(tree, node)
        assert angle(inside, tree.center[node]).max() <= tree.angle[node] + 1e-6
        assert (tree.low[node], tree.high[node]) == (tree.label[inside].min(), tree.label[inside].max())
        net = [tree.center[c] for c in range(*tree.child[node])]
        for k, a in enumerate(net):
            assert all(angle([b], a)[0] > tree.angle[node] / 2 - 1e-6 for b in net[:k])
            assert tree.angle[tree.child[node][0] + k] <= tree.angle[node] / 2 + 1e-6
        for query in (tree.as_float[node], -tree.as_float[node], np.zeros(5)):
            reach = float(np.linalg.norm(query)) * top
            low, high = tree.bounds(np.array([node]), query, reach)
            scores = tree.as_float[inside] @ query
            assert low[0] <= scores.min() and scores.max() <= high[0]


def brute_search(vectors, label, query, own_label, windows, count, same, skip):
    scores = [int(x) for x in vectors.astype(object) @ query.astype(object)]
    out = []
    for low, high in windows:
        hits = [
            (s, (0, k)) for k, s in enumerate(scores)
            if low <= s <= high and (label[k] == own_label) == same and k != skip
        ]
        out.append(sorted(hits, key=lambda x: (-x[0], x[1]))[:count])
    return out


@pytest.mark.parametrize("width, scale", [(1, 1), (3, 1), (16, 1), (4, 1 << 40)])
def test_search_equals_brute_force(width, scale):
    vectors, label = clustered(400, width, width)
    vectors = np.unique(np.column_stack([vectors * scale, label]), axis=0)
    vectors, label = vectors[:, :-1], vectors[:, -1]
    tree = tree_of(vectors, label)
    rng = random.Random(1)
    for k in rng.sample(range(len(vectors)), min(60, len(vectors))):
        square = int(sum(int(x) ** 2 for x in vectors[k]))
        tops = [square, square // 2, 0, -5, H.LONG]
        windows = [(H.lowest(top, 80) if top < H.LONG else -H.LONG - 1, top) for top in tops]
        if scale > 1:
            clip = [(max(-H.LONG - 1, a), min(H.LONG, b)) for a, b in windows]
            vectors_ok = max(abs(int(x)) for x in (vectors.astype(object) @ vectors[k].astype(object))) <= H.LONG
            windows = clip if vectors_ok else [(-H.LONG - 1, H.LONG)]
        for same in (True, False):
            wanted = brute_search(vectors, label, vectors[k], label[k], windows, 5, same, k if same else None)
            wanted = [[(max(-H.LONG - 1, min(H.LONG, s)), name) for s, name in w] for w in wanted]
            if scale == 1 or vectors_ok:
                got = tree.search(vectors[k], label[k], windows, 5, same, (0, k))
                assert got == wanted


def test_nodes_outside_the_window_are_skipped(monkeypatch):
    rng = np.random.default_rng(3)
    centers = rng.integers(-900, 900, (40, 16))
    vectors = centers[np.arange(4000) % 40] + rng.integers(-9, 10, (4000, 16))
    tree = tree_of(vectors.astype(np.int64), np.arange(4000) % 40 % 3)
    asked = []
    bounds = H.CoverTree.bounds
    monkeypatch.setattr(H.CoverTree, "bounds", lambda self, n, *a: asked.append(len(n)) or bounds(self, n, *a))
    square = int(vectors[0] @ vectors[0])
    found = tree.search(vectors[0], 0, [(H.lowest(square, 80), square)], 5, True, None)
    assert len(found[0]) == 5 and sum(asked) < len(tree.center) / 4


def brute(rows, every: int, positives=5, negatives=5, percent=80) -> list[tuple]:
    usable = [
        (i, [math.floor(256 * x) for x in v], y) for i, v, y in rows
        if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for k, (i, v, y) in enumerate(usable):
        if i is None or i % every:
            continue
        scored = [
            (-sum(a * b for a, b in zip(v, w, strict=False)), j is None, j or 0, z)
            for m, (j, w, z) in enumerate(usable) if m != k
        ]
        for s, none, j, _ in sorted(r for r in scored if r[3] == y)[:positives]:
            fits = sorted(r for r in scored if r[3] != y and percent * -s <= 100 * -r[0] <= 100 * -s)
            out += [
                (i, None if none else j, n, None if r[1] else r[2], -s, -r[0])
                for n, r in enumerate(fits[:negatives], 1)
            ]
    return sorted(out, key=repr)


def awkward(n: int) -> list[tuple]:
    rng = random.Random(6)
    rows = [
        (0, None, 1), (100, [], 1), (200, [float("nan"), 1.0], 1), (300, [float("inf")], 2), (1, [None, 1.0], 2),
        (2, [1.0], None), (None, [0.5, 0.5, 0.1], 1), (None, [0.5, 0.5, 0.1], 2), (400, [0.5], 1),
        (500, [0.0, 0.0, 0.0, 0.0], 0), (600, [0.5, 0.5, 0.1], 1), (600, [0.5, 0.5, 0.1], 1), (-100, [-0.5, 0.2], 2),
    ]
    for k in range(700, 700 + n):
        hot = rng.random() < 0.35
        vector = [0.5, 0.5, 0.1] if hot else [round(rng.uniform(-1, 1) * 8) / 8 for _ in range(3)]
        rows.append((k, vector, rng.randrange(3)))
    return rows


@pytest.mark.parametrize("block, anchors", [(4096, 4096), (16, 3)])
def test_equals_brute_force(spark, monkeypatch, block, anchors):
    monkeypatch.setattr(H, "BLOCK", block)
    monkeypatch.setattr(H, "ANCHORS", anchors)
    rows = awkward(300)
    frame = spark.createDataFrame(rows, ROWS).selectExpr("*", "1 as vector", "2 as score", "3 as cell")
    found = H.hard_negatives(frame, F.col("vec_id") % 20 == 0)
    assert found.columns == [
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    ]
    wanted = brute(rows, 20)
    assert len(wanted) > 200
    assert sorted(map(tuple, found.collect()), key=repr) == wanted


def test_empty_and_unusable_tables_give_no_rows(spark):
    for rows in ([], [(0, None, 1)], [(0, [1.0], 1)], [(0, [1.0], 1), (1, [1.0], 1)]):
        assert H.hard_negatives(spark.createDataFrame(rows, ROWS), F.col("vec_id") % 100 == 0).collect() == []
