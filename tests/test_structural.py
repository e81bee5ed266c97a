"""The structural join against brute force, and on deep and hot trees."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from inkloom.operators.structural import enclosing

SCHEMA = "page string, i int, end int, tag string"


def tree(rng: random.Random, page, size: int) -> list[tuple]:
    """Random nested intervals; every open and close has a place of its own."""
    rows, open_, at = [], [], 0
    while len(rows) < size or open_:
        if open_ and (len(rows) >= size or rng.random() < 0.45):
            rows[open_.pop()][2] = at
        else:
            open_.append(len(rows))
            rows.append([page, at, None, rng.choice("abc")])
        at += 1
    return [tuple(row) for row in rows]


@pytest.mark.parametrize("block", [7, 1 << 16])
def test_equals_brute_force(spark, block):
    rng = random.Random(block)
    nodes = [n for page, size in (("hot", 150), ("b", 20), (None, 30), ("one", 1)) for n in tree(rng, page, size)]
    points = [(p, i, i, "text") for p in ("hot", "b", None, "none") for i in rng.sample(range(40), 15)]
    crossing = [("hot", i, i + rng.randrange(60), "any") for i in range(0, 200, 9)]
    inner = nodes + points + crossing + points[:3]
    outer = [n for n in nodes if n[3] != "c"]
    found = enclosing(
        spark.createDataFrame(inner, SCHEMA), spark.createDataFrame(outer + outer[:5], SCHEMA), ["page"], block=block
    )
    assert found.columns == ["page", "i", "end", "tag", "outer_start", "outers"]
    wanted = []
    for page, i, end, tag in inner:
        around = [a for p, a, b, _ in outer if p == page and a < i and b > end]
        wanted.append((page, i, end, tag, max(around, default=None), len(around)))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(wanted, key=repr)
    assert sum(r[5] > 1 for r in wanted) > 50


def test_a_hundred_thousand_nested_nodes_of_one_page(spark):
    n = 100_000
    nodes = spark.range(n).select(
        F.lit(1).alias("page"), F.col("id").cast("int").alias("i"), (2 * n - F.col("id")).cast("int").alias("end")
    )
    found = enclosing(nodes, nodes, ["page"], block=25_000)
    wrong = found.filter((F.col("outers") != F.col("i")) | ~F.col("outer_start").eqNullSafe(F.when(F.col("i") > 0, F.col("i") - 1)))
    assert wrong.count() == 0 and found.count() == n


def test_empty_sets(spark):
    none, some = spark.createDataFrame([], SCHEMA), spark.createDataFrame([("a", 1, 2, "x")], SCHEMA)
    assert enclosing(none, some, ["page"]).collect() == []
    assert [tuple(r) for r in enclosing(some, none, ["page"]).collect()] == [("a", 1, 2, "x", None, 0)]
