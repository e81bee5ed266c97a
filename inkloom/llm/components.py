"""Connected components by alternating large and small stars, every round written out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.session import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest node near it."""
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (
        both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them; ``u > v`` in the input."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node with a link.

    ``links`` has two columns of integer nodes. Each round halves the depth of the trees at
    least; a round ends in a table in the shared folder, so a lost executor repeats one round.
    Aggregations combine before they shuffle and the joins are plain equi-joins that adaptive
    execution splits where one node has very many links.
    """
    edges = links.toDF("u", "v").filter("u <> v")
    edges = cut_lineage(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    before = None
    while True:
        edges = cut_lineage(_small_star(_large_star(edges).distinct()).distinct())
        state = tuple(
            edges.agg(
                F.count(F.lit(1)),
                F.coalesce(F.sum(F.col("v").cast("decimal(38,0)")), F.lit(0)),
                F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)),
            ).first()
        )
        if state == before:
            break
        before = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
