"""Structural join: which intervals of one set lie inside which of another, in one sorted pass.

A node of a tree is the interval from its open to its close, so "inside" relates two sets of
intervals. Both are merged in the order of their starts, and a stack holds the outer intervals
that are open; an inner one lies inside the part of the stack that ends after it. Every interval
is pushed and popped once, whatever the depth or the number of pairs.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkloom.operators.keyed import BLOCK, equal_depth, null_safe_join


def enclosing(
    inner: DataFrame,
    outer: DataFrame,
    keys: Sequence[str],
    *,
    start: str = "i",
    end: str = "end",
    block: int = BLOCK,
) -> DataFrame:
    """``inner`` with the intervals of ``outer`` around each row: ``outer_start`` is the start of
    the nearest one, null if there is none, and ``outers`` the number of them.

    Both sets have ``keys`` (such as the page; nulls are a key) and integer bounds. An interval is
    around another that starts after it and ends before it, so none is around itself. Those of
    ``outer`` are nested or apart, as nodes of a tree are; those of ``inner`` may be any, points
    too. Rows that repeat an interval get the same answer each.

    The merged sets are dealt into blocks of equal depth by key and start, so a key with most of
    the rows is many tasks. Outer intervals still open where a block begins are copied to it: that
    many more rows as the nodes are deep there. Neither a key nor the pairs are held anywhere, only
    the stack.
    """
    keys = list(keys)
    place = [F.col(start).cast("bigint").alias("_start"), F.col(end).cast("bigint").alias("_end")]
    thin = (
        inner.select(*keys, *place, F.lit(False).alias("_outer"))
        .unionByName(outer.select(*keys, *place, F.lit(True).alias("_outer")))
        .distinct()
    )
    cut = equal_depth(thin, [*keys, "_start"], block=block)
    # A row for each block, of which equal_depth makes a bounded number.
    borders = cut.groupBy("_block").agg(F.min(F.struct(*keys, "_start")).alias("_first"))
    to = borders.select(
        F.col("_block").alias("_to"), F.col("_first._start").alias("_from"),
        *[F.col("_first")[name].alias(f"_key_{name}") for name in keys],
    )
    open_there = (F.col("_to") > F.col("_block")) & (F.col("_from") < F.col("_end"))
    same = [F.col(name).eqNullSafe(F.col(f"_key_{name}")) for name in keys]
    carried = cut.filter("_outer").join(
        F.broadcast(to), reduce(lambda a, b: a & b, [*same, open_there])
    )
    both = cut.select("_block", *keys, "_start", "_end", "_outer").unionByName(
        carried.select(F.col("_to").alias("_block"), *keys, "_start", "_end", "_outer")
    )
    # Of one start, inner intervals come first, then outer ones from the widest.
    ordered = both.repartition("_block").sortWithinPartitions(
        "_block", *keys, "_start", "_outer", F.desc("_end")
    )
    width = len(keys)
    fields = [T.StructField(name, inner.schema[name].dataType) for name in keys]
    fields += [T.StructField(name, T.LongType()) for name in ("_start", "_end", "outer_start", "outers")]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = None
        starts: list[int] = []
        ends: list[int] = []  # negated, so that they rise with the stack
        for batch in batches:
            columns = [column.to_pylist() for column in batch.columns]
            keep, nearest, around = [], [], []
            for row, (*group, at, to, is_outer) in enumerate(zip(*columns, strict=True)):
                if group != here:
                    here = group
                    starts.clear()
                    ends.clear()
                while ends and -ends[-1] < at:
                    ends.pop()
                    starts.pop()
                if is_outer:
                    starts.append(at)
                    ends.append(-to)
                    continue
                count = bisect_left(ends, -to)
                keep.append(row)
                nearest.append(starts[count - 1] if count else None)
                around.append(count)
            picked = batch.select(range(1, width + 3)).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*picked.columns, pa.array(nearest, pa.int64()), pa.array(around, pa.int64())],
                names=[*picked.schema.names, "outer_start", "outers"],
            )

    found = ordered.mapInArrow(merge, T.StructType(fields))
    renamed = found.withColumnsRenamed({"_start": start, "_end": end})
    return null_safe_join(inner, renamed, [*keys, start, end])
