"""Joins and running sums that survive a key holding a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkloom.session import cut_lineage

# A key is hot from this many rows on, so there are at most rows / HOT_ROWS hot keys and the
# list of them, unlike the rows, is always small enough to broadcast.
HOT_ROWS = 1_000_000
SALTS = 64
# Rows of a block that is windowed at once, blocks of one table at most (the sample of their
# borders goes through the driver), and blocks that are folded into one.
BLOCK = 1 << 16
MOST_BLOCKS = 4096
SPAN = 64
SMALL_ROWS = 200_000


def small_side(frame: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """Broadcast hint, given only after counting that ``frame`` really is small."""
    return F.broadcast(frame) if frame.limit(rows + 1).count() <= rows else frame


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: str,
    *,
    spread: Sequence[str],
    how: str = "left",
    hot_rows: int = HOT_ROWS,
    salts: int = SALTS,
    left_rows: int | None = None,
) -> DataFrame:
    """Join to ``right``, unique on ``on``, with hot keys (and nulls) of ``left`` salted.

    Rows of a hot key are spread by a hash of the ``spread`` columns, which must tell rows of
    one key apart; only the few matching right rows are copied once per salt. A hash keeps the
    choice the same when a lost task is run again. ``left_rows``, if the caller knows it, saves
    the search for hot keys where there cannot be one.
    """
    if left_rows is not None and left_rows <= hot_rows:
        return left.join(right, on, how)
    hot = (
        left.groupBy(on)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .filter((F.col("_rows") > hot_rows) & F.col(on).isNotNull())
        .select(on, F.lit(True).alias("_hot"))
    )
    salt = F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")
    wide = F.col("_hot") | F.col(on).isNull()
    salted = (
        left.join(F.broadcast(hot), on, "left")
        .withColumn("_salt", F.when(wide, salt).otherwise(F.lit(0)))
        .drop("_hot")
    )
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(
        F.array(F.lit(0))
    )
    copied = (
        right.join(F.broadcast(hot), on, "left")
        .withColumn("_salt", F.explode(copies))
        .drop("_hot")
    )
    return salted.join(copied, [on, "_salt"], how).drop("_salt")


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal or both-null columns; the columns of ``left``, then the others of ``right``."""
    renamed = right.withColumnsRenamed({name: f"_right_{name}" for name in on})
    same = [F.col(name).eqNullSafe(F.col(f"_right_{name}")) for name in on]
    return left.join(renamed, reduce(lambda a, b: a & b, same), how).drop(*[f"_right_{n}" for n in on])


def equal_depth(frame: DataFrame, by: Sequence[str], *, block: int = BLOCK) -> DataFrame:
    """``frame`` written once in blocks that are contiguous in the order of ``by``; adds ``_block``.

    Borders come from quantiles of a sample, so blocks hold about equally many rows however the
    values are spread: an outlier, a sparse order or a key with most of the rows changes nothing.
    There are rows / ``block`` of them, ``MOST_BLOCKS`` at most. The number of a block is stored
    with its rows, so that all that follows sees the same cut, also where tasks run again.
    """
    blocks = max(1, min(MOST_BLOCKS, -(-frame.count() // block)))
    ranged = frame.repartitionByRange(blocks, *by)
    return cut_lineage(ranged.withColumn("_block", F.spark_partition_id()))


def before_blocks(totals: DataFrame, keys: Sequence[str], value: str, fold, *, span: int = SPAN) -> DataFrame:
    """Adds ``_before``: the fold (sum or max) of ``value`` over earlier blocks of the same keys.

    ``totals`` has a row for each key and ``_block``. Runs of ``span`` blocks are folded first and
    then windowed per key, the blocks of a run among themselves: no window holds more than
    ``span`` or a ``span``-th of a key's blocks. Null where there is no earlier block.
    """

    def earlier(order: str, *more: str):
        window = Window.partitionBy(*keys, *more).orderBy(order)
        return window.rowsBetween(Window.unboundedPreceding, -1)

    run = F.floor(F.col("_block") / F.lit(span)).cast("int")
    marked = totals.withColumn("_run", run)
    runs = marked.groupBy(*keys, "_run").agg(fold(value).alias("_whole"))
    runs = runs.select(*keys, "_run", fold("_whole").over(earlier("_run")).alias("_runs_before"))
    inside = marked.withColumn("_inside", fold(value).over(earlier("_block", "_run")))
    both = null_safe_join(inside, runs, [*keys, "_run"])
    parts = F.array_compact(F.array("_runs_before", "_inside"))
    found = F.array_max(parts) if fold is F.max else F.element_at(parts, 1) + F.when(
        F.size(parts) > 1, F.element_at(parts, -1)
    ).otherwise(F.lit(0))
    return both.withColumn("_before", F.when(F.size(parts) > 0, found)).drop("_run", "_inside", "_runs_before")


def running_sum(
    frame: DataFrame,
    keys: Sequence[str],
    order: str,
    value: Column,
    out: str,
    *,
    block: int = BLOCK,
) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over earlier rows of the same keys.

    ``order`` is unique per key. Sums are made on thin rows, the keys, the order and the value,
    dealt into blocks of equal depth: rows are windowed per block and only one total per block is
    windowed per key, so no task sorts a whole hot key. Each row of ``frame`` then meets its sum
    once, by its keys and order, which no two rows share. Nulls among the keys are a key.
    """
    thin = frame.select(*keys, order, value.alias("_value"))
    cut = equal_depth(thin, [*keys, order], block=block)
    totals = cut.groupBy(*keys, "_block").agg(F.sum("_value").alias("_total"))
    before = before_blocks(totals, keys, "_total", F.sum).drop("_total")
    earlier_rows = (
        Window.partitionBy(*keys, "_block")
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    within = cut.withColumn("_within", F.sum("_value").over(earlier_rows))
    summed = F.coalesce("_before", F.lit(0)) + F.coalesce("_within", F.lit(0))
    placed = null_safe_join(within, before, [*keys, "_block"]).select(*keys, order, summed.alias(out))
    return null_safe_join(frame, placed, [*keys, order])


def numbered(
    frame: DataFrame, keys: Sequence[str], order: str, out: str, *, block: int = BLOCK
) -> DataFrame:
    """Adds ``out``: 1-based position within the keys by an integer order."""
    counted = running_sum(frame, keys, order, F.lit(1).cast("bigint"), out, block=block)
    return counted.withColumn(out, F.col(out) + F.lit(1))
