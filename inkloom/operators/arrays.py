"""Sample vectors of a group as one long vector, kept in segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.operators.keyed import running_sum


def concat_arrays(vectors: DataFrame, key: str, order: str, samples: str, **tuning) -> DataFrame:
    """Adds ``start``: where a row's samples begin in the concatenation of its group.

    The concatenated vector stays a set of segments; reading them by ``start`` gives it in
    order and no group has to fit anywhere whole.
    """
    sized = vectors.select(key, order, samples, F.size(samples).cast("bigint").alias("length"))
    placed = running_sum(sized, [key], order, F.col("length"), "start", **tuning)
    return placed.select(key, order, "start", "length", samples)


def joined_samples(vectors: DataFrame, key: str, order: str, samples: str, **tuning) -> DataFrame:
    """One row per sample with its position in the concatenated vector."""
    placed = concat_arrays(vectors, key, order, samples, **tuning)
    rows = placed.select(key, "start", F.posexplode(samples).alias("_at", "sample"))
    return rows.select(key, (F.col("start") + F.col("_at")).alias("position"), "sample")
