"""Numeric arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: full scale of a signed 16-bit sample.
FULL_SCALE = 32767


def quantise_i16(samples: Column) -> Column:
    """Clip to [-1, 1] and scale to 16-bit integers, truncating toward zero in 32-bit maths."""
    scale = F.lit(FULL_SCALE).cast("float")

    def one(sample: Column) -> Column:
        clipped = F.greatest(
            F.lit(-1.0).cast("float"), F.least(F.lit(1.0).cast("float"), sample.cast("float"))
        )
        return (clipped * scale).cast("smallint")

    return F.transform(samples, one)
