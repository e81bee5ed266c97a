"""Counts and checks over parts, statuses and slugs; all combine on the map side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.operators.keyed import lookup_join


def status_tally(results: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    ok = F.col("status") == "ok"
    return results.groupBy(*keys).agg(
        F.count_if(ok).alias("total_ok"), F.count_if(~ok).alias("total_failed")
    )


def extensions(paths: DataFrame, path: str = "path") -> DataFrame:
    """Adds the lower-case extension with its dot, empty if there is none."""
    return paths.withColumn("ext", F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1)))


def ext_set(parts: DataFrame, keys: tuple[str, ...] = ("base",)) -> DataFrame:
    """Distinct extensions per key, in order, and whether every part is a ``.wav``.

    ``exts`` is the set itself: parts are reduced to distinct extensions before they meet.
    """
    seen = extensions(parts).select(*keys, "ext").distinct()
    return (
        seen.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("extensions"),
            F.min("ext").alias("first_ext"),
            F.sort_array(F.collect_list("ext")).alias("exts"),
        )
        .withColumn("all_wav", (F.col("extensions") == 1) & (F.col("first_ext") == ".wav"))
    )


def format_uniform(
    parts: DataFrame,
    fields: tuple[str, ...] = ("sample_rate", "channels"),
    key: str = "base",
) -> DataFrame:
    """Whether all parts share the first part's format, and the first part that does not."""
    variants = parts.groupBy(key, *fields).agg(F.min("part_no").alias("_first_part"))
    first = variants.groupBy(key).agg(F.min_by(F.struct(*fields), "_first_part").alias("_format"))
    other = F.struct(*fields) != F.col("_format")
    return (
        lookup_join(variants, first, key, spread=["_first_part"], how="inner")
        .groupBy(key)
        .agg(F.min(F.when(other, F.col("_first_part"))).alias("first_mismatch"))
        .select(key, F.col("first_mismatch").isNull().alias("uniform"), "first_mismatch")
    )


def slug_collisions(named: DataFrame, keys: tuple[str, ...] = ("slug",)) -> DataFrame:
    """Slugs that more than one input maps to."""
    return (
        named.groupBy(*keys).agg(F.count(F.lit(1)).alias("inputs")).filter(F.col("inputs") > 1)
    )
