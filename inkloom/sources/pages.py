"""Captured pages and per-site settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkloom.config import DEFAULT, ExtractConfig
from inkloom.operators.keyed import small_side

PAGE_SCHEMA = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
        # Null where the captures have no status.
        T.StructField("status", T.IntegerType()),
    ]
)


def captured_pages(spark: SparkSession, path: str) -> DataFrame:
    """The page table; an optional ``status`` column holds the HTTP status of the capture."""
    return spark.read.parquet(path)


def pages_scan(pages: DataFrame) -> DataFrame:
    """Pages that were captured well; the filter reaches the file scan."""
    if "status" not in pages.columns:
        return pages
    return pages.filter(F.col("status").isNull() | (F.col("status") < 400))


def site_settings(
    pages: DataFrame, overrides: DataFrame, config: ExtractConfig = DEFAULT
) -> DataFrame:
    """Adds ``host`` and the settings in force: a row of ``overrides`` per host, else ``config``.

    ``overrides`` has ``host`` and any of ``min_text_len``, ``scene_break_style``,
    ``br_threshold``; nulls in it mean the default.
    """
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    defaults = {
        "min_text_len": F.lit(config.min_text_len),
        "scene_break_style": F.lit(config.scene_break_style),
        "br_threshold": F.lit(config.br_threshold),
    }
    side = small_side(
        overrides.select(
            F.col("host").alias("_host"),
            *[F.col(name).alias(f"_{name}") for name in defaults if name in overrides.columns],
        )
    )
    hosted = pages.withColumn("host", host)
    joined = hosted.join(side, F.col("host") == F.col("_host"), "left")
    settings = [
        (F.coalesce(f"_{name}", value) if name in overrides.columns else value).alias(name)
        for name, value in defaults.items()
    ]
    return joined.select(*pages.columns, "host", *settings)
