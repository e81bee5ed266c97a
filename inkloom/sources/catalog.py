"""The voice catalogue: a JSON file, or the built-in list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CATALOG_SCHEMA = (
    "voices array<struct<id:string,lang:string,gender:string,display:string>>,"
    "aliases map<string,string>"
)
# The built-in voices and their aliases.
VOICES = (
    ("af_heart", "a", "female", "Heart (American Female)"),
    ("af_bella", "a", "female", "Bella (American Female)"),
    ("am_michael", "a", "male", "Michael (American Male)"),
    ("bf_emma", "b", "female", "Emma (British Female)"),
    ("bm_george", "b", "male", "George (British Male)"),
)
ALIASES = (
    ("en", "af_heart"),
    ("en-us", "af_heart"),
    ("american", "af_heart"),
    ("en-gb", "bf_emma"),
    ("british", "bf_emma"),
)


def _inline_table(spark: SparkSession, rows: tuple, columns: str) -> DataFrame:
    values = ", ".join("('" + "', '".join(row) + "')" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({columns})")


def voice_catalog(spark: SparkSession, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``voices (id, lang, gender, display)`` and ``aliases (alias, maps_to)``."""
    if path is None:
        # Inline tables: the optimizer knows their size.
        return (
            _inline_table(spark, VOICES, "id, lang, gender, display"),
            _inline_table(spark, ALIASES, "alias, maps_to"),
        )
    catalog = spark.read.schema(CATALOG_SCHEMA).option("multiLine", True).json(path)
    aliases = catalog.select(F.explode("aliases").alias("alias", "maps_to"))
    return catalog.select(F.inline("voices")), aliases
