"""Voice catalogue lookups and speech requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkloom.functions.strings import none_if_blank, trim_ws
from inkloom.operators.keyed import small_side

FALLBACK_VOICE, FALLBACK_LANG = "af_heart", "a"
SAMPLE_RATE = 24000
# Audio formats a request may ask for.
AUDIO_FORMATS = ("wav", "mp3", "pcm_s16le")


def voice_names(voices: DataFrame, aliases: DataFrame) -> DataFrame:
    """Voices and aliases in one listing: ``kind, name, voice, lang, gender, display``."""
    own = voices.select(
        F.lit("voice").alias("kind"), F.col("id").alias("name"), F.col("id").alias("voice"),
        "lang", "gender", "display",
    )
    named = aliases.join(small_side(voices), F.col("maps_to") == F.col("id"), "left").select(
        F.lit("alias").alias("kind"), F.col("alias").alias("name"),
        F.col("maps_to").alias("voice"), "lang", "gender", "display",
    )
    return own.unionByName(named)


def _alias_side(aliases: DataFrame) -> DataFrame:
    return small_side(aliases.select(F.col("alias").alias("_alias"), F.col("maps_to").alias("_maps")))


def resolve_voice(requests: DataFrame, voices: DataFrame, aliases: DataFrame, requested: str) -> DataFrame:
    """Adds ``voice`` and ``lang``: alias, then catalogue, then the id's prefix, then fallback."""
    # Two catalogue ids that differ only in case: the smaller one counts.
    by_id = voices.groupBy(F.lower("id").alias("_key")).agg(
        F.min(F.struct("id", F.coalesce("lang", F.lit(FALLBACK_LANG)).alias("lang"))).alias("_hit")
    )
    wanted = F.lower(trim_ws(F.coalesce(requested, F.lit(""))))
    named = requests.join(_alias_side(aliases), wanted == F.col("_alias"), "left").withColumn(
        "_vid", F.coalesce("_maps", requested)
    )
    found = named.join(small_side(by_id), F.lower("_vid") == F.col("_key"), "left")
    guessed = F.contains(F.coalesce("_vid", F.lit("")), F.lit("_"))
    return found.select(
        *requests.columns,
        F.coalesce("_hit.id", F.when(guessed, F.col("_vid")), F.lit(FALLBACK_VOICE)).alias("voice"),
        F.coalesce(
            "_hit.lang", F.when(guessed, F.substring("_vid", 1, 1)), F.lit(FALLBACK_LANG)
        ).alias("lang_code"),
    )


def voice_lang(
    requests: DataFrame, aliases: DataFrame, requested: str, default_lang: str = FALLBACK_LANG
) -> DataFrame:
    """Adds ``voice`` (alias replaced) and ``lang_code`` by the serving rule."""
    asked = trim_ws(F.coalesce(none_if_blank(F.col(requested)), F.lit(FALLBACK_VOICE)))
    named = requests.join(_alias_side(aliases), F.lower(asked) == F.col("_alias"), "left").withColumn(
        "voice", F.coalesce("_maps", asked)
    )
    plain = F.lower(trim_ws(F.col("voice")))
    again = named.select(*requests.columns, "voice").join(
        _alias_side(aliases), plain == F.col("_alias"), "left"
    )
    lang = (
        F.when(F.contains(plain, F.lit("_")), F.substring(plain, 1, 1))
        .when(F.col("_maps").isNotNull(), F.substring("_maps", 1, 1))
        .otherwise(F.lit(default_lang))
    )
    return again.select(*requests.columns, "voice", lang.alias("lang_code"))


def audio_format(wanted: Column) -> Column:
    """Known format in lower case; anything else, also nothing, is ``wav``."""
    name = F.lower(wanted)
    return F.when(name.isin(*AUDIO_FORMATS), name).otherwise(F.lit("wav"))


def synth_requests(
    chunks: DataFrame,
    *,
    voice: Column,
    rate: Column | None = None,
    speed: Column | None = None,
    wanted_format: Column | None = None,
) -> DataFrame:
    """One request per non-blank chunk, with the defaults filled in."""
    rate = F.lit(0) if rate is None else rate
    speed = F.lit(0.0) if speed is None else speed
    wanted = F.lit("") if wanted_format is None else wanted_format
    return chunks.filter(trim_ws(F.col("text")) != "").select(
        *[name for name in chunks.columns if name not in ("text", "voice")],
        "text",
        F.coalesce(none_if_blank(trim_ws(voice)), F.lit(FALLBACK_VOICE)).alias("voice"),
        F.coalesce(F.nullif(rate, F.lit(0)), F.lit(SAMPLE_RATE)).cast("int").alias("sample_rate_hz"),
        audio_format(wanted).alias("audio_format"),
        F.coalesce(F.nullif(speed, F.lit(0.0)), F.lit(1.0)).cast("float").alias("speed"),
    )
