"""Voice lookups and speech requests for ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.operators import chunks as chunk_ops
from inkloom.operators import voices as ops
from inkloom.plans.pipelines import requests_from_documents
from inkloom.sources.catalog import ALIASES, VOICES, voice_catalog
from inkloom.suite import query, table
from inkloom.suite.texts import chunk_ctes, sql_trim

VOICES_SQL = "v(id, lang, gender, display) AS (VALUES " + ", ".join(map(str, VOICES)) + ")"
ALIASES_SQL = "a(alias, maps_to) AS (VALUES " + ", ".join(map(str, ALIASES)) + ")"
# Every document asks five times: by language, by region in odd spelling, by two ids and not at all.
ASKED = """array(lang, concat(' ', upper(lang), '-US '), upper('af_heart'), concat(lang, '_', source), '')"""
ASKED_SQL = """asked AS (SELECT doc_id, unnest(l) AS requested, unnest(range(1, 6))::INT AS ask FROM (
  SELECT doc_id, [lang, ' ' || upper(lang) || '-US ', 'AF_HEART', lang || '_' || source, ''] AS l FROM documents))"""


def _asked(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.expr(ASKED)).alias("_at", "requested"))
    return rows.select("doc_id", (F.col("_at") + 1).alias("ask"), "requested")


@query(
    "resolve_voice",
    f"""WITH {VOICES_SQL}, {ALIASES_SQL}, {ASKED_SQL},
    named AS (SELECT r.*, coalesce(a.maps_to, r.requested) AS vid FROM asked r
              LEFT JOIN a ON a.alias = lower({sql_trim('r.requested')}))
    SELECT doc_id, ask, requested,
      coalesce(v.id, CASE WHEN contains(vid, '_') THEN vid END, 'af_heart') AS voice,
      coalesce(v.lang, CASE WHEN contains(vid, '_') THEN substring(vid, 1, 1) END, 'a') AS lang_code
    FROM named LEFT JOIN v ON lower(v.id) = lower(vid)""",
)
def resolve_voice(spark, sf_dir) -> DataFrame:
    return ops.resolve_voice(_asked(spark, sf_dir), *voice_catalog(spark), "requested")


@query(
    "voice_lang",
    f"""WITH {ALIASES_SQL}, {ASKED_SQL},
    named AS (SELECT r.*, coalesce(a.maps_to, w) AS voice FROM
      (SELECT *, {sql_trim("coalesce(nullif(requested, ''), 'af_heart')")} AS w FROM asked) r
      LEFT JOIN a ON a.alias = lower(w))
    SELECT doc_id, ask, requested, voice,
      CASE WHEN contains(voice, '_') THEN substring(lower({sql_trim('voice')}), 1, 1)
           ELSE coalesce(substring(a.maps_to, 1, 1), 'a') END AS lang_code
    FROM named LEFT JOIN a ON a.alias = lower({sql_trim('voice')})""",
)
def voice_lang(spark, sf_dir) -> DataFrame:
    return ops.voice_lang(_asked(spark, sf_dir), voice_catalog(spark)[1], "requested")


NAMES_SQL = """names AS (SELECT 'voice' AS kind, id AS name, id AS voice, lang, gender, display FROM v
  UNION ALL SELECT 'alias', alias, maps_to, lang, gender, display FROM a LEFT JOIN v ON v.id = a.maps_to)"""


@query(
    "voice_names",
    f"""WITH {VOICES_SQL}, {ALIASES_SQL}, {NAMES_SQL}, {ASKED_SQL}
    SELECT n.*, count(r.doc_id) AS requests FROM names n
    LEFT JOIN asked r ON lower({sql_trim('r.requested')}) = n.name GROUP BY ALL""",
)
def voice_names(spark, sf_dir) -> DataFrame:
    """The listing of names, each with how many requests of the documents use it."""
    names = ops.voice_names(*voice_catalog(spark))
    asked = (
        _asked(spark, sf_dir)
        .groupBy(F.lower(F.trim("requested")).alias("name"))
        .agg(F.count(F.lit(1)).alias("_requests"))
    )
    counted = names.join(asked, "name", "left")
    return counted.select(*names.columns, F.coalesce("_requests", F.lit(0)).alias("requests"))


@query(
    "voice_catalog",
    f"""WITH {VOICES_SQL}, {ALIASES_SQL} SELECT v.id, v.lang, v.gender, v.display, count(d.doc_id) AS documents
    FROM v LEFT JOIN a ON a.maps_to = v.id LEFT JOIN documents d ON d.lang = a.alias GROUP BY ALL""",
)
def catalog(spark, sf_dir) -> DataFrame:
    """Voices of the catalogue with the documents whose language is an alias of theirs."""
    voices, aliases = voice_catalog(spark)
    per_lang = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("_n"))
    used = (
        aliases.join(per_lang.withColumnRenamed("lang", "alias"), "alias")
        .groupBy(F.col("maps_to").alias("id"))
        .agg(F.sum("_n").alias("_n"))
    )
    return voices.join(used, "id", "left").select(
        "id", "lang", "gender", "display", F.coalesce("_n", F.lit(0)).alias("documents")
    )


@query(
    "synth_requests",
    f"""WITH RECURSIVE {chunk_ctes(1800)}
    SELECT c.doc_id, part_no, c.text, CASE WHEN lang = 'en' THEN 'en-us' ELSE 'af_heart' END AS voice,
      CASE WHEN lang = 'de' THEN 22050 ELSE 24000 END::INT AS sample_rate_hz,
      CASE lower(source) WHEN 'src1' THEN 'mp3' WHEN 'src2' THEN 'pcm_s16le' ELSE 'wav' END AS audio_format,
      CASE WHEN lang = 'fr' THEN 1.5 ELSE 1.0 END::FLOAT AS speed
    FROM chunks c JOIN documents d ON d.doc_id = c.doc_id""",
)
def synth_requests(spark, sf_dir) -> DataFrame:
    """Requests with some settings given and the rest left to their defaults."""
    documents = table(spark, sf_dir, "documents")
    parts = chunk_ops.chunks(documents, keep=("lang", "source")).drop("n_chars")
    wanted = F.when(F.col("source") == "src1", F.lit("MP3")).when(
        F.col("source") == "src2", F.lit("pcm_s16le")
    ).otherwise(F.col("source"))
    return ops.synth_requests(
        parts,
        voice=F.when(F.col("lang") == "en", F.lit("en-us")).otherwise(F.lit(" ")),
        rate=F.when(F.col("lang") == "de", F.lit(22050)).otherwise(F.lit(0)),
        speed=F.when(F.col("lang") == "fr", F.lit(1.5)).otherwise(F.lit(0.0)),
        wanted_format=wanted,
    ).drop("lang", "source")


@query(
    "document_requests",
    f"""WITH RECURSIVE {chunk_ctes(1800)}
    SELECT doc_id, part_no, text, 'af_heart' AS voice, 'a' AS lang_code, 24000::INT AS sample_rate_hz,
      'wav' AS audio_format, 1.0::FLOAT AS speed FROM chunks""",
)
def document_requests(spark, sf_dir) -> DataFrame:
    """Documents to requests in one plan: voice per document, chunks, defaults."""
    documents = table(spark, sf_dir, "documents")
    return requests_from_documents(documents, *voice_catalog(spark))
