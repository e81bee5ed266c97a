"""Checks, tallies, sample vectors and pacing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.functions.strings import slugify
from inkloom.operators import arrays, audits, pacing
from inkloom.suite import query, table
from inkloom.suite.texts import sql_slug

STATUS = "CASE WHEN quality = 1 AND toxic = 0 THEN 'ok' ELSE 'failed' END"


@query(
    "status_tally",
    f"""SELECT quality, count(*) FILTER (s = 'ok') AS total_ok, count(*) FILTER (s <> 'ok') AS total_failed
    FROM (SELECT quality, {STATUS} AS s FROM labels) GROUP BY quality""",
)
def status_tally(spark, sf_dir) -> DataFrame:
    results = table(spark, sf_dir, "labels").select("quality", F.expr(STATUS).alias("status"))
    return audits.status_tally(results, ("quality",))


PART_PATH = """concat(source, '/part-', cast(doc_id as string), CASE WHEN source IN ('src1', 'src2') THEN '.WAV'
  WHEN lang = 'en' THEN '.wav' WHEN lang = 'de' THEN '.Mp3' ELSE '' END)"""


@query(
    "ext_set",
    f"""WITH e AS (SELECT DISTINCT source AS base,
        lower(regexp_extract({PART_PATH.replace('as string', 'as varchar')}, '(\\.[^./]*)$', 1)) AS ext FROM documents)
    SELECT base, count(*) AS extensions, min(ext) AS first_ext, string_agg(ext, ',' ORDER BY ext) AS exts, count(*) = 1 AND min(ext) = '.wav' AS all_wav
    FROM e GROUP BY base""",
)
def ext_set(spark, sf_dir) -> DataFrame:
    parts = table(spark, sf_dir, "documents").select(F.col("source").alias("base"), F.expr(PART_PATH).alias("path"))
    return audits.ext_set(parts).withColumn("exts", F.array_join("exts", ","))


RATE = "CASE WHEN n_chars > 3000 AND source <> 'src3' THEN 22050 ELSE 24000 END"
CHANNELS = "CASE WHEN lang = 'de' AND source <> 'src3' THEN 2 ELSE 1 END"


@query(
    "format_uniform",
    f"""WITH p AS (SELECT source AS base, doc_id AS part_no, {RATE} AS r, {CHANNELS} AS c FROM documents),
    f AS (SELECT *, first_value(r) OVER w AS r0, first_value(c) OVER w AS c0 FROM p
          WINDOW w AS (PARTITION BY base ORDER BY part_no))
    SELECT base, bool_and(r = r0 AND c = c0) AS uniform, min(part_no) FILTER (r <> r0 OR c <> c0) AS first_mismatch
    FROM f GROUP BY base""",
)
def format_uniform(spark, sf_dir) -> DataFrame:
    parts = table(spark, sf_dir, "documents").select(
        F.col("source").alias("base"), F.col("doc_id").alias("part_no"),
        F.expr(RATE).alias("sample_rate"), F.expr(CHANNELS).alias("channels"),
    )
    return audits.format_uniform(parts)


@query(
    "concat_arrays",
    """SELECT label, s + o AS position, sample FROM (
      SELECT label, s, unnest(embedding) AS sample, unnest(range(0, len(embedding))) AS o FROM (
        SELECT label, embedding, coalesce(sum(len(embedding)) OVER (PARTITION BY label ORDER BY vec_id
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM embeddings))""",
)
def concat_arrays(spark, sf_dir) -> DataFrame:
    return arrays.joined_samples(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding")


TEXT_AND_LANG = "concat(text, ' ', lang)"


@query(
    "slug_collisions",
    f"""SELECT slug, count(*) AS inputs FROM (SELECT {sql_slug(TEXT_AND_LANG)} AS slug FROM documents)
    GROUP BY slug HAVING count(*) > 1""",
)
def slug_collisions(spark, sf_dir) -> DataFrame:
    named = table(spark, sf_dir, "documents").select(slugify(F.expr(TEXT_AND_LANG)).alias("slug"))
    return audits.slug_collisions(named)


DELAY_US = 2 * 3600 * 1_000_000


@query(
    "fetch_pacing",
    f"""WITH k AS (SELECT event_id, user_id, epoch_us(ts) AS arrive_us,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events)
    SELECT event_id, user_id, arrive_us, (max(arrive_us - k * {DELAY_US}) OVER (PARTITION BY user_id ORDER BY k)
      + k * {DELAY_US})::BIGINT AS start_us FROM k""",
)
def fetch_pacing(spark, sf_dir) -> DataFrame:
    """Users stand in for hosts, a request every two hours each."""
    arrivals = table(spark, sf_dir, "events").select(
        "event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("arrive_us")
    )
    return pacing.fetch_pacing(
        arrivals, host="user_id", arrive_us="arrive_us", tie="event_id", delay_us=DELAY_US
    )
