"""The operators as queries over the given tables, with the SQL each must equal where it can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.llm import (
    byte_pairs,
    decontaminate,
    divergence,
    hard_negatives,
    language,
    line_dedup,
    mixing,
    multiset_hash,
    secrets,
    simhash,
    style_tree,
    suffix_dedup,
    toxicity,
)
from inkloom.llm.common import fold, pick

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query("op1_style_tree")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return style_tree.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@query("op2_suffix_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.repeats(documents(spark, sf_dir), length=200)
    left = suffix_dedup.what_is_left("text", "spans")
    return found.select("doc_id", left.alias("left")).select("doc_id", "left.*")


@query(
    "op3_source_mix",
    r"""
    WITH sized AS (
      SELECT doc_id, source,
             len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
             md5(coalesce(doc_id::VARCHAR, '')) AS mix_key
      FROM documents
    ), words AS (
      SELECT source, sum(size)::BIGINT AS source_size,
             row_number() OVER (ORDER BY source NULLS LAST) AS s
      FROM sized GROUP BY source
    ), weighed AS (
      SELECT *, [3.0, 1.0, 2.0][(s - 1) % 3 + 1]::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap
      FROM words
    ), levels AS (
      SELECT *, (SELECT sum(source_size) FROM words) * 1.5::DOUBLE - coalesce(sum(cap) OVER before, 0) AS rest,
             sum(w) OVER onward AS rest_w, row_number() OVER (ORDER BY cap / w, s) AS k
      FROM weighed
      WINDOW before AS (ORDER BY cap / w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
             onward AS (ORDER BY cap / w, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    ), first AS (
      SELECT k, rest, rest_w FROM levels WHERE rest * w <= cap * rest_w ORDER BY k LIMIT 1
    ), sources AS (
      SELECT l.s, l.source, l.source_size,
             CASE WHEN l.k < coalesce(f.k, l.k + 1) THEN l.cap ELSE l.w * f.rest / f.rest_w END AS target,
             greatest(1, least(1024, l.source_size // 256)) AS block_words
      FROM levels l LEFT JOIN first f ON true
    ), blocked AS (
      SELECT *, (source_size + block_words - 1) // block_words AS blocks,
             sum(target / block_words) OVER (ORDER BY s) AS upto
      FROM sources
    ), ranges AS (
      SELECT s, blocks, coalesce(lag(upto) OVER (ORDER BY s), 0) AS low, upto AS high,
             max(upto) OVER () AS whole
      FROM blocked WHERE source_size > 0
    ), slots AS (
      SELECT slot, ((slot % 1073741824) * 663608941 % 1073741824) / 1073741824.0::DOUBLE AS point
      FROM range((SELECT floor(coalesce(max(whole) + 0.5, 0)) FROM ranges)::BIGINT) t(slot)
    ), dealt AS (
      SELECT s, blocks, row_number() OVER (PARTITION BY s ORDER BY slot) - 1 AS rank
      FROM slots JOIN ranges ON point >= low / whole AND (point < high / whole OR high = whole)
    ), times AS (
      SELECT s, rank % blocks AS block, count(*) AS passes
      FROM dealt WHERE rank // blocks < 2 GROUP BY 1, 2
    ), placed AS (
      SELECT d.doc_id, d.size, b.s, b.source_size, b.target, b.block_words, d.mix_key,
             coalesce(sum(d.size) OVER (PARTITION BY b.s ORDER BY d.mix_key, d.doc_id, d.size
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
      FROM sized d JOIN blocked b ON d.source IS NOT DISTINCT FROM b.source
    ), pieces AS (
      SELECT s, start, size, block_words,
             unnest(range(start // block_words, (start + size - 1) // block_words + 1)) AS block
      FROM placed WHERE size > 0
    ), taken AS (
      SELECT s, start, sum(passes * (least(start + size, (block + 1) * block_words)
                                     - greatest(start, block * block_words))) AS taken
      FROM pieces JOIN times USING (s, block) GROUP BY 1, 2
    )
    SELECT p.doc_id, p.size, p.source_size, p.target,
           CASE WHEN p.size > 0 THEN coalesce(t.taken, 0) ELSE 0 END::BIGINT AS taken
    FROM placed p LEFT JOIN taken t ON p.s = t.s AND p.start = t.start
    """,
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(documents(spark, sf_dir), weights=(3, 1, 2), share=1.5, most=2)


@query(
    "op4_line_dedup",
    r"""
    WITH lines AS (
      SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
             generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
      FROM documents
    ), keyed AS (
      SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
      FROM lines
    ), frequent AS (
      SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 40
      GROUP BY k HAVING count(DISTINCT doc_id) >= 5
    ), marked AS (
      SELECT keyed.*, frequent.last IS NOT NULL AND keyed.doc_id IS DISTINCT FROM frequent.last AS gone
      FROM keyed LEFT JOIN frequent USING (k)
    )
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
    FROM marked GROUP BY doc_id
    """,
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(documents(spark, sf_dir)).select(
        "doc_id", "n_lines", "n_dropped", "kept_sha256"
    )


@query("op5_language_id")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(documents(spark, sf_dir), doc_id="bigint", text="string", lang="string")
    predict = language.language_of(spark, language.fit_languages(docs, folds=3, held_out=1))
    return docs.select(
        "doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), predict("text").alias("found")
    ).select("doc_id", "held_out", "found.*")


@query("op6_decontaminate")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.contaminated(documents(spark, sf_dir), benchmark, share=0.05)


@query("op7_secrets")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(documents(spark, sf_dir))


@query("op8_simhash")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir), shingle=3, radius=3, seed=42)
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


@query(
    "op9_fingerprint",
    r"""
    WITH d AS (
      SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n,
             row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS m
      FROM documents
    ), e AS (
      SELECT a.doc_id, a.i, a.n, a.text, b.i AS j,
             substr(a.text, 1, a.n - a.n // 4) || substr(b.text, 1, a.n // 4) AS edited
      FROM d a JOIN d b ON b.i = (a.i + 1) % a.m
    ), t AS (
      SELECT i, 0 AS kind, text AS t FROM e UNION ALL SELECT i, 1, edited FROM e
    ), u AS (
      SELECT i, kind, md5(unnest(regexp_extract_all(t,
        '(?:[^\x20\x09-\x0D]*[^\x20\x09-\x0D.!?][\x20\x09\x0B-\x0D]+){0,5}[^\x20\x09-\x0D]+'))) AS h
      FROM t
    ), numbers AS (
      SELECT i, kind, ('0x' || substr(h, 1, 15))::BIGINT AS x, ('0x' || substr(h, 17, 15))::BIGINT AS y
      FROM u
    ), levelled AS (
      SELECT i, kind, (x >> 16 & 65535) % 128 AS lane, x & 65535 AS value,
             unnest(range(0, 1 + len(list_filter(range(1, 24), lambda k: (x >> 32) % (1::BIGINT << k) = 0)))) AS level
      FROM numbers
    ), lanes AS (
      SELECT i, kind, level * 128 + lane AS lane, sum(value)::BIGINT % 65536 AS total
      FROM levelled GROUP BY ALL
    ), whole AS (
      SELECT i, kind, count(x) AS n,
             coalesce(sum(x & 1073741823)::HUGEINT % 4294967296, 0)::BIGINT AS d0,
             coalesce(sum(x >> 30)::HUGEINT % 4294967296, 0)::BIGINT AS d1,
             coalesce(sum(y & 1073741823)::HUGEINT % 4294967296, 0)::BIGINT AS d2,
             coalesce(sum(y >> 30)::HUGEINT % 4294967296, 0)::BIGINT AS d3
      FROM t LEFT JOIN numbers USING (i, kind) GROUP BY ALL
    ), prints AS (
      SELECT w.i, w.kind, w.n,
             printf('%08x%08x%08x%08x%08x', w.n, d0, d1, d2, d3) AS head,
             coalesce(string_agg(printf('%07x', lane * 65536 + total), '' ORDER BY lane), '') AS tail
      FROM whole w LEFT JOIN lanes l ON w.i = l.i AND w.kind = l.kind GROUP BY ALL
    ), pairs AS (
      SELECT i, 0 AS pair, i AS other, 1 AS kind FROM e UNION ALL SELECT i, 1, j, 0 FROM e
    ), sides AS (
      SELECT p.i, p.pair, l.lane, l.total FROM pairs p JOIN lanes l ON l.i = p.i AND l.kind = 0
      UNION ALL
      SELECT p.i, p.pair, l.lane, l.total FROM pairs p JOIN lanes l ON l.i = p.other AND l.kind = p.kind
    ), differ AS (
      SELECT i, pair, lane // 128 AS level FROM sides
      GROUP BY i, pair, lane HAVING count(*) = 1 OR min(total) <> max(total)
    ), off AS (
      SELECT p.i, p.pair, k.level, count(f.level) AS off
      FROM pairs p, range(0, 24) k(level)
      LEFT JOIN differ f ON f.i = p.i AND f.pair = p.pair AND f.level = k.level GROUP BY ALL
    ), used AS (
      SELECT i, pair, min_by(off, level) AS off, min(level) AS level
      FROM off WHERE 5 * off <= 512 OR level = 23 GROUP BY i, pair
    ), near AS (
      SELECT p.i, p.pair,
             CASE WHEN a.n + b.n = 0 OR a.head || a.tail = b.head || b.tail THEN 1.0
             ELSE round(greatest(0.0, least(1.0, 1 - (-ln(1 - least(u.off, 127.5::DOUBLE) / 128.0::DOUBLE)
               * 128 * pow(2.0::DOUBLE, u.level)) / (a.n + b.n))), 6) END::DOUBLE AS near
      FROM pairs p JOIN used u ON u.i = p.i AND u.pair = p.pair
      JOIN prints a ON a.i = p.i AND a.kind = 0 JOIN prints b ON b.i = p.other AND b.kind = p.kind
    )
    SELECT e.doc_id, e.n AS n_chars, sha256(e.edited) AS edited_sha256,
           a.head || a.tail AS fingerprint, b.head || b.tail AS edited_fingerprint,
           x.near AS near_edited, y.near AS near_next
    FROM e JOIN prints a ON a.i = e.i AND a.kind = 0 JOIN prints b ON b.i = e.i AND b.kind = 1
    JOIN near x ON x.i = e.i AND x.pair = 0 JOIN near y ON y.i = e.i AND y.pair = 1
    """,
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset_hash.with_edits(documents(spark, sf_dir))


@query("op10_toxicity")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(documents(spark, sf_dir), doc_id="bigint", text="string")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    score = toxicity.toxicity_of(spark, toxicity.fit_toxicity(docs, labels, folds=5, held_out=0))
    return docs.select(
        "doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), score("text").alias("score")
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query("op12_byte_pairs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    tokenizer = byte_pairs.Tokenizer(spark, path, public_tokenizers.PATTERN)
    docs = pick(documents(spark, sf_dir), doc_id="bigint", text="string")
    coded = docs.select("doc_id", tokenizer.round_trip()("text").alias("made"))
    return coded.select("doc_id", "made.*").select(
        "doc_id",
        F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("back", 256).alias("decoded_sha256"),
    )


@query(
    "op13_divergence",
    r"""
    WITH d AS (
      SELECT row_number() OVER () AS doc, coalesce(text, '') AS text, coalesce(lang, '') AS lang,
             coalesce(source, '') AS source
      FROM documents
    ), t AS (
      SELECT doc, lang, source,
             translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
      FROM d
    ), kept AS (
      SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT doc) >= 3
    ), counts AS (
      SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL
    ), langs AS (
      SELECT lang, count(kept.term) AS v, coalesce(sum(kept.n), 0)::BIGINT AS n
      FROM (SELECT DISTINCT lang FROM d) LEFT JOIN kept USING (lang) GROUP BY lang
    ), groups AS (
      SELECT g.lang, g.source, langs.v, langs.n AS n_lang, coalesce(sum(counts.n), 0)::BIGINT AS n
      FROM (SELECT DISTINCT lang, source FROM d) g JOIN langs USING (lang)
      LEFT JOIN counts USING (lang, source) GROUP BY ALL
    ), shares AS (
      SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
             1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (g.n + g.v) AS p,
             1 + 1000000000::HUGEINT * (k.n + 1) // (g.n_lang + g.v) AS q
      FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)
    ), found AS (
      SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value
      FROM shares WHERE n > 0 AND p > q
      UNION ALL
      SELECT a.lang, a.source, 'pair', b.source,
             coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0)
      FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN shares x ON x.lang = a.lang AND x.source = a.source
      LEFT JOIN shares y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
      WHERE x.term IS NULL OR y.term IS NOT NULL
      GROUP BY a.lang, a.source, b.source
    )
    SELECT lang, source, part, item, value::BIGINT AS value,
           row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
    FROM found QUALIFY part = 'pair' OR rank <= 200
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(documents(spark, sf_dir), min_docs=3, top=200)


@query(
    "op11_hard_negatives",
    """
    WITH r AS (
      SELECT row_number() OVER () AS r, vec_id,
             CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
      FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scored AS (
      SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS b, b.vec_id, a.label = b.label AS same,
             list_inner_product(a.v, b.v)::BIGINT AS score
      FROM r a JOIN r b ON a.r <> b.r WHERE a.vec_id % 100 = 0
    ), positives AS (
      SELECT * FROM scored WHERE same
      QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) <= 5
    )
    SELECT p.anchor_id, p.vec_id AS positive_id,
           row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.vec_id)::INT AS rank,
           n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
    FROM positives p JOIN scored n ON n.a = p.a AND NOT n.same
      AND 80 * p.score <= 100 * n.score AND n.score <= p.score
    QUALIFY rank <= 5
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pick(
        spark.read.parquet(f"{sf_dir}/embeddings.parquet"),
        vec_id="bigint", embedding="array<double>", label="bigint",
    )
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(
        rows.withColumn("label", moved), F.col("vec_id") % 100 == 0,
        positives=5, negatives=5, percent=80, scale=256,
    )
