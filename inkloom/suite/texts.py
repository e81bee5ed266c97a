"""Text functions, sentence splitting and chunking over ``documents``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.functions import markup, strings
from inkloom.functions.sentences import hard_wrap, sentence_split
from inkloom.functions.vectors import quantise_i16
from inkloom.operators import chunks as ops
from inkloom.operators.packing import chunks_of_parts, text_parts
from inkloom.session import shared_folder
from inkloom.sinks import write_text_files
from inkloom.sources.texts import text_inputs
from inkloom.suite import query, table

SPACE = strings.UNICODE_SPACE


def sql_trim(text: str) -> str:
    return f"trim({text}, '{SPACE}')"


def sql_slug(text: str) -> str:
    plain = f"strip_accents(lower({sql_trim(text)}))"
    return f"substring(trim(regexp_replace({plain}, '[^a-z0-9]+', '-', 'g'), '-'), 1, 64)"


def sql_escape(text: str) -> str:
    for char, entity in markup.ESCAPES:
        char = char.replace("'", "''")
        text = f"replace({text}, '{char}', '{entity}')"
    return text


def _per_document(name: str, column, sql: str, out: str):
    """A query of one computed column per document."""

    @query(name, f"SELECT doc_id, {sql} AS {out} FROM documents")
    def run(spark, sf_dir) -> DataFrame:
        return table(spark, sf_dir, "documents").select("doc_id", column(F.col("text")).alias(out))

    return run


_per_document("slugify", strings.slugify, sql_slug("text"), "slug")
_per_document(
    "safe_name",
    strings.safe_name,
    f"""translate(lower({sql_trim('text')}), '— /:|?*"<>', '---')""",
    "name",
)
_per_document("escape_html", markup.escape_html, sql_escape("text"), "escaped")
_per_document(
    "collapse_ws",
    strings.collapse_ws,
    r"regexp_replace(text, '[\t\n\f\r ]+', ' ', 'g')",
    "text",
)

UNICODE_SLUG_SQL = f"""
SELECT doc_id, substring(coalesce(nullif(trim(regexp_replace(regexp_replace(lower(
    {sql_trim("text")}), '[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}{SPACE}-]+', '-', 'g'),
    '[{SPACE}_]+', '-', 'g'), '-'), ''), 'audiofile'), 1, 64) AS slug
FROM documents"""


@query("slugify_unicode", UNICODE_SLUG_SQL)
def slugify_unicode(spark, sf_dir) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return documents.select("doc_id", strings.slugify_unicode(F.col("text")).alias("slug"))


CODE = r"\b(\d+\.\d+\s*[A-Z]?)\b"


def sql_code(title: str) -> str:
    found = f"regexp_replace(regexp_extract({title}, '{CODE}', 1), '[\\t\\n\\f\\r ]+', ' ', 'g')"
    return f"coalesce(nullif({sql_trim(found)}, ''), {title})"


_per_document("chapter_code", strings.chapter_code, sql_code("text"), "code")


@query(
    "chapter_slug",
    f"""SELECT doc_id, coalesce(nullif({sql_slug(sql_code("text"))}, ''),
        nullif({sql_slug("source")}, ''), 'chapter') AS slug FROM documents""",
)
def chapter_slug(spark, sf_dir) -> DataFrame:
    code = strings.chapter_code(F.col("text"))
    slug = strings.chapter_slug(code, F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", slug.alias("slug"))


# A comma list per document: its first words, language and tags in several spellings.
TAG_LIST = (
    "concat(' ', upper(lang), ' ,', source, ',epub, PDF ,', replace(text, ' ', ','), ',txt,epub')"
)
TAGS = ("epub", "pdf", "txt", "en", "fr", "de", "the", "la", "der")


@query(
    "clean_tag_list",
    f"""SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS tags
    FROM (SELECT doc_id, list_filter(list_transform(string_split({TAG_LIST}, ','),
              lambda x: lower({sql_trim('x')})), lambda x: x IN {TAGS}) AS l FROM documents)""",
)
def clean_tag_list(spark, sf_dir) -> DataFrame:
    tags = strings.clean_tag_list(F.expr(TAG_LIST), TAGS)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(tags, "|").alias("tags"))


# A path per document, with and without an extension, from its source and whole text.
PATH = "concat('in/', source, '/', text, CASE WHEN lang = 'en' THEN '.TXT' ELSE '' END)"


@query(
    "base_name",
    f"""SELECT doc_id, coalesce(nullif({sql_slug(
        "regexp_extract(" + PATH + r", '([^/]*?)(?:\.[^./]*)?$', 1)")}, ''), 'audiofile') AS base
    FROM documents""",
)
def base_name(spark, sf_dir) -> DataFrame:
    base = strings.base_name(F.expr(PATH))
    return table(spark, sf_dir, "documents").select("doc_id", base.alias("base"))


@query("sort_paths", f"SELECT doc_id, {PATH} AS path FROM documents ORDER BY path, doc_id")
def sort_paths(spark, sf_dir) -> DataFrame:
    """The listing order of inputs: a range-partitioned sort."""
    paths = table(spark, sf_dir, "documents").select("doc_id", F.expr(PATH).alias("path"))
    return paths.orderBy("path", "doc_id")


def _text_files(spark, sf_dir, content) -> str:
    """The documents as text files by source, some of them with names that Spark's readers skip."""
    folder = f"{shared_folder(spark).rstrip('/')}/texts-{uuid.uuid4().hex}"
    address = folder if ":/" in folder else f"file://{folder}"
    first = F.element_at(F.array(F.lit(""), F.lit("_"), F.lit(".")), (F.col("doc_id") % 3 + 1).cast("int"))
    last = F.when(F.col("doc_id") % 2 == 0, ".txt").otherwise(".TxT")
    name = F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), first, F.col("doc_id"), last)
    documents = table(spark, sf_dir, "documents")
    written = write_text_files(documents.select(name.alias("name"), content.alias("content")), address)
    written.write.format("noop").mode("overwrite").save()
    return address


FILE_NAME = """coalesce(source, 'none') || '/' || CASE doc_id % 3 WHEN 1 THEN '_' WHEN 2 THEN '.' ELSE '' END || doc_id
  || CASE doc_id % 2 WHEN 0 THEN '.txt' ELSE '.TxT' END"""


def _read_back(spark, folder: str) -> DataFrame:
    read = text_inputs(spark, folder, recursive=True)
    name = F.regexp_extract("path", "([^/]*/[^/]*)$", 1)
    return read.select(name.alias("name"), F.md5("text").alias("text_md5"), F.length("text").cast("bigint").alias("chars"))


@query(
    "text_inputs",
    f"SELECT {FILE_NAME} AS name, md5(coalesce(text, '')) AS text_md5, length(coalesce(text, ''))::BIGINT AS chars FROM documents",
)
def text_files(spark, sf_dir) -> DataFrame:
    """Every text file of a folder tree, hidden names among them."""
    return _read_back(spark, _text_files(spark, sf_dir, F.encode(F.coalesce("text", F.lit("")), "UTF-8")))


@query(
    "read_text_lossy",
    f"""SELECT {FILE_NAME} AS name, md5('a' || coalesce(text, '') || chr(65533) || 'z') AS text_md5,
      length(coalesce(text, ''))::BIGINT + 3 AS chars
    FROM documents""",
)
def lossy_text_files(spark, sf_dir) -> DataFrame:
    """Bytes that are not UTF-8 are dropped; a replacement character of the text stays."""
    broken = F.concat(
        F.unhex(F.lit("FF61C3")), F.encode(F.coalesce("text", F.lit("")), "UTF-8"), F.unhex(F.lit("EFBFBDE282")), F.unhex(F.lit("7AF0"))
    )
    return _read_back(spark, _text_files(spark, sf_dir, broken))


SEGMENT = r"""(?s).+?(?:[.!?]+["'')\]]*[\t\n\f\r ]+|\n{2,}|\z)"""
NORMAL = r"regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '[ \t\f\x0B]+', ' ', 'g')"


def sentence_ctes() -> str:
    return f"""
split AS (SELECT doc_id, regexp_extract_all({NORMAL}, '{SEGMENT}') AS l FROM documents),
sents AS (SELECT doc_id, unnest(l) AS sen, unnest(range(1, len(l) + 1)) AS k FROM split)"""


@query(
    "sentence_split",
    f"WITH {sentence_ctes()} SELECT doc_id, k::INT AS sent_no, sen AS text FROM sents",
)
def sentences(spark, sf_dir) -> DataFrame:
    return ops.sentences(table(spark, sf_dir, "documents"))


def wrap_ctes(limit: int) -> str:
    """One cut of every over-long sentence per step."""
    window = f"substring(rest, 1, {limit + 1})"
    cut = (
        f"CASE WHEN regexp_matches({window}, '(?s)^.+[ \\n\\t]') THEN "
        f"length(regexp_extract({window}, '(?s)^(.+)[ \\n\\t]', 1)) ELSE {limit} END"
    )
    return f"""{sentence_ctes()},
wrap AS (
  SELECT doc_id, k, 0 AS j, NULL::VARCHAR AS piece, sen AS rest FROM sents WHERE length(sen) > {limit}
  UNION ALL
  SELECT doc_id, k, j + 1, {sql_trim("substring(rest, 1, c)")} || chr(10),
         {sql_trim("substring(rest, c + 1)")}
  FROM (SELECT *, {cut} AS c FROM wrap WHERE length(rest) > {limit})
),
pieces AS (
  SELECT doc_id, k, 0 AS j, sen AS piece, false AS fresh FROM sents WHERE length(sen) <= {limit}
  UNION ALL SELECT doc_id, k, j, piece, j = 1 FROM wrap WHERE j > 0
  UNION ALL SELECT doc_id, k, j + 1, rest, false FROM wrap WHERE length(rest) <= {limit} AND rest <> ''
)"""


def strict_ctes(limit: int) -> str:
    """As above for the strict rule: spaces only, and a cut piece closes its chunk."""
    window = f"substring(rest, 1, {limit})"
    cut = (
        f"CASE WHEN regexp_matches({window}, '(?s)^.+ ') THEN "
        f"length(regexp_extract({window}, '(?s)^(.+) ', 1)) ELSE {limit} END"
    )
    return f"""{sentence_ctes()},
wrap AS (
  SELECT doc_id, k, 0 AS j, NULL::VARCHAR AS piece, sen AS rest FROM sents WHERE length(sen) > {limit}
  UNION ALL
  SELECT doc_id, k, j + 1, substring(rest, 1, c) || chr(10), ltrim(substring(rest, c + 1), '{SPACE}')
  FROM (SELECT *, {cut} AS c FROM wrap WHERE length(rest) > {limit})
),
pieces AS (
  SELECT doc_id, k, 0 AS j, sen AS piece, false AS fresh FROM sents WHERE length(sen) <= {limit}
  UNION ALL SELECT doc_id, k, j, piece, true FROM wrap WHERE j > 0
  UNION ALL SELECT doc_id, k, j + 1, rest, true FROM wrap WHERE length(rest) <= {limit}
)"""


def chunk_ctes(limit: int, strict: bool = False) -> str:
    """Greedy packing, one piece of every document per step."""
    return f"""{strict_ctes(limit) if strict else wrap_ctes(limit)},
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k, j) AS n FROM pieces),
pack AS (
  SELECT doc_id, n, piece AS cur, NULL::VARCHAR AS done FROM numbered WHERE n = 1
  UNION ALL
  SELECT doc_id, n, CASE WHEN f THEN piece ELSE cur || piece END, CASE WHEN f THEN cur END
  FROM (SELECT x.doc_id, x.n, p.cur, x.piece,
               (length(p.cur) + length(x.piece) > {limit} OR x.fresh) AND p.cur <> '' AS f
        FROM pack p JOIN numbered x ON x.doc_id = p.doc_id AND x.n = p.n + 1)
),
closed AS (
  SELECT doc_id, n, {sql_trim("done")} AS text FROM pack WHERE done IS NOT NULL
  UNION ALL
  SELECT doc_id, n + 1, {sql_trim("cur")} FROM pack
  WHERE n = (SELECT max(n) FROM numbered m WHERE m.doc_id = pack.doc_id)
),
chunks AS (
  SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY n))::INT AS part_no, text,
         length(text)::INT AS n_chars
  FROM closed WHERE text <> ''
)"""


def _chunk_query(name: str, limit: int, strict: bool = False, floor: int = 0):
    # No limit means the usual one.
    ctes = chunk_ctes(max(floor, limit or 1800), strict)

    @query(name, f"WITH RECURSIVE {ctes} SELECT doc_id, part_no, text, n_chars FROM chunks")
    def run(spark, sf_dir) -> DataFrame:
        return ops.chunks(table(spark, sf_dir, "documents"), limit, strict=strict, floor=floor)


_chunk_query("chunk_text", 1800)
_chunk_query("chunk_text_no_limit", 0)
_chunk_query("chunk_text_floor", 50, floor=400)
_chunk_query("chunk_text_short", 400)
_chunk_query("chunk_text_strict", 1800, strict=True)
_chunk_query("chunk_text_strict_floor", 400, strict=True)


def _parts_query(name: str, limit: int, chars: int, strict: bool = False):
    ctes = chunk_ctes(limit, strict)

    @query(name, f"WITH RECURSIVE {ctes} SELECT doc_id, part_no, text, n_chars FROM chunks")
    def run(spark, sf_dir) -> DataFrame:
        """The chunks of documents that are stored in rows of ``chars`` characters."""
        parts = text_parts(table(spark, sf_dir, "documents"), chars)
        return chunks_of_parts(parts, limit, strict=strict)


_parts_query("chunk_parts", 1800, 5000)
_parts_query("chunk_parts_strict", 400, 700, strict=True)


@query(
    "hard_wrap",
    f"""WITH RECURSIVE {wrap_ctes(40)}
    SELECT doc_id, k::INT AS sent_no, (row_number() OVER (PARTITION BY doc_id, k ORDER BY j))::INT
      AS piece_no, piece FROM pieces""",
)
def hard_wrapped(spark, sf_dir) -> DataFrame:
    """Every sentence of every document wrapped at 40 characters."""
    rows = (
        table(spark, sf_dir, "documents")
        .select("doc_id", F.posexplode(sentence_split(F.col("text"))).alias("_k", "sen"))
        .select("doc_id", "_k", F.posexplode(hard_wrap(F.col("sen"), 40)).alias("_j", "piece"))
    )
    return rows.select(
        "doc_id", (F.col("_k") + 1).alias("sent_no"), (F.col("_j") + 1).alias("piece_no"), "piece"
    )


BASE = "concat('doc-', cast(doc_id as string))"


@query(
    "chunk_manifest",
    f"""WITH RECURSIVE {chunk_ctes(1800)}
    SELECT doc_id, part_no, n_chars, file_name, 'file ''' || file_name || '''' AS list_line
    FROM (SELECT *, format('doc-{{}}-part-{{:04d}}.wav', doc_id, part_no) AS file_name FROM chunks)""",
)
def chunk_manifest(spark, sf_dir) -> DataFrame:
    parts = ops.chunks(table(spark, sf_dir, "documents"))
    return ops.chunk_manifest(parts, F.expr(BASE))


PLAN_SQL = f"""WITH RECURSIVE {chunk_ctes(1800, strict=True)},
plan AS (SELECT d.doc_id, d.lang, d.source, count(c.part_no)::INT AS chunks FROM documents d
         LEFT JOIN chunks c ON c.doc_id = d.doc_id GROUP BY ALL)"""


@query("chunk_plan", f"{PLAN_SQL} SELECT doc_id, chunks FROM plan")
def chunk_plan(spark, sf_dir) -> DataFrame:
    return ops.chunk_plan(table(spark, sf_dir, "documents"))


@query(
    "document_report",
    f"""{PLAN_SQL} SELECT doc_id, base, chunks, status,
      '{{"doc_id":' || doc_id || ',"base":"' || base || '","chunks":' || chunks
        || ',"status":"' || status || '"}}' AS entry
    FROM (SELECT doc_id, chunks, {sql_slug("source || ' ' || lang")} AS base,
                 CASE WHEN chunks > 0 THEN 'ok' ELSE 'failed' END AS status FROM plan)""",
)
def document_report(spark, sf_dir) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    base = strings.base_name(F.concat_ws(" ", "source", "lang"))
    blank = strings.trim_ws(F.col("text")) == ""
    status = F.when(blank, F.lit("failed")).otherwise(F.lit("ok"))
    return ops.document_report(documents, base, status)


RUN = {"voice": "af_heart", "rate": 24000, "speed": 1.0}


@query(
    "run_header",
    f"""{PLAN_SQL} SELECT md5('af_heart|24000|1.0') AS run_id, 'af_heart' AS voice, 24000 AS rate,
      1.0::DOUBLE AS speed, count(*) AS inputs, sum(chunks)::BIGINT AS chunks,
      count(*) FILTER (chunks = 0) AS not_ok FROM plan""",
)
def run_header(spark, sf_dir) -> DataFrame:
    """The head of a run's report; its rows carry the same run_id."""
    return ops.run_header(document_report(spark, sf_dir), **RUN)


@query(
    "quantise_i16",
    """SELECT vec_id, unnest(range(1, len(embedding) + 1))::INT AS at,
      trunc(greatest(-1::FLOAT, least(1::FLOAT, unnest(embedding))) * 32767::FLOAT)::SMALLINT AS sample
    FROM embeddings""",
)
def quantised(spark, sf_dir) -> DataFrame:
    samples = quantise_i16(F.col("embedding"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(samples).alias("_at", "sample"))
    return rows.select("vec_id", (F.col("_at") + 1).alias("at"), "sample")
