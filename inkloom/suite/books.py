"""Chapter store and books over conversation turns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.operators import books as ops
from inkloom.suite import query
from inkloom.suite.texts import sql_escape
from inkloom.suite.turns import HTML_SQL, TITLE_SQL, URL_SQL, turn_chapters

CHAPTERS_SQL = f"""ch AS (SELECT 'c' || conv_id AS book_id, turn * 3 AS seq, {URL_SQL} AS url, {TITLE_SQL} AS title,
  role AS code, {HTML_SQL} AS html,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS no FROM conversations)"""
STORE_SQL = f"""{CHAPTERS_SQL}, store AS (SELECT *, code AS slug FROM ch
  QUALIFY row_number() OVER (PARTITION BY book_id, code ORDER BY seq DESC) = 1)"""


@query("chapter_store", f"WITH {STORE_SQL} SELECT book_id, slug, seq, url, title, code, html FROM store")
def chapter_store(spark, sf_dir) -> DataFrame:
    return ops.chapter_store(turn_chapters(spark, sf_dir))


@query(
    "chapter_meta",
    f"""WITH {STORE_SQL} SELECT book_id, slug, 'chapters/' || slug || '/index.html' AS path,
      '{{"code":"' || code || '","html":"chapters/' || slug || '/index.html","title":"' || title || '","url":"'
        || url || '"}}' AS meta FROM store""",
)
def chapter_meta(spark, sf_dir) -> DataFrame:
    # The text itself is not needed here and stays out of the aggregate.
    return ops.chapter_meta(ops.chapter_store(turn_chapters(spark, sf_dir).drop("html")))


@query(
    "chapter_number",
    f"WITH {CHAPTERS_SQL} SELECT book_id, url, no AS chapter_no, format('{{:03d}}', no) AS chapter_label FROM ch",
)
def chapter_number(spark, sf_dir) -> DataFrame:
    chapters = turn_chapters(spark, sf_dir).select("book_id", "seq", "url")
    return ops.chapter_number(chapters).drop("seq")


PLAIN_SQL = "html"
for _old, _new in (
    ("</p>\n<p>", "\n\n\n"), ("<p>", ""), ("</p>", ""), ("&#39;", "''"), ("&#34;", '"'),
    ("&gt;", ">"), ("&lt;", "<"), ("&amp;", "&"),
):
    PLAIN_SQL = f"replace({PLAIN_SQL}, '{_old}', '{_new}')"


@query(
    "book_txt",
    f"""WITH {CHAPTERS_SQL} SELECT book_id, no AS chapter_no, CASE WHEN no > 1 THEN chr(10) ELSE '' END
      || title || chr(10) || CASE WHEN html = '' THEN '' ELSE chr(10) || {PLAIN_SQL} END || chr(10) AS text FROM ch""",
)
def book_txt(spark, sf_dir) -> DataFrame:
    return ops.book_txt(turn_chapters(spark, sf_dir))


FILE_SQL = "'ch_' || format('{:03d}', no) || '_' || code || '.xhtml'"


@query(
    "book_sections",
    f"""WITH {CHAPTERS_SQL}, s AS (SELECT *, {FILE_SQL} AS f FROM ch)
    SELECT book_id, no AS section_no, 1::BIGINT AS fragment_no, f AS file_name, title,
           '<h2>' || {sql_escape('title')} || '</h2>' || html AS body FROM s
    UNION ALL SELECT book_id, 0, no, 'toc.xhtml', 'Table of Contents',
           '<li><a href="' || f || '">' || {sql_escape('title')} || '</a></li>' FROM s
    UNION ALL SELECT DISTINCT book_id, 0, 0, 'toc.xhtml', 'Table of Contents', '<h1>Table of Contents</h1><ol>' FROM s
    UNION ALL SELECT book_id, 0, count(*) + 1, 'toc.xhtml', 'Table of Contents', '</ol>' FROM s GROUP BY book_id""",
)
def book_sections(spark, sf_dir) -> DataFrame:
    return ops.book_sections(turn_chapters(spark, sf_dir))
