"""A linked page per conversation turn: the pages table itself has no chains.

Every page links to the following turn, so the link of the last one leads nowhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.functions.markup import escape_html
from inkloom.functions.strings import trim_ws
from inkloom.suite import table
from inkloom.suite.texts import sql_escape, sql_trim

SITE = "https://books.example/c"
URL_SQL = f"'{SITE}' || conv_id || '/' || turn"
TITLE_SQL = "'Chapter ' || conv_id || '.' || turn || ' ' || role"
LINES_SQL = f"""list_filter(list_transform(string_split(text, chr(10)), lambda l: {sql_trim('l')}), lambda l: l <> '')"""
HTML_SQL = (
    f"array_to_string(list_transform({LINES_SQL}, lambda l: '<p>' || {sql_escape('l')} || '</p>'), chr(10))"
)
# What extraction makes of the turn pages: short ones are rejected.
TURNS_SQL = f"""turns AS (SELECT conv_id, turn, role, {URL_SQL} AS url, '{SITE}' || conv_id || '/' || (turn + 1) AS next_url,
  {TITLE_SQL} AS title, conv_id || '.' || turn AS code, {HTML_SQL} AS html FROM conversations),
good AS (SELECT * FROM turns WHERE octet_length(encode({sql_trim("regexp_replace(html, '<[^>]+>', '', 'g')")})) >= 50)"""


def _url():
    return F.concat(F.lit(SITE), F.col("conv_id"), F.lit("/"), F.col("turn"))


def _title():
    return F.concat(F.lit("Chapter "), F.col("conv_id"), F.lit("."), F.col("turn"), F.lit(" "), F.col("role"))


def turn_pages(spark, sf_dir) -> DataFrame:
    escaped = F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    html = F.concat(
        F.lit('<html><head><link rel="next" href="'), F.col("turn") + 1,
        F.lit('"></head><body><article><h1>'), _title(), F.lit("</h1><p>"),
        F.replace(escaped, F.lit("\n"), F.lit("</p>\n<p>")),
        F.lit("</p></article></body></html>"),
    )
    turns = table(spark, sf_dir, "conversations")
    page_id = F.xxhash64("conv_id", "turn")
    return turns.select(page_id.alias("page_id"), _url().alias("url"), html.alias("html"))


def turn_edges(spark, sf_dir) -> DataFrame:
    """Links between the turn pages with no extraction: ``url`` and ``next_href``."""
    turns = table(spark, sf_dir, "conversations")
    return turns.select(_url().alias("url"), (F.col("turn") + 1).cast("string").alias("next_href"))


def turn_starts(spark, sf_dir) -> DataFrame:
    first = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min("turn").alias("turn"))
    return first.select(_url().alias("start_url"))


def turn_chapters(spark, sf_dir) -> DataFrame:
    return chapters_of(table(spark, sf_dir, "conversations"))


def chapters_of(turns: DataFrame) -> DataFrame:
    """Turns as chapters of one book per conversation; the role serves as code, so slugs repeat."""
    lines = F.filter(F.transform(F.split("text", "\n"), trim_ws), lambda line: line != "")
    html = F.array_join(
        F.transform(lines, lambda line: F.concat(F.lit("<p>"), escape_html(line), F.lit("</p>"))), "\n"
    )
    return turns.select(
        F.concat(F.lit("c"), F.col("conv_id")).alias("book_id"),
        (F.col("turn") * 3).alias("seq"),
        _url().alias("url"),
        _title().alias("title"),
        F.col("role").alias("code"),
        html.alias("html"),
    )
